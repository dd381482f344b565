"""Fill-in-the-middle: texts cut into prefix, middle and suffix at token boundaries, by a parallel automaton scan.

Tokens are runs of A-Z and a-z and every other single character. One automaton over UTF-8 bytes starts tokens and looks for the
markers. A chunk of bytes is run from every state at once: it emits its transition function (the state after it for
each state before it) and the tokens that start in it for each of those states. Functions compose associatively, so chunks are run side by
side, in any order, and the states at their entries follow afterwards; a cut is then found in the one chunk that holds its token.

Texts of at most `giant` bytes are cut into chunks where they stand, with no shuffle. Longer ones are written once, their blocks of `giant` bytes are
dealt over all tasks, one row of functions a block comes together by text (a text of 2 GB has 32,768), and only the two blocks that hold the cuts are read again.
Both ways give the same cuts.

Null and empty texts are plain and empty. A null id hashes as no digits. Repeated rows are cut alike. An empty table gives no rows. Columns other than id and
text are not looked at. Texts must be valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import Scratch, byte_slices

#: Classes of bytes: the later bytes of a character move nothing.
SKIP, LETTER, MARK, OPEN, CLOSE, OTHER = range(6)
#: States: after a sign or in a word, with no marker, with `<` or `<P` just read, or with a whole marker read before.
GAP, WORD, SIGN, SIGN_LETTER, SEEN_GAP, SEEN_WORD = range(6)
STATES, CLASSES, GRAM = 6, 6, 4
#: Bytes of a chunk, a multiple of GRAM; bytes of a block of a giant text, a multiple of CHUNK.
CHUNK, GIANT = 512, 1 << 16
#: Texts whose chunks are run side by side at a time.
TEXTS = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[128:192] = SKIP
    for first, last in ((b"A", b"Z"), (b"a", b"z")):
        table[first[0] : last[0] + 1] = LETTER
    table[list(b"PSM")] = MARK
    table[ord("<")], table[ord(">")] = OPEN, CLOSE
    return table


def step(state: int, kind: int) -> tuple[int, int]:
    """The state after a byte of a class, and 1 if a token starts with it."""
    if kind == SKIP:
        return state, 0
    letter = kind in (LETTER, MARK)
    starts = int(not (letter and state in (WORD, SIGN_LETTER, SEEN_WORD)))
    if state in (SEEN_GAP, SEEN_WORD):
        return SEEN_WORD if letter else SEEN_GAP, starts
    if kind == MARK and state == SIGN:
        return SIGN_LETTER, starts
    if letter:
        return WORD, starts
    if kind == OPEN:
        return SIGN, starts
    return SEEN_GAP if kind == CLOSE and state == SIGN_LETTER else GAP, starts


CLASS_OF = _classes()
_STEP = np.array([[step(s, c) for s in range(STATES)] for c in range(CLASSES)])
#: By (class, state): the next state and whether a token starts; and the same for GRAM classes in a row, read as one number.
NEXT1, STARTS1 = _STEP[..., 0], _STEP[..., 1]
NEXT, STARTS = NEXT1, STARTS1
for _ in range(GRAM - 1):
    NEXT, STARTS = NEXT1[:, NEXT].swapaxes(0, 1), STARTS[:, None] + STARTS1[:, NEXT].swapaxes(0, 1)
    NEXT, STARTS = NEXT.reshape(-1, STATES), STARTS.reshape(-1, STATES)
NEXT, STARTS = NEXT.ravel(), STARTS.ravel().astype(np.int32)


class Chunks:
    """Texts data[offsets[k]:offsets[k + 1]] in chunks of CHUNK bytes, each with its transition function and counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        self.size, self.per_text = size, -(-size // CHUNK)
        self.first = np.concatenate([[0], np.cumsum(self.per_text)])
        text = np.repeat(np.arange(len(size)), self.per_text)
        start = offsets[:-1][text] + (np.arange(len(text)) - self.first[text]) * CHUNK
        at = start[:, None] + np.arange(CHUNK)
        inside = at < offsets[1:][text][:, None]
        self.kinds = np.where(inside, CLASS_OF[data[np.minimum(at, max(len(data) - 1, 0))]], SKIP) if len(text) else np.zeros((0, CHUNK), np.uint8)
        self.chars = (self.kinds != SKIP).sum(1)
        grams = self.kinds.reshape(len(text), CHUNK // GRAM, GRAM).astype(np.int32)
        code = grams[..., 0]
        for k in range(1, GRAM):
            code = code * CLASSES + grams[..., k]
        self.after = np.tile(np.arange(STATES), (len(text), 1))
        self.starts = np.zeros((len(text), STATES), np.int32)
        for column in np.ascontiguousarray(code.T) * STATES:
            at = column[:, None] + self.after
            self.starts += STARTS[at]
            self.after = NEXT[at]

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(after, starts, chars) of each text: the composition of its chunks' functions, from each state."""
        n = len(self.size)
        after, starts, chars = np.tile(np.arange(STATES), (n, 1)), np.zeros((n, STATES), np.int64), np.zeros(n, np.int64)
        for live, c in self._rounds():
            starts[live] += np.take_along_axis(self.starts[c], after[live], 1)
            after[live] = np.take_along_axis(self.after[c], after[live], 1)
            chars[live] += self.chars[c]
        return after, starts, chars

    def _rounds(self):
        """The k-th chunks of all texts that have one, for each k."""
        live = np.arange(len(self.size))
        for k in range(int(self.per_text.max(initial=0))):
            live = live[self.per_text[live] > k]
            yield live, self.first[live] + k

    def enter(self) -> None:
        """Entry states of all chunks, with the tokens and characters of the text before each; state, tokens and characters of whole texts."""
        n, chunks = len(self.size), len(self.chars)
        self.state, self.tokens, self.length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.entry, self.before, self.chars_before = (np.zeros(chunks, np.int64) for _ in range(3))
        for live, c in self._rounds():
            self.entry[c], self.before[c], self.chars_before[c] = self.state[live], self.tokens[live], self.length[live]
            self.tokens[live] += self.starts[c, self.state[live]]
            self.length[live] += self.chars[c]
            self.state[live] = self.after[c, self.state[live]]

    def find(self, text: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, character) in each text at which its token of that rank starts; the text's end for ranks past the last."""
        byte, char = self.size[text].copy(), self.length[text].copy()
        ask = np.flatnonzero(rank < self.tokens[text])
        base = np.concatenate([[0], np.cumsum(self.tokens)])
        owner = np.repeat(np.arange(len(self.size)), self.per_text)
        chunk = np.searchsorted(base[owner] + self.before, base[text[ask]] + rank[ask], side="right") - 1
        state, left = self.entry[chunk], rank[ask] - self.before[chunk] + 1
        place = np.zeros(len(ask), np.int64)
        for k, kinds in enumerate(self.kinds[chunk].T):
            left = left - STARTS1[kinds, state] * (left > 0)
            state = NEXT1[kinds, state]
            place += left > 0
            if k % 32 == 31 and not (left > 0).any():
                break
        byte[ask] = (chunk - self.first[text[ask]]) * CHUNK + place
        char[ask] = self.chars_before[chunk] + ((self.kinds[chunk] != SKIP) & (np.arange(CHUNK) < place[:, None])).sum(1)
        return byte, char


def _slices(column):
    """byte_slices of at most TEXTS texts: a chunk's row is CHUNK bytes wide however short its text is."""
    for first, end, data, offsets in byte_slices(column):
        for at in range(0, end - first, TEXTS):
            some = offsets[at : at + TEXTS + 1]
            yield first + at, first + at + len(some) - 1, data[some[0] : some[-1]], some - some[0]


CUTS = "struct<n:bigint,marked:boolean,byte1:bigint,byte2:bigint,char1:bigint,char2:bigint>"


def _cuts_column(text: Column, h1: Column, h2: Column) -> Column:
    """Tokens, markers and both cuts of texts that fit a task."""

    def run(texts, h1, h2):
        import pyarrow as pa

        parts = []
        h1, h2 = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        for first, end, data, offsets in _slices(texts):
            chunks = Chunks(data, offsets)
            chunks.enter()
            every, n = np.arange(end - first), chunks.tokens
            a, b = h1[first:end] % (n + 1), h2[first:end] % (n + 1)
            byte1, char1 = chunks.find(every, np.minimum(a, b))
            byte2, char2 = chunks.find(every, np.maximum(a, b))
            parts.append([n, chunks.state >= SEEN_GAP, byte1, byte2, char1, char2])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (int, bool, int, int, int, int)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n", "marked", "byte1", "byte2", "char1", "char2"])

    return F.arrow_udf(run, CUTS)(text.cast("binary"), h1, h2)


def _blocks(batches):
    """(row, block, h1, h2, body) to (row, block, h1, h2, after, starts, chars)."""
    import pyarrow as pa

    for b in batches:
        for first, end, data, offsets in _slices(b.column(4)):
            after, starts, chars = Chunks(data, offsets).totals()
            lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (after, starts)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, end - first) for k in range(4)), *lists, pa.array(chars)], names=["row", "block", "h1", "h2", "after", "starts", "chars"])


def _compose(table):
    """All blocks of one text, in order: totals, and for each cut its block, the state at that block's entry, the token's rank in it and the characters before it."""
    import pyarrow as pa

    table = table.sort_by("block")
    after, starts = (np.array(table[c].to_pylist()) for c in ("after", "starts"))
    chars = table["chars"].to_numpy()
    state, entry, before = 0, [], [0]
    for k in range(len(chars)):
        entry.append(state)
        before.append(before[-1] + int(starts[k, state]))
        state = int(after[k, state])
    n, length = before[-1], np.concatenate([[0], np.cumsum(chars)])
    out = {"row": table["row"][0].as_py(), "n": n, "marked": state >= SEEN_GAP}
    ranks = sorted(table[h][0].as_py() % (n + 1) for h in ("h1", "h2"))
    for j, rank in enumerate(ranks, 1):
        k = len(chars) - 1 if rank == n else int(np.searchsorted(before, rank, side="right")) - 1
        out |= {f"block{j}": k, f"state{j}": entry[k], f"rank{j}": rank - before[k], f"chars{j}": int(length[k])}
    return pa.Table.from_pylist([out])


_COMPOSED = "row bigint, n bigint, marked boolean, " + ", ".join(f"block{j} bigint, state{j} bigint, rank{j} bigint, chars{j} bigint" for j in (1, 2))


def _find_column(body: Column, state: Column, rank: Column) -> Column:
    """Where in a block, entered in a state, the token of a rank starts; the block's end past its last."""

    def run(bodies, states, ranks):
        import pyarrow as pa

        parts = []
        states, ranks = states.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        for first, end, data, offsets in _slices(bodies):
            chunks = Chunks(data, offsets)
            # a block's first chunk is entered in the block's state: move the start state there
            for k in range(end - first):
                if chunks.per_text[k]:
                    c, s = chunks.first[k], states[first + k]
                    chunks.after[c, 0], chunks.starts[c, 0] = chunks.after[c, s], chunks.starts[c, s]
            chunks.enter()
            lead = chunks.first[:-1][chunks.per_text > 0]
            chunks.entry[lead] = states[first:end][chunks.per_text > 0]
            parts.append(chunks.find(np.arange(end - first), ranks[first:end]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, int)] * 2
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["byte", "char"])

    return F.arrow_udf(run, "struct<byte:bigint,char:bigint>")(body, state, rank)


def _cut_giants(giants: DataFrame, giant: int) -> DataFrame:
    """(id, text, h3, h4, cuts) of giant texts (row, id, text, h1 to h4): rows are told apart by row, which must be stable."""
    raw = F.col("text").cast("binary")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("text") - 1) / giant).cast("long"))).alias("block")
    blocks = giants.select("row", block, "h1", "h2", "text").select("row", "block", "h1", "h2", F.substring(raw, F.col("block").cast("int") * giant + 1, F.lit(giant)).alias("body"))
    summaries = blocks.repartition("row", "block").mapInArrow(_blocks, "row bigint, block bigint, h1 bigint, h2 bigint, after array<bigint>, starts array<bigint>, chars bigint")
    composed = summaries.groupBy("row").applyInArrow(_compose, _COMPOSED)
    found = giants.join(composed, "row")
    for j in (1, 2):
        body = F.substring(raw, F.col(f"block{j}").cast("int") * giant + 1, F.lit(giant))
        found = found.withColumn(f"cut{j}", _find_column(body, F.col(f"state{j}"), F.col(f"rank{j}")))
    cuts = F.struct(
        "n", "marked", *((F.col(f"block{j}") * giant + F.col(f"cut{j}.byte")).alias(f"byte{j}") for j in (1, 2)), *((F.col(f"chars{j}") + F.col(f"cut{j}.char")).alias(f"char{j}") for j in (1, 2))
    )
    return found.select("id", "text", "h3", "h4", cuts.alias("cuts"))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", giant: int = GIANT, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of each row. giant: a multiple of CHUNK."""
    if giant % CHUNK:
        raise ValueError(f"giant must be a multiple of {CHUNK}")
    scratch = scratch or Scratch(df.sparkSession)
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("id", "text", *(F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(1, 5)))
    long = F.octet_length("text") > giant
    giants = scratch.save(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "giants")
    here = rows.where(~long).select("id", "text", "h3", "h4", _cuts_column(F.col("text"), F.col("h1"), F.col("h2")).alias("cuts"))
    cut = here.unionByName(_cut_giants(giants, giant))
    plain = (F.col("text") == "") | F.col("cuts.marked") | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    cut = cut.select("id", "text", "cuts", form.alias("form"))
    raw, byte1, byte2 = F.col("text").cast("binary"), F.col("cuts.byte1").cast("int"), F.col("cuts.byte2").cast("int")
    part = lambda name, body: (F.lit(name).cast("binary"), body)
    prefix = part(PREFIX, F.substring(raw, F.lit(1), byte1))
    middle = part(MIDDLE, F.substring(raw, byte1 + 1, byte2 - byte1))
    suffix = part(SUFFIX, F.substring(raw, byte2 + 1, F.octet_length("text") - byte2))
    output = F.when(F.col("form") == "plain", raw).when(F.col("form") == "psm", F.concat(*prefix, *suffix, *middle)).otherwise(F.concat(*suffix, *prefix, *middle))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select(
        F.col("id").alias(id_col), F.col("cuts.n").alias("n"), "form", cut_only(F.col("cuts.char1")).alias("prefix_chars"),
        cut_only(F.col("cuts.char2") - F.col("cuts.char1")).alias("middle_chars"), output.cast("string").alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text of an output: a text with markers of its own is plain, so the first three markers are ours."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = lambda *at: F.concat(*(F.get(parts, F.lit(k)) for k in at))
    return F.when(form == "plain", output).when(form == "psm", order(1, 3, 2)).otherwise(order(2, 3, 1))
