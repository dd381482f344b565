"""Language identification by cross-parsing entropy.

Labelled text of each language makes a suffix automaton. A text is cut greedily into phrases, each the longest match from
where the last one ended; the phrases, times the bits that name a place in the training text, over the text's length estimate its
cross entropy with the language. The language with the least wins; ties go to the bytewise smaller name.

A phrase starts at the automaton's root, so all that a text's walk needs is a table (state, symbol) -> state: many pieces of text walk side by side.
Texts are put into small letters; runs of ASCII characters that are no letters count as one gap. A phrase also ends with
each piece of PIECE symbols, so a long text is walked in parallel and whole.

Training text is a bounded sample: of each language the SAMPLE rows with the smallest hashes of (text, language), distinct texts only, and of each at most
ROW_BYTES from its start; with many languages fewer, so that all have at most TOTAL_ROWS rows (1 MB). Automata have three edges a byte at most and are
broadcast as edges; a worker's tables have a row a state, two a byte, of the symbols that the language's sample contains. Everything else covers all rows.

Null texts and texts without a letter are `und` with score 0, and so is all if no language was learnt. Rows with null lang, null id or a held-out id teach nothing. Repeated rows
are scored alike. An empty table gives no rows. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.shared import byte_slices

SAMPLE, ROW_BYTES, TOTAL_ROWS = 64, 1024, 1024
PIECE = 2048
#: Shards of a language while its smallest hashes are looked for.
SHARDS = 64
UNDETERMINED = "und"


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ASCII letters small and each run of other ASCII characters as one 0; the bytes of other characters stay."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    gap = (data < 128) & ~((data >= 97) & (data <= 122))
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    keep[first] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    return np.where(gap, 0, data)[keep].astype(np.uint8), counts[offsets]


def automaton(text: bytes) -> np.ndarray:
    """Edges (state, symbol, state) of the suffix automaton of a text; state 0 is the root. Every substring, and nothing else, is a path from it."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at >= 0:
            to = edges[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                split = len(edges)
                edges.append(dict(edges[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and edges[at].get(c) == to:
                    edges[at][c] = split
                    at = link[at]
                link[to] = link[new] = split
        last = new
    return np.array([(s, c, t) for s, out in enumerate(edges) for c, t in out.items()], np.int32).reshape(-1, 3)


class Parser:
    """The table of one language's automaton and the bits that name a place in its text."""

    def __init__(self, edges: np.ndarray, size: int):
        used = np.unique(edges[:, 1])
        self.column = np.zeros(256, np.intp)  # symbols that the text lacks share a column without edges
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        states = int(edges[:, [0, 2]].max(initial=0)) + 1
        table = np.zeros((states, self.width), np.int32)
        table[edges[:, 0], self.column[edges[:, 1]]] = edges[:, 2] * self.width
        self.table, self.bits = table.ravel(), np.log2(size + 2)

    def phrases(self, body: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many phrases each piece body[start:start + size] is cut into; longest pieces first."""
        n = len(sizes)
        state, count = np.zeros(n, np.intp), np.zeros(n, np.int64)
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # pieces with a k-th symbol
        for k, live_k in enumerate(live):
            at = self.column[body[start[:live_k] + k]]
            to = self.table[state[:live_k] + at]
            stuck = np.flatnonzero(to == 0)
            ended = stuck[state[stuck] > 0]
            count[ended] += 1  # the phrase ends before this symbol, which opens the next
            to[stuck] = self.table[at[stuck]]
            count[stuck[to[stuck] == 0]] += 1  # a symbol that the language lacks is a phrase of its own
            state[:live_k] = to
        return count + (state > 0)


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, text) of the pieces of texts, longest first."""
    size = np.diff(offsets)
    per_text = -(-size // PIECE)
    text = np.repeat(np.arange(len(size)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    sizes = np.minimum(PIECE, size[text] - nth * PIECE)
    order = np.argsort(-sizes, kind="stable")
    return (offsets[:-1][text] + nth * PIECE)[order], sizes[order], text[order]


def entropies(parsers: list[Parser], body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits a symbol of each text (rows) under each language (columns)."""
    start, sizes, text = cut(offsets)
    size = np.maximum(np.diff(offsets), 1)
    return np.stack([np.bincount(text, p.phrases(body, start, sizes), minlength=len(size)) * p.bits / size for p in parsers], axis=1)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(train: DataFrame, sample: int = SAMPLE, row_bytes: int = ROW_BYTES, total_rows: int = TOTAL_ROWS) -> dict[str, tuple[np.ndarray, int]]:
    """train (lang, text) to the automata of its languages: at most total_rows rows of row_bytes come to the driver (or a row a language, if there are more)."""
    train = train.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text", "lang"))
    languages = train.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(sample, total_rows // max(languages, 1)))
    keys = train.select("lang", "h").distinct()  # a text that stands often counts once
    nth = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy("h"))
    few = keys.withColumn("shard", F.pmod("h", F.lit(SHARDS))).withColumn("nth", nth("shard")).where(F.col("nth") <= each)
    chosen = few.withColumn("nth", nth()).where(F.col("nth") <= each).select("lang", "h")
    rows = train.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring(F.lower("text").cast("binary"), F.lit(1), F.lit(row_bytes))).alias("body"))
    texts: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"].encode(), r["h"])):
        texts.setdefault(r["lang"], []).append(bytes(r["body"]))
    out = {}
    for lang, bodies in texts.items():
        data = np.frombuffer(b" ".join(bodies), np.uint8)
        body, _ = symbols(data, np.array([0, len(data)]))
        out[lang] = (automaton(body.tobytes()), len(body))
    return out


def identify(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of each row of df; train (lang, text). The score is 1 less the ratio of the best and the second best entropy (1 with one language)."""
    spark = df.sparkSession
    model = learn(train, **bounds)
    names = list(model)
    shared = spark.sparkContext.broadcast([model[k] for k in names])

    def run(batches):
        import pyarrow as pa

        parsers = [Parser(*m) for m in shared.value]
        for b in batches:
            for first, end, data, offsets in byte_slices(b.column(1)):
                n = end - first
                best, score = np.full(n, -1), np.zeros(n)
                if parsers:
                    bits = entropies(parsers, *symbols(data, offsets))
                    best = bits.argmin(1)
                    ordered = np.sort(bits, axis=1)
                    score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-12) if len(parsers) > 1 else np.ones(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.clip(score, 0, 1)), pa.array(best.astype(np.int32))], names=["row", "score", "best"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    lettered = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)).alias("lettered")
    scored = df.select(F.struct(F.col(id_col).alias("id"), lettered).alias("row"), F.lower(text).cast("binary").alias("body")).mapInArrow(run, f"row struct<id:{kind},lettered:boolean>, score double, best int")
    known = F.col("row.lettered") & (F.col("best") >= 0)
    pred = F.get(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("best"))
    return scored.select(
        F.col("row.id").alias(id_col), held_out(F.col("row.id")).alias("held_out"), F.when(known, pred).otherwise(UNDETERMINED).alias("lang_pred"), F.when(known, F.col("score")).otherwise(F.lit(0.0)).alias("score")
    )
