"""Jaccard join of word 5-gram sets by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct shingles; sets of equal size and equal 128-bit fingerprint (of hashes
of their own) are one class, so copies never meet. The global n-gram order takes the shingles of the lowest hashes (a fixed share of
the hash range) by how many documents hold them, rarest first, then the rest by hash. It is cut into fragments:
the first holds all that are ordered by frequency, the others equal ranges of the rest. Each text is shingled once
and its set written in these fragments.

Two classes that link share a shingle among their first n - ceil(t n) + 1 in that order, at places that leave enough
behind (prefix, length and positional filters). The overlap of a candidate pair is counted in each fragment by itself and
summed per pair; pairs whose first fragments share too little for any rest to make up end there.

Candidates come from posting lists in rounds: the members of a list nearest to the list's common stock (fewest
shingles of their own) are its pivots, one at first, then eight times as many in each round, and meet
all others that are not in their component yet. A list is done when its members are one component or all
have been pivots, so no link between components is lost, and a group of thousands of near copies
costs a star, not all its pairs. Only a list whose members do not link with each other ends in all its pairs that pass the filters.

Few documents stay in lists that are not done after REFINE_AFTER rounds: those that share common passages. Among
them all shingles are ordered anew, by how many of these documents hold them, and the rounds begin again on the
shorter prefixes of that order.

Common shingles, large classes, pivots with many partners and hubs are dealt over several tasks (join_hot). Bitmaps of bounded
size go to the executors: of shingles that two documents hold, of classes' representatives and of candidates. They only
spare rows the shuffle; what they let through in error is joined away.

Texts without words are in no group: their component is themselves. Rows are told apart by a number of their own, so null and
repeated ids are fine: a component's id is the smallest of its rows' ids that is not null, or null. A text is shingled whole
in memory, with some 20 bytes for each of its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.shared import BASE, FEW, Scratch, Strings, byte_slices, hot_limit, join_hot, mix, row_keys

WORDS, PERCENT = 5, 80
#: Share of the hash range whose shingles are ordered by frequency: somewhat over the share of a prefix.
ORDERED = 0.28
FRAGMENTS = 4
#: log2 of the most bits of a bitmap; up to that it has 8 bits a value, or more where what it lets through in error is shuffled.
MOST_BITS = 27
#: Bytes of texts that a worker shingles at a time: its arrays are some 40 times that.
SLICE = 1 << 18
GROWTH, REFINED_GROWTH = 8, 64
REFINE_AFTER = 2
BROADCAST_KEYS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, counts): each text's distinct shingles by ascending hash, one text after the other, and how many each has."""
    n = len(offsets) - 1
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    first = np.flatnonzero(~gap & before)
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    last = np.flatnonzero(~gap & after) + 1
    strings = Strings(_LOWER[data])
    doc = np.searchsorted(offsets, first, side="right") - 1
    words = np.bincount(doc, minlength=n)
    starts = np.cumsum(words) - words
    inside = np.arange(max(0, len(first) - width + 1))
    inside = inside[doc[inside] == doc[inside + width - 1]] if len(inside) else inside
    owner = np.concatenate([doc[inside], *(np.flatnonzero(words == k) for k in range(1, width))])

    def hashes(lane: int) -> np.ndarray:
        code = strings.of(first, last, lane)

        def chain(at: np.ndarray, length: int) -> np.ndarray:
            h = np.full(len(at), length + lane * width, np.uint64) * BASE
            for k in range(length):
                h = mix(h + code[at + k])
            return h

        return np.concatenate([chain(inside, width), *(chain(starts[np.flatnonzero(words == k)], k) for k in range(1, width))])

    h = hashes(0)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], hashes(1)[order[new]], np.bincount(owner[new], minlength=n)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the texts data[offsets[k]:offsets[k + 1]]."""
    h, _, counts = _shingles(data, offsets, width)
    return h, counts


def prefix_length(n, percent: int = PERCENT):
    """Shingles at the front of the order of which a set of n must share one with any that it links to."""
    return n - (percent * n + 99) // 100 + 1


def prefix_length_column(n, percent: int = PERCENT):
    return n - F.floor((percent * n + 99) / 100) + 1


def needed_column(n, m, percent: int = PERCENT):
    """What two sets of these sizes must share."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _sets(texts: DataFrame, fragments: int) -> DataFrame:
    """Rows (row, doc, k1, k2, fragment, n, before, low, fp1, fp2, tokens) of texts (row, doc, k1, k2, text): each set in fragments of the order, the first one always.

    before: shingles in earlier fragments; low: in the first; fp1 and fp2: the set's order-free fingerprint.
    """
    ordered = int(ORDERED * 2**64)
    cuts = np.array([ordered + k * ((1 << 64) - ordered) // (fragments - 1) for k in range(fragments - 1)], np.uint64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, end, data, offsets in byte_slices(b.column(4), SLICE):
                h, g, counts = _shingles(data, offsets)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
                np.cumsum(g, out=sums[1, 1:])
                ends = np.cumsum(counts)
                fp = (sums[:, ends] - sums[:, ends - counts]).view(np.int64)
                owner = np.repeat(np.arange(end - first), counts)
                cell = owner * fragments + np.searchsorted(cuts, h, side="right")
                sizes = np.bincount(cell, minlength=(end - first) * fragments)
                bounds = np.append(0, np.cumsum(sizes)) * 8
                tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(h)])
                of, part = np.divmod(np.arange(len(sizes)), fragments)
                before = (bounds[:-1] // 8) - (ends - counts)[of]
                low = sizes.reshape(-1, fragments)[of, 0]
                keep = pa.array((sizes > 0) | (part == 0))
                at = pa.array(of + first)
                row = pa.array(mix(b.column(0).to_numpy().astype(np.uint64)).view(np.int64)[of + first])
                ints = (pa.array(x.astype(np.int32)) for x in (part, counts[of], before, low))
                columns = [row, *(b.column(c).take(at) for c in (1, 2, 3)), *ints, pa.array(fp[0][of]), pa.array(fp[1][of]), tokens.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "k1", "k2", "fragment", "n", "before", "low", "fp1", "fp2", "tokens"]).filter(keep)

    return texts.mapInArrow(run, "row long, doc long, k1 long, k2 long, fragment int, n int, before int, low int, fp1 long, fp2 long, tokens binary")


class Bitmap:
    """Sent to the executors: whether a hash may be among some values; never false for those that are."""

    def __init__(self, values: DataFrame, column: str, count: int, bits: int = 8):
        self.log2 = int(min(MOST_BITS, max(16, math.ceil(math.log2(bits * count + 1)))))
        self.sent = values.sparkSession.sparkContext.broadcast(bitmap(values, column, self.log2))

    def test(self):
        """A function of an array of values, to be called on an executor."""
        bits, mask = np.frombuffer(self.sent.value, np.uint8), (1 << self.log2) - 1
        return lambda x: (bits[(x & mask) >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1

    def destroy(self) -> None:
        self.sent.destroy()

    def __getstate__(self):
        return self.log2, self.sent

    def __setstate__(self, state):
        self.log2, self.sent = state


def _prefix_tokens(sets: DataFrame, percent: int, reps: Bitmap, held: Bitmap | None = None) -> DataFrame:
    """Shingles that may stand in prefixes: (token), or, pruned by held, (token, row, n, low, place).

    low: how many of the document's shingles are ordered by frequency; place: -1 for those, else the place in the order.
    """

    def run(batches):
        import pyarrow as pa

        rep, shared = reps.test(), held and held.test()
        for batch in batches:
            batch = batch.filter(pa.array(rep(batch.column(0).to_numpy())))
            for first, end in _by_size([batch.column(5)]):
                b = batch.slice(first, end - first)
                tokens = [np.frombuffer(t, np.int64) for t in b.column(5).to_pylist()]
                owner = np.repeat(np.arange(b.num_rows), [len(t) for t in tokens])
                token = np.concatenate(tokens)
                fragment, n, before = (b.column(k).to_numpy() for k in (1, 2, 3))
                sizes = np.bincount(owner, minlength=b.num_rows)
                place = before[owner] + np.arange(len(token)) - (np.cumsum(sizes) - sizes)[owner]
                keep = (fragment[owner] == 0) | (place < prefix_length(n, percent)[owner])
                if shared:
                    keep &= shared(token)
                place = np.where(fragment[owner] == 0, -1, place)[keep].astype(np.int32)
                at = pa.array(owner[keep])
                if shared:
                    yield pa.RecordBatch.from_arrays([pa.array(token[keep]), b.column(0).take(at), b.column(2).take(at), b.column(4).take(at), pa.array(place)], names=["token", "row", "n", "low", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(token[keep])], names=["token"])

    able = sets.where((F.col("fragment") == 0) | (F.col("before") < prefix_length_column(F.col("n"), percent)))
    return able.select("row", "fragment", "n", "before", "low", "tokens").mapInArrow(run, "token long, row long, n int, low int, place int" if held else "token long")


def bitmap(df: DataFrame, column: str, log2: int) -> bytes:
    """2 ** log2 bits; bit x & (2 ** log2 - 1) is set for each value x. 64 parts or more, of at most 4 KB, are made apart: nothing else reaches the driver."""
    part = min(15, log2 - 6)

    def run(batches):
        import pyarrow as pa

        parts: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column(0).to_numpy()
            for p in np.unique(slot >> part):
                bits = parts.setdefault(int(p), np.zeros(1 << part, bool))
                bits[slot[slot >> part == p] & ((1 << part) - 1)] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()])], names=["part", "bits"])

    slots = df.select(F.col(column).bitwiseAND((1 << log2) - 1).alias("slot"))
    dealt = slots.repartition(F.shiftright("slot", part).cast("int"))
    out = bytearray(1 << (log2 - 3))
    size = 1 << (part - 3)
    for r in dealt.mapInArrow(run, "part int, bits binary").collect():  # 2 ** log2 bits in all
        out[r["part"] * size : (r["part"] + 1) * size] = r["bits"]
    return bytes(out)


def _by_size(columns, limit: int = 1 << 20):
    """(first, end) of runs of rows whose bytes in the columns are about limit together: what a worker holds at a time."""
    import pyarrow.compute as pc

    sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield first, end
        first = end


def _candidates(sets: DataFrame, wanted: Bitmap) -> DataFrame:
    """(row, fragment, low, tokens) of the rows that the bitmap has."""

    def run(batches):
        import pyarrow as pa

        test = wanted.test()
        for b in batches:
            yield b.filter(pa.array(test(b.column(0).to_numpy())))

    return sets.select("row", "fragment", "low", "tokens").mapInArrow(run, "row long, fragment int, low int, tokens binary")


def _overlaps(joined: DataFrame) -> DataFrame:
    """(d, p, n, pn, rest, overlap) of rows (d, p, n, pn, rest, left, right): how many tokens both segments hold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, end in _by_size([batch.column(5), batch.column(6)]):
                b = batch.slice(first, end - first)
                codes, rows = [], []
                for side in (5, 6):
                    texts = b.column(side).to_pylist()
                    codes.append(np.frombuffer(b"".join(texts), np.uint64))
                    rows.append(np.repeat(np.arange(len(texts)), [len(t) // 8 for t in texts]))
                code, row = np.concatenate(codes), np.concatenate(rows)
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                both = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.bincount(row[1:][both], minlength=b.num_rows).astype(np.int64))], names=["d", "p", "n", "pn", "rest", "overlap"])

    return joined.select("d", "p", "n", "pn", "rest", "left", "right").mapInArrow(run, "d long, p long, n int, pn int, rest int, overlap long")


def verify(scratch: Scratch, pairs: DataFrame, segments: DataFrame, name: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (d, p, n, pn) that link, as (d, p), saved by that name. p, the pivot, may have any number of partners.

    The first fragment's overlap and what the others could add at most decide which pairs go on to those. Of the segments only
    those that pairs name are shuffled, and the few others that a bitmap lets through. They are shuffled for few pairs too: after
    broadcast joins the bitmap's test and the overlaps would share a stage, with two Python workers for each task of an executor.
    """
    weights = pairs.groupBy("p").agg(F.count("*").alias("w"))
    total, most = weights.agg(F.sum("w"), F.max("w")).first()
    if not total:
        return pairs.select("d", "p")
    limit = hot_limit(total)
    sent = []

    def both(some: DataFrame, count: int, part) -> DataFrame:
        of_d, of_p = (Bitmap(some, c, count, 16) for c in "dp")
        sent.extend((of_d, of_p))
        left = _candidates(segments.where(part), of_d).select(F.col("row").alias("d"), "fragment", "low", F.col("tokens").alias("left"))
        right = _candidates(segments.where(part), of_p).select(F.col("row").alias("p"), "fragment", F.col("low").alias("plow"), F.col("tokens").alias("right"))
        right = right.join(weights, "p") if most > limit else right.withColumn("w", F.lit(0))
        return join_hot(some.hint("merge").join(left, "d"), right.hint("merge"), ["p", "fragment"], "w", limit, ["d"], most=most)

    first = both(pairs, total, F.col("fragment") == 0).withColumn("rest", F.least(F.col("n") - F.col("low"), F.col("pn") - F.col("plow")))
    needed = needed_column(F.col("n"), F.col("pn"), percent)
    able = scratch.save(_overlaps(first).where(F.col("overlap") + F.col("rest") >= needed), f"{name}_able")
    others = _overlaps(both(able.drop("overlap"), able.count(), F.col("fragment") > 0)).groupBy("d", "p").agg(F.sum("overlap").alias("more"))
    total = able.join(others, ["d", "p"], "left").withColumn("overlap", F.col("overlap") + F.coalesce("more", F.lit(0)))
    linked = total.where(100 * F.col("overlap") >= percent * (F.col("n") + F.col("pn") - F.col("overlap")))
    linked = scratch.save(linked.select("d", "p"), name)
    for each in sent:
        each.destroy()
    return linked


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row of df."""
    found = _groups(df, id_col, text_col, percent, scratch or Scratch(df.sparkSession))
    return found.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """The rows of df without those that a component has besides its first: the smallest id, null ones last, and of equal rows any one. Texts without words stay.

    Up to BROADCAST_KEYS rows that go are broadcast, so texts stay where they are; more are joined by a shuffle.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = scratch.save(_groups(df, id_col, text_col, percent, scratch).where("n > 0").select("doc", "k1", "k2", "component"), "groups")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "k1", "k2")).alias("first"), F.count("*").alias("weight")).where("weight > 1")
    several = join_hot(rows, first, ["component"], "weight", hot_limit(rows.count()), ["k1", "k2"])
    same = (F.col("k1") == F.col("first")["k1"]) & (F.col("k2") == F.col("first")["k2"])
    gone = several.groupBy(F.col("k1").alias("g1"), F.col("k2").alias("g2")).agg(F.bool_or(same).alias("first"), F.count("*").alias("times"))
    gone = scratch.save(gone.where("not first or times > 1"), "gone")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    keyed = df.select(row, F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumns(row_keys(F.col("_id"), F.col("_text")))
    joined = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
    alone = joined.where("times is null").select("row")
    equal = joined.where("first and times > 1").withColumn("nth", F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.lit(1)))).where("nth = 1").select("row")
    return alone.union(equal).select("row.*")


def _groups(df: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> DataFrame:
    """(doc, k1, k2, n, component, component_id) of each row of df; component is a number of its own, or null without words."""
    spark = df.sparkSession
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = texts.withColumns(row_keys(F.col("doc"), F.col("text"))).select("row", "doc", "k1", "k2", "text")
    sets = scratch.save(_sets(texts, FRAGMENTS), "sets")
    docs = sets.where("fragment = 0").select("row", "doc", "k1", "k2", "n", "fp1", "fp2")
    classes = docs.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("row").alias("rep"), F.min("doc").alias("least"), F.count("*").alias("members"))
    classes = scratch.save(classes, "classes")
    n_classes, members, most = classes.agg(F.count("*"), F.sum("members"), F.max("members")).first()
    reps = Bitmap(classes, "rep", n_classes)

    shared = _prefix_tokens(sets, percent, reps).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = scratch.save(shared, "shared")
    scratch.free_shuffles()
    n_shared, total, widest = shared.agg(F.count("*"), F.sum("df"), F.max("df")).first()
    held = Bitmap(shared, "token", n_shared)
    rows = _prefix_tokens(sets, percent, reps, held)
    rows = join_hot(rows, shared.withColumn("weight", F.col("df")), ["token"], "weight", hot_limit(total or 0), ["row"], most=widest or 0)
    # an inner join stays behind the one above, where the window's shuffle serves it too; a semi join would be moved ahead of that, with a shuffle of its own
    rows = rows.join(classes.select(F.col("rep").alias("row")), "row")
    # a document's rare shingles come first in the order; of the others, those ordered by frequency, then the rest by hash
    by_row = W.partitionBy("row")
    rows = rows.withColumn("nth", F.row_number().over(by_row.orderBy(F.col("place") >= 0, "df", "token")))
    known = F.coalesce(F.max(F.when(F.col("place") < 0, F.col("nth"))).over(by_row), F.lit(0))
    rows = rows.withColumn("rare", F.col("low") - known)
    rows = rows.withColumn("place", F.when(F.col("place") < 0, F.col("rare") + F.col("nth") - 1).otherwise(F.col("place")))
    rows = rows.where(F.col("place") < prefix_length_column(F.col("n"), percent)).select("token", "row", "n", "place", (F.col("rare") / F.col("n")).alias("own"), "df")
    postings = scratch.save(rows, "postings")
    scratch.drop("shared")
    scratch.free_shuffles()
    held.destroy()
    reps.destroy()

    lists = scratch.save(_open_lists(postings.withColumn("group", F.col("row")), 0), "members_0")
    scratch.drop("postings")
    candidates = scratch.save(lists.select("row").distinct(), "candidates")
    # the few others that the bitmap lets through are in no pair, so they need no shuffle here to be left out
    wanted = Bitmap(candidates, "row", candidates.count(), 64)
    segments = scratch.save(_candidates(sets, wanted), "segments")
    # of the sets only sizes and fingerprints are read from here on
    docs = scratch.save(docs, "docs")
    scratch.drop("sets")
    scratch.free_shuffles()
    wanted.destroy()

    joined = _join_rounds(scratch, lists, segments, percent)
    of_class = classes.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = scratch.save(of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("weight")), "least")
    at = of_class.select("n", "fp1", "fp2", "members", "component")
    limit = hot_limit(members or 0)
    named = join_hot(at, least, ["component"], "weight", limit, ["fp1"]).select("n", "fp1", "fp2", "members", "component", "component_id")
    named = scratch.save(named, "named")
    some = join_hot(docs.where("n > 0"), named, ["n", "fp1", "fp2"], "members", limit, ["row"], most=most or 0)
    none = docs.where("n = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc")})
    columns = ["doc", "k1", "k2", "n", "component", "component_id"]
    return some.select(*columns).union(none.select(*columns))


def _dealt(df: DataFrame, limit: int) -> DataFrame:
    """df with _salt: rows of a list of more than limit members are dealt over several tasks."""
    return df.withColumn("_salt", F.when(F.col("df") > limit, F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / limit)).cast("int")).otherwise(0))


def _to_all(df: DataFrame, limit: int) -> DataFrame:
    """df with a row for each task that its list is dealt to."""
    return df.withColumn("_salt", F.explode(F.when(F.col("df") > limit, F.sequence(F.lit(0), F.ceil(F.col("df") / limit).cast("int") - 1)).otherwise(F.array(F.lit(0))))).drop("df")


def _open_lists(members: DataFrame, done: int) -> DataFrame:
    """The posting lists (token, row, group, df, ...) that are not done: more members than have been pivots, of more than one group."""
    lists = members.groupBy("token").agg(F.count("*").alias("size"), F.min("group").alias("g0"), F.max("group").alias("g1"), F.max("df").alias("df"))
    limit = hot_limit(0)
    lists = _to_all(lists.where((F.col("size") > done) & (F.col("g0") < F.col("g1"))).select("token", "df"), limit)
    return _dealt(members, limit).join(lists, ["token", "_salt"], "left_semi").drop("_salt")


def _refined(scratch: Scratch, members: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Postings (token, row, n, place, own, group, df) of the members' documents, by an order of all shingles that these documents hold."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, end in _by_size([b.column(1)]):
                tokens = [np.frombuffer(t, np.int64) for t in b.column(1).slice(first, end - first).to_pylist()]
                at = pa.array(np.repeat(np.arange(first, end), [len(t) for t in tokens]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), b.column(0).take(at)], names=["token", "row"])

    docs = scratch.save(members.groupBy("row").agg(F.first("n").alias("n"), F.first("group").alias("group")), "open_docs")
    rows = segments.join(docs.select("row"), "row", "left_semi").select("row", "tokens").mapInArrow(run, "token long, row long")
    shared = scratch.save(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "open_shared")
    total, most = shared.agg(F.sum("df"), F.max("df")).first()
    rows = join_hot(rows, shared.withColumn("weight", F.col("df")), ["token"], "weight", hot_limit(total or 0), ["row"], most=most or 0).join(docs, "row")
    by_row = W.partitionBy("row")
    rows = rows.withColumns({"nth": F.row_number().over(by_row.orderBy("df", "token")), "rare": F.col("n") - F.count("*").over(by_row)})
    rows = rows.withColumn("place", F.col("rare") + F.col("nth") - 1).where(F.col("place") < prefix_length_column(F.col("n"), percent))
    return rows.select("token", "row", "n", "place", (F.col("rare") / F.col("n")).alias("own"), "group", "df")


def _renamed(df: DataFrame, joined: DataFrame, column: str, other: str, few: bool) -> DataFrame:
    """df (column, other) with the values of column that are nodes of joined replaced by their components; a common value is dealt over tasks unless rows are few."""
    to = joined.select(F.col("node").alias(column), F.col("component").alias("to"))
    to = to.withColumn("weight", F.lit(0)) if few else to.join(df.groupBy(column).agg(F.count("*").alias("weight")), column)
    named = join_hot(df, to, [column], "weight", hot_limit(0), [other], "left", most=0 if few else None)
    return named.withColumn(column, F.coalesce("to", column)).select(df.columns)


def _join_rounds(scratch: Scratch, members: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that link. members: the open lists, saved as members_0, each class a group of its own."""
    joined = scratch.spark.createDataFrame([], "node long, component long")
    done, upto, k, limit, n_joined = 0, 1, 0, hot_limit(0), 0
    while members.limit(1).count():
        if k == REFINE_AFTER:
            members = scratch.save(_open_lists(_refined(scratch, members, segments, percent), 0), "members_refined")
            done, upto = 0, 1
        nth = F.row_number().over(W.partitionBy("token").orderBy("own", "row"))
        pivots = members.withColumn("nth", nth).where(F.col("nth") <= upto).where(F.col("nth") > done)
        pivots = pivots.select("token", "df", F.col("row").alias("p"), F.col("n").alias("pn"), F.col("place").alias("pp"), F.col("group").alias("pg"))
        pairs = _dealt(members, limit).drop("df").join(_to_all(pivots, limit), ["token", "_salt"])
        # what is left of both sets from this shingle on must do
        left = F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pp"))
        fits = (F.col("group") != F.col("pg")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & (left >= needed_column(F.col("n"), F.col("pn"), percent))
        pairs = scratch.save(pairs.where(fits).select(F.col("row").alias("d"), "p", "n", "pn").distinct(), f"pairs_{k}")
        links = verify(scratch, pairs, segments, f"links_{k}", percent)
        n_links = links.count()
        if n_links:
            edges, few = links.select(F.col("d").alias("u"), F.col("p").alias("v")), n_links + n_joined <= FEW
            if n_joined:
                for c, other in (("u", "v"), ("v", "u")):
                    edges = _renamed(edges, joined, c, other, few)
            new = components(scratch, edges, f"stars_{k}")
            if n_joined:
                moved = _renamed(joined, new, "component", "node", few)
                new = moved.union(new.join(joined.select(F.col("node").alias("old")), F.col("node") == F.col("old"), "left_anti"))
            joined = scratch.save(new, f"joined_{k}")
            n_joined += n_links  # no fewer than have joined
        regrouped = members.drop("group").join(joined, F.col("row") == F.col("node"), "left").withColumn("group", F.coalesce("component", "row")).drop("node", "component")
        members = scratch.save(_open_lists(regrouped, upto), f"members_{k + 1}")
        scratch.drop(f"members_{k}", f"pairs_{k}", f"links_{k}", f"links_{k}_able")
        scratch.free_shuffles()
        done, upto, k = upto, upto * (GROWTH if k < REFINE_AFTER else REFINED_GROWTH), k + 1
    return joined
