"""Suffix-array dedup by prefix-free parsing.

Removed is every byte of a text that a string of `length` bytes covers which also starts anywhere else.

Parsing: a rolling hash of K bytes triggers where it is the least of `SPREAD` neighbours (leftmost of
equals), so each window of `length` bytes has its trigger by its content alone, wherever it stands. A
text thus falls into phrases: a trigger with all windows that it is the trigger of, from the first window's
start to the last one's end. The dictionary is the set of distinct phrases, the parse the sequence of them.
What all windows of a trigger share, the bytes from it to the end of the earliest window, is its core.

Order: phrases overlap by `length` - 1 bytes, so no window reaches over two of them, and of the parse's suffix array
cut at `length` bytes only the first symbol counts: a phrase that the parse holds twice repeats in all its
windows. A core that stands once repeats in none. What is left are cores that stand in different phrases: of those
the dictionary's suffix array is built (prefix doubling over the phrases' bytes, ranks up to `length` bytes), and
windows of equal rank in different phrases are repeats. That is the corpus order as far as repeats show in it; windows that differ are
ordered only within their bucket of the dictionary.

The dictionary is sorted in buckets of whole cores. A core in more than CORE_PHRASES phrases is no bucket: its windows are
refined by content instead, by what ever fewer neighbouring windows share and cover, as counts of hashes that
are aggregated, never gathered. Joins by core or phrase deal common ones over several tasks.

Texts are parsed once. For the parse hashes and places are shuffled; whole texts move twice, to their wanted phrases and to
their spans. Phrases are known by 128 bits (core and phrase), buckets compare bytes, refined windows have 128 bits.

Null texts are empty; texts under `length` bytes stay whole. Rows are told apart by id and text together, so null ids and one id with
several texts are fine; rows that agree in both are texts of their own and repeat each other. Long texts
are parsed in overlapping pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from skein.llm.shared import BASE, Scratch, Strings, byte_slices, hot_limit, join_hot, mix, row_keys

LENGTH = 200
#: Bytes of the rolling hash and how many neighbours it is the least of. SPREAD is a power of two.
K, SPREAD = 16, 128
#: Neighbouring windows that are refined together, round by round; each divides the one before.
RANGES = (32, 8, 2, 1)
#: Windows that a long text is parsed at a time.
PIECE = 1 << 20
#: Distinct phrases whose suffixes are sorted at a time, and how many of one core may be among them.
BUCKET, CORE_PHRASES = 4096, 1024


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """x[i:i + width].min() for each i; width is a power of two."""
    step = 1
    while step < width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return x


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Phrases of the texts data[offsets[k]:offsets[k + 1]]: (text, trigger, first window, last window, core, phrase hash).

    Places count from the text's start; a phrase's windows are all starts from its first to its last.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    strings = Strings(data)
    rolling = mix(strings.eight[: n - K + 1] * BASE + strings.eight[8 : n - K + 9] * np.uint64(0xC2B2AE3D27D4EB4F))
    # hash in front, place behind: the least is the leftmost of equals
    key = (rolling >> np.uint64(1) & ~np.uint64((1 << 24) - 1)) | np.arange(n - K + 1, dtype=np.uint64)
    least = sliding_least(key.view(np.int64), SPREAD)
    start = np.arange(n - length + 1)
    text = np.searchsorted(offsets, start, side="right") - 1
    start = start[start + length <= offsets[text + 1]]
    if not len(start):
        return empty, empty, empty, empty, empty, empty
    trigger = least[start] & ((1 << 24) - 1)
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1
    first, last, t = start[heads], start[tails], trigger[heads]
    core = strings.of(t, t + length - SPREAD + 1)
    phrase = strings.of(first, last + length, 1)
    # where the trigger stands in the phrase is part of it
    phrase = mix(phrase + (t - first).astype(np.uint64) * BASE + (last - first).astype(np.uint64))
    of = np.searchsorted(offsets, first, side="right") - 1
    base = offsets[of]
    return of, t - base, first - base, last - base, core.view(np.int64), phrase.view(np.int64)


def _pieces(column, length: int):
    """(first row, end row, bytes, offsets, start) with texts over PIECE cut into pieces that overlap by length - 1 bytes."""
    for first, end, data, offsets in byte_slices(column):
        if end - first == 1 and len(data) > 2 * PIECE:
            for start in range(0, len(data) - length + 1, PIECE):
                piece = data[start : start + PIECE + length - 1]
                yield first, end, piece, np.array([0, len(piece)]), start
        else:
            yield first, end, data, offsets, 0


#: place: a phrase's first window, the trigger's offset in the phrase and its last window's, which fit a byte each (SPREAD windows at most).
PLACE = "k1 long, k2 long, place long"


def _phrases(texts: DataFrame, length: int) -> DataFrame:
    """(core, phrase, k1, k2, place) of each phrase of rows (k1, k2, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, _, data, offsets, start in _pieces(b.column(2), length):
                of, trigger, head, tail, core, phrase = parse(data, offsets, length)
                if len(of):
                    rows = pa.array(of + first)
                    place = (head + start) << 16 | (trigger - head) << 8 | (tail - head)
                    yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(phrase), b.column(0).take(rows), b.column(1).take(rows), pa.array(place)], names=["core", "phrase", "k1", "k2", "place"])

    return texts.mapInArrow(run, f"core long, phrase long, {PLACE}")


def _take_phrases(joined: DataFrame, length: int) -> DataFrame:
    """(core, single, hot, k1, k2, place, bytes) of rows (k1, k2, text, wanted): the bytes of the phrases wanted of each text."""

    def run(batches):
        import pyarrow as pa

        kinds = (("core", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()), ("place", pa.int64()))
        for b in batches:
            for k in range(b.num_rows):
                text = (b.column(2)[k].as_py() or "").encode()
                rows = b.column(3)[k].as_py()
                for at in range(0, len(rows), 4096):
                    some = rows[at : at + 4096]
                    core, single, hot, place = (pa.array([w[c] for w in some], t) for c, t in kinds)
                    same = pa.array([k] * len(some))
                    parts = [text[w["place"] >> 16 : (w["place"] >> 16) + (w["place"] & 255) + length] for w in some]
                    yield pa.RecordBatch.from_arrays([core, single, hot, b.column(0).take(same), b.column(1).take(same), place, pa.array(parts, pa.binary())], names=["core", "single", "hot", "k1", "k2", "place", "bytes"])

    return joined.select("k1", "k2", "text", "wanted").mapInArrow(run, f"core long, single boolean, hot boolean, {PLACE}, bytes binary")


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of data[s:s + length] for the starts: the suffix array by prefix doubling, cut at length bytes."""
    rank, width = data.astype(np.int64), 1
    if length >= 8:  # the first three doublings at once: 8 bytes as one number
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        rank, width = np.unique(np.ndarray((max(len(data) - 7, 0),), ">u8", padded, strides=(1,)), return_inverse=True)[1], 8

    def joined(rank: np.ndarray, shift: int) -> np.ndarray:
        pair = rank[: len(rank) - shift] * (rank.max(initial=0) + 1) + rank[shift:]
        return np.unique(pair, return_inverse=True)[1]

    while width * 2 <= length:
        rank, width = joined(rank, width), width * 2
    if width < length:
        rank = joined(rank, length - width)
    return rank[starts]


def _repeats_in_bucket(length: int):
    """Of a bucket's distinct phrases, runs of windows of single ones that another phrase holds too: (doc, start, end) in bytes."""

    def run(rows):
        import pandas as pd

        rows = rows.sort_values("core", kind="stable")
        parts = rows["bytes"].tolist()
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        windows = sizes - length + 1
        phrase = np.repeat(np.arange(len(parts)), windows)
        begin = np.cumsum(sizes) - sizes
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = suffix_ranks(data, begin[phrase] + inner, length)
        # equal windows have one trigger, so a phrase never holds one twice
        repeated = np.bincount(rank)[rank] > 1
        repeated &= rows["single"].to_numpy()[phrase]
        head = repeated.copy()
        head[1:] &= ~(repeated[:-1] & (phrase[1:] == phrase[:-1]))
        tail = repeated.copy()
        tail[:-1] &= ~(repeated[1:] & (phrase[1:] == phrase[:-1]))
        h, t = np.flatnonzero(head), np.flatnonzero(tail)
        at = rows["place"].to_numpy() >> 8
        at = rows["place"].to_numpy() >> 16
        of = {c: rows[c].to_numpy()[phrase[h]] for c in ("k1", "k2")}
        return pd.DataFrame(of | {"start": at[phrase[h]] + inner[h], "end": at[phrase[t]] + inner[t] + length})

    return run


def _refined(scratch: Scratch, phrases: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, end) of the windows of single phrases that another phrase of rows (core, single, k1, k2, place, bytes) holds too.

    A window has its trigger l bytes behind its start. Windows with l in a range [a, b] share a bytes in front of the trigger and
    length - b from it on, and cover together b in front and length - a behind. A range whose shared bytes no other phrase has repeats
    in none of its windows; one whose covered bytes another has repeats in all, and one phrase with them stands for the others from there on.
    What is left is cut smaller, so a phrase has few ranges at a time and no group is ever gathered.
    """

    def hashed(size: int):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
                parts, place, nth = column("bytes").to_pylist(), column("place").to_numpy(), column("nth").to_numpy().astype(np.int64)
                core = column("core").to_numpy().view(np.uint64)
                begin = np.cumsum([0, *map(len, parts)])[:-1]
                strings = Strings(np.frombuffer(b"".join(parts), np.uint8))
                most = place >> 8 & 255
                least, trigger = most - (place & 255), begin + most
                first, last = nth * size, nth * size + size - 1
                salt = mix(core + nth.astype(np.uint64))
                whole = (most >= last) & (least <= first)  # else no phrase can have the same covered bytes as a range
                row = mix(column("k1").to_numpy().view(np.uint64) ^ mix(column("k2").to_numpy().view(np.uint64) ^ mix(place.astype(np.uint64))))
                front, behind = np.where(whole, last, 0), np.where(whole, length - first, 0)
                keys = [mix(strings.of(trigger - first, trigger + length - last, lane) ^ salt) for lane in (0, 1)]
                keys += [np.where(whole, mix(strings.of(trigger - front, trigger + behind, lane) + salt), mix(row ^ salt + np.uint64(lane))) for lane in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), *map(column, ("k1", "k2", "place", "settled", "nth"))], names=["key", "key2", "all", "all2", "k1", "k2", "place", "settled", "nth"])

        return run

    at = ["k1", "k2", "place"]
    most = F.shiftright("place", 8).bitwiseAND(255)

    def cut(df: DataFrame, into: int, size: int) -> DataFrame:
        """df's ranges, each cut into parts of size windows; those that no window of the phrase is in go."""
        parts = df.withColumn("nth", F.explode(F.array(*(into * F.col("nth") + k for k in range(into)))))
        return parts.where((most >= F.col("nth") * size) & (most - F.col("place").bitwiseAND(255) < (F.col("nth") + 1) * size))

    whole = phrases.select(*at, (~F.col("single")).alias("settled"), F.lit(0).alias("nth"))
    alive, spans = cut(whole, SPREAD // RANGES[0], RANGES[0]), None
    for size, smaller in zip(RANGES, (*RANGES[1:], 0), strict=True):
        rows = phrases.select(*at, "core", "bytes").join(alive, at).mapInArrow(hashed(size), f"key long, key2 long, all long, all2 long, {PLACE}, settled boolean, nth int")
        rows = scratch.save(rows, f"ranges_{size}")
        shared = rows.groupBy("key", "key2").agg(F.count("*").alias("n"), F.bool_and("settled").alias("known")).where("n > 1 and not known")
        covered = rows.groupBy("all", "all2").agg(F.count("*").alias("m"), F.min(F.struct(*at)).alias("stands")).where("m > 1")
        limit = hot_limit(rows.count())
        rows = join_hot(rows, shared.select("key", "key2", "n"), ["key", "key2"], "n", limit, at)
        rows = scratch.save(join_hot(rows, covered, ["all", "all2"], "m", limit, at, "left"), f"left_{size}")
        start = F.shiftright("place", 16) + most - (F.col("nth") + 1) * size + 1
        found = rows.where(F.col("stands").isNotNull() & ~F.col("settled")).select("k1", "k2", start.alias("start"), (start + size - 1 + length).alias("end"))
        found = scratch.save(found, f"found_{size}")
        spans = found if spans is None else spans.union(found)
        stays = rows.where(F.col("stands").isNull() | (F.col("stands") == F.struct(*at))).withColumn("settled", F.col("settled") | F.col("stands").isNotNull())
        if smaller:
            alive = scratch.save(cut(stays, size // smaller, smaller).select(*at, "settled", "nth"), f"alive_{smaller}")
        scratch.drop(f"ranges_{size}", f"left_{size}", f"alive_{size}")
        if smaller and alive.isEmpty():
            break
    return spans


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """(k1, k2, start, end): byte spans of texts, by the keys of their rows, that are covered by repeated strings; they may overlap."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    texts = texts.withColumns(row_keys(F.col("id"), F.col("text"))).select("k1", "k2", "text")
    parsed = scratch.save(_phrases(texts, length), "parse")
    cores = parsed.groupBy("core").agg(F.count("*").alias("n"), F.min("phrase").alias("p0"), F.max("phrase").alias("p1"))
    cores = scratch.save(cores.where("n > 1").select("core", "n", (F.col("p0") < F.col("p1")).alias("mixed")), "cores")
    limit = hot_limit(cores.agg(F.sum("n")).first()[0] or 0)
    places = scratch.save(join_hot(parsed, cores, ["core"], "n", limit, ["k1", "k2", "place"]), "places")
    scratch.drop("parse", "cores")
    scratch.free_shuffles()

    # mixed cores: what the parse holds twice repeats anyway, one of each phrase goes into the dictionary
    mixed = places.where("mixed").drop("mixed")
    entries = mixed.groupBy("core", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at"))
    entries = scratch.save(entries, "entries")
    twice = join_hot(mixed, entries.where("n > 1").select("core", "phrase", "n"), ["core", "phrase"], "n", limit, ["k1", "k2", "place"])
    whole = places.where(~F.col("mixed")).select("k1", "k2", "place").union(twice.select("k1", "k2", "place"))
    start = F.shiftright("place", 16)
    whole = scratch.save(whole.select("k1", "k2", start.alias("start"), (start + F.col("place").bitwiseAND(255) + length).alias("end")), "whole")

    variety = scratch.save(entries.groupBy("core").agg(F.count("*").alias("m")).where(F.col("m") > CORE_PHRASES), "variety")
    hot = variety.agg(F.sum("m")).first()[0] or 0
    dictionary = entries.select("core", (F.col("n") == 1).alias("single"), "at.*")
    if hot:
        dictionary = join_hot(dictionary, variety.withColumn("hot", F.lit(True)), ["core"], "m", hot_limit(hot), ["k1", "k2", "place"], "left")
    else:
        dictionary = dictionary.withColumn("hot", F.lit(None).cast("boolean"))
    wanted = dictionary.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "single", F.coalesce("hot", F.lit(False)).alias("hot"), "place")).alias("wanted"))
    once = texts.withColumn("nth", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))).where("nth = 1")  # equal rows have equal phrases
    phrases = scratch.save(_take_phrases(once.join(wanted, ["k1", "k2"]), length), "phrases")
    scratch.drop("places", "entries")
    scratch.free_shuffles()
    spans = "k1 long, k2 long, start long, end long"
    buckets = max(1, -(-phrases.where(~F.col("hot")).count() // BUCKET))
    sorted_ = phrases.where(~F.col("hot")).withColumn("bucket", F.pmod("core", F.lit(buckets))).groupBy("bucket").applyInPandas(_repeats_in_bucket(length), spans)
    found = whole.union(sorted_)
    if hot:
        found = found.union(_refined(scratch, phrases.where("hot"), length))
    found = scratch.save(found, "spans")
    scratch.drop("whole", "variety", "phrases", *(f"found_{k}" for k in RANGES))
    scratch.free_shuffles()
    return found


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    if not len(start):
        return []
    head = np.append(True, start[1:] > end[:-1])
    at = np.flatnonzero(head)
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(start)) - 1].tolist(), strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), within: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_bytes, spans, kept) of each row of df: maximal removed runs [start, end) and the bytes that stay.

    carry: other columns of df to hand through, as columns of their names, which must differ from these, or as fields of one struct column `within`.
    """
    scratch = scratch or Scratch(df.sparkSession)
    spans = repeated_spans(df, id_col, text_col, length, scratch)
    by_text = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in carry)).alias("others")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), others).withColumns(row_keys(F.col("id"), F.col("text")))
    joined = rows.join(by_text, ["k1", "k2"], "left").select("id", "text", "found", "others")

    def run(batches):
        import pyarrow as pa

        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for at in range(0, b.num_rows, 200):
                piece = b.slice(at, 200)
                size, runs, kept = [], [], []
                for text, found in zip(piece.column(1), piece.column(2), strict=True):
                    raw = (text.as_py() or "").encode()
                    own = []
                    if found.is_valid:
                        flat = found.values
                        own = merge_spans(flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False))
                    edges = [0, *(x for s in own for x in s), len(raw)]
                    size.append(len(raw))
                    runs.append([{"start": s, "end": e} for s, e in own])
                    kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size, pa.int64()), pa.array(runs, pa.list_(pair)), pa.array(kept, pa.binary()), piece.column(3)], names=["id", "n_bytes", "spans", "kept", "others"])

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    shape = [StructField("id", df.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("spans", ArrayType(span)), StructField("kept", BinaryType()), rows.schema["others"]]
    out = joined.mapInArrow(run, StructType(shape))
    handed = [F.col("others").alias(within)] if within else [F.col("others")[c].alias(c) for c in carry]
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept", *handed)
