"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into halves, each half is quantised by its own centroids (k-means over a bounded sample: of the rows with
the smallest id hashes SAMPLE at most, and SAMPLE_NUMBERS numbers), about the square root of the index's size of them, MOST_CENTROIDS
at most; a pair of centroids is a cell. A query pops cells from a heap in order of the summed distance of its halves to the
pair until the cells hold a share of the index, then all entries of those cells are ranked by their exact inner product, in
double precision. After HEAP_POPS cells the rest are put in the same order by one sort. The share is a parameter or measured on the sample:
the least that holds RECALL of its rows' exact neighbours. In a larger index neighbours are nearer, so it holds more there.

The index holds every row. Equal vectors are one entry with its `top` + 1 smallest distinct ids, each up to `top` times: no other copy can be
among the nearest, as ties go to smaller ids. A query's own id is no candidate however often it stands, so lists that are cut
before the query's id is known keep `top` + 1 distinct ids, each up to `top` times. Entries of a group of first centroids form blocks of bounded size, hashed into chunks, and
meet the queries in parts of PART, which carry only their vector and the distance up to which they read cells, so a hot vector
or cell is no single task. The index is sent once for every PART queries.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows without an id.
Vectors of one number are quantised by that alone. Rows that repeat an id are a query each, a candidate each for
other ids and none for their own. With fewer candidates
than asked for, all that are found are returned. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from skein.llm.shared import Scratch, hot_limit, join_hot

SAMPLE, SAMPLE_NUMBERS, ROUNDS = 20_000, 2_000_000, 8
LEAST_CENTROIDS, MOST_CENTROIDS = 16, 128
#: The share of the exact neighbours of CALIBRATORS rows of the sample that the cells must hold.
RECALL, CALIBRATORS = 0.96, 256
HEAP_POPS = 256
BLOCKS, CHUNK, PART = 32, 4096, 1 << 15
#: Queries of a part that are multiplied at a time.
PIECE = 512


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def train(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k-means centroids of the rows of x; fewer where x has fewer distinct rows, one where they have no numbers."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        a = nearest_centroid(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: float, pops: int = HEAP_POPS) -> list[tuple[int, int]]:
    """Cells in ascending order of first[i] + second[j] until their counts reach want; empty cells are left out."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, popped, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], [], 0
    while heap and held < want and len(popped) < pops:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]), int(b[j])
        popped.append(cell)
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    if heap and held < want:
        sums, left = (first[:, None] + second[None, :]).ravel(), counts.ravel() > 0
        left[[i * len(b) + j for i, j in popped]] = False
        left = np.flatnonzero(left)
        left = left[np.argsort(sums[left], kind="stable")]
        ends = held + np.cumsum(counts.ravel()[left])
        out += [(int(c) // len(b), int(c) % len(b)) for c in left[: int(np.searchsorted(ends, want)) + 1]]
    return out


def _stack(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the centroids."""
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def calibrate(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, top: int, recall: float = RECALL) -> float:
    """The share of the rows of x that the nearest cells must hold so that `recall` of CALIBRATORS rows' exact neighbours are among them."""
    top = min(top, len(x) - 1)
    if top < 1 or len(x) <= 8 * top:
        return 1.0
    half = c1.shape[1]
    asked = np.random.default_rng(5).permutation(len(x))[:CALIBRATORS]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-scores, top - 1, axis=1)[:, :top]
    sums = distances(x[asked, :half], c1)[:, nearest_centroid(x[:, :half], c1)] + distances(x[asked, half:], c2)[:, nearest_centroid(x[:, half:], c2)]
    # what a query reads before it has read a neighbour's cell, of all rows but itself
    before = [np.searchsorted(np.sort(s), s[n], side="right") / len(x) for s, n in zip(sums, near, strict=True)]
    return float(np.quantile(np.concatenate(before), recall))


def first_groups(ask: np.ndarray, place: np.ndarray, score: np.ndarray, tie: np.ndarray, grp: np.ndarray, top: int) -> np.ndarray:
    """Which rows stay of each query `ask`: by falling score and rising tie those of the first top + 1 groups, each group's first `top`. No query's own id can leave it with less than top."""
    n = np.bincount(ask)
    bound = np.full(len(n), -np.inf)
    order = np.lexsort((-score, ask))
    begin = np.concatenate([[0], np.cumsum(n)])
    if len(np.unique(grp[np.unique(place, return_index=True)[1]])) == len(np.unique(place)):  # no group twice, so top + 1 rows are enough
        far = np.flatnonzero(n > top)
        bound[far] = score[order[begin[far] + top]]
        rows = np.flatnonzero(score >= bound[ask])
        rows = rows[np.lexsort((tie[rows], -score[rows], ask[rows]))]
        nth = np.arange(len(rows)) - np.searchsorted(ask[rows], ask[rows])
        return rows[nth <= top]
    rows = np.lexsort((tie, -score, ask))
    by_group = rows[np.lexsort((np.arange(len(rows)), grp[rows], ask[rows]))]
    new = np.append(True, (ask[by_group[1:]] != ask[by_group[:-1]]) | (grp[by_group[1:]] != grp[by_group[:-1]]))
    nth = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    number, lead = np.empty(len(score), np.int64), np.zeros(len(score), bool)
    number[by_group], lead[by_group] = nth, new
    rank = np.cumsum(lead[rows])  # groups opened so far, over all queries
    opened = rank - np.concatenate([[0], rank])[begin[ask[rows]]]  # of this query
    at = np.empty(len(score), np.int64)
    at[rows] = opened
    leader = np.empty(len(score), np.int64)
    leader[by_group] = at[by_group[np.flatnonzero(new)[np.cumsum(new) - 1]]]
    return rows[(leader[rows] <= top + 1) & (number[rows] < top)]


def _first_groups(df: DataFrame, grp: str, ties: list[str], top: int) -> DataFrame:
    """The same of rows (query, score, ...) of a table, by windows over each query's few rows."""
    best = [F.desc("score"), *ties]
    nth = F.row_number().over(W.partitionBy("query", grp).orderBy(*best))
    cut = df.repartition("query").withColumn("_nth", nth).where(F.col("_nth") <= top)
    opens = F.count(F.when(F.col("_nth") == 1, 1)).over(W.partitionBy("query").orderBy(*best, grp, "_nth").rowsBetween(W.unboundedPreceding, 0))
    leader = F.min("_opened").over(W.partitionBy("query", grp))
    return cut.withColumn("_opened", opens).withColumn("_leader", leader).where(F.col("_leader") <= top + 1).drop("_nth", "_opened", "_leader")


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries=None, top: int = 20, share: float | None = None, centroids: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows where `queries` (a condition over id_col's values; default all) holds."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    kind = "float" if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(F.col("vec_id").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes[0]["d"]
    half = max(1, d // 2)
    rows = rows.where(F.size("v") == d)

    # entries: distinct vectors; windows with a limit are cut down before they are shuffled
    repeats = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(top)).alias("n"))
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = repeats.withColumn("nth", nth).where(F.col("nth") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    entries = entries.withColumn("only", F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]))
    # a number of its own for each entry: several vectors may share their smallest id
    entries = scratch.save(entries.withColumn("first", F.col("ids")[0]["vec_id"]).withColumn("entry", F.xxhash64("first", "v")), "entries")
    total = entries.count()
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // d))).select("v").toPandas()
    x = np.array(sample["v"].tolist(), np.float64)
    k = centroids or min(MOST_CENTROIDS, max(LEAST_CENTROIDS, math.isqrt(total)))
    c1, c2 = train(x[:, :half], k), train(x[:, half:], k)
    want = (calibrate(x, c1, c2, top) if share is None else share) * total

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                v = _stack(b.column(0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest_centroid(v[:, :half], c1), pa.int32()), pa.array(nearest_centroid(v[:, half:], c2), pa.int32())], names=[*b.schema.names, "i", "j"])

    cells = scratch.save(entries.select("v", "ids", "only", "first", "entry").mapInArrow(assign, f"v array<{kind}>, ids array<struct<vec_id:bigint,n:bigint>>, only long, first long, entry long, i int, j int"), "cells")
    scratch.drop("entries")
    counts = np.zeros((len(c1), len(c2)), np.int64)
    for r in cells.groupBy("i", "j").agg(F.count("*").alias("n")).collect():  # at most a row a cell
        counts[r["i"], r["j"]] = r["n"]
    blocks = min(BLOCKS, len(c1))
    sizes = np.bincount(np.arange(len(c1)) % blocks, counts.sum(1), blocks)
    chunks = np.maximum(1, -(-sizes // CHUNK)).astype(int)

    asked = rows if queries is None else rows.where(queries(F.col("vec_id")))
    vectors = asked.groupBy("v").agg(F.count("*").alias("weight"))
    asked_entries = scratch.save(cells.select("entry", "v").join(vectors, "v"), "queries")
    parts = max(1, -(-asked_entries.count() // PART))

    def dispatch(batches):
        """A row for each query and chunk that it reads, with the distance up to which it reads cells."""
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                v, ids = _stack(piece.column(1)), piece.column(0).to_pylist()
                d1, d2 = distances(v[:, :half], c1), distances(v[:, half:], c2)
                row, block, chunk, reach = [], [], [], []
                for k in range(len(ids)):
                    read = traverse(d1[k], d2[k], counts, want)
                    last = max((float(d1[k][i] + d2[k][j]) for i, j in read[-1:]), default=-math.inf)
                    for t in {i % blocks for i, _ in read}:
                        row += [k] * chunks[t]
                        block += [t] * chunks[t]
                        chunk += range(chunks[t])
                        reach += [last] * chunks[t]
                if row:
                    take = pa.array(row)
                    part = pa.array([ids[k] * 0x9E3779B1 % (1 << 31) % parts for k in row], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(chunk, pa.int32()), part, piece.column(0).take(take), piece.column(1).take(take), pa.array(reach, pa.float64())], names=["block", "chunk", "part", "entry", "v", "reach"])

    sent = asked_entries.select("entry", "v").mapInArrow(dispatch, f"block int, chunk int, part int, entry long, v array<{kind}>, reach double")
    block = F.col("i") % blocks
    chunk_of = F.pmod(F.xxhash64("entry"), F.element_at(F.array(*(F.lit(int(c)) for c in chunks)), block + 1)).cast("int")
    held = cells.select(block.alias("block"), chunk_of.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "i", "j", "entry", "first", F.coalesce("only", F.col("entry")).alias("grp"), "v")

    def rank_block(left, right):
        import pandas as pd

        out = {"query": [], "entry": [], "first": [], "grp": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values(["i", "j", "first", "entry"])
            e, i, j, first, grp = (left[c].to_numpy() for c in ("entry", "i", "j", "first", "grp"))
            tie = np.empty(len(e), np.int64)
            tie[np.lexsort((e, first))] = np.arange(len(e))
            x = np.array(left["v"].tolist(), np.float64)
            starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            ends = np.append(starts[1:], len(i))
            q = np.array(right["v"].tolist(), np.float64)
            reach, asker = right["reach"].to_numpy(), right["entry"].to_numpy()
            for at in range(0, len(q), PIECE):
                some = q[at : at + PIECE]
                # the same sums as in the traversal, so the same cells; only they are multiplied
                near = distances(some[:, :half], c1)[:, i[starts]] + distances(some[:, half:], c2)[:, j[starts]] <= reach[at : at + PIECE, None] * (1 + 1e-12) + 1e-12
                asks, places, scores = [], [], []
                for c, (start, end) in enumerate(zip(starts, ends, strict=True)):
                    who = np.flatnonzero(near[:, c])
                    if len(who):
                        asks.append(np.repeat(who, end - start))
                        places.append(np.tile(np.arange(start, end), len(who)))
                        scores.append((some[who] @ x[start:end].T).ravel())
                if asks:
                    ask, place, score = np.concatenate(asks), np.concatenate(places), np.concatenate(scores)
                    keep = first_groups(ask, place, score, tie[place], grp[place], top)
                    out["query"].append(asker[at : at + PIECE][ask[keep]])
                    for name, column in (("entry", e), ("first", first), ("grp", grp)):
                        out[name].append(column[place[keep]])
                    out["score"].append(score[keep])
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})

    by = ["block", "chunk", "part"]
    found = held.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(rank_block, "query long, entry long, first long, grp long, score double")
    nearest = _first_groups(found, "grp", ["first", "entry"], top).drop("grp", "first").join(cells.select("entry", "ids"), "entry").select("query", "score", F.inline("ids"))
    each = F.explode(F.array_repeat("vec_id", F.col("n").cast("int")))
    nearest = _first_groups(nearest.select("query", "score", each.alias("vec_id")), "vec_id", ["vec_id"], top)
    nearest = nearest.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("near"))
    nearest = scratch.save(asked_entries.join(nearest, F.col("entry") == F.col("query")).select("v", "weight", "near"), "nearest")
    # back to every asked row: few neighbours travel with its vector (top + 1 where no id is repeated), a hot one dealt over tasks
    per = join_hot(asked, nearest, ["v"], "weight", hot_limit(0), ["vec_id"]).withColumnRenamed("vec_id", "query_id")
    own = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, top)
    return per.select("query_id", F.posexplode(own)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col")["vec_id"].alias("vec_id"), F.col("col")["score"].alias("score"))
