"""Packing into optimal length buckets.

The histogram of all lengths is cut into buckets whose texts are padded to the longest of them; dynamic
programming chooses the boundaries that pad least. Inside a bucket texts form batches of as many as the
token budget holds at the padded length, one at least, so that longer texts than the budget stand alone.
Lengths up to `fine` keep cells of their own; above, a cell spans 1 / fine of its power of two, so the
histogram that comes to the driver has about fine rows for each power of two, however long texts are. The boundaries are optimal among
ends of cells; with fine=None every length is a cell, they are optimal among all, and the histogram has a row for each length that occurs.

Null and empty texts have length 0. Repeated rows are texts of their own. An empty table gives no rows.
Batches hold texts in an order of hashed (id, length), in which rows that agree in both are alike: reruns agree, in whatever order the rows come.
Rows of one id, null among them, are dealt over the parts by their length too; those alike in both are counted, ranked as one and numbered at the end, PIECE of them a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.shared import Scratch, word_count

FINE = 4096
BUCKETS, BUDGET = 16, 16_384
PARTS, PART_ROWS = 256, 1_000_000
PIECE = 16_384


def cell(length: Column, fine: int | None = FINE) -> Column:
    """The histogram cell of a length."""
    if fine is None:
        return length.cast("long")
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / fine)) + 1).cast("long")
    return F.when(length < fine, length).otherwise(F.floor(length / step) * step).cast("long")


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """cells: (longest, count, sum of lengths), ascending. Upper ends of at most so many buckets with the least padding.

    With N and S the running counts and sums and L the lengths, a bucket over cells i..j costs L[j] (N[j] - N[i]) - (S[j] - S[i]).
    The best i for j minimises a line of slope -N[i] at L[j], so a monotone hull of lines finds it in linear time.
    """
    m = len(cells)
    if not m:
        return []
    longest, count, total = [0], [0], [0]
    for size, n, s in cells:
        longest.append(size)
        count.append(count[-1] + n)
        total.append(total[-1] + s)
    cost = [0] + [longest[j] * count[j] - total[j] for j in range(1, m + 1)]
    back = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at, new, via = 0, cost[:], back[-1][:]
        via = [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if i:
                slope, height = -count[i], cost[i] + total[i]
                while len(hull) >= 2 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, height, i))
                at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * longest[j] + hull[at + 1][1] <= hull[at][0] * longest[j] + hull[at][1]:
                at += 1
            if hull:
                best = hull[at][0] * longest[j] + hull[at][1] + longest[j] * count[j] - total[j]
                if best < new[j]:
                    new[j], via[j] = best, hull[at][2]
        cost = new
        back.append(via)
    ends, j = [], m
    for via in reversed(back):
        if j == 0:
            break
        ends.append(longest[j])
        j = via[j]
    return sorted(ends)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, fine: int | None = FINE, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, n_tokens, bucket, bucket_tokens, batch, slot) of each row: batch numbers count within the bucket, slots within the batch.

    length: a column that gives the length in tokens; else the number of words.
    """
    scratch = scratch or Scratch(df.sparkSession)
    size = word_count(F.col(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), size.alias("n_tokens")).groupBy("id", "n_tokens").agg(F.count("*").alias("alike"))
    rows = scratch.save(rows.withColumn("hash", F.xxhash64("id", "n_tokens", F.lit(7))), "lengths")
    cells = rows.groupBy(cell(F.col("n_tokens"), fine).alias("cell")).agg(F.max("n_tokens").alias("longest"), F.sum("alike").alias("n"), F.sum(F.col("n_tokens") * F.col("alike")).alias("total"), F.max("alike").alias("most"))
    cells = sorted(cells.collect(), key=lambda r: r["cell"])
    ends = best_boundaries([(r["longest"], r["n"], r["total"]) for r in cells], buckets) or [0]
    ends_col = F.array(*(F.lit(e).cast("long") for e in ends))
    parts = max(PARTS, sum(r["n"] for r in cells) // PART_ROWS)
    rows = rows.withColumns({"bucket": F.size(F.filter(ends_col, lambda e: e < F.col("n_tokens"))).cast("int"), "part": F.pmod("hash", F.lit(parts))})
    counts = rows.groupBy("bucket", "part").agg(F.sum("alike").alias("n"))  # at most buckets * parts rows
    before = lambda of, by, order: F.coalesce(F.sum(of).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("bucket", "part", before("n", ["bucket"], ["part"]).alias("before"))
    ranked = rows.withColumn("nth", before("alike", ["bucket", "part"], ["hash", "id", "n_tokens"])).join(counts, ["bucket", "part"])
    ranked = ranked.withColumn("bucket_tokens", F.element_at(ends_col, F.col("bucket") + 1)).withColumn("rank", F.col("before") + F.col("nth"))
    # rows alike in id and length are told by their number alone; many of them go to several tasks
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1, F.lit(PIECE).cast("long"))).alias("piece")
    ranked = ranked.select("id", "n_tokens", "bucket", "bucket_tokens", "rank", "alike", piece)
    if max((r["most"] for r in cells), default=0) > PIECE:
        ranked = ranked.repartition("id", "n_tokens", "piece")
    one = F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + PIECE, F.col("alike")) - 1)).alias("one")
    ranked = ranked.select("id", "n_tokens", "bucket", "bucket_tokens", "rank", one).withColumn("rank", F.col("rank") + F.col("one"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return ranked.select(F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("rank") / room).cast("long").alias("batch"), (F.col("rank") % room).cast("long").alias("slot"))
