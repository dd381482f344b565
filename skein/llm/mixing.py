"""Mixing sources to target weights by entropy balancing.

Only DataFrame functions. Each source gets a target: its share, by weight, of `share` times all words,
at most `cap` times its own words, the excess going to the others by weight. The document rates nearest to 1 in
entropy that meet a source's target are r = min(cap, exp(lambda * size / mean size)); Newton steps
on the convex dual, over the sources' size histograms, find each lambda (a step outside the
bracket so far is replaced by its midpoint). Rates are then rounded to copies systematically in order
of size: the words taken miss a source's target by one document of it at most, and no document is
taken more than `cap` (a whole number) times.

Null and empty texts have size 0, rate 1 and take nothing. Null is a source of its own, last in order. Repeated
rows and rows of one id, null ids too, are documents of their own, told apart by their texts; rows that agree in
both share what they are taken. The same rows in any order give the same copies. One task orders the sources
(a row each); no row of a document meets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.shared import Scratch, hot_limit, join_hot, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2
#: Rows of one size and source are ranked in so many parts, so that a hot size is no single task.
PARTS = 256
#: Rows of a run that a task gives out.
RUN = 8192
MAX_STEPS, TOLERANCE = 200, 1e-6


def source_targets(histogram: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, mean) of a histogram (source, size, n). One row a source: the only rows that one task orders."""
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", (F.col("source_size") * cap).cast("double"))
    # Sources fill up in order of limit / weight: the level that those not full share follows from running sums.
    fills = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = per.withColumns({
        "level": (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("limit").over(fills.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(fills.rowsBetween(0, W.unboundedFollowing)),
    })
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(W.partitionBy())["level"]
    full = full.withColumn("level", level)
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit")))
    return full.select("source", "source_size", target.alias("target"), (F.col("source_size") / F.col("docs")).alias("mean"))


def rate(cap: int):
    """Of a row with lambda, size and mean."""
    return F.when((F.col("mean") > 0) & (F.col("size") > 0), F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.try_divide(F.col("lambda") * F.col("size"), F.col("mean")))))).otherwise(1.0)


def balance(scratch: Scratch, histogram: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """targets with lambda. Each step is one aggregation over the histograms; the dual's state is a row a source."""
    state = scratch.save(targets.withColumns({"lambda": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0), "miss": F.lit(None).cast("double")}), "dual_0")
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")  # noqa: E731  the same in any order of summation
    full = F.col("target") >= cap * F.col("source_size")  # met by no finite lambda, but by the cap alone
    for step in range(1, MAX_STEPS + 1):
        joined = histogram.join(state.select(F.col("source").alias("at"), "lambda", "mean"), F.col("source").eqNullSafe(F.col("at")))
        words = F.col("n") * F.col("size") * rate(cap)
        slope = F.coalesce(F.when(rate(cap) < cap, F.try_divide(words * F.col("size"), F.col("mean"))), F.lit(0.0))
        sums = joined.groupBy(F.col("source").alias("at")).agg(exact(words).alias("words"), exact(slope).alias("slope"))
        new = state.join(sums, F.col("source").eqNullSafe(F.col("at")), "left").withColumns({"words": F.coalesce("words", F.lit(0.0)), "slope": F.coalesce("slope", F.lit(0.0))})
        new = new.withColumns({
            "low": F.when(F.col("words") < F.col("target"), F.col("lambda")).otherwise(F.col("low")),
            "high": F.when(F.col("words") > F.col("target"), F.col("lambda")).otherwise(F.col("high")),
            "miss": F.when(full, 0.0).otherwise(F.abs(F.col("words") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))),
            "newton": F.when(F.col("slope") > 0, F.col("lambda") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))),
        })
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        inside = inside & F.lit(step % 3 != 0)  # each third step halves the bracket, so the end is sure
        moved = F.when(F.col("miss") <= TOLERANCE, F.col("lambda")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        new = new.withColumn("lambda", moved).select(state.columns)
        state = scratch.save(new, f"dual_{step}")
        if not state.where((F.col("miss") > TOLERANCE) & (F.col("high") - F.col("low") > 1e-12)).limit(1).count():
            return state
        scratch.drop(f"dual_{step - 1}")
    raise RuntimeError(f"no balance after {MAX_STEPS} steps")


def numbered(rows: DataFrame, hot: bool, spread: list[str]) -> DataFrame:
    """Each row n (long, at least 1) times. If some n may be over RUN, the runs are dealt over tasks first."""
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long"))))
    if hot:
        pieces = pieces.repartition(F.xxhash64(*spread), "_piece")
    times = F.least(F.col("n") - F.col("_piece") + 1, F.lit(RUN).cast("long"))
    return pieces.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("n", "_piece", "_one")


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, hash, source, size, source_size, target, rate, copies, taken) of each row of df; hash is the text's, xxhash64."""
    scratch = scratch or Scratch(df.sparkSession)
    part = F.pmod(F.xxhash64("id", "hash"), F.lit(PARTS)).cast("int")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    # rows that agree in all of these are counted: they are ranked as one and told by their number at the end
    rows = scratch.save(rows.groupBy("id", "hash", "source", "size").agg(F.count("*").alias("alike")).withColumn("part", part), "sizes")
    parts = scratch.save(rows.groupBy("source", "size", "part").agg(F.sum("alike").alias("n"), F.max("alike").alias("most")), "parts")
    histogram = scratch.save(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    duals = balance(scratch, histogram, source_targets(histogram, weights, share, cap), cap)

    at = duals.select(F.col("source").alias("at"), "source_size", "target", "mean", "lambda")
    groups = histogram.join(at, F.col("source").eqNullSafe(F.col("at"))).drop("at")
    exact = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(rate(cap))
    groups = groups.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(exact))
    whole = F.floor("rate").cast("long")
    by_size = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    share_of = F.when(F.col("size") == 0, 0.0).otherwise((F.col("rate") - whole) * F.col("n"))
    groups = groups.withColumns({"whole": whole, "_own": share_of}).withColumn("_end", F.sum("_own").over(by_size))
    # Rounded ends of running sums: what all sizes up to one get more misses their due by half a copy at most.
    end = F.floor(F.col("_end") + 0.5)
    groups = groups.withColumn("more", F.least(F.col("n"), F.greatest(F.lit(0), end - F.coalesce(F.lag(end).over(W.partitionBy("source").orderBy("size")), F.lit(0)))).cast("long"))
    groups = groups.select(F.col("source").alias("at"), F.col("size").alias("at_size"), "source_size", "target", "rate", "whole", "more", F.col("n").alias("all"))

    within = W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    dealt = parts.join(groups, F.col("source").eqNullSafe(F.col("at")) & (F.col("size") == F.col("at_size"))).withColumn("upto", F.sum("n").over(within))
    upto = lambda c: F.floor(F.col("more") * c / F.col("all"))
    dealt = dealt.withColumn("more_here", upto(F.col("upto")) - upto(F.col("upto") - F.col("n")))
    dealt = scratch.save(dealt.select("at", "at_size", F.col("part").alias("at_part"), "source_size", "target", "rate", "whole", "more_here"), "dealt")

    joined = rows.join(dealt, F.col("source").eqNullSafe(F.col("at")) & (F.col("size") == F.col("at_size")) & (F.col("part") == F.col("at_part")))
    order = W.partitionBy("source", "size", "part").orderBy(F.xxhash64("id", "hash", F.lit(9)), "id", "hash").rowsBetween(W.unboundedPreceding, -1)
    nth = F.coalesce(F.sum("alike").over(order), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(nth + F.col("alike"), F.col("more_here")) - F.least(nth, F.col("more_here")))
    joined = joined.withColumn("extra", extra)
    # of rows that are alike the first `extra` are taken once more
    runs = F.array(F.struct(F.col("extra").alias("n"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("alike") - F.col("extra")).alias("n"), F.col("whole").alias("copies")))
    out = joined.select("id", "hash", "source", "size", "source_size", "target", "rate", F.inline(F.filter(runs, lambda r: r["n"] > 0)))
    out = numbered(out, (parts.agg(F.max("most")).first()[0] or 0) > RUN, ["id", "hash"]).withColumn("copies", F.col("copies").cast("int"))
    return out.select(F.col("id").alias(id_col), "hash", F.col("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None, **settings) -> DataFrame:
    """df with each row as often as it is taken. Rows that agree in id, source and text deal what they are taken among themselves.

    Such rows are dealt over tasks, both where they meet what they are taken and where they are numbered; wholly equal ones are counted first and given out in runs.
    """
    scratch = scratch or Scratch(df.sparkSession)
    key = lambda id_, hash_, source: {"ki": F.coalesce(F.concat(F.lit("1"), id_.cast("string")), F.lit("0")), "kh": hash_, "ks": F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))}
    names = ["ki", "kh", "ks"]
    taken = copies(df, id_col, text_col, source_col, scratch=scratch, **settings)
    per = taken.select(*(c.alias(n) for n, c in key(F.col(id_col), F.col("hash"), F.col(source_col)).items()), "copies")
    per = scratch.save(per.groupBy(*names).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")), "per_row")
    found = per.agg(F.sum("rows"), F.max("rows"), F.max("copies")).first()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(*(c.alias(n) for n, c in key(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(source_col)).items()), row).withColumn("place", F.monotonically_increasing_id())
    joined = join_hot(rows, per.where("copies > 0").withColumn("weight", F.col("rows")), names, "weight", hot_limit(found[0] or 0), ["place"], most=found[1] or 0)
    alone = joined.where("rows = 1").select("row", F.col("copies").alias("times"))
    # equal rows are counted on the spot; the first `copies % rows` of a key's rows, in an order of their hashes, are taken once more
    alike = joined.where("rows > 1").groupBy(*names, F.xxhash64("row").alias("h1"), F.xxhash64("row", F.lit(1)).alias("h2")).agg(F.first("row").alias("row"), F.first("rows").alias("rows"), F.first("copies").alias("copies"), F.count("*").alias("n"))
    alike = alike.withColumn("part", F.pmod("h1", F.lit(PARTS)))
    before = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = alike.groupBy(*names, "part").agg(F.sum("n").alias("n")).withColumn("start", before(names, ["part"])).drop("n")  # PARTS rows a key at most
    alike = alike.withColumn("nth", before([*names, "part"], ["h1", "h2"])).join(parts, [*names, "part"])
    first, extra = F.col("start") + F.col("nth"), F.col("copies") % F.col("rows")
    more = F.greatest(F.lit(0), F.least(first + F.col("n"), extra) - F.least(first, extra))
    several = alike.select("row", (F.floor(F.col("copies") / F.col("rows")) * F.col("n") + more).cast("long").alias("times"))
    every = alone.union(several).where("times > 0").select("row", F.col("times").cast("long").alias("n"))
    return numbered(every, (found[2] or 0) > RUN, ["row"]).select("row.*")
