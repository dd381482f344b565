"""Budgets: what is spilled, cut or compacted to fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import approx_tokens

PREVIEW_CHARS = 2_000


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    """Size in whole KB and the start of a text that is kept elsewhere."""
    head = F.concat(F.lit("["), F.floor(F.length(c) / 1024).cast("string"), F.lit(" KB kept]\n"), F.left(c, F.lit(chars)))
    return F.when(F.length(c) > chars, F.concat(head, F.lit("\n..."))).otherwise(head)


def spill_single(rows: DataFrame, text: str = "text", limit: int = 50_000, chars: int = PREVIEW_CHARS) -> DataFrame:
    """Adds spilled and shown: texts over the limit show a preview."""
    over = F.length(text) > limit
    return rows.withColumns({"spilled": F.coalesce(over, F.lit(False)), "shown": F.when(over, preview(F.col(text), chars)).otherwise(F.col(text))})


def spill_batch(rows: DataFrame, batch: str, order: str, text: str = "text", limit: int = 200_000, least: int = PREVIEW_CHARS, exempt: Column | None = None) -> DataFrame:
    """Adds spilled: in a batch over the limit the longest texts go first, until it fits.

    A preview just over `least` may be longer than its text, so the running saving may fall: spilling stops for good
    when it first suffices, hence the running maximum of what the longer ones saved.
    """
    able = (F.length(text) > least) & (F.lit(True) if exempt is None else ~exempt)
    rows = rows.withColumns({"_len": F.length(text).cast("long"), "_able": F.coalesce(able, F.lit(False))})
    rows = rows.withColumn("_saves", F.when(F.col("_able"), F.col("_len") - F.length(preview(F.col(text), least))).otherwise(0).cast("long"))
    by = W.partitionBy(batch).orderBy(F.desc("_len"), order)
    prior = by.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_total": F.sum("_len").over(W.partitionBy(batch)), "_cum": F.sum("_saves").over(by.rowsBetween(W.unboundedPreceding, 0))})
    most = F.greatest(F.lit(0), F.coalesce(F.max("_cum").over(prior), F.lit(0)))
    return rows.withColumn("spilled", F.col("_able") & (F.col("_total") - most > limit)).drop("_len", "_able", "_saves", "_total", "_cum")


def compact_threshold(window: int, answer: int = 20_000, margin: int = 13_000) -> int:
    return window - answer - margin


def compact_decision(tokens: Column, prefix_tokens: Column, window: int, soft_margin: int = 13_000, hard_margin: int = 3_000, answer: int = 20_000, failures: Column | None = None, least_prefix: int = 2_000) -> Column:
    """none below the soft threshold, force from the hard one on; between, a tripped breaker or a short prefix prevents it."""
    soft, hard = compact_threshold(window, answer, soft_margin), compact_threshold(window, answer, hard_margin)
    tripped = F.lit(False) if failures is None else failures >= 3
    return F.when(tokens < soft, "none").when(tokens >= hard, "force").when(tripped, "tripped").when(prefix_tokens < least_prefix, "short").otherwise("compact")


def prefix_within(rows: DataFrame, key: str, order: list[Column], text: str, budget: int = 25_000, extra: int = 8) -> DataFrame:
    """Rows in order until their tokens (and a fixed extra each) first exceed the budget."""
    cost = F.sum(approx_tokens(F.length(text)) + extra).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", cost).where(F.col("used") <= budget)


def failure_streak(rows: DataFrame, key: str, order: list[str], failed: Column, opens_at: int = 3) -> DataFrame:
    """Adds streak (failures in a row up to here) and open. A success starts a new island."""
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_failed", F.when(failed, 1).otherwise(0)).withColumn("_island", F.sum(1 - F.col("_failed")).over(by))
    within = W.partitionBy(key, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum("_failed").over(within).cast("long")).withColumn("open", F.col("streak") >= opens_at).drop("_failed", "_island")
