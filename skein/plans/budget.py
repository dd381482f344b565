"""Queries of budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import budget as b
from skein.operators import transcript as t
from skein.plans.registry import query
from skein.plans.transcript import KEEP, TAIL
from skein.tables import load, messages

PREVIEW = "('[' || (length(text) // 1024) || ' KB kept]' || chr(10) || left(text, {n}) || CASE WHEN length(text) > {n} THEN chr(10) || '...' ELSE '' END)"


@query(f"SELECT doc_id, coalesce(length(text) > 5000, false) AS spilled, CASE WHEN length(text) > 5000 THEN {PREVIEW.format(n=2000)} ELSE text END AS shown FROM documents")
def spill_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.spill_single(load(spark, sf_dir, "documents", "doc_id", "text"), limit=5000).select("doc_id", "spilled", "shown")


@query(f"SELECT doc_id, {PREVIEW.format(n=100)} AS preview FROM documents")
def spill_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", b.preview(F.col("text"), 100).alias("preview"))


@query(f"""WITH d AS (SELECT doc_id, source, length(text) AS len, length(text) > 1000 AS able, CASE WHEN length(text) > 1000 THEN length(text) - length({PREVIEW.format(n=1000)}) ELSE 0 END AS saves FROM documents),
  c AS (SELECT *, sum(len) OVER (PARTITION BY source) AS total, sum(saves) OVER (PARTITION BY source ORDER BY len DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM d),
  m AS (SELECT *, greatest(0, coalesce(max(cum) OVER (PARTITION BY source ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS most FROM c)
  SELECT doc_id, source, able AND total - most > 60000 AS spilled FROM m""")
def spill_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    return b.spill_batch(rows, "source", "doc_id", limit=60_000, least=1_000).select("doc_id", "source", "spilled")


@query(f"""WITH {TAIL}, s AS (SELECT conv_id, sum(tokens) AS tokens, coalesce(sum(CASE WHEN NOT keep THEN tokens END), 0) AS prefix FROM kept GROUP BY conv_id)
  SELECT conv_id, tokens, CASE WHEN tokens < 500 THEN 'none' WHEN tokens >= 900 THEN 'force' WHEN conv_id % 4 >= 3 THEN 'tripped' WHEN prefix < 200 THEN 'short' ELSE 'compact' END AS decision FROM s""")
def compact_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = t.with_keep(messages(spark, sf_dir), **KEEP)
    sums = kept.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.when(~F.col("keep"), F.col("tokens"))), F.lit(0)).alias("prefix"))
    decision = b.compact_decision(F.col("tokens"), F.col("prefix"), 1500, soft_margin=600, hard_margin=200, answer=400, failures=F.col("conv_id") % 4, least_prefix=200)
    return sums.select("conv_id", "tokens", decision.alias("decision"))


@query("""WITH c AS (SELECT doc_id, source, CAST(sum(CAST(floor(length(text) / 3.5) AS BIGINT) + 8) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents)
  SELECT doc_id, source, used FROM c WHERE used <= 5000""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    return b.prefix_within(rows, "source", [F.desc("doc_id")], "text", budget=5_000).select("doc_id", "source", "used")


@query("""WITH f AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' OR event_id % 3 <> 0 THEN 1 ELSE 0 END AS failed FROM events),
  i AS (SELECT *, sum(1 - failed) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
  SELECT user_id, event_id, CAST(sum(failed) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak, sum(failed) OVER (PARTITION BY user_id, island ORDER BY event_id) >= 3 AS open FROM i""")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return b.failure_streak(events, "user_id", ["event_id"], (F.col("event_type") == "error") | (F.col("event_id") % 3 != 0)).select("user_id", "event_id", "streak", "open")
