"""Session logs: JSON lines of messages and compaction markers.

Readers are permissive, with a fixed schema: blank and malformed lines, values that are no object and records without a role
are skipped; a missing time becomes the time given. Writers leave out empty fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "compact_boundary"
SCHEMA = "role string, content string, ts bigint, type string, tool_uses string, tool_results string"


def parse_lines(lines: DataFrame, now: Column, value: str = "value") -> DataFrame:
    """lines with the record's fields; content is a text or, for markers, an object's JSON."""
    record = F.from_json(F.col(value), SCHEMA, {"mode": "PERMISSIVE"})
    object_like = F.btrim(F.col(value), F.lit(" \t\r\n")).startswith("{") & F.try_parse_json(F.col(value)).isNotNull()
    rows = lines.where(object_like).withColumn("_r", record).where(F.col("_r.role").isNotNull())
    return rows.withColumns({"role": F.col("_r.role"), "content": F.coalesce("_r.content", F.lit("")), "ts": F.coalesce("_r.ts", now), "type": F.col("_r.type"), "tool_uses": F.col("_r.tool_uses"), "tool_results": F.col("_r.tool_results")}).drop("_r", value)


def read(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Records of all logs under a path, with the file they stand in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_lines(lines, now)


def to_lines(records: DataFrame, *fields: str) -> DataFrame:
    """(value): a JSON line a record; empty fields are left out."""
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c)).alias(c)
    return records.select(F.to_json(F.struct(*map(blank, fields))).alias("value"))


def to_records(messages: DataFrame, conv: str = "conv_id", order: str = "idx") -> DataFrame:
    """(conv, order, role, content, ts, tool_uses, tool_results) of messages whose blocks, an array of (type, text, id), lose their thinking."""
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    listed = lambda kind: F.when(F.size(of(kind)) > 0, F.to_json(of(kind)))
    text = F.array_join(F.transform(of("text"), lambda b: b["text"]), "\n")
    return messages.select(conv, order, "role", text.alias("content"), "ts", listed("tool_use").alias("tool_uses"), listed("tool_result").alias("tool_results"))


def marker(summaries: DataFrame, now: Column, conv: str = "conv_id") -> DataFrame:
    """(conv, role, content, ts, type): the marker record of rows (conv, summary, keep: an array of (role, content))."""
    content = F.to_json(F.struct("summary", "keep"))
    return summaries.select(conv, F.lit("system").alias("role"), content.alias("content"), now.alias("ts"), F.lit(MARKER).alias("type"))


def meta_of(records: DataFrame, conv: str = "conv_id", order: str = "idx") -> DataFrame:
    """(conv, message_count, last_active) of records: markers move the last time but are no messages."""
    plain = ~F.coalesce(F.col("type") == MARKER, F.lit(False))
    return records.groupBy(conv).agg(F.count(F.when(plain, F.lit(1))).alias("message_count"), F.max("ts").alias("last_active"))


def save_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def load_meta(spark: SparkSession, path: str, conv: str = "conv_id") -> DataFrame:
    """Rows of saved sessions, those that are no JSON left out."""
    schema = f"{conv} long, message_count long, last_active long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append(records: DataFrame, path: str, *fields: str) -> None:
    to_lines(records, *fields).write.mode("append").text(path)


def expand_markers(records: DataFrame, conv: str = "conv_id", order: str = "idx") -> DataFrame:
    """(conv, order, sub, role, content): a marker becomes its summary, as a user's message, and the messages it kept; other roles than user and assistant go."""
    marker = F.coalesce(F.col("type") == MARKER, F.lit(False))
    payload = F.from_json(F.when(marker, F.col("content")), "summary string, keep array<struct<role:string,content:string>>")
    rows = records.withColumn("_p", payload)
    kept = F.coalesce(F.col("_p.keep"), F.array().cast("array<struct<role:string,content:string>>"))
    head = F.array(F.struct(F.lit("user").alias("role"), F.coalesce("_p.summary", F.lit("")).alias("content")))
    items = F.when(marker, F.concat(head, kept)).otherwise(F.array(F.struct("role", "content")))
    out = rows.select(conv, order, F.posexplode(items).alias("sub", "item"))
    return out.select(conv, order, "sub", F.col("item.role").alias("role"), F.coalesce("item.content", F.lit("")).alias("content")).where(F.col("role").isin("user", "assistant"))


def session_list(meta: DataFrame, k: int = 10) -> DataFrame:
    """The sessions last active."""
    return meta.orderBy(F.desc("last_active"), "conv_id").limit(k)
