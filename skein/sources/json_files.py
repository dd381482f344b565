"""Mailboxes, task boards, teams and event streams as JSON, with fixed schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import keyed

MESSAGE = "from string, text string, timestamp string, read boolean, type string, requestId string, approve boolean"
TASK = "id string, title string, description string, status string, assignee string, created_by string, blocks array<string>, blocked_by array<string>"
MEMBER = "agentId string, name string, agentType string, model string, isActive boolean"


def messages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row a message of each mailbox (a JSON array); what is no array is empty."""
    rows = texts.select(key, F.posexplode(F.from_json(text, f"array<struct<{_inner(MESSAGE)}>>")).alias("seq", "m"))
    return rows.select(key, "seq", F.col("m.from").alias("sender"), F.col("m.text").alias("text"), F.to_timestamp("m.timestamp").alias("ts"), F.coalesce("m.read", F.lit(False)).alias("read"), "m.type", F.col("m.requestId").alias("request_id"), "m.approve")


def tasks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row a task of each board ``{next_id, tasks}``; unknown fields go."""
    board = F.from_json(text, f"next_id bigint, tasks array<struct<{_inner(TASK)}>>")
    return texts.select(key, F.posexplode(board["tasks"]).alias("seq", "t")).select(key, "seq", "t.*")


def members(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row a member of each team."""
    team = F.from_json(text, f"name string, leadAgentId string, members array<struct<{_inner(MEMBER)}>>")
    rows = texts.select(key, team["name"].alias("team"), F.explode(team["members"]).alias("m"))
    return rows.select(key, "team", F.col("m.agentId").alias("agent_id"), F.col("m.name").alias("name"), F.col("m.isActive").alias("is_active"))


def _inner(schema: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(","))


def to_boards(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """(key, text): a JSON array of each key's rows in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("item")))), lambda s: s["item"])
    return rows.groupBy(key).agg(F.to_json(items).alias("text"))


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object a line."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file as one text."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def spill(rows: DataFrame, path: str, key: str, batch: str | None = None) -> None:
    """Texts kept elsewhere, a row a key: what is there already stays and new keys are added. A write that is to be repeatable names its batch."""
    keyed.spill(rows, path, key, batch or uuid.uuid4().hex)


def transcripts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, role, content, tool_uses, tool_results) of transcripts (a JSON array of messages): arguments stay VARIANT, as each tool has its own. What is no array is empty, a message without role goes."""
    each = F.try_parse_json(text)
    rows = texts.select(key, F.posexplode(F.try_variant_get(each, "$", "array<variant>")).alias("idx", "m"))
    get = lambda path, kind: F.try_variant_get("m", path, kind)
    uses = get("$.tool_uses", "array<struct<tool_use_id:string,tool_name:string,arguments:variant>>")
    results = F.transform(get("$.tool_results", "array<struct<tool_use_id:string,content:string,is_error:boolean>>"), lambda r: F.struct(r["tool_use_id"].alias("tool_use_id"), r["content"].alias("content"), F.coalesce(r["is_error"], F.lit(False)).alias("is_error")))
    out = rows.select(key, "idx", get("$.role", "string").alias("role"), F.coalesce(get("$.content", "string"), F.lit("")).alias("content"), uses.alias("tool_uses"), results.alias("tool_results"))
    return out.where("role is not null")


def to_transcripts(messages: DataFrame, key: str) -> DataFrame:
    """(key, text) that transcripts() reads back: uses and results are left out where there are none."""
    one = F.to_json(F.struct("role", "content", F.when(F.size("tool_uses") > 0, F.col("tool_uses")).alias("tool_uses"), F.when(F.size("tool_results") > 0, F.col("tool_results")).alias("tool_results")))
    every = F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("m")))), lambda s: s["m"])
    return messages.groupBy(key).agg(F.concat(F.lit("["), F.array_join(every, ","), F.lit("]")).alias("text"))


def history(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of a prompt history without the blank ones."""
    return lines.where(F.btrim(F.col(value), F.lit(" \t\n\x0b\x0c\r")) != "")


def remember(prompts: DataFrame, path: str, value: str = "value") -> None:
    prompts.select(value).write.mode("append").text(path)
