"""Message histories: rows (conv_id, idx, role, content) ordered by idx within a conversation.

Every operator partitions by conversation only, so they share one exchange when composed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import approx_tokens, strip


def conv() -> WindowSpec:
    return W.partitionBy("conv_id")


def ordered() -> WindowSpec:
    return conv().orderBy("idx")


def upto() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, 0)


def before() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, -1)


def backwards() -> WindowSpec:
    return conv().orderBy(F.desc("idx"))


def session_rollup(messages: DataFrame, title_chars: int = 50) -> DataFrame:
    """Count, title (the first user text with something in it, cut) and last place of each conversation."""
    titled = F.when((F.col("role") == "user") & (strip(F.col("content")) != ""), F.struct("idx", F.left("content", F.lit(title_chars)).alias("title")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.coalesce(F.min(titled)["title"], F.lit("")).alias("title"), F.max("idx").alias("last_active"))


def token_estimates(messages: DataFrame) -> DataFrame:
    """Each message by itself: floors do not add up to the conversation's."""
    return messages.select("conv_id", "idx", approx_tokens(F.length("content")).alias("tokens"))


def conversation_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(approx_tokens(F.sum(F.length("content"))).alias("tokens"))


def with_keep(messages: DataFrame, enough_tokens: int = 10_000, enough_rows: int = 5, most_tokens: int = 40_000) -> DataFrame:
    """Adds tokens and keep: the tail that a walk from the end takes until it has enough of either, never over the most but for the last row."""
    back = backwards().rowsBetween(W.unboundedPreceding, 0)
    rows = messages.withColumn("tokens", approx_tokens(F.length("content"))).withColumns({"_sum": F.sum("tokens").over(back), "_n": F.count("*").over(back)})
    more = (F.col("_sum") - F.col("tokens") < enough_tokens) & (F.col("_n") - 1 < enough_rows) & (F.col("_sum") <= most_tokens)
    return rows.withColumn("keep", (F.col("_n") == 1) | more).drop("_sum", "_n")


def keep_tail(messages: DataFrame, **limits: int) -> DataFrame:
    return with_keep(messages, **limits).where("keep").drop("keep")


def aligned_start(kept: DataFrame, has_use: str = "has_use", has_result: str = "has_result") -> DataFrame:
    """(conv_id, start): the first kept place, moved back over pairs of a result row and the assistant row with its call.

    kept: messages with keep and the two flags. A row joins its predecessor if it is a result after a call; the run of such joins is an island.
    """
    joins = F.col(has_result) & F.coalesce(F.lag(has_use).over(ordered()), F.lit(False))
    rows = kept.withColumn("_island", F.sum(F.when(joins, 0).otherwise(1)).over(upto()))
    first = rows.groupBy("conv_id").agg(F.min(F.when(F.col("keep"), F.struct("idx", "_island"))).alias("at"))
    starts = rows.groupBy("conv_id", "_island").agg(F.min("idx").alias("start"))
    return first.join(starts, ["conv_id"]).where(F.col("_island") == F.col("at")["_island"]).select("conv_id", "start")


def merge_user_runs(messages: DataFrame, plain: Column | None = None) -> DataFrame:
    """Adjacent plain user rows become one, joined by newlines; any other row breaks the run."""
    plain = (F.col("role") == "user") if plain is None else (F.col("role") == "user") & plain
    rows = messages.withColumn("_plain", plain)
    same = F.col("_plain") & F.coalesce(F.lag("_plain").over(ordered()), F.lit(False))
    rows = rows.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(upto()))
    texts = F.array_sort(F.collect_list(F.struct("idx", "content")))
    return rows.groupBy("conv_id", "_run", "role").agg(F.min("idx").alias("idx"), F.count("*").alias("n_rows"), F.array_join(F.transform(texts, lambda s: s["content"]), "\n").alias("content")).drop("_run")


def turn_groups(messages: DataFrame, has_use: Column) -> DataFrame:
    """Adds group, from 1: one ends with each assistant row that calls no tool; a rest at the end is a group too."""
    ends = (F.col("role") == "assistant") & ~has_use
    return messages.withColumn("group", (F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before()), F.lit(0)) + 1).cast("long"))


def drop_oldest_groups(grouped: DataFrame) -> DataFrame:
    """The oldest fifth of a conversation's groups goes, one at least."""
    return grouped.withColumn("_n", F.max("group").over(conv())).where(F.col("group") > F.greatest(F.lit(1), F.floor(F.col("_n") / 5))).drop("_n")


def repair_pairs(uses: DataFrame, results: DataFrame, message: str = "No result recorded") -> DataFrame:
    """(conv_id, idx, sub, kind, id, content) with each call followed by what it gave.

    uses (conv_id, idx, id) and results (conv_id, idx, id, content). Results without a call go; a call without a result
    gets an error row right behind it, once for each id however often it stands. Ids meet over the whole history.
    """
    known = uses.select("conv_id", "id").distinct()
    kept = results.join(known, ["conv_id", "id"], "left_semi")
    missing = uses.join(results.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
    missing = missing.withColumn("_nth", F.row_number().over(W.partitionBy("conv_id", "id").orderBy("idx"))).where("_nth = 1")
    row = lambda df, sub, kind, content: df.select("conv_id", "idx", F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), "id", content.alias("content"))
    return row(uses, 0, "use", F.lit("")).union(row(kept, 0, "result", F.col("content"))).union(row(missing, 1, "synthetic", F.lit(message)))


def replay(records: DataFrame, is_marker: Column) -> DataFrame:
    """Rows from a conversation's last marker on; all rows where it has none."""
    last = F.max(F.when(is_marker, F.col("idx"))).over(conv())
    return records.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("idx") >= F.col("_last"))).drop("_last")


def last_rows(messages: DataFrame, n: int, of: Column | None = None) -> DataFrame:
    rows = messages if of is None else messages.where(of)
    return rows.withColumn("_nth", F.row_number().over(backwards())).where(F.col("_nth") <= n).drop("_nth")


def anchored_tokens(messages: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(conv_id, tokens): the last positive anchor plus an estimate of the rows behind it; without one, of all rows."""
    at = F.max(F.when(F.col(anchor) > 0, F.struct("idx", F.col(anchor).alias("value")))).over(conv())
    rows = messages.withColumn("_at", at)
    later = F.when(F.col("_at").isNull() | (F.col("idx") > F.col("_at")["idx"]), F.length("content")).otherwise(0)
    return rows.groupBy("conv_id").agg((F.coalesce(F.max(F.col("_at")["value"]), F.lit(0)) + approx_tokens(F.sum(later))).alias("tokens"))


def running_totals(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return events.withColumn("running", F.sum(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def contains_marker(messages: DataFrame, text: str) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.coalesce(F.bool_or((F.col("role") == "user") & F.contains("content", F.lit(text))), F.lit(False)).alias("found"))


def serialize_flat(messages: DataFrame, uses: DataFrame, results: DataFrame) -> DataFrame:
    """One message as several items: its text, then its calls, then outputs: (conv_id, idx, item, type, body)."""
    text = messages.where(F.col("content") != "").select("conv_id", "idx", F.lit(0).alias("item"), F.lit("message").alias("type"), F.col("content").alias("body"))
    calls = uses.select("conv_id", "idx", F.lit(1).alias("item"), F.lit("function_call").alias("type"), F.col("id").alias("body"))
    outputs = results.select("conv_id", "idx", F.lit(2).alias("item"), F.lit("function_call_output").alias("type"), F.col("id").alias("body"))
    return text.union(calls).union(outputs)


def fold_stream(deltas: DataFrame, key: str = "call_id", order: str = "seq", piece: str = "piece") -> DataFrame:
    """Arguments of each call from its fragments in order; what is no JSON becomes an empty object."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda s: s[piece])
    whole = deltas.groupBy(key).agg(F.array_join(parts, "").alias("arguments"))
    return whole.withColumn("arguments", F.when(F.try_parse_json("arguments").isNotNull() & (F.col("arguments") != ""), F.col("arguments")).otherwise("{}"))


def serialize_blocks(messages: DataFrame, uses: DataFrame, results: DataFrame) -> DataFrame:
    """One item a message, its blocks as one JSON array in body: (conv_id, idx, item, type, body). Results stand in a user's message, calls in an assistant's."""
    text = messages.where(F.col("content") != "").select("conv_id", "idx", "role", F.lit(0).alias("at"), F.lit("").alias("by"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("block"))
    block = lambda df, role, at, kind, name: df.select("conv_id", "idx", F.lit(role).alias("role"), F.lit(at).alias("at"), F.col("id").alias("by"), F.to_json(F.struct(F.lit(kind).alias("type"), F.col("id").alias(name))).alias("block"))
    blocks = text.union(block(uses, "assistant", 1, "tool_use", "id")).union(block(results, "user", 2, "tool_result", "tool_use_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "by", "block"))), lambda s: s["block"]), ",")
    return blocks.groupBy("conv_id", "idx", "role").agg(joined.alias("b")).select("conv_id", "idx", F.lit(0).alias("item"), F.col("role").alias("type"), F.concat(F.lit("["), "b", F.lit("]")).alias("body"))


def serialize_chat(messages: DataFrame, uses: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, idx, item, type, body): an assistant's calls ride in its message, each result is a message of its own, and a message with results has no other."""
    calls = uses.groupBy("conv_id", "idx").agg(F.array_sort(F.collect_list("id")).alias("calls"))
    plain = messages.join(results.select("conv_id", "idx").distinct(), ["conv_id", "idx"], "left_anti").join(calls, ["conv_id", "idx"], "left")
    body = F.to_json(F.struct("content", F.col("calls").alias("tool_calls")))
    rows = plain.select("conv_id", "idx", F.lit(0).alias("item"), F.col("role").alias("type"), body.alias("body"))
    nth = F.row_number().over(W.partitionBy("conv_id", "idx").orderBy("id"))
    return rows.union(results.select("conv_id", "idx", (nth - 1).alias("item"), F.lit("tool").alias("type"), F.to_json(F.struct(F.col("id").alias("tool_call_id"), "content")).alias("body")))


PROTOCOLS = {"openai": serialize_flat, "openai-compat": serialize_chat}


def serialize(messages: DataFrame, uses: DataFrame, results: DataFrame, protocol: str = "anthropic") -> DataFrame:
    """(conv_id, idx, item, type, body) as a protocol wants it; an unknown one gets blocks."""
    return PROTOCOLS.get(protocol, serialize_blocks)(messages, uses, results)


def mark_cached_tail(messages: DataFrame) -> DataFrame:
    """messages with cached: the last user row of each conversation, whose last block the provider may cache up to."""
    last = F.max(F.when(F.col("role") == "user", F.col("idx"))).over(conv())
    return messages.withColumn("cached", F.coalesce((F.col("role") == "user") & (F.col("idx") == last), F.lit(False)))


def inject(messages: DataFrame, environment: DataFrame, memory: DataFrame) -> DataFrame:
    """(conv_id, idx, role, content) with a conversation's environment first and its memory next, each once, and all rows numbered anew from 0.

    environment and memory: (conv_id, content), a row a conversation.
    """
    row = lambda df, part: df.select("conv_id", F.lit(part).alias("part"), F.lit(0).cast("long").alias("idx"), F.lit("user").alias("role"), "content")
    every = row(environment, 0).union(row(memory, 1)).union(messages.select("conv_id", F.lit(2).alias("part"), F.col("idx").cast("long"), "role", "content"))
    nth = F.row_number().over(conv().orderBy("part", "idx"))
    return every.select("conv_id", (nth - 1).alias("idx"), "role", "content")


def since_cursor(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """(conv_id, seen, text): of each conversation the rows behind its cursor (conv_id, seen: rows handled so far, none at first) as lines, and the new cursor.

    Rows without a text or of other roles give no line; a conversation without lines keeps its cursor and gives no row.
    """
    nth = F.row_number().over(ordered())
    numbered = messages.withColumns({"_n": nth, "_all": F.count("*").over(conv())}).join(cursors, "conv_id", "left")
    new = numbered.where((F.col("_n") > F.coalesce("seen", F.lit(0))) & (F.col("content") != "") & F.col("role").isin("user", "assistant"))
    line = F.struct("_n", F.concat(F.lit("["), "role", F.lit("]: "), "content").alias("line"))
    found = new.groupBy("conv_id").agg(F.max("_all").alias("seen"), F.array_sort(F.collect_list(line)).alias("lines"))
    return found.select("conv_id", "seen", F.array_join(F.transform("lines", lambda s: s["line"]), "").alias("text"))
