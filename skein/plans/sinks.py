"""Queries of what is written and read again, of typed calls, skills and streams: inputs from the tables, files in the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import typed
from skein.operators import catalog
from skein.plans.registry import query
from skein.plans.rules import made
from skein.sources import files, json_files, keyed, skills
from skein.streaming import hooks, state
from skein.tables import load, new_folder


@query("SELECT user_id AS key, CASE WHEN min(event_id) FILTER (event_type = 'view') IS NOT NULL THEN 'view ' || min(event_id) FILTER (event_type = 'view') ELSE 'click ' || min(event_id) FILTER (event_type = 'click') END AS text FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def spill_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are spilled first, then clicks: those of users that have a text already stay out."""
    e, folder = load(spark, sf_dir, "events", "event_id", "user_id", "event_type"), new_folder(spark)
    for kind in ("view", "click"):
        rows = e.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.format_string(f"{kind} %d", "event_id").alias("text"), "event_id")
        keyed.spill(rows, folder, "key", kind, order=["event_id"], buckets=8)
    return keyed.spilled(spark, folder, "key long, text string, event_id long").select("key", "text")


@query("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase', event_id) AS version FROM events WHERE event_type IN ('purchase', 'error'))
  SELECT '/u/' || user_id AS path, event_id AS seq, version, substr(sha256('/u/' || user_id), 1, 16) || '@v' || version AS name FROM v""")
def backup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes of edits, the second one twice."""
    e, folder = load(spark, sf_dir, "events", "event_id", "user_id", "event_type"), new_folder(spark)
    for kind in ("error", "purchase", "purchase"):
        edits = e.where(F.col("event_type") == kind).select(F.format_string("/u/%d", "user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
        keyed.back_up(edits, folder, kind, buckets=8)
    return keyed.backups(spark, folder).select("path", "seq", "version", "name")


@query("""WITH m AS (SELECT CASE p_size % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'feedback' WHEN 2 THEN 'project' ELSE 'reference' END AS type, p_name AS name, coalesce(max(p_partkey) FILTER (p_partkey % 2 = 1), max(p_partkey)) AS seq FROM part GROUP BY ALL)
  SELECT type, type || '/' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.md' AS file, '- [' || name || '](' || type || '/' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.md): kept as ' || seq AS line FROM m""")
def memory_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories in folders by type, in two writes of which the later counts; an index line each."""
    folder = new_folder(spark)
    kind = "CASE p_size % 5 WHEN 0 THEN ' User' WHEN 1 THEN 'feedback' WHEN 2 THEN 'PROJECT' WHEN 3 THEN p_brand ELSE '' END"
    rows = made(spark, sf_dir, name="p_name", description="'kept as ' || p_partkey", type=kind, body="p_type", seq="p_partkey")
    for half in (0, 1):
        keyed.write_memories(rows.where(F.col("p_partkey") % 2 == half).drop("p_partkey"), folder)
    return keyed.index_lines(keyed.read_memories(spark, folder))


@query("SELECT p_name AS name, max(p_partkey) AS seq FROM part WHERE p_size % 5 = 1 GROUP BY p_name")
def memory_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder alone, by name: only its partition is read."""
    folder = new_folder(spark)
    kind = "CASE p_size % 5 WHEN 1 THEN 'feedback' ELSE 'user' END"
    keyed.write_memories(made(spark, sf_dir, name="p_name", description="p_brand", type=kind, body="p_type", seq="p_partkey").drop("p_partkey"), folder)
    return keyed.read_memories(spark, folder, flat="feedback").select("name", "seq")


@query("SELECT event_id, user_id, event_type FROM events")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, appended and read again."""
    folder = new_folder(spark)
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    for part in (0, 1):
        json_files.write_events(e.where(F.col("event_id") % 2 == part), folder)
    return spark.read.schema("event_id long, user_id long, event_type string").json(folder)


@query("SELECT s_nationkey AS team_key, 'team ' || s_nationkey AS team, 'a' || s_suppkey AS agent_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 3 = 1 END AS is_active FROM supplier")
def team_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name")
    k = F.col("s_suppkey")
    member = F.struct(F.format_string("a%d", k).alias("agentId"), F.col("s_name").alias("name"), F.when(k % 3 != 0, k % 3 == 1).alias("isActive"))
    text = F.to_json(F.struct(F.format_string("team %d", "s_nationkey").alias("name"), F.collect_list(member).alias("members")))
    return json_files.members(s.groupBy(F.col("s_nationkey").alias("team_key")).agg(text.alias("text")), "team_key")


@query("""SELECT conv_id, CAST(turn AS INT) AS idx, role, text AS content, CASE WHEN role = 'assistant' THEN 'conv ' || conv_id || ' turn ' || turn END AS argument, CASE WHEN role = 'user' AND turn % 2 = 0 THEN turn % 3 = 0 END AS failed FROM conversations WHERE role IN ('user', 'assistant')""")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcripts and read again: a nested argument by its path, an error by its flag."""
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where(F.col("role").isin("user", "assistant"))
    argument = F.parse_json(F.to_json(F.struct(F.struct(F.array(F.format_string("conv %d turn %d", "conv_id", "turn")).alias("values")).alias("deep"))))
    use = F.struct(F.lit("t").alias("tool_use_id"), F.lit("Bash").alias("tool_name"), argument.alias("arguments"))
    result = F.struct(F.lit("t").alias("tool_use_id"), F.lit("out").alias("content"), (F.col("turn") % 3 == 0).alias("is_error"))
    rows = rows.select("conv_id", F.col("turn").alias("idx"), "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.array(use)).alias("tool_uses"), F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), F.array(result)).alias("tool_results"))
    read = json_files.transcripts(json_files.to_transcripts(rows, "conv_id"), "conv_id")
    at = F.dense_rank().over(W.partitionBy("conv_id").orderBy("idx"))
    order = rows.select("conv_id", F.col("idx").alias("turn"), (at - 1).alias("idx"))
    deep = F.try_variant_get(F.get("tool_uses", F.lit(0))["arguments"], "$.deep.values[0]", "string")
    return read.join(order, ["conv_id", "idx"]).select("conv_id", F.col("turn").cast("int").alias("idx"), "role", "content", deep.alias("argument"), F.get("tool_results", F.lit(0))["is_error"].alias("failed"))


LISTED = {
    "path": "CASE p_size % 6 WHEN 0 THEN '/w/.git/' WHEN 1 THEN '/w/src/node_modules/' WHEN 2 THEN '/w/distant/' ELSE '/w/' END || p_type || '/' || p_partkey",
    "mtime_ms": "p_size * 1000",
}


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY mtime_ms DESC, path) AS place FROM (SELECT p_partkey, {LISTED['path']} AS path, {LISTED['mtime_ms']} AS mtime_ms, p_size FROM part) WHERE p_size % 6 NOT IN (0, 1) ORDER BY place LIMIT 100")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest files outside skipped folders: a distributed top-k, whose few rows are numbered."""
    newest = files.listing(made(spark, sf_dir, **LISTED), "/w").limit(100)
    return newest.select("p_partkey", F.expr("row_number() OVER (ORDER BY mtime_ms DESC, path)").cast("long").alias("place"))


@query("SELECT o_custkey AS path, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"))
    return files.first_of_each_path(parts, "path", "seq")


@query("SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN length(p_name) ELSE 0 END + CASE WHEN contains(p_type, 'PROMO') THEN 7 ELSE 0 END AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25")
def search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's search with another scorer."""
    scorer = lambda name, text, wanted: F.when(name.startswith(wanted), F.length(name)).otherwise(0) + F.when(F.contains(text, F.lit("PROMO")), 7).otherwise(0)
    return catalog.search(load(spark, sf_dir, "part", "p_partkey", "p_name", "p_type"), "red", "p_name", "p_type", "p_partkey", 25, scorer).select("p_partkey", "score")


CALL_SCHEMA = {
    "type": "object", "required": ["name"],
    "properties": {
        "name": {"type": "string"}, "size": {"type": "integer"}, "price": {"type": "number"}, "tags": {"type": "array", "items": {"type": "string"}},
        "boxes": {"type": "array", "items": {"type": "object", "required": ["label"], "properties": {"label": {"type": "string"}, "counts": {"type": "array", "items": {"type": "integer"}}}}},
    },
}


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN 'size: no integer' WHEN k = 2 THEN 'name: missing' WHEN k = 3 THEN 'boxes[0].label: missing' WHEN k = 4 THEN 'arguments: no JSON' END AS error, CASE WHEN k IN (0, 5, 6) THEN p_name END AS name,
  CASE WHEN k IN (0, 5, 6) THEN p_size::BIGINT END AS size, CASE WHEN k IN (0, 5, 6) THEN p_brand END AS tag, CASE WHEN k IN (0, 5, 6) THEN p_type END AS label, CASE WHEN k IN (0, 5, 6) THEN p_size + 1 END AS second FROM (SELECT *, p_partkey % 7 AS k FROM part)""")
def typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of a whole table, typed by a JSON schema that is known when the query runs."""
    typed.register(spark)
    k = F.col("p_partkey") % 7
    p = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    box = F.struct(F.when(k != 3, F.col("p_type")).alias("label"), F.array("p_size", F.col("p_size") + 1).alias("counts"))
    good = F.struct(F.when(k != 2, F.col("p_name")).alias("name"), F.col("p_size").alias("size"), F.array("p_brand", F.lit("x")).alias("tags"), F.array(box).alias("boxes"))
    text = F.when(k == 1, F.regexp_replace(F.to_json(good), '"size":([0-9]+)', '"size":"$1"')).when(k == 4, F.col("p_name")).otherwise(F.to_json(good))
    p.select("p_partkey", text.alias("arguments")).createOrReplaceTempView("skein_typed_calls")
    return spark.sql(
        "SELECT p_partkey, t.error, t.name, t.size, t.tags[0] AS tag, t.boxes[0].label AS label, t.boxes[0].counts[1] AS second FROM skein_typed_calls, LATERAL typed_arguments(arguments, :schema) AS t",
        args={"schema": json.dumps(CALL_SCHEMA)},
    )


SKILLS = [
    ("/s/review.md", "---\nname: review-code\ndescription: >\n  looks at\n  code\ncontext: fork\n---\nReview $ARGUMENTS with 'care'.", 0),
    ("/s/note.md", "---\nname: note\n---\nWrite it down.", 0),
]


@query("""SELECT p_partkey, CASE k WHEN 0 THEN 'fork' WHEN 1 THEN 'inline' END AS mode, CASE WHEN k = 0 THEN 'Review ' || p_name || '''s '' || ' || p_type || ' with ''care''.' WHEN k = 1 AND p_size % 4 = 0 THEN 'Write it down.' WHEN k = 1 THEN 'Write it down.' || chr(10) || chr(10) || p_name || '''s '' || ' || p_type END AS prompt
  FROM (SELECT *, p_partkey % 3 AS k FROM part)""")
def skill_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills called as SQL functions over a table; their files are the only literal texts."""
    known = skills.load_skills(spark.createDataFrame(SKILLS, "path string, content string, mtime_ms long"))
    skills.register_skills(spark, known)
    calls = made(spark, sf_dir, name="CASE p_partkey % 3 WHEN 0 THEN 'Review-Code' WHEN 1 THEN 'note' ELSE p_name END", arguments="CASE WHEN p_partkey % 3 = 1 AND p_size % 4 = 0 THEN ' ' ELSE p_name || '''s '' || ' || p_type END")
    return skills.run_skills(calls, known).select("p_partkey", "mode", "prompt")


@query("""WITH m AS (SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'signup'), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), d AS (SELECT user_id, max(event_id) AS last FROM m WHERE event_type = 'error' AND event_id % 50 = 3 GROUP BY user_id)
  SELECT m.user_id AS recipient, event_id AS seq FROM m JOIN p USING (user_id) LEFT JOIN d USING (user_id) WHERE last IS NULL OR event_id = last""")
def mailbox_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a stream, handed over when their user polls (a signup): a shutdown request pre-empts the rest."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(key), new_folder(spark)
    state.use_rocksdb(spark)
    try:
        columns = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        rows = spark.readStream.schema(columns).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
        down = (F.col("event_type") == "error") & (F.col("event_id") % 50 == 3)
        kind = F.when(F.col("event_type") == "signup", "poll").when(down, state.SHUTDOWN_KIND).otherwise("text")
        mail = rows.select(F.col("user_id").cast("string").alias("recipient"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit("lead").alias("sender"), F.col("props").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
        got = state.consume(mail, idle_ms=1 << 45)  # no timer within the table's time
        query = got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(state.INBOX_OUT).parquet(f"{folder}/out").select(F.col("recipient").cast("long").alias("recipient"), "seq")


EFFECT_HOOKS = [
    {"id": "tell", "event": "click", "condition": "args.k =~ /^[1-4]/", "action": {"type": "prompt", "message": "$EVENT of $TOOL_NAME: $ARGUMENTS"}},
    {"id": "send", "event": "purchase", "action": {"type": "http", "url": "http://hooks/$TOOL_NAME", "body": "$ARGUMENTS", "method": "PUT"}},
    {"id": "run", "event": "click", "condition": "tool == u7", "action": {"type": "command", "command": "note $TOOL_NAME"}},
]


@query("""WITH e AS (SELECT event_id, event_id % 3 AS epoch, event_type, 'u' || user_id AS tool, props, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events)
  SELECT event_id, epoch, 'tell' AS hook_id, 'prompt' AS kind, NULL AS target, event_type || ' of ' || tool || ': ' || props AS text, NULL AS method FROM e WHERE event_type = 'click' AND regexp_matches(k, '^[1-4]')
  UNION ALL SELECT event_id, epoch, 'send', 'http', 'http://hooks/' || tool, props, 'PUT' FROM e WHERE event_type = 'purchase' UNION ALL SELECT event_id, epoch, 'run', 'command', NULL, 'note ' || tool, NULL FROM e WHERE event_type = 'click' AND tool = 'u7'""")
def hook_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of events in three epochs, the second one twice, as after a failure: each is kept once."""
    folder = new_folder(spark)
    e = load(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props").withColumn("tool", F.format_string("u%d", "user_id"))
    handle = hooks.with_effects(lambda batch, epoch: None, EFFECT_HOOKS, folder, "event_type", "tool", "props", ("event_id",))
    for epoch in (0, 1, 1, 2):
        handle(e.where(F.col("event_id") % 3 == epoch), epoch)
    return hooks.kept_effects(spark, folder, f"event_id long, {hooks.EFFECT}").drop("nth")


@query("""SELECT '/u/' || user_id AS path, max(event_id) AS mtime_ms, 'new' AS state FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of a file a user, an error deleting it: what one run of the stream says to load."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(key), new_folder(spark)
    state.use_rocksdb(spark)
    try:
        columns = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        rows = spark.readStream.schema(columns).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
        listing = rows.select(F.format_string("/u/%d", "user_id").alias("path"), F.col("event_id").alias("mtime_ms"), F.lit(1).cast("long").alias("size"), (F.col("event_type") == "error").alias("deleted"))
        query = state.watch(listing).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(state.WATCH_OUT).parquet(f"{folder}/out").select("path", "mtime_ms", "state")
