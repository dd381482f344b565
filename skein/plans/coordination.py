"""Queries of mailboxes, tasks, traces and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import catalog
from skein.operators import coordination as c
from skein.plans.registry import query
from skein.tables import load


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    read = F.when(F.col("event_id") % 3 == 0, F.lit(True)).when(F.col("event_id") % 3 == 1, F.lit(False))
    return e.select("event_id", F.col("user_id").alias("recipient"), "event_type", read.alias("read"))


@query("SELECT event_id, user_id AS recipient FROM events WHERE event_id % 3 <> 0")
def mailbox_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unread(mailbox(spark, sf_dir)).select("event_id", "recipient")


@query("SELECT m.n_nationkey AS message, m.n_regionkey AS sender, r.r_regionkey AS recipient FROM nation m JOIN region r ON m.n_regionkey <> r.r_regionkey")
def broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("message"), F.col("n_regionkey").alias("sender"))
    return c.broadcast(sent, load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("member"))).select("message", "sender", "recipient")


@query("SELECT event_id, user_id FROM (SELECT *, event_type = 'purchase' AND event_id % 11 = 0 AS down, bool_or(event_type = 'purchase' AND event_id % 11 = 0) OVER (PARTITION BY user_id) AS any_down FROM events) WHERE NOT any_down OR down")
def shutdown_preempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0), "shutdown_request").otherwise("message")
    return c.after_shutdown(e, "user_id", c.is_shutdown(kind, F.lit(""))).select("event_id", "user_id")


@query("SELECT n_regionkey, bool_and(CASE WHEN n_nationkey % 4 = 0 THEN false WHEN n_nationkey % 4 = 1 THEN true END IS NOT DISTINCT FROM false) AS all_idle FROM nation WHERE n_nationkey % 4 = 0 OR n_regionkey > 1 GROUP BY n_regionkey")
def all_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").where("n_nationkey % 4 = 0 OR n_regionkey > 1")
    active = F.when(F.col("n_nationkey") % 4 == 0, F.lit(False)).when(F.col("n_nationkey") % 4 == 1, F.lit(True))
    return c.all_idle(n.withColumn("is_active", active), "n_regionkey")


@query("SELECT user_id, count(*) AS n_events, arg_max(event_id % 100, event_id) AS tokens, string_agg(event_type, ',' ORDER BY event_id) FILTER (n <= 5) AS activities FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) GROUP BY user_id")
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type").withColumn("tokens", F.col("event_id") % 100)
    return c.progress(e, "user_id", "event_id", "tokens", "event_type")


@query("SELECT user_id, count(*) AS n_nodes, CAST(sum(event_id % 100) AS BIGINT) AS total_tokens FROM events GROUP BY user_id")
def trace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id").withColumn("tokens", F.col("event_id") % 100)
    return c.trace_totals(e, "user_id", "tokens")


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
  t AS (SELECT id, id AS root, 0 AS depth, id AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.parent = t.id) SELECT id, root, depth, path FROM t""")
def trace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    regions = load(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nations = load(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"))
    customers = load(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"))
    return c.trace_tree(regions.union(nations).union(customers))


@query("""WITH b AS (SELECT user_id AS path, event_id // 1000 AS snapshot, event_id AS version FROM events WHERE event_type = 'purchase'), cur AS (SELECT path, max(version) AS version FROM b GROUP BY path),
  then_ AS (SELECT path, max(version) AS v FROM b WHERE snapshot <= 4 GROUP BY path) SELECT path, CASE WHEN v IS NULL THEN 'delete' WHEN v = version THEN 'keep' ELSE 'restore' END AS action, coalesce(v, 0) AS version FROM cur LEFT JOIN then_ USING (path)""")
def rewind_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type").where("event_type = 'purchase'")
    backups = e.select(F.col("user_id").alias("path"), F.floor(F.col("event_id") / 1000).alias("snapshot"), F.col("event_id").alias("version"))
    return c.rewind(backups, backups.groupBy("path").agg(F.max("version").alias("version")), 4)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def snapshot_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.newest_snapshots(load(spark, sf_dir, "events", "user_id", "event_id"), "user_id", "event_id", 10)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' - INTERVAL 30 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.retention(load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1997-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("""SELECT user_id, CASE WHEN hours < 24 THEN 'too soon' WHEN user_id % 20 < 10 THEN 'throttled' WHEN n < 5 THEN 'too few' ELSE 'run' END AS state
  FROM (SELECT user_id, count(*) AS n, date_diff('hour', date_trunc('hour', max(ts)), date_trunc('hour', (SELECT max(ts) FROM events))) AS hours FROM events GROUP BY user_id)""")
def consolidation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "user_id", "ts")
    now = e.agg(F.date_trunc("hour", F.max("ts")).alias("now"))
    per = e.groupBy("user_id").agg(F.count("*").alias("n"), F.date_trunc("hour", F.max("ts")).alias("last")).crossJoin(F.broadcast(now))  # one row: the clock
    hours = F.floor((F.unix_timestamp("now") - F.unix_timestamp("last")) / 3600)
    return per.select("user_id", c.consolidation_gate(hours, F.col("n"), F.col("user_id") % 20).alias("state"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN a.k IS NULL THEN 'pending' WHEN a.approve THEN 'approved' ELSE 'denied' END AS state FROM orders LEFT JOIN
  (SELECT l_orderkey AS k, right(min(l_linenumber || l_returnflag), 1) = 'A' AS approve FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey) a ON k = o_orderkey""")
def correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("request_id"))
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_linenumber > 1")
    approve = F.when(F.col("l_returnflag") == "A", F.lit(True)).when(F.col("l_returnflag") == "R", F.lit(False))
    first = F.struct("l_linenumber", "l_returnflag")
    return c.correlate(requests, lines.select(F.col("l_orderkey").alias("request_id"), approve.alias("approve"), first.alias("seq"))).select("request_id", "state")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def already_surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return c.surfaced(load(spark, sf_dir, "documents", "doc_id"), labels.where("toxic = 1"), labels.where("quality = 1"), "doc_id").select("doc_id")


@query("SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where(F.col("o_orderstatus").isin("O", "P"))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a,b,c' WHEN o_orderkey % 3 = 1 THEN 'b,c' ELSE 'c,b' END AS edges FROM orders")
def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    old = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("b")))
    new = F.when(k == 2, F.array(F.lit("c"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    return load(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.array_join(catalog.append_absent(old, new), ",").alias("edges"))


@query("SELECT event_id, (event_id - 1) % 5 = 0 AS full_text FROM events")
def reminder_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_id").select("event_id", c.full_reminder(F.col("event_id")).alias("full_text"))


@query("""WITH m AS (SELECT doc_id AS seq, '/m/' || doc_id || '.md' AS path, 'f' || (doc_id % 50) || '.md' AS filename, doc_id * 11 AS mtime_ms FROM documents),
  k AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/m/' || doc_id || '.md' WHEN 1 THEN 'f' || (doc_id % 70) || '.md' ELSE 'nothing' END AS key FROM labels),
  f AS (SELECT filename, min(seq) AS seq FROM m GROUP BY filename)
  SELECT k.doc_id, coalesce(p.path, n.path) AS path, coalesce(p.mtime_ms, n.mtime_ms) AS mtime_ms FROM k LEFT JOIN m p ON p.path = k.key LEFT JOIN f ON f.filename = k.key LEFT JOIN m n ON n.seq = f.seq WHERE p.path IS NOT NULL OR n.path IS NOT NULL""")
def memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda lead, k: F.concat(F.lit(lead), k.cast("string"), F.lit(".md"))
    k = F.col("doc_id")
    memories = load(spark, sf_dir, "documents", "doc_id").select(k.alias("seq"), name("/m/", k).alias("path"), name("f", k % 50).alias("filename"), (k * 11).alias("mtime_ms"))
    chosen = load(spark, sf_dir, "labels", "doc_id").withColumn("key", F.when(k % 3 == 0, name("/m/", k)).when(k % 3 == 1, name("f", k % 70)).otherwise("nothing"))
    return c.by_path_or_name(chosen, memories).select("doc_id", "path", "mtime_ms")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'call' WHEN 'purchase' THEN 'usage' WHEN 'signup' THEN 'turn' END AS kind FROM events)
  SELECT user_id, coalesce(string_agg(event_id % 10, '' ORDER BY event_id) FILTER (kind = 'text'), '') AS result, count(*) FILTER (kind = 'turn') AS num_turns,
  coalesce(string_agg('t' || (event_id % 3) || ':' || (event_id % 5 = 0), ',' ORDER BY event_id) FILTER (kind = 'call'), '') AS tool_calls, coalesce(arg_max(event_id % 100, event_id) FILTER (kind = 'usage'), 0) AS input_tokens, coalesce(arg_max(event_id % 50, event_id) FILTER (kind = 'usage'), 0) AS output_tokens FROM e GROUP BY user_id""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    k, kind = F.col("event_id"), F.col("event_type")
    rows = e.select("user_id", "event_id", F.when(kind == "view", "text").when(kind == "click", "call").when(kind == "purchase", "usage").when(kind == "signup", "turn").alias("kind"), (k % 10).cast("string").alias("text"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("tool"), (k % 5 == 0).alias("is_error"), (k % 100).alias("tokens_in"), (k % 50).alias("tokens_out"))
    calls = F.array_join(F.transform("tool_calls", lambda x: F.concat(x["name"], F.lit(":"), x["is_error"].cast("string"))), ",")
    return c.run_summary(rows, "user_id", "event_id").withColumn("tool_calls", calls)


@query("""WITH u AS (SELECT o_custkey AS id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'paused' END, o_orderkey) FILTER (o_orderstatus IN ('F', 'P') AND o_orderkey % 4 = 0) AS status, arg_max(o_orderkey % 1000, o_orderkey) FILTER (o_orderkey % 3 = 0) AS tokens FROM orders GROUP BY 1),
  s AS (SELECT c_custkey AS id, c_nationkey AS parent, coalesce(u.status, 'running') AS status, coalesce(u.tokens, 0) AS tokens FROM customer LEFT JOIN u ON u.id = c_custkey)
  SELECT id, parent, CASE WHEN status = 'running' AND parent % 2 = 0 THEN 'completed' ELSE status END AS status, tokens FROM s""")
def trace_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("tokens"))
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    k, state = F.col("o_orderkey"), F.col("o_orderstatus")
    updates = o.select(F.col("o_custkey").alias("id"), k.alias("seq"), F.when(k % 4 == 0, F.when(state == "F", "failed").when(state == "P", "paused")).alias("status"), F.when(k % 3 == 0, k % 1000).alias("tokens"))
    done = load(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("parent"))
    return c.trace_state(nodes, updates, done).select("id", "parent", "status", "tokens")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def completed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    tasks = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    handed = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return c.completed(tasks, handed).select("id")


@query("""SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'gone' WHEN p_partkey % 5 = 1 THEN 'new' ELSE 'changed' END AS state FROM part WHERE p_partkey % 5 < 2 OR p_partkey % 7 = 0 OR p_size % 2 = 1""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files by their stamps: some are new, some gone, some have another time or another size than was known."""
    p = load(spark, sf_dir, "part", "p_partkey", "p_size")
    k, size = F.col("p_partkey"), F.col("p_size")
    now = p.where(k % 5 != 0).select(k.alias("path"), k.alias("mtime_ms"), size.alias("size"))
    known = p.where(k % 5 != 1).select(k.alias("path"), F.when(k % 7 == 0, k + 1).otherwise(k).alias("mtime_ms"), F.when(size % 2 == 1, size + 1).otherwise(size).alias("size"))
    return c.changed(now, known)
