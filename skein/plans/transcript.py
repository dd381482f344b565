"""Queries of message histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import transcript as t
from skein.plans.registry import query
from skein.tables import load, messages

MSG = "msg AS (SELECT conv_id, turn AS idx, role, coalesce(text, '') AS content FROM conversations WHERE role IN ('user', 'assistant'))"
#: conversations hold no tool blocks: ids of calls and results follow from conversation and turn.
USES = "uses AS (SELECT conv_id, idx, conv_id * 1000 + idx AS id FROM msg WHERE role = 'assistant' AND (conv_id + idx) % 2 = 0)"
RESULTS = """results AS (SELECT conv_id, idx, conv_id * 1000 + idx - 1 AS id, content FROM msg WHERE role = 'user' AND (conv_id + idx) % 3 <> 0
  UNION ALL SELECT conv_id, idx, conv_id * 1000 + 500 + idx AS id, content FROM msg WHERE role = 'user' AND idx % 5 = 0)"""


def derived_uses(m: DataFrame) -> DataFrame:
    return m.where((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("idx")) % 2 == 0)).select("conv_id", "idx", (F.col("conv_id") * 1000 + F.col("idx")).alias("id"))


def derived_results(m: DataFrame) -> DataFrame:
    users = m.where(F.col("role") == "user")
    answers = users.where((F.col("conv_id") + F.col("idx")) % 3 != 0).select("conv_id", "idx", (F.col("conv_id") * 1000 + F.col("idx") - 1).alias("id"), "content")
    strays = users.where(F.col("idx") % 5 == 0).select("conv_id", "idx", (F.col("conv_id") * 1000 + 500 + F.col("idx")).alias("id"), "content")
    return answers.union(strays)


@query(f"WITH {MSG} SELECT conv_id, idx, role, content FROM msg")
def resume_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir)


@query(f"""WITH {MSG} SELECT conv_id, count(*) AS message_count,
  coalesce(arg_min(left(content, 50), idx) FILTER (role = 'user' AND trim(content, E' \\t\\n\\x0b\\x0c\\r') <> ''), '') AS title, max(idx) AS last_active FROM msg GROUP BY conv_id""")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.session_rollup(messages(spark, sf_dir))


@query(f"WITH {MSG} SELECT conv_id, idx, CAST(floor(length(content) / 3.5) AS BIGINT) AS tokens FROM msg")
def token_per_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.token_estimates(messages(spark, sf_dir))


@query(f"WITH {MSG} SELECT conv_id, CAST(floor(sum(length(content)) / 3.5) AS BIGINT) AS tokens FROM msg GROUP BY conv_id")
def token_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.conversation_tokens(messages(spark, sf_dir))


KEEP = {"enough_tokens": 300, "enough_rows": 4, "most_tokens": 700}
TAIL = f"""{MSG}, tok AS (SELECT *, CAST(floor(length(content) / 3.5) AS BIGINT) AS tokens FROM msg),
  back AS (SELECT *, sum(tokens) OVER w AS s, count(*) OVER w AS n FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING)),
  kept AS (SELECT *, n = 1 OR (s - tokens < 300 AND n - 1 < 4 AND s <= 700) AS keep FROM back)"""


@query(f"WITH {TAIL} SELECT conv_id, idx, role, tokens FROM kept WHERE keep")
def keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.keep_tail(messages(spark, sf_dir), **KEEP).select("conv_id", "idx", "role", "tokens")


@query(f"WITH {MSG}, last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS n FROM msg WHERE role = 'user') SELECT conv_id, idx, left(content, 200) AS digest FROM last WHERE n <= 2")
def last_user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.last_rows(messages(spark, sf_dir), 2, F.col("role") == "user").select("conv_id", "idx", F.left("content", F.lit(200)).alias("digest"))


@query(f"""WITH {TAIL}, flags AS (SELECT *, role = 'assistant' AND (conv_id + idx) % 2 = 0 AS has_use, role = 'user' AND (conv_id + idx) % 3 <> 0 AS has_result FROM kept),
  runs AS (SELECT *, sum(CASE WHEN has_result AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY idx) AS island
    FROM (SELECT *, lag(has_use) OVER (PARTITION BY conv_id ORDER BY idx) AS prev FROM flags)),
  firsts AS (SELECT conv_id, arg_min(island, idx) AS island FROM runs WHERE keep GROUP BY conv_id)
  SELECT r.conv_id, min(r.idx) AS start FROM runs r JOIN firsts USING (conv_id, island) GROUP BY r.conv_id""")
def aligned_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = t.with_keep(messages(spark, sf_dir), **KEEP)
    use = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("idx")) % 2 == 0)
    result = (F.col("role") == "user") & ((F.col("conv_id") + F.col("idx")) % 3 != 0)
    return t.aligned_start(kept.withColumns({"has_use": use, "has_result": result}))


@query(f"""WITH {MSG}, flagged AS (SELECT *, role = 'user' AND idx % 4 <> 3 AS plain FROM msg),
  marked AS (SELECT *, sum(CASE WHEN plain AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY idx) AS run
    FROM (SELECT *, lag(plain) OVER (PARTITION BY conv_id ORDER BY idx) AS prev FROM flagged))
  SELECT conv_id, role, min(idx) AS idx, count(*) AS n_rows, string_agg(content, chr(10) ORDER BY idx) AS content FROM marked GROUP BY conv_id, run, role""")
def merge_user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.merge_user_runs(messages(spark, sf_dir), F.col("idx") % 4 != 3).select("conv_id", "role", "idx", "n_rows", "content")


GROUPS = f"""{MSG}, grouped AS (SELECT *, CAST(coalesce(sum(CASE WHEN role = 'assistant' AND idx % 3 <> 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS grp FROM msg)"""


@query(f'WITH {GROUPS} SELECT conv_id, idx, grp AS "group" FROM grouped')
def turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.turn_groups(messages(spark, sf_dir), F.col("idx") % 3 == 0).select("conv_id", "idx", "group")


@query(f'WITH {GROUPS} SELECT conv_id, idx, grp AS "group" FROM (SELECT *, max(grp) OVER (PARTITION BY conv_id) AS n FROM grouped) WHERE grp > greatest(1, n // 5)')
def drop_oldest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.drop_oldest_groups(t.turn_groups(messages(spark, sf_dir), F.col("idx") % 3 == 0)).select("conv_id", "idx", "group")


@query(f"""WITH {MSG}, {USES}, {RESULTS},
  missing AS (SELECT conv_id, min(idx) AS idx, id FROM uses u WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.conv_id = u.conv_id AND r.id = u.id) GROUP BY conv_id, id)
  SELECT conv_id, idx, 0 AS sub, 'use' AS kind, id, '' AS content FROM uses
  UNION ALL SELECT conv_id, idx, 0, 'result', id, content FROM results r WHERE EXISTS (SELECT 1 FROM uses u WHERE u.conv_id = r.conv_id AND u.id = r.id)
  UNION ALL SELECT conv_id, idx, 1, 'synthetic', id, 'No result recorded' FROM missing""")
def pairing_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return t.repair_pairs(derived_uses(m), derived_results(m))


@query(f"""WITH {MSG} SELECT conv_id, idx, role FROM (SELECT *, max(CASE WHEN idx % 4 = 2 AND role = 'assistant' THEN idx END) OVER (PARTITION BY conv_id) AS last FROM msg) WHERE last IS NULL OR idx >= last""")
def replay_from_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.replay(messages(spark, sf_dir), (F.col("idx") % 4 == 2) & (F.col("role") == "assistant")).select("conv_id", "idx", "role")


@query(f"""WITH {MSG}, a AS (SELECT *, CASE WHEN role = 'assistant' AND idx % 3 = 1 THEN 100 * idx ELSE 0 END AS anchor FROM msg),
  anchors AS (SELECT conv_id, max(idx) AS i, arg_max(anchor, idx) AS v FROM a WHERE anchor > 0 GROUP BY conv_id)
  SELECT a.conv_id, coalesce(max(v), 0) + CAST(floor(sum(CASE WHEN i IS NULL OR idx > i THEN length(content) ELSE 0 END) / 3.5) AS BIGINT) AS tokens FROM a LEFT JOIN anchors USING (conv_id) GROUP BY a.conv_id""")
def anchored_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when((F.col("role") == "assistant") & (F.col("idx") % 3 == 1), 100 * F.col("idx")).otherwise(0)
    return t.anchored_tokens(messages(spark, sf_dir).withColumn("anchor", anchor))


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT user_id, event_id, CAST(event_id % 97 AS BIGINT) AS value FROM events)")
def usage_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", "user_id", "event_id").withColumn("value", F.col("event_id") % 97)
    return t.running_totals(events, "user_id", "event_id", "value").select("user_id", "event_id", "running")


@query(f"WITH {MSG} SELECT conv_id, coalesce(bool_or(role = 'user' AND contains(content, 'the')), false) AS found FROM msg GROUP BY conv_id")
def history_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.contains_marker(messages(spark, sf_dir), "the")


@query(f"""WITH {MSG}, {USES}, {RESULTS} SELECT conv_id, idx, 0 AS item, 'message' AS type, content AS body FROM msg WHERE content <> ''
  UNION ALL SELECT conv_id, idx, 1, 'function_call', CAST(id AS VARCHAR) FROM uses UNION ALL SELECT conv_id, idx, 2, 'function_call_output', CAST(id AS VARCHAR) FROM results""")
def serialize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    as_text = lambda df: df.withColumn("id", F.col("id").cast("string"))
    return t.serialize_flat(m, as_text(derived_uses(m)), as_text(derived_results(m)))


@query("""WITH d AS (SELECT event_id // 4 AS call_id, event_id % 4 AS seq, CASE event_id % 4 WHEN 0 THEN '{"k":' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN ',"u":1' ELSE CASE WHEN event_id % 5 = 0 THEN '' ELSE '}' END END AS piece FROM events),
  j AS (SELECT call_id, string_agg(piece, '' ORDER BY seq) AS w FROM d GROUP BY call_id) SELECT call_id, CASE WHEN json_valid(w) THEN w ELSE '{}' END AS arguments FROM j""")
def fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id")
    n = F.col("event_id") % 4
    piece = F.when(n == 0, '{"k":').when(n == 1, F.col("event_id").cast("string")).when(n == 2, ',"u":1').when(F.col("event_id") % 5 == 0, "").otherwise("}")
    return t.fold_stream(e.select(F.floor(F.col("event_id") / 4).cast("long").alias("call_id"), n.alias("seq"), piece.alias("piece")))


TEXT_IDS = """u AS (SELECT conv_id, idx, CAST(id AS VARCHAR) AS id FROM uses), r AS (SELECT conv_id, idx, CAST(id AS VARCHAR) AS id, content FROM results)"""


@query(f"""WITH {MSG}, {USES}, {RESULTS}, {TEXT_IDS},
  b AS (SELECT conv_id, idx, role, 0 AS p, '' AS k, json_object('type', 'text', 'text', content) AS b FROM msg WHERE content <> '' UNION ALL SELECT conv_id, idx, 'assistant', 1, id, json_object('type', 'tool_use', 'id', id) FROM u
    UNION ALL SELECT conv_id, idx, 'user', 2, id, json_object('type', 'tool_result', 'tool_use_id', id) FROM r),
  c AS (SELECT conv_id, idx, list(id ORDER BY id) AS calls FROM u GROUP BY ALL)
  SELECT 'anthropic' AS protocol, conv_id, idx, 0 AS item, role AS type, '[' || string_agg(CAST(b AS VARCHAR), ',' ORDER BY p, k) || ']' AS body FROM b GROUP BY conv_id, idx, role
  UNION ALL SELECT 'openai-compat', m.conv_id, m.idx, 0, role, CAST(CASE WHEN calls IS NULL THEN json_object('content', content) ELSE json_object('content', content, 'tool_calls', calls) END AS VARCHAR) FROM msg m LEFT JOIN c ON c.conv_id = m.conv_id AND c.idx = m.idx
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = m.conv_id AND r.idx = m.idx)
  UNION ALL SELECT 'openai-compat', conv_id, idx, CAST(row_number() OVER (PARTITION BY conv_id, idx ORDER BY id) - 1 AS INTEGER), 'tool', CAST(json_object('tool_call_id', id, 'content', content) AS VARCHAR) FROM r
  UNION ALL SELECT 'openai', conv_id, idx, 0, 'message', content FROM msg WHERE content <> '' UNION ALL SELECT 'openai', conv_id, idx, 1, 'function_call', id FROM u UNION ALL SELECT 'openai', conv_id, idx, 2, 'function_call_output', id FROM r""")
def serialize_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    as_text = lambda df: df.withColumn("id", F.col("id").cast("string"))
    uses, results = as_text(derived_uses(m)), as_text(derived_results(m))
    out = None
    for protocol in ("anthropic", "openai", "openai-compat"):
        rows = t.serialize(m, uses, results, protocol).select(F.lit(protocol).alias("protocol"), "conv_id", "idx", "item", "type", "body")
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {MSG} SELECT conv_id, idx, coalesce(idx = max(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY conv_id) AND role = 'user', false) AS cached FROM msg")
def cached_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.mark_cached_tail(messages(spark, sf_dir)).select("conv_id", "idx", "cached")


@query(f"""WITH {MSG}, c AS (SELECT DISTINCT conv_id FROM msg), e AS (SELECT conv_id, 0 AS part, 0 AS idx, 'user' AS role, 'at ' || conv_id AS content FROM c UNION ALL SELECT conv_id, 1, 0, 'user', 'known' FROM c WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, 2, idx, role, content FROM msg)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, idx) - 1 AS idx, role, content FROM e""")
def inject_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is told where it is, and those that have a memory what is known."""
    m = messages(spark, sf_dir)
    every = m.select("conv_id").distinct()
    return t.inject(m, every.withColumn("content", F.concat(F.lit("at "), F.col("conv_id").cast("string"))), every.where(F.col("conv_id") % 3 != 0).withColumn("content", F.lit("known")))


@query(f"""WITH {MSG}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS n, count(*) OVER (PARTITION BY conv_id) AS every FROM msg)
  SELECT conv_id, max(every) AS seen, string_agg('[' || role || ']: ' || content, '' ORDER BY n) AS text FROM n WHERE n > CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 3 END AND content <> '' GROUP BY conv_id""")
def extraction_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the conversations have no cursor yet."""
    m = messages(spark, sf_dir)
    cursors = m.where(F.col("conv_id") % 3 != 0).select("conv_id", (F.col("conv_id") % 3).alias("seen")).distinct()
    return t.since_cursor(m, cursors)
