"""Queries of texts made of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import render as r
from skein.plans.registry import query
from skein.plans.transcript import MSG
from skein.tables import load, messages


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text", "lang")


STALE_SQL = _q(r.STALE).replace("%d", "' || d || '")
AGE_SQL = "CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE d || ' days ago' END"


@query(f"""WITH m AS (SELECT doc_id // 3 AS session, doc_id, doc_id % 4 AS d, text FROM documents)
  SELECT session, {_q(r.REMINDER_HEAD)} || chr(10) || string_agg('## Memory: m' || doc_id || '.md (saved ' || {AGE_SQL} || ')' || chr(10) || chr(10) || CASE WHEN d <= 1 THEN '' ELSE {STALE_SQL} || chr(10) || chr(10) END || text || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY doc_id) AS text FROM m GROUP BY session""")
def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = documents(spark, sf_dir).select(F.floor(k / 3).alias("session"), "doc_id", F.concat(F.lit("m"), k.cast("string"), F.lit(".md")).alias("name"), (k % 4).alias("days"), F.col("text").alias("content"))
    return r.reminder(rows, "session", "doc_id")


@query(f"""WITH {MSG} SELECT conv_id, idx, {_q(r.COMPACT_HEAD)} || content || CASE WHEN idx % 2 = 0 THEN {_q(r.COMPACT_TAIL)} ELSE '' END || CASE WHEN idx % 3 = 0 THEN {_q(r.COMPACT_LOG)} || '/log/' || conv_id ELSE '' END || CASE WHEN idx % 5 = 0 THEN {_q(chr(10) * 2 + "---" + chr(10) * 2)} || role ELSE '' END AS content FROM msg""")
def compact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("idx")
    log = F.when(idx % 3 == 0, F.concat(F.lit("/log/"), F.col("conv_id").cast("string"))).otherwise("")
    text = r.compact_message(F.col("content"), F.when(idx % 5 == 0, F.col("role")).otherwise(""), idx % 2 == 0, log)
    return messages(spark, sf_dir).select("conv_id", "idx", text.alias("content"))


FENCE = "'```'"


@query(f"""WITH d AS (SELECT doc_id, doc_id // 8 AS k, text, lang, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id * 7919 % 100003 DESC, doc_id) AS n FROM documents),
  f AS (SELECT k, {_q(r.FILES_HEAD)} || string_agg('### /d/' || doc_id || '  (read 2024-01-01T00:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || 'Z)' || chr(10) || {FENCE} || chr(10) || left(text, 17500) || CASE WHEN ends_with(left(text, 17500), chr(10)) THEN '' ELSE chr(10) END || {FENCE} || chr(10), '' ORDER BY n) AS t FROM d WHERE n <= 5 GROUP BY k),
  s AS (SELECT *, CAST(sum(CAST(floor(length(left(text, 17500)) / 3.5) AS BIGINT) + CAST(floor(length('s' || doc_id) / 3.5) AS BIGINT) + 8) OVER (PARTITION BY k ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM d WHERE doc_id % 3 = 0),
  g AS (SELECT k, {_q(r.SKILLS_HEAD)} || string_agg('### s' || doc_id || chr(10) || chr(10) || left(text, 17500) || chr(10), '' ORDER BY doc_id) AS t FROM s WHERE used <= 25000 GROUP BY k),
  o AS (SELECT k, {_q(r.TOOLS_HEAD)} || string_agg('- t' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' — in ' || lang ELSE '' END || chr(10), '' ORDER BY doc_id) AS t FROM d WHERE doc_id % 8 < 3 GROUP BY k)
  SELECT k, string_agg(t, chr(10) ORDER BY p) || chr(10) || {_q(r.HINT)} AS text FROM (SELECT k, 0 AS p, t FROM f UNION ALL SELECT k, 1, t FROM g UNION ALL SELECT k, 2, t FROM o) GROUP BY k""")
def recovery_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents are a session: files it read (the newest five), skills within their budget, and tools."""
    id_ = F.col("doc_id")
    d = documents(spark, sf_dir).withColumn("k", F.floor(id_ / 8))
    named = lambda lead: F.concat(F.lit(lead), id_.cast("string"))
    newest = F.row_number().over(W.partitionBy("k").orderBy(F.desc(id_ * 7919 % 100_003), "doc_id"))
    read_at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(id_ % 60).cast("decimal(18,6)"))
    files = d.withColumn("seq", newest).where("seq <= 5").select("k", F.col("seq").cast("long").alias("seq"), r.file_section(named("/d/"), F.col("text"), read_at).alias("text"))
    used = F.sum(r.skill_tokens(named("s"), F.col("text"))).over(W.partitionBy("k").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0))
    skills = d.where(id_ % 3 == 0).withColumn("used", used).where("used <= 25000").select("k", id_.alias("seq"), r.skill_section(named("s"), F.col("text")).alias("text"))
    about = F.when(id_ % 2 == 0, F.concat(F.lit("\n in "), "lang", F.lit("\nand more")))
    tools = d.where(id_ % 8 < 3).select("k", id_.alias("seq"), r.tool_section(named("t"), about).alias("text"))
    return r.recovery_attachment(files, skills, tools, "k")


CALLS = """c AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'ReadFile' WHEN 'click' THEN 'Bash' WHEN 'purchase' THEN 'WriteFile' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Grep' ELSE 'EditFile' END ELSE 'Task' END AS tool, '/a/b/f' || user_id || '.py' AS path, 'run ' || user_id || ' ' || repeat('x', event_id % 60) AS command FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    kind, k, user = F.col("event_type"), F.col("event_id"), F.col("user_id").cast("string")
    tool = F.when(kind == "view", "ReadFile").when(kind == "click", "Bash").when(kind == "purchase", "WriteFile").when(kind == "signup", F.when(k % 2 == 0, "Grep").otherwise("EditFile")).otherwise("Task")
    command = F.concat(F.lit("run "), user, F.lit(" "), F.repeat(F.lit("x"), (k % 60).cast("int")))
    arguments = F.to_json(F.struct(F.concat(F.lit("/a/b/f"), user, F.lit(".py")).alias("file_path"), command.alias("command"), F.lit("p*").alias("pattern"), F.lit("one\ntwo").alias("content")))
    return e.select("event_id", tool.alias("tool"), arguments.alias("arguments"))


@query(f"""WITH {CALLS} SELECT event_id, CASE tool WHEN 'ReadFile' THEN 'Read f' || user_id || '.py' WHEN 'WriteFile' THEN 'Write f' || user_id || '.py (2 lines)' WHEN 'EditFile' THEN 'Edit f' || user_id || '.py' WHEN 'Bash' THEN 'Bash: ' || left(command, 50) || CASE WHEN length(command) > 50 THEN '…' ELSE '' END WHEN 'Grep' THEN 'Grep: p*' ELSE tool END AS title,
  CASE tool WHEN 'ReadFile' THEN 'Reading ' || path WHEN 'WriteFile' THEN 'Writing ' || path WHEN 'EditFile' THEN 'Editing ' || path WHEN 'Bash' THEN 'Running ' || left(command, 40) || CASE WHEN length(command) > 40 THEN '…' ELSE '' END WHEN 'Grep' THEN 'Grepping p*' ELSE tool END AS activity FROM c""")
def call_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool, arguments = F.col("tool"), F.col("arguments")
    return calls(spark, sf_dir).select("event_id", r.call_title(tool, arguments).alias("title"), r.call_activity(tool, arguments).alias("activity"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS every, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents),
  c AS (SELECT *, list_concat(list_transform(ls[1:20], lambda x: '  ' || x), CASE WHEN len(every) > 20 THEN ['  … (' || (len(every) - 20) || ' more lines)'] ELSE [] END) AS cut FROM l)
  SELECT doc_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN list_concat(['  IN   go', ''], list_transform(ls, lambda x: '  OUT  ' || x)) WHEN 1 THEN list_concat(['  /f', ''], cut) ELSE cut END, chr(10)) AS detail FROM c""")
def call_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    tool = F.when(k == 0, "Bash").when(k == 1, "ReadFile").otherwise("Task")
    detail = r.call_detail(tool, F.lit('{"command": "go", "file_path": "/f"}'), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", detail.alias("detail"))


@query(f"""WITH {MSG} SELECT conv_id, idx, array_to_string(['<task-notification>', 'Task ID: ' || conv_id || '-' || idx, 'Agent: ' || role, 'Status: completed', 'Elapsed: ' || CASE WHEN idx % 4 = 3 THEN '' WHEN idx * 6 >= 60 THEN printf('%.1f', idx / 10.0) || 'm' ELSE printf('%.1f', idx * 6.0) || 's' END,
  CASE WHEN idx > 0 THEN chr(10) || 'Tokens: input=' || idx || ', output=' || 2 * idx ELSE '' END, 'Result:', left(content, 40) || CASE WHEN length(content) > 40 THEN chr(10) || '... (truncated)' ELSE '' END, '</task-notification>'], chr(10)) AS text FROM msg""")
def task_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("idx")
    id_ = F.concat(F.col("conv_id").cast("string"), F.lit("-"), idx.cast("string"))
    text = r.task_notification(id_, F.col("role"), F.lit("completed"), F.col("content"), F.when(idx % 4 != 3, idx * 6), idx, 2 * idx, most=40)
    return messages(spark, sf_dir).select("conv_id", "idx", text.alias("text"))


@query("""SELECT user_id, '<team-notification team="' || user_id || '">' || chr(10) || string_agg('from=' || event_type || ': ' || event_id, chr(10) ORDER BY event_id) || chr(10) || '</team-notification>' AS text FROM events GROUP BY user_id""")
def team_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    rows = e.select("user_id", "event_id", F.col("event_type").alias("sender"), F.col("event_id").cast("string").alias("text"))
    return r.team_notification(rows, "user_id", "event_id")


@query("""WITH s AS (SELECT doc_id // 4 AS prompt, doc_id, trim(text, E' \\t\\n\\x0b\\x0c\\r') AS t FROM documents) SELECT prompt, string_agg(t, chr(10) || chr(10) ORDER BY doc_id * 7 % 3, doc_id) AS text FROM s WHERE t <> '' GROUP BY prompt""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = documents(spark, sf_dir).select(F.floor(k / 4).alias("prompt"), "doc_id", (k * 7 % 3).alias("priority"), "text")
    return r.assemble(rows, "prompt", "priority", "doc_id", "text")
