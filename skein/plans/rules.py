"""Queries of rules, commands and hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import patterns
from skein.operators import rule_index
from skein.operators import rules as r
from skein.plans.registry import query
from skein.tables import load

RULES = [("Brand#1", "*STEEL*", "deny"), ("Brand#1", "PROMO*", "ask"), ("Brand#2", "*[!A-M]", "allow"), ("Brand#3", "?R*", "ask"), ("Brand#3", "*COPPER", "deny"), ("Brand#1", "*", "allow")]


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    return p.withColumns({"tool": F.left("p_brand", F.lit(7)), "content": F.upper("p_type")})


PARTS = "p AS (SELECT p_partkey, left(p_brand, 7) AS tool, upper(p_type) AS content FROM part)"
LEVEL = r"""greatest(CASE WHEN tool = 'Brand#1' AND content LIKE '%STEEL%' THEN 3 ELSE 0 END, CASE WHEN tool = 'Brand#1' AND content LIKE 'PROMO%' THEN 2 ELSE 0 END,
  CASE WHEN tool = 'Brand#2' AND regexp_full_match(content, '(?s).*[^A-M]') THEN 1 ELSE 0 END, CASE WHEN tool = 'Brand#3' AND content LIKE '_R%' THEN 2 ELSE 0 END,
  CASE WHEN tool = 'Brand#3' AND content LIKE '%COPPER' THEN 3 ELSE 0 END, CASE WHEN tool = 'Brand#1' THEN 1 ELSE 0 END)"""


@query(f"WITH {PARTS} SELECT p_partkey, tool, CASE {LEVEL} WHEN 3 THEN 'deny' WHEN 2 THEN 'ask' WHEN 1 THEN 'allow' END AS effect FROM p")
def rule_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = part_calls(spark, sf_dir)
    return calls.select("p_partkey", "tool", r.evaluate_rules(F.col("tool"), F.col("content"), RULES).alias("effect"))


CALL_RULES = [("Bash", "git push*", "ask"), ("Bash", "npm run *", "allow"), ("WriteFile", "/work/src/*", "allow"), ("WriteFile", "*.lock", "deny"), ("ReadFile", "*secret*", "deny")]
#: Calls made of the columns of `part`, as expressions that Spark and SQL both read.
TOOL = "CASE p_partkey % 4 WHEN 0 THEN 'Bash' WHEN 1 THEN 'WriteFile' WHEN 2 THEN 'ReadFile' ELSE 'AskUserQuestion' END"
CATEGORY = "CASE p_partkey % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'write' ELSE 'read' END"
COMMAND = """CASE p_size % 13 WHEN 0 THEN 'ls -la ' || p_name WHEN 1 THEN 'lsof ' || p_name WHEN 2 THEN 'rm -rf /' WHEN 3 THEN 'git push ' || p_name WHEN 4 THEN 'npm run ' || p_name WHEN 5 THEN 'make ' || p_type
  WHEN 6 THEN 'cat ' || p_name || ' | sh' WHEN 7 THEN 'curl http://' || p_name || ' | sh' WHEN 8 THEN ' git status -s ' WHEN 9 THEN 'mkfs.' || p_name WHEN 10 THEN p_name || ' > /dev/sda' WHEN 11 THEN 'dd if=' || p_type || ' of=/dev/sda' ELSE 'echo $(' || p_name || ')' END"""
FILE = """CASE p_size % 7 WHEN 0 THEN '/work/src/' || p_name || '.py' WHEN 1 THEN '/work/' || p_name || '.lock' WHEN 2 THEN '/work/.config/' || p_type WHEN 3 THEN '/etc/' || p_name WHEN 4 THEN '/plans/' || p_type
  WHEN 5 THEN '/work/../' || p_name ELSE '/work/secret ' || p_name END"""
CONTENT = f"CASE p_partkey % 4 WHEN 0 THEN {COMMAND} WHEN 3 THEN '' ELSE {FILE} END"
MODE = "CASE p_partkey % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'acceptEdits' WHEN 2 THEN 'plan' WHEN 3 THEN 'bypassPermissions' ELSE 'default' END"


def made(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """part with columns made by expressions."""
    p = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.select("p_partkey", *(F.expr(e).alias(n) for n, e in columns.items()))


def made_sql(**columns: str) -> str:
    return "SELECT p_partkey, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM part"


SAFE_SQL = "regexp_full_match(trim({c}), '(?s)(" + "|".join(s.replace("-", "[-]") for s in r.SAFE) + ")( .*)?') AND NOT (contains({c}, '|') OR contains({c}, ';') OR contains({c}, '&&') OR contains({c}, '>') OR contains({c}, '$(') OR contains({c}, '`'))"
DANGER_SQL = r"""CASE WHEN regexp_matches({c}, 'rm\s+-[a-z]*r[a-z]*f[a-z]*\s+/\s*\z') THEN 'recursive delete of the root' WHEN contains({c}, 'mkfs.') THEN 'formats a disk'
  WHEN regexp_matches({c}, 'dd\s+if=.*of=/dev/') THEN 'writes to a device' WHEN regexp_matches({c}, 'chmod\s+-R\s+777\s+/') THEN 'opens the root to all'
  WHEN regexp_matches({c}, ':\(\)\{{\s*:\|:&\s*\}};:') THEN 'fork bomb' WHEN regexp_matches({c}, '(curl|wget)\s+.*\|\s*(ba)?sh') THEN 'runs a remote script' WHEN regexp_matches({c}, '>\s*/dev/sd') THEN 'overwrites a disk' END"""
MODE_SQL = "CASE WHEN category = 'read' OR mode = 'bypassPermissions' OR (mode = 'acceptEdits' AND category = 'write') THEN 'allow' ELSE 'ask' END"


CALL_COLUMNS = {"tool": TOOL, "category": CATEGORY, "content": CONTENT, "mode": MODE}


@query(f"""WITH c AS ({made_sql(**CALL_COLUMNS)}),
  e AS (SELECT *, CASE WHEN tool = 'WriteFile' AND content LIKE '%.lock' OR tool = 'ReadFile' AND content LIKE '%secret%' THEN 'deny' WHEN tool = 'Bash' AND content LIKE 'git push%' THEN 'ask'
    WHEN tool = 'Bash' AND content LIKE 'npm run %' OR tool = 'WriteFile' AND content LIKE '/work/src/%' THEN 'allow' END AS ruled FROM c)
  SELECT p_partkey, tool, category, content, mode, CASE WHEN mode = 'plan' AND (tool = 'AskUserQuestion' OR tool = 'WriteFile' AND content LIKE '/plans/%') THEN 'allow'
    WHEN category = 'command' AND {SAFE_SQL.format(c='content')} THEN 'allow' WHEN category = 'command' AND ({DANGER_SQL.format(c='content')}) IS NOT NULL THEN 'deny'
    WHEN category = 'write' AND content LIKE '/work/.config/%' THEN 'deny' WHEN category IN ('read', 'write') AND content <> '' AND mode <> 'bypassPermissions' AND (content NOT LIKE '/work/%' OR content LIKE '%/../%') THEN 'ask'
    ELSE coalesce(ruled, {MODE_SQL}) END AS effect FROM e""")
def permission_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = made(spark, sf_dir, **CALL_COLUMNS)
    return calls.withColumn("effect", r.permission_chain(*(F.col(c) for c in ("tool", "category", "content", "mode")), CALL_RULES))


LINE = "CASE p_partkey % 4 WHEN 0 THEN 'git push ' || p_name WHEN 1 THEN 'npm run ' || p_name ELSE 'make ' || p_type END || CASE p_size % 5 WHEN 0 THEN ' && ' WHEN 1 THEN ' | ' WHEN 2 THEN '; ' WHEN 3 THEN ' || ' ELSE ' ;; ' END || CASE p_partkey % 3 WHEN 0 THEN 'rm ' || p_name WHEN 1 THEN '' ELSE 'npm run rm' END"


@query(f"""SELECT p_partkey, line, CASE WHEN list_bool_or(list_transform(parts, lambda p: p LIKE 'rm %')) THEN 'deny' WHEN list_bool_or(list_transform(parts, lambda p: p LIKE 'git push%')) THEN 'ask' ELSE 'allow' END AS effect
  FROM (SELECT p_partkey, line, list_transform(regexp_split_to_array(line, '&&|\\|\\||[;|]'), lambda p: trim(p)) AS parts FROM ({made_sql(line=LINE)}))""")
def subcommand_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*CALL_RULES, ("Bash", "rm *", "deny")]
    return made(spark, sf_dir, line=LINE).withColumn("effect", r.evaluate_subcommands(F.lit("Bash"), F.col("line"), rules))


@query(f"SELECT p_partkey, command, {DANGER_SQL.format(c='command')} AS reason, {SAFE_SQL.format(c='command')} AS safe FROM ({made_sql(command=COMMAND)})")
def command_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("command")
    return made(spark, sf_dir, command=COMMAND).select("p_partkey", "command", r.danger(c).alias("reason"), r.is_safe(c).alias("safe"))


#: Rules made of a fifth of the parts each: whole types, their first, last and inner letters, and signs for single letters.
RULE_GLOB = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 4 + p_partkey % 3) || '*' WHEN 2 THEN '*' || substr(p_name, 5) WHEN 3 THEN '*' || substr(p_name, 3, 4) || '*' ELSE '?' || substr(p_name, 2, 2) || '*' || substr(p_name, 9, 1) END"
RULE_EFFECT = "CASE p_size % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'ask' WHEN 2 THEN 'allow' ELSE 'unknown' END"


@query(f"""WITH r AS ({made_sql(tool="p_brand", pattern=RULE_GLOB, effect=RULE_EFFECT)}), c AS (SELECT DISTINCT p_brand AS tool, p_name AS content FROM part),
  v AS (SELECT c.tool, content, max(CASE effect WHEN 'deny' THEN 3 WHEN 'ask' THEN 2 WHEN 'allow' THEN 1 END) AS level FROM c JOIN r ON c.tool = r.tool AND content GLOB pattern GROUP BY ALL)
  SELECT p_partkey, CASE level WHEN 3 THEN 'deny' WHEN 2 THEN 'ask' WHEN 1 THEN 'allow' END AS effect FROM part LEFT JOIN v ON tool = p_brand AND content = p_name""")
def rule_table_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = made(spark, sf_dir, tool="p_brand", pattern=RULE_GLOB, effect=RULE_EFFECT)
    calls = load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name")
    return rule_index.severity(calls, rules, "p_brand", "p_name").select("p_partkey", "effect")


@query("""WITH c AS (SELECT event_id, 'use ' || props || ' of ' || event_type AS command FROM events), p AS (SELECT DISTINCT p_size AS seq, '"k": ' || p_size || '[}0-4]' AS pattern FROM part)
  SELECT event_id, (SELECT 'size ' || min(seq) FROM p WHERE regexp_matches(command, pattern)) AS reason FROM c""")
def danger_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    patterns = load(spark, sf_dir, "part", "p_size").distinct().select(F.col("p_size").alias("seq"), F.concat(F.lit('"k": '), size, F.lit("[}0-4]")).alias("pattern"), F.concat(F.lit("size "), size).alias("reason"))
    commands = load(spark, sf_dir, "events", "event_id", "props", "event_type").select("event_id", F.concat(F.lit("use "), "props", F.lit(" of "), "event_type").alias("command"))
    return rule_index.danger_by_rows(commands, patterns).select("event_id", "reason")


@query(f"SELECT doc_id, ({DANGER_SQL.format(c='text')}) IS NOT NULL AS dangerous FROM documents")
def danger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", r.danger(F.col("text")).isNotNull().alias("dangerous"))


HOOKS = [
    {"id": "h1", "event": "click", "condition": "args.k == 7", "once": True},
    {"id": "h2", "event": "view", "condition": 'args.k =~ /^1/ && tool != "none"'},
    {"id": "h3", "event": "purchase", "condition": "args.k ~= [2-4]? || args.k == 5"},
    {"id": "h4", "event": "click", "condition": "tool == click && args.missing == x"},
    {"id": "h5", "event": "purchase", "condition": "", "once": True},
    {"id": "h6", "event": "view", "condition": "args.k =~ ["},
]
HOOK_SQL = r"""m AS (SELECT event_id, h.hook_id, h.once FROM (SELECT event_id, event_type, CASE WHEN k = '0' THEN '' ELSE k END AS k FROM (SELECT *, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events))
  JOIN (VALUES ('h1', true), ('h2', false), ('h3', false), ('h5', true)) h(hook_id, once)
  ON (hook_id = 'h1' AND event_type = 'click' AND k = '7') OR (hook_id = 'h2' AND event_type = 'view' AND k LIKE '1%') OR (hook_id = 'h3' AND event_type = 'purchase' AND (regexp_full_match(k, '[2-4].') OR k = '5')) OR (hook_id = 'h5' AND event_type = 'purchase'))"""


def hook_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", "event_id", "event_type", "props")
    return r.match_hooks(events, HOOKS, "event_type", "event_type", "props")


@query(f"WITH {HOOK_SQL} SELECT event_id, hook_id FROM m")
def hook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hook_matches(spark, sf_dir).select("event_id", "hook_id")


@query(f"WITH {HOOK_SQL} SELECT event_id, hook_id FROM (SELECT *, row_number() OVER (PARTITION BY hook_id ORDER BY event_id) AS n FROM m) WHERE NOT once OR n = 1")
def hook_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.once_only(hook_matches(spark, sf_dir), ["event_id"]).select("event_id", "hook_id")


HOOK_COLUMNS = {
    "event": "CASE p_size % 3 WHEN 0 THEN 'pre_tool_use' WHEN 1 THEN 'post_tool_use' ELSE lower(p_type) END", "action": "CASE p_partkey % 5 WHEN 0 THEN 'command' WHEN 1 THEN 'prompt' WHEN 2 THEN 'http' WHEN 3 THEN 'agent' ELSE p_name END",
    "reject": "p_size % 2 = 0", "is_async": "p_partkey % 3 = 0",
}


@query(f"""SELECT p_partkey, CASE WHEN event NOT IN ('pre_tool_use', 'post_tool_use') THEN 'unknown event' WHEN action NOT IN ('command', 'prompt', 'http', 'agent') THEN 'unknown action'
  WHEN reject AND event <> 'pre_tool_use' THEN 'reject needs pre_tool_use' WHEN is_async AND event = 'pre_tool_use' THEN 'pre_tool_use cannot be async' END AS error FROM ({made_sql(**HOOK_COLUMNS)})""")
def hook_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = made(spark, sf_dir, **HOOK_COLUMNS).withColumnRenamed("is_async", "async")
    return r.hook_errors(defs, ["pre_tool_use", "post_tool_use"]).select("p_partkey", "error")


EXIT_COLUMNS = {
    "line": "CASE p_size % 9 WHEN 0 THEN 'grep ' || p_type || ' f' WHEN 1 THEN 'cat f | grep ' || p_type WHEN 2 THEN 'FOO=1 /usr/bin/diff a ' || p_type WHEN 3 THEN 'make ' || p_name WHEN 4 THEN 'ls | sort' WHEN 5 THEN '' WHEN 6 THEN 'find . -name ' || p_type WHEN 7 THEN 'grep x | wc' ELSE p_name END",
    "code": "CAST(p_partkey % 4 AS INT)",
}


@query(f"""SELECT p_partkey, CASE WHEN code = 0 THEN false WHEN regexp_matches(line, '(^|[|/ ])(grep|diff|find)( [^|]*)?\\z') THEN code >= 2 ELSE true END AS failed FROM ({made_sql(**EXIT_COLUMNS)})""")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, **EXIT_COLUMNS).select("p_partkey", r.is_failure(F.col("line"), F.col("code")).alias("failed"))


@query("""WITH s AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS safe FROM events)
  SELECT user_id, event_id, CAST(sum(CASE WHEN safe AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS batch FROM (SELECT *, lag(safe) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM s)""")
def safe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return r.safe_batches(events, "user_id", ["event_id"], F.col("event_type").isin("view", "click")).select("user_id", "event_id", "batch")


@query("""WITH reads AS (SELECT user_id AS path, arg_max(event_id % 5, event_id) AS read_mtime FROM events WHERE event_type = 'view' GROUP BY 1)
  SELECT event_id, path, CASE WHEN read_mtime IS NULL THEN 'not read' WHEN read_mtime <> mtime THEN 'changed' ELSE 'ok' END AS verdict FROM (SELECT event_id, user_id AS path, event_id % 4 AS mtime FROM events WHERE event_type = 'purchase') e LEFT JOIN reads USING (path)""")
def read_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    reads = e.where("event_type = 'view'").select(F.col("user_id").alias("path"), (F.col("event_id") % 5).alias("mtime"), F.col("event_id").alias("seq"))
    edits = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("path"), (F.col("event_id") % 4).alias("mtime"))
    return r.read_before_edit(edits, reads).select("event_id", "path", "verdict")


EVENT_MODE = "CASE user_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'acceptEdits' WHEN 2 THEN 'plan' WHEN 3 THEN 'bypassPermissions' ELSE 'unknown' END"
EVENT_CATEGORY = "CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'command' ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN mode <> 'unknown' AND category IN ('read', 'write', 'command') THEN {MODE_SQL} END AS effect FROM (SELECT event_id, {EVENT_MODE} AS mode, {EVENT_CATEGORY} AS category FROM events)")
def mode_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", r.mode_effect(F.expr(EVENT_MODE), F.expr(EVENT_CATEGORY)).alias("effect"))


RULE_TEXT = "CASE p_size % 6 WHEN 0 THEN replace(p_type, ' ', '_') || '(' || p_name || ' *)' WHEN 1 THEN ' Edit(' || p_name || ') ' WHEN 2 THEN p_name WHEN 3 THEN 'Bash()' WHEN 4 THEN 'Read(a)(' || p_name || ')' ELSE p_type || ' x(' || p_name || ')' END"


@query(f"SELECT p_partkey, CASE WHEN ok THEN regexp_extract(trim(rule), '^(\\w+)\\((.+)\\)\\z', 1) END AS tool, CASE WHEN ok THEN regexp_extract(trim(rule), '^(\\w+)\\((.+)\\)\\z', 2) END AS pattern FROM (SELECT p_partkey, rule, regexp_matches(trim(rule), '^\\w+\\(.+\\)\\z') AS ok FROM ({made_sql(rule=RULE_TEXT)}))")
def rule_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = made(spark, sf_dir, rule=RULE_TEXT).withColumn("p", patterns.parse_rule(F.col("rule")))
    return parsed.select("p_partkey", F.col("p")["tool"].alias("tool"), F.col("p")["pattern"].alias("pattern"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN coalesce(json_extract_string(args, '$.command'), '') WHEN 'view' THEN coalesce(json_extract_string(args, '$.file_path'), '') ELSE '' END AS content FROM (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN '{\"command\": \"run ' || user_id || '\"}' ELSE '{\"file_path\": \"/f/' || user_id || '\"}' END AS args FROM events)")
def call_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    tool = F.when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "view", "ReadFile").otherwise("Other")
    args = F.when(F.col("event_type") == "click", F.format_string('{"command": "run %d"}', "user_id")).otherwise(F.format_string('{"file_path": "/f/%d"}', "user_id"))
    return e.select("event_id", patterns.call_content(tool, args).alias("content"))


@query("""SELECT event_id, event_type <> 'error' AND event_id % 5 IN (0, 2, 3) AS reads_back FROM events""")
def spill_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "event_type")
    name = F.col("event_id").cast("string")
    path = F.element_at(F.array(F.concat(F.lit("/s/x/../spill//./"), name), F.concat(F.lit("/s/spill/../../s/other/"), name), F.concat(F.lit("spill/"), name), F.concat(F.lit("../s/spilled/"), name), F.lit("")), (F.col("event_id") % 5 + 1).cast("int"))
    tool = F.when(F.col("event_type") == "error", "Bash").otherwise("ReadFile")
    return e.select("event_id", r.reads_back_spill(tool, path, "/s/spill", "/s").alias("reads_back"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Missing required fields: extra' WHEN 1 THEN 'Expected object, got list' WHEN 2 THEN 'Expected object, got str' WHEN 4 THEN 'Expected object, got float' WHEN 5 THEN 'Expected object, got bool' END AS error FROM events")
def output_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "props")
    whole = F.regexp_replace("props", r"\}\s*\z", ', "extra": null}')
    output = F.element_at(F.array(F.col("props"), F.concat(F.lit("["), "props", F.lit("]")), F.lit('"text"'), whole, F.lit("-1.5"), F.lit("true")), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", r.output_error(output, {"type": "object", "required": ["k", "extra"]}).alias("error"))


@query("SELECT p_partkey, path FROM (SELECT p_partkey, p_type || '/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END AS path FROM part) WHERE regexp_full_match(rtrim(path, '/'), '(?s)PROMO/.*|.*/.old .*|.*[gk]et')")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_type", "p_name")
    files = p.select("p_partkey", F.concat("p_type", F.lit("/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("")).alias("path"))
    return r.matching_files(files, ["PROMO/*", "*/?old *", "*[gk]et"])


@query("""SELECT CAST(p_partkey % 3 AS INTEGER) AS layer, p_partkey AS seq, p_brand AS tool, p_name AS pattern, CASE p_size % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'ask' ELSE 'deny' END AS effect FROM part WHERE p_size % 4 <> 3""")
def rule_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_size")
    effect = F.element_at(F.array(*map(F.lit, ("allow", "ask", "deny", "maybe"))), (F.col("p_size") % 4 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("tool"), F.col("p_name").alias("pattern"), effect.alias("effect"))
    return r.union_rules(*(rows.where(F.col("seq") % 3 == k) for k in range(3)))
