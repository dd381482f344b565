"""Queries of file-like sources, over lines and texts that the carriers stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.coerce import coerce_json
from skein.functions.text import substitute
from skein.plans.registry import query
from skein.sources import files, json_files, session_log
from skein.tables import load


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn AS idx, CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS content, role, CASE WHEN turn % 3 = 0 THEN 99 ELSE turn END AS ts FROM conversations WHERE turn % 5 <> 4")
def json_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as log lines among blank and broken ones; some lack a time, some a text, some a role."""
    c = conversations(spark, sf_dir)
    record = F.struct(F.when(F.col("turn") % 5 != 4, F.col("role")).alias("role"), F.when(F.col("turn") % 7 != 6, F.col("text")).alias("content"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("ts"))
    noise = c.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, ("", "{broken", "[1, 2]", "null"))), (F.col("turn") % 4 + 1).cast("int")).alias("value"))
    lines = c.select("conv_id", "turn", F.to_json(record).alias("value")).union(noise)
    return session_log.parse_lines(lines, F.lit(99)).select("conv_id", F.col("turn").alias("idx"), "content", "role", "ts")


@query("""SELECT conv_id, turn AS idx, 0 AS sub, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND turn % 4 <> 3
  UNION ALL SELECT conv_id, turn, 0, 'user', 'so far' FROM conversations WHERE turn % 4 = 3 UNION ALL SELECT conv_id, turn, 1, role, text FROM conversations WHERE turn % 4 = 3 AND role IN ('user', 'assistant')""")
def expand_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    marker = F.col("turn") % 4 == 3
    payload = F.to_json(F.struct(F.lit("so far").alias("summary"), F.array(F.struct("role", F.col("text").alias("content"))).alias("keep")))
    rows = c.select("conv_id", F.col("turn").alias("idx"), "role", F.when(marker, payload).otherwise(F.col("text")).alias("content"), F.when(marker, session_log.MARKER).alias("type"))
    return session_log.expand_markers(rows)


@query("SELECT conv_id, max(turn) AS last_active FROM conversations GROUP BY conv_id ORDER BY 2 DESC, 1 LIMIT 10")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_log.session_list(conversations(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("last_active")))


def memory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    text = F.concat(F.lit("---\n"), F.when(F.col("doc_id") % 2 == 0, F.format_string("name: n%d\n", "doc_id")).otherwise(""), F.lit("description: in "), F.col("lang"), F.lit("\ntype: user\n---\n"), F.col("text"))
    path = F.when(F.col("doc_id") % 50 == 0, "/m/MEMORY.md").otherwise(F.format_string("/m/f%d.md", "doc_id"))
    return d.select("doc_id", path.alias("path"), text.alias("content"), (F.col("doc_id") * 7919 % 100_003 * 1000 + 1_700_000_000_123).alias("mtime_ms"))


@query("SELECT '/m/f' || doc_id || '.md' AS path, 'user' AS scope, doc_id * 7919 % 100003 * 1000 + 1700000000123 AS mtime_ms, CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE 'f' END || doc_id AS name, 'in ' || lang AS description, 'user' AS type FROM documents WHERE doc_id % 50 <> 0 ORDER BY 3 DESC, 1 LIMIT 200")
def memory_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.memory_headers(memory_files(spark, sf_dir), "user")


@query("SELECT doc_id, '- [user-scope] /m/' || doc_id || ' (' || strftime(make_timestamp((doc_id * 86400000 + 7) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z): ' || lang AS line FROM documents")
def memory_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/m/"), F.col("doc_id").cast("string"))
    line = files.manifest_line(F.lit("user"), F.lit(""), path, F.col("doc_id") * 86_400_000 + 7, F.col("lang"))
    return load(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", line.alias("line"))


@query("SELECT doc_id, CAST(k AS INTEGER) AS pos, 'm' || k AS name, lang AS description, CASE WHEN k = 1 THEN 'project' ELSE 'reference' END AS type, 'b' || doc_id AS body FROM documents, (VALUES (0), (1)) v(k)")
def memory_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda k, kind: F.concat(F.lit(f"MEMORY_NAME: m{k}\nMEMORY_DESC: "), F.col("lang"), F.lit(f"\nMEMORY_TYPE: {kind}\nMEMORY_BODY: b"), F.col("doc_id").cast("string"), F.lit("\nmore\n"))
    d = load(spark, sf_dir, "documents", "doc_id", "lang")
    texts = d.select("doc_id", F.concat(block(0, "odd"), F.lit("---\n"), block(1, "Project"), F.lit("---\nnothing")).alias("text"))
    return files.memory_blocks(texts, "doc_id")


@query("SELECT s_suppkey AS file, 'old' AS line FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("file"))
    return files.index_upsert(s.where("file % 2 = 0").withColumn("line", F.lit("old")), s.where("file % 3 = 0").withColumn("line", F.lit("new")))


@query("SELECT p_partkey, lower(replace(p_type, ' ', '-')) || ':' || lower(replace(p_name, ' ', '-')) AS name FROM part")
def command_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("p_type", F.lit("/"), "p_name", F.lit(".md"))
    return load(spark, sf_dir, "part", "p_partkey", "p_type", "p_name").select("p_partkey", files.command_name(path).alias("name"))


@query("SELECT user_id AS box, event_type AS text, event_id % 2 = 0 AS read, CAST(event_id AS VARCHAR) AS request_id FROM events")
def mailbox_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    rows = e.select(F.col("user_id").alias("box"), "event_id", F.col("event_type").alias("text"), (F.col("event_id") % 2 == 0).alias("read"), F.col("event_id").cast("string").alias("requestId"))
    boxes = json_files.to_boards(rows, "box", "event_id", "text", "read", "requestId")
    return json_files.messages(boxes, "box").select("box", "text", "read", "request_id")


@query("SELECT c_nationkey AS board, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 THEN 'done' END AS status FROM customer")
def task_board_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    rows = c.select(F.col("c_nationkey").alias("board"), "c_custkey", F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "done").alias("status"), F.lit(1).alias("extra"))
    boards = json_files.to_boards(rows, "board", "c_custkey", "id", "title", "status", "extra").withColumn("text", F.concat(F.lit('{"next_id": 9, "tasks": '), "text", F.lit("}")))
    return json_files.tasks(boards, "board").select("board", "id", "title", "status")


@query()
def include_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document includes others by fixed steps: chains, loops and unknown names."""
    d = load(spark, sf_dir, "documents", "doc_id", "text")
    name = lambda c: F.concat(F.lit("/d"), c.cast("string"))
    text = F.concat_ws("\n", F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@"), name(F.floor(F.col("doc_id") / 3)))), F.when(F.col("doc_id") % 5 == 0, F.lit("@./nowhere")), F.lit("```\n@/d1\n```"))
    return files.expand_includes(d.select(name(F.col("doc_id")).alias("file"), text.alias("content")))


@query("""SELECT event_id, '{"flag": true, "ids": [1, 2, "x"], "k": "' || json_extract_string(props, '$.k') || '"}' AS arguments FROM events""")
def coerce_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"type": "object", "properties": {"k": {"type": "string"}, "ids": {"type": "array", "items": {"type": "integer"}}, "flag": {"type": "boolean"}}}
    given = F.concat(F.regexp_replace("props", r"\}\s*\z", ""), F.lit(', "ids": "1, 2,x", "flag": "True"}'))
    return load(spark, sf_dir, "events", "event_id", "props").select("event_id", coerce_json(schema)(given).alias("arguments"))


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a part: entries in both orders, quoted or not, among such as count for nothing."""
    text = F.concat(F.lit("# rules\n- rule: Bash("), "p_name", F.lit(" *)\n  effect: allow\n- effect: 'deny'\n  rule: \"Read(/x/*)\"\n- effect: maybe\n  rule: A(b)\n- nonsense\n- rule: no rule\n  effect: ask\n"))
    return load(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 7 == 0, "name: not a list\n").otherwise(text).alias("content"))


@query("SELECT p_partkey AS path, CAST(k AS INTEGER) AS seq, CASE k WHEN 0 THEN 'Bash' ELSE 'Read' END AS tool, CASE k WHEN 0 THEN p_name || ' *' ELSE '/x/*' END AS pattern, CASE k WHEN 0 THEN 'allow' ELSE 'deny' END AS effect FROM part, (VALUES (0), (1)) v(k) WHERE p_partkey % 7 <> 0")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rule_rows(rule_files(spark, sf_dir))


@query("""SELECT p_partkey AS path, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE k END AS INTEGER) AS seq, CASE k WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' ELSE 'Edit' END AS tool, CASE k WHEN 0 THEN p_name || ' *' WHEN 1 THEN '/x/*' ELSE 'it''s "' || p_partkey || '"' END AS pattern,
  CASE k WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' ELSE 'ask' END AS effect FROM part, (VALUES (0), (1), (2)) v(k) WHERE p_partkey % 7 <> 0 OR k = 2""")
def rule_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file read, written with one rule more, and read again."""
    text = rule_files(spark, sf_dir)
    pattern = F.concat(F.lit("it's \""), F.col("path").cast("string"), F.lit('"'))
    new = text.select("path", F.lit("Edit").alias("tool"), pattern.alias("pattern"), F.lit("ask").alias("effect"))
    return files.rule_rows(files.append_rule(files.rule_rows(text), new))


@query("""SELECT doc_id AS path, 'a' || doc_id AS name, 'in ' || lang AS description, 'Read,Grep' AS tools, CASE WHEN doc_id % 2 = 0 THEN 'Bash,Write it' ELSE '' END AS disallowed, CASE WHEN doc_id % 3 = 0 THEN 'inherit' ELSE 'm-1' END AS model, CASE WHEN doc_id % 5 = 1 THEN 7 ELSE 200 END AS max_turns,
  CASE WHEN doc_id % 2 = 0 THEN 'acceptEdits' ELSE 'default' END AS permission_mode, doc_id % 3 = 0 AS background, ltrim(text, chr(10)) AS prompt FROM documents WHERE doc_id % 5 <> 2 AND doc_id % 7 <> 3 AND doc_id % 11 <> 4""")
def agent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the prompt of an agent; some files are broken in one way or another."""
    k, line = F.col("doc_id"), F.lit("\n")
    either = lambda test, yes, no="": F.when(test, yes).otherwise(no)
    head = F.concat(
        F.lit("---\nname: a"), k.cast("string"), line, either(k % 7 != 3, F.concat(F.lit('description: "in '), "lang", F.lit('"\n'))), F.lit("# more\ntools: [Read, 'Grep']\n"), either(k % 2 == 0, "disallowedTools:\n  - Bash\n  - Write it\npermissionMode: acceptEdits\n"),
        either(k % 3 == 0, "model: Inherit\nbackground: true\n", "model: m-1\n"), either(k % 5 == 1, "maxTurns: 7\n"), either(k % 5 == 2, "maxTurns: many\n"), either(k % 11 == 4, "just a line\n"), F.lit("---\n\n"), "text",
    )
    defs = files.agent_defs(load(spark, sf_dir, "documents", "doc_id", "lang", "text").select(k.alias("path"), head.alias("content")))
    return defs.withColumns({"tools": F.array_join("tools", ","), "disallowed": F.array_join("disallowed", ",")})


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, E' \\t\\n\\x0b\\x0c\\r') <> ''")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return json_files.history(lines, "line")


@query("SELECT 'PROMO/' || name || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END AS shown FROM (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN '.' ELSE '' END || p_name || '-' || p_partkey AS name FROM part) WHERE p_type = 'PROMO' AND starts_with(lower(name), 'c') ORDER BY name LIMIT 10")
def path_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    name = F.concat(F.when(F.col("p_partkey") % 9 == 0, ".").otherwise(""), "p_name", F.lit("-"), F.col("p_partkey").cast("string"))
    return files.complete_path(p.select(F.col("p_type").alias("folder"), name.alias("name"), (F.col("p_partkey") % 2 == 0).alias("is_folder")), "PROMO/C")


@query("""SELECT p_partkey, lower(replace(p_type, ' ', '-')) || ':' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'about ' || p_brand ELSE 'Do ' || p_name || ': $ARGUMENTS' END AS description, 'Do ' || p_name || ': it now' AS prompt FROM part""")
def command_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command files, and what each becomes with its arguments."""
    p = load(spark, sf_dir, "part", "p_partkey", "p_type", "p_name", "p_brand")
    path = F.concat(F.lit("file:///c/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    head = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("---\ndescription: about "), "p_brand", F.lit("\n---\n"))).otherwise("# Title\n")
    body = F.concat(F.lit("Do "), "p_name", F.lit(": $ARGUMENTS"))
    defs = files.command_defs(p.select("p_partkey", path.alias("path"), F.concat(head, body).alias("content")), "/c")
    # the carrier's key is in the name
    key = F.substring_index("name", ":", -1).cast("long")
    prompt = substitute(F.regexp_replace("template", r"\A# Title\n", ""), F.lit("it now"))
    return defs.select(key.alias("p_partkey"), "name", "description", prompt.alias("prompt"))


@query("SELECT conv_id, count(*) FILTER (turn % 4 <> 3) AS message_count, max(turn) AS last_active FROM conversations GROUP BY conv_id")
def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", F.col("turn").alias("idx"), F.col("turn").alias("ts"), F.when(F.col("turn") % 4 == 3, session_log.MARKER).alias("type"))
    return session_log.meta_of(rows)


@query("""SELECT conv_id, turn AS idx, role, text || CASE WHEN turn % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS content, CASE WHEN turn % 3 = 0 THEN '[{"type":"tool_use","text":"","id":"' || turn || '"}]' END AS tool_uses FROM conversations""")
def message_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda kind, text, id_="": F.struct(F.lit(kind).alias("type"), (F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(id_) if isinstance(id_, str) else id_).alias("id"))
    always = F.array(block("thinking", "hm"), block("text", F.col("text")))
    some = lambda test, b: F.when(test, F.array(b)).otherwise(F.array().cast("array<struct<type:string,text:string,id:string>>"))
    blocks = F.concat(always, some(F.col("turn") % 2 == 0, block("text", "more")), some(F.col("turn") % 3 == 0, block("tool_use", "", F.col("turn").cast("string"))))
    rows = conversations(spark, sf_dir).select("conv_id", F.col("turn").alias("idx"), "role", F.lit(0).alias("ts"), blocks.alias("blocks"))
    return session_log.to_records(rows).select("conv_id", "idx", "role", "content", "tool_uses")
