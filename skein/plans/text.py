"""Queries of scalar text functions and file-like sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as x
from skein.plans.registry import query
from skein.plans.rules import made, made_sql
from skein.tables import load

BLANKS = "E' \\t\\n\\x0b\\x0c\\r'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text", "lang")


@query("SELECT doc_id, CAST(i AS INTEGER) AS line_no, s AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(s, '[Ll]icense|idiot')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = documents(spark, sf_dir).where(F.col("text").rlike("[Ll]icense|idiot")).select("doc_id", F.posexplode(x.lines(F.col("text"))).alias("pos", "line"))
    return every.where(F.col("line").rlike("[Ll]icense|idiot")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


@query("SELECT doc_id, coalesce(array_to_string(list_transform(l[2:4], lambda s, i: (i + 1) || chr(9) || s), chr(10)), '') AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def read_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", x.read_slice(F.col("text"), 1, 3).alias("part"))


@query(f"""WITH t AS (SELECT doc_id, array_to_string(string_split(trim(text, {BLANKS}), chr(10))[1:4], chr(10)) AS s FROM documents),
  h AS (SELECT doc_id, s, left(s, CAST(list_max(list_filter(range(0, least(length(s), 400) + 1), lambda i: strlen(left(s, i)) <= 400)) AS BIGINT)) AS head FROM t)
  SELECT doc_id, CASE WHEN strlen(s) <= 400 THEN s WHEN contains(head, chr(10)) AND length(head) - position(chr(10) IN reverse(head)) > 0 THEN left(head, length(head) - position(chr(10) IN reverse(head))) ELSE head END AS index FROM h""")
def index_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", x.truncate_index(F.col("text"), 4, 400).alias("index"))


@query("SELECT doc_id, 'doc-' || doc_id AS name, lang || ' text' AS description, '' AS type FROM documents")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("---\nname: doc-"), F.col("doc_id").cast("string"), F.lit('\ndescription: "'), F.col("lang"), F.lit(' text"\nkind: x\n---\n'), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", *(x.frontmatter(block, f).alias(f) for f in ("name", "description", "type")))


@query(f"SELECT doc_id, trim(split_part(text || '</summary>', '</summary>', 1), {BLANKS}) AS summary, '{{\"id\": ' || doc_id || '}}' AS object, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, {BLANKS})), lambda s: s <> '')[1], '') AS first_line FROM documents")
def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    tagged = F.concat(F.lit("x <summary>"), F.col("text"), F.lit("</summary> y"))
    prose = F.concat(F.lit('Sure: {"id": '), F.col("doc_id").cast("string"), F.lit("} done"))
    return d.select("doc_id", x.tagged(tagged).alias("summary"), x.json_object(prose).alias("object"), x.first_line(F.col("text")).alias("first_line"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", x.occurrences(F.col("text"), "the").alias("n"))


@query("SELECT doc_id, CASE WHEN n = 1 THEN replace(text, 'license', 'LICENCE') ELSE text END AS text, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' END AS error FROM (SELECT *, (length(text) - length(replace(text, 'license', ''))) // 7 AS n FROM documents)")
def replace_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = documents(spark, sf_dir).withColumn("r", x.replace_once(F.col("text"), "license", "LICENCE"))
    return done.select("doc_id", F.col("r")["text"].alias("text"), F.col("r")["error"].alias("error"))


GIVEN = {
    "value": "CASE p_size % 10 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN ' -' || p_partkey || ' ' WHEN 2 THEN '1_' || p_partkey WHEN 3 THEN p_partkey || '.5' WHEN 4 THEN p_name WHEN 5 THEN '.' || p_size WHEN 6 THEN ' TRUE' WHEN 7 THEN 'yes' WHEN 8 THEN p_size || 'e2' ELSE '' END",
    "want": "CASE p_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' ELSE 'string' END",
}


@query(f"""SELECT p_partkey, value, want, CASE WHEN want = 'integer' AND regexp_full_match(trim(value), '[+-]?[0-9]+') OR want = 'number' AND regexp_full_match(trim(value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') OR want = 'boolean' AND lower(trim(value)) IN ('true', 'false') THEN want ELSE 'string' END AS kind FROM ({made_sql(**GIVEN)})""")
def coerce_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, **GIVEN).withColumn("kind", x.coerce_scalar(F.col("value"), F.col("want"))["kind"])


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'integer' ELSE 'string' END AS kind, CASE WHEN event_type = 'click' THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE v END AS text FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS v FROM events)")
def coerce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events", "event_id", "event_type", "props")
    want = F.when(F.col("event_type") == "click", "integer").otherwise("string")
    out = e.withColumn("c", x.coerce_scalar(F.get_json_object("props", "$.k"), want))
    return out.select("event_id", F.col("c")["kind"].alias("kind"), F.col("c")["text"].alias("text"))


@query("SELECT event_id, CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE d || ' days ago' END AS age FROM (SELECT event_id, greatest(CAST(floor((10 * 86400000 - event_id * 100000) / 86400000) AS BIGINT), 0) AS d FROM events)")
def memory_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = x.age_days(F.col("event_id") * 100_000, F.lit(10 * 86_400_000))
    return load(spark, sf_dir, "events", "event_id").select("event_id", x.age_label(days).alias("age"))


TYPED = "CASE p_size % 6 WHEN 0 THEN '/' || p_type || ' ' || p_name WHEN 1 THEN '  /Session  ' || p_name || '  ' WHEN 2 THEN p_name WHEN 3 THEN '/' WHEN 4 THEN '/a' || chr(10) || p_name ELSE '/' || p_brand END"


@query(f"SELECT p_partkey, CASE WHEN ok THEN lower(regexp_extract(t, '^/([^ \\n]+)', 1)) END AS name, CASE WHEN ok THEN trim(regexp_replace(t, '^/[^ \\n]+', ''), {BLANKS}) END AS args FROM (SELECT p_partkey, trim(line, {BLANKS}) AS t, regexp_matches(trim(line, {BLANKS}), '^/[^ \\n]') AS ok FROM ({made_sql(line=TYPED)}))")
def parse_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = made(spark, sf_dir, line=TYPED).withColumn("p", x.parse_command(F.col("line")))
    return parsed.select("p_partkey", F.col("p")["name"].alias("name"), F.col("p")["args"].alias("args"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'run ' || p_brand || ' now' WHEN p_partkey % 3 = 1 THEN 'run' || chr(10) || chr(10) || p_brand ELSE 'run' END AS prompt, p_brand || ':' || p_type AS expanded FROM part")
def substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    template = F.when(k == 0, "run $ARGUMENTS now").otherwise("run")
    args = F.when(k == 2, " ").otherwise(F.col("p_brand"))
    expanded = x.expand_variables(F.lit("$TOOL:$MESSAGE"), {"TOOL": F.col("p_brand"), "MESSAGE": F.col("p_type")})
    return load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", x.substitute(template, args).alias("prompt"), expanded.alias("expanded"))


@query("SELECT doc_id, left(sha256('/docs/' || doc_id), 16) || '@v' || (doc_id % 4) AS key FROM documents")
def backup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.left(F.sha2(path, 256), F.lit(16)), F.lit("@v"), (F.col("doc_id") % 4).cast("string")).alias("key"))


@query()
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with its second line changed."""
    new = F.array_join(F.transform(x.lines(F.col("text")), lambda s, i: F.when(i == 1, F.concat(s, F.lit(" changed"))).otherwise(s)), "\n")
    d = documents(spark, sf_dir).withColumn("d", x.line_diff(F.col("text"), new))
    return d.select("doc_id", F.col("d")["additions"].alias("additions"), F.col("d")["removals"].alias("removals"), F.col("d")["text"].alias("text"))


@query("SELECT doc_id, CASE WHEN n >= 4 THEN 3 WHEN n >= 2 THEN 1 ELSE 0 END AS additions, CASE WHEN n >= 4 THEN 3 WHEN n >= 2 THEN 1 ELSE 0 END AS removals FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with its second and fourth line changed: all between them counts."""
    new = F.array_join(F.transform(x.lines(F.col("text")), lambda s, i: F.when(i.isin(1, 3), F.concat(s, F.lit(" changed"))).otherwise(s)), "\n")
    d = documents(spark, sf_dir).withColumn("d", x.line_diff(F.col("text"), new))
    return d.select("doc_id", F.col("d")["additions"].alias("additions"), F.col("d")["removals"].alias("removals"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago' ELSE (s // 86400) || ' days ago' END AS ago,
  CAST(100 * (event_id % 37) // 37 AS INTEGER) AS percent FROM (SELECT event_id, event_id * 37 AS s FROM events)""")
def labels_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("event_id") * 37
    return load(spark, sf_dir, "events", "event_id").select("event_id", x.relative_time(s).alias("ago"), x.percent(F.col("event_id") % 37, F.lit(37)).alias("percent"))


#: Links to repositories made of the urls of `pages`.
LINK = """CASE page_id % 6 WHEN 0 THEN 'https://github.com/o/r/tree/main/' || replace(url, '://', '/') WHEN 1 THEN 'http://www.skills.sh/o/' || replace(url, '://', '/') WHEN 2 THEN 'https://raw.githubusercontent.com/o/r/dev/' || replace(url, '://', '/') || '/'
  WHEN 3 THEN 'https://github.com/' || replace(url, '://', '/') WHEN 4 THEN 'ftp://github.com/o/r/tree/m/' || replace(url, '://', '/') ELSE url END"""


@query(f"""WITH l AS (SELECT page_id, regexp_extract(link, '^https?://([^/:?#]+)', 1) AS host, list_filter(string_split(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS p FROM (SELECT page_id, {LINK} AS link FROM pages)),
  s AS (SELECT *, len(p) AS n, CASE WHEN contains(p[len(p)], '.') THEN p[4:len(p) - 1] ELSE p[4:] END AS raw FROM l)
  SELECT page_id, CASE WHEN host = 'www.skills.sh' AND n >= 3 THEN p[1] || '/' || p[2] || '@main:skills/' || array_to_string(p[3:], '/') WHEN host = 'github.com' AND n >= 5 AND p[3] = 'tree' THEN p[1] || '/' || p[2] || '@' || p[4] || ':' || array_to_string(p[5:], '/')
    WHEN host = 'raw.githubusercontent.com' AND n >= 4 AND len(raw) > 0 THEN p[1] || '/' || p[2] || '@' || p[3] || ':' || array_to_string(raw, '/') END AS source FROM s""")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages", "page_id", "url").withColumn("r", x.repository_path(F.expr(LINK)))
    return rows.select("page_id", F.when(F.col("r").isNotNull(), F.format_string("%s/%s@%s:%s", "r.owner", "r.repo", "r.ref", "r.subpath")).alias("source"))


@query("SELECT p_partkey, regexp_full_match(lower(p_name), '[a-z0-9][a-z0-9_-]*') AND length(p_name) <= 64 AS ok, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select("p_partkey", x.is_name(F.lower("p_name")).alias("ok"), x.slug(F.col("p_type")).alias("slug"))


@query("SELECT p_partkey, p_name || ' ${TYPE} ${NOPE} $ {TYPE} t$ ${' AS text FROM part")
def env_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.concat("p_name", F.lit(" ${BRAND} ${NOPE} $ {TYPE} ${TYPE}$ ${"))
    return load(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", x.expand_env(template, {"BRAND": "${TYPE}", "TYPE": "t"}).alias("text"))


@query("SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_linenumber <> 3 THEN l_partkey ELSE 0 END - CASE WHEN l_linenumber <> 2 THEN l_suppkey ELSE 0 END, 0) AS tokens FROM lineitem")
def usage_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", x.uncached(F.when(n != 3, F.col("l_partkey")), F.when(n != 2, F.col("l_suppkey"))).alias("tokens"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '[image: image/png]' WHEN 1 THEN text || chr(10) || lang WHEN 2 THEN '[binary resource: mem://' || doc_id || ']' ELSE '(no output)' END AS text FROM documents""")
def content_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = lambda kind, text=None, mime=None, uri=None: F.struct(F.lit(kind).alias("type"), *((F.lit(None).cast("string") if v is None else v).alias(n) for n, v in (("text", text), ("mime", mime), ("uri", uri))))
    k, uri = F.col("doc_id") % 4, F.concat(F.lit("mem://"), F.col("doc_id").cast("string"))
    text = block("text", F.col("text"))
    blocks = F.when(k == 0, F.array(text, block("image", mime=F.lit("image/png")))).when(k == 1, F.array(text, block("odd"), block("resource", F.col("lang"), uri=uri))).when(k == 2, F.array(block("resource", uri=uri))).otherwise(F.array(block("odd")))
    return documents(spark, sf_dir).select("doc_id", x.flatten_content(blocks).alias("text"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'bigint' WHEN 'click' THEN 'double' WHEN 'purchase' THEN 'boolean' WHEN 'signup' THEN 'array<string>' ELSE 'string' END AS kind FROM events")
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "integer").when(F.col("event_type") == "click", "number").when(F.col("event_type") == "purchase", "boolean").when(F.col("event_type") == "signup", "array").otherwise("date")
    return load(spark, sf_dir, "events", "event_id", "event_type").select("event_id", x.sql_type(name).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'inline' WHEN p_size % 3 = 1 THEN 'fork' WHEN p_size % 4 = 0 THEN 'fork' ELSE 'inline' END AS mode, CASE p_size % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'recent' WHEN 2 THEN 'none' ELSE 'full' END AS context FROM part")
def skill_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    mode = F.when(size % 3 == 0, "inline").when(size % 3 == 1, "fork").otherwise("")
    context = F.when(size % 4 == 0, "fork").when(size % 4 == 1, "recent").when(size % 4 == 2, "none")
    rows = load(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("m", x.run_mode(mode, context))
    return rows.select("p_partkey", "m.mode", "m.context")
