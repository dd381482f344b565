"""Queries of catalogs and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import patterns
from skein.functions.registry import Registry
from skein.operators import catalog as c
from skein.operators import coordination
from skein.plans.registry import query
from skein.plans.rules import made, made_sql
from skein.tables import load, rows_of


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("description"))


ASKED = ["steel", "promo steel steel", ""]


def _score(q: str) -> str:
    one = lambda col, part, n: f"CASE WHEN contains(lower({col}), '{part}') THEN {n} ELSE 0 END"
    return " + ".join([one("p_name", q, 10), one("descr", q, 5), *(x for w in q.split() for x in (one("p_name", w, 3), one("descr", w, 1)))])


@query(" UNION ALL ".join(f"(SELECT '{q}' AS query, p_partkey, CAST({_score(q)} AS BIGINT) AS score FROM (SELECT *, concat_ws(' ', p_type, p_brand) AS descr FROM part) WHERE {_score(q)} > 0 ORDER BY 3 DESC, 2 LIMIT 5)" for q in ASKED))
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for q in ASKED:
        best = c.search(parts(spark, sf_dir), q, "p_name", "description", "p_partkey").select(F.lit(q).alias("query"), "p_partkey", "score")
        found = best if found is None else found.union(best)
    return found


NAMES = ["Customer#000000007", "Customer#000000003", "nobody"]


@query(f"SELECT c_custkey, list_position({NAMES}, c_name) AS pos FROM customer WHERE c_name IN ({', '.join(repr(n) for n in NAMES)})")
def select_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.select_names(load(spark, sf_dir, "customer", "c_custkey", "c_name"), NAMES, "c_name").select("c_custkey", "pos")


@query("SELECT c_name FROM customer WHERE c_name LIKE 'Customer#00000001%' OR c_mktsegment LIKE 'AUTO%' ORDER BY c_name LIMIT 8")
def prefix_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer", "c_name", "c_mktsegment").withColumn("aliases", F.array("c_mktsegment"))
    pick = customers.withColumn("aliases", F.transform("aliases", lambda a: F.when(a.startswith("AUTO"), F.lit("Customer#00000001")).otherwise(a)))
    return c.complete(pick, "Customer#00000001", "c_name", "aliases").select("c_name")


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey % 7 <> 0")
def deferred_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = load(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 3 == 0).alias("deferred"))
    found = load(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("name"))
    off = cat.where(F.col("name") % 7 == 0).select("name")
    return c.deferred(cat, found, off).select("name")


@query("SELECT p_partkey FROM part WHERE left(p_brand, 7) = 'Brand#5' OR (p_brand NOT IN ('Brand#11', 'Brand#12') AND p_brand IN ('Brand#11', 'Brand#13', 'Brand#21'))")
def agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_brand")
    name = F.when(F.col("p_brand").startswith("Brand#5"), F.concat(F.lit("mcp__"), "p_brand")).otherwise(F.col("p_brand"))
    return p.where(c.agent_tools(name, ["Brand#11"], ["Brand#12"], ["Brand#11", "Brand#13", "Brand#21"])).select("p_partkey")


SHORT, FULL = "replace(p_name, ' ', '_')", "'mcp__' || p_brand || '__' || replace(p_name, ' ', '_')"
NAMES_ASKED = {
    "server": "CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE 'Brand#' || p_size % 25 END",
    "tool": f"CASE p_partkey % 5 WHEN 2 THEN {FULL} WHEN 3 THEN 'nothing' ELSE {SHORT} END",
}


@query(f"""WITH t AS (SELECT DISTINCT {FULL} AS "full", p_brand AS server, {SHORT} AS short FROM part WHERE p_size % 16 = 0), a AS ({made_sql(**NAMES_ASKED)})
  SELECT p_partkey, coalesce((SELECT "full" FROM t WHERE "full" = a.tool), (SELECT "full" FROM t WHERE t.server = a.server AND short = a.tool), (SELECT min("full") FROM t WHERE short = a.tool HAVING count(*) = 1)) AS "full" FROM a""")
def resolve_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = load(spark, sf_dir, "part", "p_name", "p_brand", "p_size").where("p_size % 16 = 0").select(F.expr(FULL).alias("full"), F.col("p_brand").alias("server"), F.expr(SHORT).alias("short")).distinct()
    return c.resolve(made(spark, sf_dir, **NAMES_ASKED), tools).select("p_partkey", "full")


@query("""WITH m AS (SELECT c_nationkey AS team, c_custkey || '' AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name FROM customer),
  a AS (SELECT o_orderkey, o_custkey % 25 AS team, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '' WHEN 1 THEN 'BUILDING' ELSE 'Customer#' || lpad(o_custkey || '', 9, '0') END AS recipient FROM orders),
  n AS (SELECT team, name, arg_min(id, CAST(id AS BIGINT)) AS id FROM m GROUP BY ALL)
  SELECT o_orderkey, coalesce(m.id, n.id) AS member_id FROM a LEFT JOIN m ON m.team = a.team AND m.id = recipient LEFT JOIN n ON n.team = a.team AND n.name = recipient""")
def resolve_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, orders = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"), load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    members = cust.select(F.col("c_nationkey").alias("team"), F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("name"), F.col("c_custkey").alias("seq"))
    k = F.col("o_orderkey") % 3
    key = F.col("o_custkey").cast("string")
    to = F.when(k == 0, key).when(k == 1, "BUILDING").otherwise(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0")))
    asked = orders.select("o_orderkey", (F.col("o_custkey") % 25).alias("team"), to.alias("recipient"))
    return coordination.recipients(asked, members, "team").select("o_orderkey", "member_id")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in three layers that overlap by key."""
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return cust.select((F.col("c_custkey") % 500).alias("key"), (F.col("c_custkey") % 3).alias("layer"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("value"))


LAYERS = "l AS (SELECT c_custkey % 500 AS key, c_custkey % 3 AS layer, c_custkey AS seq, c_acctbal AS value FROM customer)"


@query(f"WITH {LAYERS} SELECT key, layer, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer * 1000000000 + seq) AS n FROM l) WHERE n = 1")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers(spark, sf_dir).withColumn("priority", F.col("layer") * 1_000_000_000 + F.col("seq"))
    return c.first_wins(rows, "key", "priority").select("key", "layer", "seq", "value")


@query(f"WITH {LAYERS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC, seq DESC) AS d, row_number() OVER (PARTITION BY key ORDER BY layer, seq) AS a FROM l) SELECT x.key, x.value, y.layer AS first_layer, y.seq AS first_seq FROM r x JOIN r y ON x.key = y.key AND x.d = 1 AND y.a = 1")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.last_wins(layers(spark, sf_dir), "key", "layer", "seq", "value")


@query("""WITH b AS (SELECT c_custkey AS key, c_acctbal AS value, c_custkey % 2 = 0 AS flag, c_custkey % 5 AS last FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT c_custkey, -c_acctbal AS v, c_custkey % 7 = 0 AS f, c_custkey % 4 AS l FROM customer WHERE c_custkey % 4 = 0)
  SELECT coalesce(key, c_custkey) AS key, coalesce(v, value) AS value, coalesce(flag, false) OR coalesce(f, false) AS flag, coalesce(l, last) AS last FROM b FULL JOIN o ON key = c_custkey""")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    base = cust.where(k % 3 != 0).select(k.alias("key"), F.col("c_acctbal").alias("value"), (k % 2 == 0).alias("flag"), (k % 5).alias("last"))
    over = cust.where(k % 4 == 0).select(k.alias("key"), (-F.col("c_acctbal")).alias("value"), (k % 7 == 0).alias("flag"), (k % 4).alias("last"))
    return c.merge_config(base, over, "key", "value", "flag", "last")


LADDER = {
    "configured": "CASE WHEN p_size % 5 = 0 THEN p_size * 1000 ELSE 0 END", "fetched": "CASE WHEN p_size % 7 = 0 THEN p_partkey ELSE 0 END",
    "model": "CASE p_partkey % 10 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'O1-' || p_type WHEN 2 THEN 'o3' WHEN 3 THEN p_type || '-1M' WHEN 4 THEN 'GPT-4.1' WHEN 5 THEN 'gpt-3.5-' || p_type WHEN 6 THEN 'claude ' || p_type WHEN 7 THEN 'gpt-4-turbo' WHEN 8 THEN 'o4-mini' ELSE p_type END",
}


@query(f"""SELECT p_partkey, CAST(CASE WHEN configured > 0 THEN configured WHEN fetched > 0 THEN fetched WHEN contains(m, '1m') OR contains(m, 'gpt-4.1') THEN 1000000 WHEN contains(m, 'gpt-4o') OR contains(m, 'gpt-4-turbo') THEN 128000
  WHEN contains(m, 'o1') OR contains(m, 'o3') OR contains(m, 'o4') THEN 200000 WHEN contains(m, 'gpt-3.5') THEN 16385 WHEN contains(m, 'claude') THEN 200000 ELSE 128000 END AS BIGINT) AS "window" FROM (SELECT *, lower(model) AS m FROM ({made_sql(**LADDER)}))""")
def window_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, **LADDER).select("p_partkey", c.context_window(F.col("configured"), F.col("fetched"), F.col("model")).alias("window"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'native' WHEN chars <= 0 OR floor(chars / 2.5) < 200 * 10 / 100 THEN 'eager' WHEN p_partkey % 2 = 0 THEN 'native' ELSE 'dispatch' END AS mode FROM (SELECT *, length(p_name) * (p_partkey % 5) AS chars FROM part)")
def loading_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    override = F.when(F.col("p_brand") == "Brand#11", "native").otherwise("")
    chars = F.length("p_name") * (F.col("p_partkey") % 5)
    return p.select("p_partkey", c.loading_mode(override, F.col("p_partkey") % 2 == 0, F.lit(200), chars).alias("mode"))


@query("SELECT coalesce(sum(length(p_type)), 0) AS chars FROM part WHERE p_brand LIKE 'Brand#1%'")
def catalog_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.schema_size(load(spark, sf_dir, "part", "p_type", "p_brand"), "p_type", "Brand#1", "p_brand")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def newest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.newest(load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), 200, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT user_id, event_type, last_use, rank FROM (SELECT user_id, event_type, max(event_id) AS last_use, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS rank FROM events GROUP BY user_id, event_type) WHERE rank <= 3")
def recent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.recent_distinct(load(spark, sf_dir, "events", "user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 3)


@query("SELECT 'team-' || min(k) AS name FROM (SELECT 2 AS k UNION SELECT s_suppkey + 1 FROM supplier WHERE s_suppkey > 0) WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def free_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = load(spark, sf_dir, "supplier", "s_suppkey").select(F.concat(F.lit("team-"), F.col("s_suppkey").cast("string")).alias("name"))
    return c.free_name(taken.union(rows_of(spark, "name string", [("team",)])), "team", "name")


NAMED = {
    "server": "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' ELSE 'li near ' || p_type END",
    "tool": "CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'mcp__' || p_type || '__' || p_name ELSE p_type || '__' || p_name END",
}


@query(f"""SELECT p_partkey, CASE WHEN s = '' THEN t ELSE s || '__' || t END AS name FROM (SELECT p_partkey, regexp_replace(CASE WHEN server <> '' THEN server WHEN cut > 0 THEN substr(bare, 1, cut - 1) ELSE '' END, '[^A-Za-z0-9_]', '_', 'g') AS s,
  regexp_replace(CASE WHEN cut > 0 THEN substr(bare, cut + 2) ELSE bare END, '[^A-Za-z0-9_]', '_', 'g') AS t FROM (SELECT *, position('__' IN bare) AS cut FROM (SELECT *, regexp_replace(tool, '^mcp__', '') AS bare FROM ({made_sql(**NAMED)}))))""")
def canonical_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, **NAMED).select("p_partkey", patterns.canonical_tool(F.col("server"), F.col("tool")).alias("name"))


SHAPES = [("anthropic", "native"), ("anthropic", "dispatch"), ("openai", "native")]


@query(" UNION ALL ".join(
    f"""SELECT '{protocol}' AS protocol, '{mode}' AS mode, p_partkey AS seq, name, CAST({"json_object('type', 'function', 'name', name, 'description', p_type, 'parameters', p_brand)" if protocol == "openai" else "CASE WHEN late THEN json_object('name', name, 'description', p_type, 'input_schema', p_brand, 'defer_loading', true) ELSE json_object('name', name, 'description', p_type, 'input_schema', p_brand) END"} AS VARCHAR) AS schema
    FROM (SELECT *, CASE p_partkey WHEN 1 THEN 'ToolSearch' WHEN 2 THEN 'mcp_call' ELSE 't' || p_partkey END AS name, p_partkey % 3 = 0 AND p_partkey % 6 <> 0 AS late FROM part) WHERE p_partkey % 10 <> 0 AND name <> 'mcp_call' {"" if (protocol, mode) == ("anthropic", "native") else "AND NOT late"}"""
    for protocol, mode in SHAPES))
def tool_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand")
    k = F.col("p_partkey")
    tools = p.select(F.when(k == 1, c.SEARCH_TOOL).when(k == 2, c.CALL_TOOL).otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("input_schema"), (k % 3 == 0).alias("deferred"), k.alias("seq"))
    found, off = tools.where("seq % 6 = 0"), tools.where("seq % 10 = 0")
    out = None
    for protocol, mode in SHAPES:
        rows = c.tool_schemas(tools, found, off, protocol, mode, show_call=False).select(F.lit(protocol).alias("protocol"), F.lit(mode).alias("mode"), "seq", "name", "schema")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT p_partkey, p_partkey = (SELECT max(p_partkey) FROM part WHERE p_size % 3 <> 0) AS cached FROM part")
def cached_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("deferred", F.col("p_size") % 3 == 0)
    return c.mark_cached_tool(p, "p_partkey").select("p_partkey", "cached")


@query("SELECT c_name, c_custkey FROM customer ORDER BY c_name")
def name_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.by_name(load(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_name")


@query("""SELECT k, CASE WHEN k % 4 = 0 THEN 'p' || n ELSE 'q,r' END AS providers, CASE WHEN k % 5 <> 0 THEN 'acceptEdits' WHEN k % 3 = 0 THEN 'default' ELSE 'plan' END AS mode,
  CASE WHEN k % 3 = 0 THEN 'a=' || k || ',b=1' ELSE 'a=' || k || ',b=7,c=' || k END AS servers, 'h' || n || ',o' AS hooks, k % 7 <> 0 AS fork, k % 2 = 0 OR k % 3 = 1 AS verify, CASE WHEN k % 2 = 0 THEN 'x' ELSE 'w' END AS team
  FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer)""")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    texts = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    server = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    base = F.struct(texts(F.concat(F.lit("p"), n)).alias("providers"), F.when(k % 3 == 0, "default").otherwise("plan").alias("mode"), F.array(server("a", k), server("b", F.lit(1))).alias("servers"), texts(F.concat(F.lit("h"), n)).alias("hooks"), F.lit(True).alias("fork"), (k % 2 == 0).alias("verify"), F.lit("w").alias("team"))
    over = F.struct(F.when(k % 4 == 0, none("string")).otherwise(texts("q", "r")).alias("providers"), F.when(k % 5 == 0, "default").otherwise("acceptEdits").alias("mode"), F.when(k % 3 == 0, none("struct<name:string,value:string>")).otherwise(F.array(server("b", -k), server("c", k), server("b", F.lit(7)))).alias("servers"), texts("o").alias("hooks"), (k % 7 != 0).alias("fork"), (k % 3 == 1).alias("verify"), F.when(k % 2 == 0, "x").otherwise("").alias("team"))
    rows = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(k.alias("k"), c.merge_settings(base, over).alias("s"))
    servers = F.transform("s.servers", lambda x: F.concat(x["name"], F.lit("="), x["value"]))
    return rows.select("k", F.array_join("s.providers", ",").alias("providers"), "s.mode", F.array_join(servers, ",").alias("servers"), F.array_join("s.hooks", ",").alias("hooks"), "s.fork", "s.verify", "s.team")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 4 = 3 THEN NULL ELSE user_id || '!' END WHEN event_type = 'click' THEN CAST(user_id + event_id AS VARCHAR) END AS output, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 4 = 3 THEN 'bad arguments of view' END WHEN event_type <> 'click' THEN 'unknown tool: ' || event_type END AS error FROM events")
def dispatch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered tools, called by the type of an event."""
    tools = Registry()
    tools.register("view", "says a text", {"type": "object", "properties": {"text": {"type": "string"}}, "required": ["text"]})(lambda a: F.concat(a["text"], F.lit("!")))
    tools.register("click", "adds numbers", {"type": "object", "properties": {"of": {"type": "array", "items": {"type": "integer"}}}})(lambda a: F.aggregate(a["of"], F.lit(0).cast("long"), lambda n, x: n + x).cast("string"))
    e = load(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    say = F.when(F.col("event_id") % 4 == 3, "{}").otherwise(F.format_string('{"text": "%d"}', "user_id"))
    arguments = F.when(F.col("event_type") == "view", say).otherwise(F.format_string('{"of": [%d, %d]}', "user_id", "event_id"))
    called = e.withColumn("r", tools.dispatch(F.col("event_type"), arguments))
    return called.select("event_id", F.col("r")["output"].alias("output"), F.col("r")["error"].alias("error"))
