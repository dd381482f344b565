"""Catalogs: search, completion, visibility, name resolution and layered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keyword_score(name: Column, description: Column, query: str) -> Column:
    """10 and 5 for the whole query in name and description, 3 and 1 for each of its words; repeated words count again."""
    name, description, query = F.lower(name), F.lower(description), query.lower()
    has = lambda c, part, points: F.when(F.contains(c, F.lit(part)), points).otherwise(0)
    score = has(name, query, 10) + has(description, query, 5)
    for word in query.split():
        score = score + has(name, word, 3) + has(description, word, 1)
    return score


def search(catalog: DataFrame, query: str, name: str, description: str, order: str, k: int = 5, scorer=keyword_score) -> DataFrame:
    """The k best of positive score, ties in order of registration: a distributed top-k, no full sort. scorer: a column of name, description and query."""
    scored = catalog.withColumn("score", scorer(F.col(name), F.coalesce(F.col(description), F.lit("")), query).cast("long"))
    return scored.where("score > 0").orderBy(F.desc("score"), order).limit(k)


def select_names(catalog: DataFrame, names: list[str], name: str) -> DataFrame:
    """Rows of the names asked for, with pos in the order asked."""
    pos = F.array_position(F.array(*map(F.lit, names)), F.col(name))
    return catalog.where(F.col(name).isin(*names)).withColumn("pos", pos)


def complete(catalog: DataFrame, prefix: str, name: str, aliases: str | None = None, k: int = 8) -> DataFrame:
    hit = F.col(name).startswith(prefix)
    if aliases:
        hit = hit | F.exists(aliases, lambda a: a.startswith(prefix))
    return catalog.where(hit).orderBy(name).limit(k)


def deferred(catalog: DataFrame, discovered: DataFrame, disabled: DataFrame, name: str = "name") -> DataFrame:
    """Deferred tools that are neither discovered nor disabled."""
    return catalog.where("deferred").join(discovered, name, "left_anti").join(disabled, name, "left_anti")


def agent_tools(name: Column, denied: list[str], agent_denied: list[str], allowed: list[str] | None) -> Column:
    """Whether an agent gets a tool: MCP tools always, others unless denied, and of an allow list if there is one."""
    ok = ~name.isin(*denied, *agent_denied)
    if allowed is not None:
        ok = ok & name.isin(*allowed)
    return name.startswith("mcp__") | ok


def resolve(asked: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds full to asked (server, tool): the exact full name, else the server's short name, else the only tool of that short name.

    tools: (full, server, short).
    """
    exact = asked.join(tools.select(F.col("full").alias("f1")), F.col("tool") == F.col("f1"), "left")
    own = tools.select(F.col("full").alias("f2"), F.col("server").alias("s2"), F.col("short").alias("t2"))
    named = exact.join(own, (F.col("server") == F.col("s2")) & (F.col("tool") == F.col("t2")), "left")
    single = tools.groupBy(F.col("short").alias("t3")).agg(F.min("full").alias("f3"), F.count("*").alias("n")).where("n = 1")
    every = named.join(single, F.col("tool") == F.col("t3"), "left")
    return every.withColumn("full", F.coalesce("f1", "f2", "f3")).drop("f1", "f2", "s2", "t2", "t3", "f3", "n")


def first_wins(layers: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key the row of the smallest priority."""
    rest = [c for c in layers.columns if c != key]
    return layers.groupBy(key).agg(F.min_by(F.struct(*rest), priority).alias("_row")).select(key, "_row.*")


def last_wins(layers: DataFrame, key: str, layer: str, seq: str, value: str) -> DataFrame:
    """Of each key the value of the highest layer, with the place where it was first seen."""
    return layers.groupBy(key).agg(F.max_by(value, F.struct(layer, seq)).alias(value), F.min(F.struct(layer, seq)).alias("_first")).select(key, value, F.col("_first")[layer].alias("first_layer"), F.col("_first")[seq].alias("first_seq"))


def merge_config(base: DataFrame, override: DataFrame, key: str, value: str, sticky: str, last: str) -> DataFrame:
    """Upsert by key: value of the override where it has one, sticky flags stay on, `last` is always the override's."""
    b = base.select(key, F.col(value).alias("v0"), F.col(sticky).alias("s0"), F.col(last).alias("l0"))
    o = override.select(F.col(key).alias("k1"), F.col(value).alias("v1"), F.col(sticky).alias("s1"), F.col(last).alias("l1"))
    both = b.join(o, F.col(key) == F.col("k1"), "full_outer")
    on = F.coalesce("s0", F.lit(False)) | F.coalesce("s1", F.lit(False))
    return both.select(F.coalesce(key, "k1").alias(key), F.coalesce("v1", "v0").alias(value), on.alias(sticky), F.coalesce("l1", "l0").alias(last))


def append_absent(old: Column, new: Column) -> Column:
    """Edges appended in order, each once."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), new)


def free_name(names: DataFrame, wanted: str, name: str) -> DataFrame:
    """The first free of wanted, wanted-2, wanted-3 ... without a limit: it is wanted or follows a taken one."""
    suffix = F.substr(F.col(name), F.lit(len(wanted) + 2))
    numbered = F.col(name).startswith(f"{wanted}-") & suffix.rlike(r"\A[1-9][0-9]*\z")
    k = F.when(F.col(name) == wanted, F.lit(1).cast("long")).when(numbered & (suffix != "1"), suffix.try_cast("long"))
    taken = names.select(k.alias("k")).where("k is not null").distinct()
    tries = taken.select(F.try_add("k", F.lit(1)).alias("k")).union(names.sparkSession.range(1, 2, numPartitions=1).select(F.col("id").alias("k")))
    first = tries.join(taken, "k", "left_anti").agg(F.min("k").alias("k"))
    return first.select(F.when(F.col("k") == 1, wanted).otherwise(F.concat(F.lit(f"{wanted}-"), F.col("k").cast("string"))).alias("name"))


def schema_size(catalog: DataFrame, schema: str, prefix: str | None = None, name: str = "name") -> DataFrame:
    rows = catalog if prefix is None else catalog.where(F.col(name).startswith(prefix))
    return rows.agg(F.coalesce(F.sum(F.length(schema)), F.lit(0)).alias("chars"))


def loading_mode(override: Column, official: Column, window: Column, chars: Column, percent: int = 10) -> Column:
    """An override wins; small catalogs load eagerly; large ones natively where the endpoint can, else by dispatch."""
    tokens = F.floor(chars / 2.5)
    return F.when(override.isin("eager", "native", "dispatch"), override).when((chars <= 0) | (tokens < window * percent / 100), "eager").when(official, "native").otherwise("dispatch")


#: Context windows by the first part of the model's name that is found.
WINDOWS = [
    ("1m", 1_000_000),
    ("gpt-4.1", 1_000_000),
    ("gpt-4o", 128_000),
    ("gpt-4-turbo", 128_000),
    ("o1", 200_000),
    ("o3", 200_000),
    ("o4", 200_000),
    ("gpt-3.5", 16_385),
    ("claude", 200_000),
]


def context_window(configured: Column, fetched: Column, model: Column, default: int = 128_000) -> Column:
    """Configured, else fetched, else by name, else the default."""
    by_name = F.coalesce(*(F.when(F.contains(F.lower(model), F.lit(part)), size) for part, size in WINDOWS), F.lit(default))
    return F.when(configured > 0, configured).when(fetched > 0, fetched).otherwise(by_name).cast("long")


def newest(rows: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(k)


def recent_distinct(rows: DataFrame, key: str, item: str, order: str, k: int = 10) -> DataFrame:
    """Of each key the k items used last, each once, with the place of the last use."""
    last = rows.groupBy(key, item).agg(F.max(order).alias("last_use"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("last_use"), item))).where(F.col("rank") <= k)


#: Names of the tools that search for and call tools that are not loaded.
SEARCH_TOOL, CALL_TOOL = "ToolSearch", "mcp_call"


def tool_schemas(tools: DataFrame, discovered: DataFrame, disabled: DataFrame, protocol: str = "anthropic", mode: str = "dispatch", show_search: bool = True, show_call: bool = True) -> DataFrame:
    """(seq, name, schema): what a model is told of each visible tool (name, description, input_schema, deferred, seq), as JSON.

    Deferred tools that were not discovered are left out; where the endpoint defers by itself (mode native) they stay, marked.
    """
    native = mode == "native" and protocol == "anthropic"
    hidden = [n for n, shown in ((SEARCH_TOOL, show_search), (CALL_TOOL, show_call)) if not shown]
    rows = tools.where(~F.col("name").isin(*hidden)) if hidden else tools
    rows = rows.join(disabled.select("name").distinct(), "name", "left_anti").join(discovered.select("name", F.lit(True).alias("_found")).distinct(), "name", "left")
    rows = rows.withColumn("_late", F.col("deferred") & F.col("_found").isNull())
    if not native:
        rows = rows.where(~F.col("_late"))
    if protocol in ("openai", "openai-compat"):
        shape = F.struct(F.lit("function").alias("type"), "name", "description", F.col("input_schema").alias("parameters"))
    else:
        shape = F.struct("name", "description", "input_schema", F.when(F.col("_late"), F.lit(True)).alias("defer_loading"))
    return rows.select("seq", "name", F.to_json(shape).alias("schema"))


def mark_cached_tool(tools: DataFrame, order: str, deferred: str = "deferred") -> DataFrame:
    """tools with cached: the last that is not deferred, if any. One aggregate of one row meets the tools, which are few."""
    last = tools.where(~F.col(deferred)).agg(F.max(order).alias("_last"))
    return tools.join(F.broadcast(last), F.col(order) == F.col("_last"), "left").withColumn("cached", F.col("_last").isNotNull()).drop("_last")


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """In order of code points, so listings agree from run to run."""
    return rows.orderBy(name)


def merge_settings(base: Column, override: Column) -> Column:
    """Two layers of settings, structs (providers, mode, servers: array of (name, value), hooks, fork, verify, team), as one.

    Providers are replaced as a whole, servers by name where they stand and new ones behind, hooks appended; mode and team yield to what is not
    the default; verify stays on; fork is always the override's.
    """
    wanted = F.transform(override["servers"], lambda s: s["name"])
    # of servers that repeat a name the last counts, where the name came first
    latest = lambda name: F.element_at(F.filter(override["servers"], lambda s: s["name"] == name), -1)
    names = F.transform(base["servers"], lambda s: s["name"])
    last_place = lambda s, i: ~F.array_contains(wanted, s["name"]) | (F.coalesce(F.array_position(F.slice(names, i + 2, F.size(names)), s["name"]), F.lit(0)) == 0)
    kept = F.transform(base["servers"], lambda s, i: F.when(F.array_contains(wanted, s["name"]) & last_place(s, i), latest(s["name"])).otherwise(s))
    new = F.transform(F.array_except(F.array_distinct(wanted), names), latest)
    return F.struct(
        F.when(F.size(override["providers"]) > 0, override["providers"]).otherwise(base["providers"]).alias("providers"),
        F.when(override["mode"] != "default", override["mode"]).otherwise(base["mode"]).alias("mode"),
        F.concat(kept, new).alias("servers"),
        F.concat(base["hooks"], override["hooks"]).alias("hooks"),
        override["fork"].alias("fork"),
        (base["verify"] | override["verify"]).alias("verify"),
        F.when(override["team"] != "", override["team"]).otherwise(base["team"]).alias("team"),
    )
