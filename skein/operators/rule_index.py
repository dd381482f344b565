"""Rules that come as a table, in any number: globs indexed by their literal parts and joined with the calls.

A glob is filed under one literal part of its own: the whole glob, its first or its last letters (of the sizes SIZES), three letters of its
longest inner run, or nothing. A call looks under the parts of its own content, so it meets the few rules that share one, and
only those are tested. The plan has the same size for ten rules and for a million.

Calls are looked at once for each distinct (tool, content), however often it stands. A call without tool or content fits no rule; a rule without tool, pattern or
a known effect is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.rules import SEVERITY, _worst
from skein.operators.skew import join_dealt
from skein.tables import new_folder

#: Lengths of first and last letters under which globs are filed.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
GRAM = 3
#: Up to so many rules are broadcast, counted first; more are joined by a shuffle.
BROADCAST_RULES = 200_000

_CLASS = r"\[!?+.[^\]]*+\]"


def _class_regex(body: Column) -> Column:
    """The inside of ``[...]``: ranges that run backwards hold nothing."""
    negated = body.startswith("!")
    inner = F.when(negated, F.substr(body, F.lit(2))).otherwise(body)
    parts = F.filter(F.regexp_extract_all(inner, F.lit(r"(?s).-.|."), F.lit(0)), lambda p: (F.length(p) < 3) | (F.left(p, F.lit(1)) <= F.right(p, F.lit(1))))
    escaped = F.transform(parts, lambda p: F.regexp_replace(p, r"([\\\[\]^&~])", r"\\$1"))
    return F.when((F.size(parts) == 0) & negated, ".").when(F.size(parts) == 0, "(?!)").otherwise(F.concat(F.when(negated, "[^").otherwise("["), F.array_join(escaped, ""), F.lit("]")))


def glob_regex(glob: Column) -> Column:
    """patterns.glob_to_regex of a column."""

    def one(t: Column) -> Column:
        plain = t.rlike(r"[A-Za-z0-9_ ]") | (F.ascii(t) > 127)
        return F.when(t == "*", ".*").when(t == "?", ".").when(F.length(t) > 2, _class_regex(F.substr(t, F.lit(2), F.length(t) - 2))).when(plain, t).otherwise(F.concat(F.lit("\\"), t))

    tokens = F.regexp_extract_all(glob, F.lit(rf"(?s){_CLASS}|."), F.lit(0))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, one), ""), F.lit(r"\z"))


def _filed(tool: Column, kind: str, size: Column, part: Column) -> Column:
    return F.xxhash64(tool, F.lit(kind), size, part)


def _size_of(part: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, SIZES)), lambda s: s <= F.length(part))), F.lit(0))


def index_rules(rules: DataFrame) -> DataFrame:
    """rules (tool, pattern, effect) to (rule_tool, pattern, level, kind, size, filed, regex), one for each (tool, pattern): its strictest."""
    level = F.coalesce(*(F.when(F.col("effect") == name, n) for name, n in SEVERITY.items()))
    rules = rules.select(F.col("tool").alias("rule_tool"), "pattern", level.alias("level")).where("rule_tool is not null and pattern is not null and level is not null")
    rules = rules.groupBy("rule_tool", "pattern").agg(F.max("level").alias("level"))
    glob, no_class = F.col("pattern"), F.regexp_replace("pattern", f"(?s){_CLASS}", "*")
    first, last = F.regexp_extract(glob, r"(?s)\A[^*?\[]*", 0), F.regexp_extract(glob, r"(?s)[^*?\[\]]*\z", 0)
    runs = F.transform(F.split(no_class, r"[*?\[\]]"), lambda x: F.struct(F.length(x).alias("n"), x.alias("run")))
    rules = rules.withColumns({"first": first, "last": last, "run": F.array_max(runs)["run"]})
    head, tail = _size_of(F.col("first")), _size_of(F.col("last"))
    kind = (
        F.when(F.col("first") == glob, "whole").when((F.greatest(head, tail) >= GRAM) & (head >= tail), "first").when(tail >= GRAM, "last")
        .when(F.length("run") >= GRAM, "inner").when(head > 0, "first").when(tail > 0, "last").otherwise("any")
    )
    rules = rules.withColumn("kind", kind)
    size = F.when(F.col("kind") == "first", head).when(F.col("kind") == "last", tail).otherwise(0)
    rules = rules.withColumn("size", size)
    tool = F.col("rule_tool")
    filed = F.coalesce(
        *(
            F.when(F.col("kind") == k, _filed(tool, k, F.col("size"), part))
            for k, part in (
                ("whole", glob), ("first", F.left("first", F.col("size"))), ("last", F.right("last", F.col("size"))), ("inner", F.left("run", F.lit(GRAM))), ("any", F.lit("")),
            )
        )
    )
    return rules.select("rule_tool", "pattern", "level", "kind", "size", filed.alias("filed"), F.when(F.col("kind") != "whole", glob_regex(glob)).alias("regex"))


def _keys(tool: Column, content: Column, ways: list[tuple[str, int]]) -> Column:
    """Where a content looks: only the ways by which any rule is filed."""
    single, many = [], []
    for kind, size in ways:
        n = F.lit(size)
        if kind == "inner":
            grams = F.transform(F.sequence(F.lit(1), F.length(content) - GRAM + 1), lambda k: F.substr(content, k, F.lit(GRAM)))
            many.append(F.when(F.length(content) >= GRAM, F.transform(F.array_distinct(grams), lambda g: _filed(tool, "inner", n, g))))
        else:
            part = {"whole": content, "first": F.left(content, n), "last": F.right(content, n), "any": F.lit("")}[kind]
            single.append(F.when(F.length(content) >= size, _filed(tool, kind, n, part)))
    keys = F.filter(F.array(*single) if single else F.array().cast("array<bigint>"), lambda k: k.isNotNull())
    return F.concat(keys, *(F.coalesce(m, F.array().cast("array<bigint>")) for m in many))


def severity(calls: DataFrame, rules: DataFrame, tool: str = "tool", content: str = "content", effect: str = "effect", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """calls with `effect`: the strictest of the rules (tool, pattern, effect) that fit, null if none does. The index is written once; two small jobs over it decide how it is joined."""
    spark, at = rules.sparkSession, new_folder(rules.sparkSession)
    index = index_rules(rules)
    index.write.parquet(at)
    index = spark.read.schema(index.schema).parquet(at)
    ways = [(r["kind"], r["size"]) for r in index.select("kind", "size").distinct().collect()]  # at most 27
    pairs = calls.groupBy(F.col(tool).alias("_tool"), F.col(content).alias("_content")).agg(F.count("*").alias("_n")).where("_tool is not null and _content is not null")
    asked = pairs.select("_tool", "_content", F.explode(_keys(F.col("_tool"), F.col("_content"), sorted(ways))).alias("filed"))
    if index.limit(broadcast_rules + 1).count() <= broadcast_rules:
        met = asked.join(F.broadcast(index), "filed")
    else:  # a part that many contents share is dealt over tasks
        met = join_dealt(asked, index.join(asked.groupBy("filed").agg(F.count("*").alias("_asked")), "filed"), ["filed"], "_asked")
    fits = (F.col("rule_tool") == F.col("_tool")) & F.when(F.col("kind") == "whole", F.col("_content") == F.col("pattern")).otherwise(F.rlike("_content", F.col("regex")))
    worst = met.where(fits).groupBy("_tool", "_content").agg(F.max("level").alias("_level"))
    verdicts = pairs.join(worst, ["_tool", "_content"]).select("_tool", "_content", "_n", _worst(F.col("_level")).alias("_effect"))
    keyed = calls.drop(effect).withColumns({"_tool": F.col(tool), "_content": F.col(content)})
    return join_dealt(keyed, verdicts, ["_tool", "_content"], "_n", "left").withColumnRenamed("_effect", effect).drop("_tool", "_content")


def danger_by_rows(commands: DataFrame, patterns: DataFrame, command: str = "command", reason: str = "reason", most: int = 10_000) -> DataFrame:
    """commands with the reason of the first pattern (seq, pattern, reason) found in them, else null. Regexes have no literal part to join on: they travel as one array, of `most` at most."""
    rows = patterns.where("pattern is not null").agg(F.array_sort(F.collect_list(F.struct("seq", "pattern", "reason"))).alias("_patterns"))
    n = patterns.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} patterns")
    found = F.get(F.filter("_patterns", lambda p: F.rlike(F.col(command), p["pattern"])), F.lit(0))
    return commands.drop(reason).crossJoin(F.broadcast(rows)).withColumn(reason, found["reason"]).drop("_patterns")
