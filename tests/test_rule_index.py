"""Rules from tables against one regex at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions.patterns import glob_to_regex
from skein.operators import rule_index
from skein.operators.rules import SEVERITY
from skein.operators.skew import join_dealt

CALL, RULE = "id long, tool string, content string", "tool string, pattern string, effect string"


def plain(calls, rules):
    compiled = [(t, re.compile(glob_to_regex(p).replace(r"\z", r"\Z")), SEVERITY[e]) for t, p, e in rules if t is not None and p is not None and e in SEVERITY]
    names = {n: e for e, n in SEVERITY.items()}
    return {i: names.get(max((n for t, p, n in compiled if t == tool and c is not None and p.match(c)), default=0)) for i, tool, c in calls}


def got(spark, calls, rules, **kw):
    rows = rule_index.severity(spark.createDataFrame(calls, CALL), spark.createDataFrame(rules, RULE), **kw).collect()
    assert len(rows) == len(calls)
    return {r["id"]: r["effect"] for r in rows}


GLOBS = ["", "*", "?", "**", "git *", "git push*", "*.lock", "*secret*", "a*z", "[ab]*", "[!ab]?", "[", "x[", "[]]", "[!]]", "a[b-d]e", "[z-a]", "[!z-a]", "*[-x]*", "a.b", "a\\b*", "(x)|y", "^a$", "é*", "*€", "line\nbreak*", "*{2}*", "ab?de*gh", "a" * 70 + "*", "*" + "b" * 50, "[a&&b]", "~[~]"]
TEXTS = ["", "a", "b", "x", "[", "x[", "]", "git ", "git push", "git pushed", "git pull\n", "a.lock", ".lock", "my secret file", "az", "abz", "ace", "aee", "a.b", "axb", "a\\bc", "(x)|y", "^a$", "étude", "5 €", "line\nbreak", "a{2}", "abcdefgh", "abcdegh", "a" * 70, "a" * 71, "c" + "b" * 50, "&", "~~", "-"]


def test_globs_of_a_column_are_those_of_the_driver(spark):
    df = spark.createDataFrame([(g,) for g in GLOBS if "[z-a]" not in g and "[!z-a]" not in g], "g string").withColumn("regex", rule_index.glob_regex(F.col("g")))
    for r in df.collect():
        assert r["regex"] == glob_to_regex(r["g"]), r["g"]


@pytest.mark.parametrize("broadcast_rules", [0, 1000])
def test_each_glob_meets_what_it_fits(spark, broadcast_rules):
    r = random.Random(3)
    rules = [(r.choice(["Bash", "Read", None]), g, r.choice([*SEVERITY, "maybe", None])) for g in GLOBS + [None] if g != "[z-a]" and g != "[!z-a]" for _ in range(3)]
    calls = list(enumerate([(t, c) for t in ("Bash", "Read", "Other", None) for c in [*TEXTS, None]] * 2))
    calls = [(k, t, c) for k, (t, c) in calls]
    assert got(spark, calls, rules, broadcast_rules=broadcast_rules) == plain(calls, rules)


def test_a_backward_range_holds_nothing_and_breaks_nothing(spark):
    calls = [(1, "t", "m"), (2, "t", "z")]
    assert got(spark, calls, [("t", "[z-a]", "deny")]) == {1: None, 2: None}
    assert got(spark, calls, [("t", "[!z-a]", "ask")]) == {1: "ask", 2: "ask"}
    assert got(spark, calls, [("t", "[z-am]", "ask")]) == {1: "ask", 2: None}


def test_a_hundred_thousand_rules_in_a_plan_of_the_same_size(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 7)))
    shape = [lambda: f"{word()} {word()}*", lambda: f"*{word()}.{word()}", lambda: f"{word()}/{word()}", lambda: f"*{word()}{word()}*{word()}*", lambda: f"{word()}?{word()}*"]
    rules = [(f"t{r.randrange(5)}", r.choice(shape)(), r.choice(list(SEVERITY))) for _ in range(100_000)]
    calls = [(k, f"t{r.randrange(6)}", r.choice([f"{word()} {word()} {word()}", f"{word()}/{word()}", f"{word()}.{word()}"])) for k in range(400)]
    assert got(spark, calls, rules) == plain(calls, rules)
    plan = rule_index.severity(spark.createDataFrame(calls, CALL), spark.createDataFrame(rules, RULE))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    size = lambda n: len(rule_index.severity(spark.createDataFrame(calls, CALL), spark.createDataFrame(rules[:n], RULE).repartition(2))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(1000) - size(50_000)) < 2000


def test_no_rules_no_calls_and_clashing_columns(spark):
    calls = spark.createDataFrame([(1, "t", "c", "mine", 5)], CALL + ", effect string, level int")
    assert [tuple(r) for r in rule_index.severity(calls, spark.createDataFrame([], RULE)).select("id", "level", "effect").collect()] == [(1, 5, None)]
    assert rule_index.severity(calls.limit(0), spark.createDataFrame([("t", "*", "deny")], RULE)).collect() == []
    assert rule_index.severity(calls, spark.createDataFrame([("t", "*", "deny")], RULE)).first()["effect"] == "deny"


def test_a_hot_key_is_dealt(spark):
    big = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k")).repartition(4)
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    out = join_dealt(big, small, ["k"], "n", limit=100)
    assert out.count() == 5000 and out.where("one = 1").count() == 5000


def test_danger_patterns_from_rows(spark):
    patterns = spark.createDataFrame([(2, r"rm\s+-rf", "second"), (1, "drop +table", "first"), (3, None, "none")], "seq int, pattern string, reason string")
    commands = spark.createDataFrame([("rm -rf x; drop table y",), ("rm  -rf x",), ("ls",), (None,)], "command string")
    assert [r["reason"] for r in rule_index.danger_by_rows(commands, patterns).collect()] == ["first", "second", None, None]
    with pytest.raises(ValueError):
        rule_index.danger_by_rows(commands, patterns, most=2)
    assert {r["reason"] for r in rule_index.danger_by_rows(commands, patterns.limit(0)).collect()} == {None}
