"""Compilers and scalar functions, with the traps that engines differ in."""

import fnmatch
import json
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import coerce, patterns, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


GLOBS = ["*", "a*", "?b", "[ab]c", "[!ab]c", "a[", "a.b", "*.py", "[]x]", "a\\b", "^$", "a[b-d]*"]
NAMES = ["", "a", "ab", "bc", "cc", "a[", "axb", "a.b", "x/y.py", "]", "a\n", "a\\b", "^$", "acz", "x"]


def test_globs_match_as_a_shell_does(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for g in GLOBS:
        got = {r["n"] for r in df.where(patterns.glob_match(F.col("n"), g)).collect()}
        assert got == {n for n in NAMES if fnmatch.fnmatchcase(n, g)}, g


def test_glob_regex_does_not_let_a_newline_pass():
    assert patterns.glob_to_regex("a").endswith(r"\z")


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ("tool == Bash", True), ('tool == "Bash" && event == pre', True), ("tool != Bash || args.k == v", True), ("args.k =~ ^v$", True), ("args.k =~ /V/", False),
        ("args.k ~= v*", True), ("args.zero == ", True), ("args.missing == x", False), ("args.k =~ (", False), ("", True), ("other == ", True), ("args.k =~ a==b", False),
    ],
)
def test_conditions(spark, condition, expected):
    args = F.lit(json.dumps({"k": "v", "zero": 0}))
    assert one(spark, patterns.compile_condition(condition, F.lit("Bash"), F.lit("pre"), args)) is expected


def test_conditions_that_do_not_parse():
    for bad in ("a == b && c == d || e == f", "nothing here"):
        with pytest.raises(patterns.ConditionError):
            patterns.compile_condition(bad, F.lit(""), F.lit(""), F.lit("{}"))


DIFFS = [("a\nb\nc", "a\nx\nc"), ("a", "a"), ("", "x"), ("a\nb", "b"), ("a\na\na", "a\na"), ("\n".join("abcdefgh"), "\n".join("abcdXYefgh"))]


def test_line_diff_counts(spark):
    for old, new in DIFFS:
        a, b = old.split("\n"), new.split("\n")
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        s = 0
        while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
            s += 1
        got = one(spark, text.line_diff(F.col("a"), F.col("b")), a=old, b=new)
        assert (got["additions"], got["removals"]) == (len(b) - p - s, len(a) - p - s)
        shown = got["text"].split("\n") if got["text"] else []
        assert sum(line.startswith("+") for line in shown) == got["additions"] and sum(line.startswith("-") for line in shown) == got["removals"]


def test_line_diff_numbers_and_limit(spark):
    got = one(spark, text.line_diff(F.col("a"), F.col("b")), a="a\nb\nc", b="a\nx\nc")
    assert got["text"] == "     1  a\n-    2  b\n+    2  x\n     3  c"
    long = one(spark, text.line_diff(F.col("a"), F.col("b")), a="", b="\n".join("x" * 300))
    assert len(long["text"].split("\n")) == 201


def test_cut_bytes_drops_split_characters(spark):
    assert one(spark, text.cut_bytes(F.col("t"), 5), t="ééé") == "éé"
    assert one(spark, text.truncate_index(F.col("t"), 2, 4), t="é\nabc\nd") == "é"


def test_frontmatter(spark):
    t = "---\nname: 'x y'\ndescription: \"q\"\nmore: 1\n---\nbody\nname: no"
    assert [one(spark, text.frontmatter(F.col("t"), f), t=t) for f in ("name", "description", "type")] == ["x y", "q", ""]
    assert one(spark, text.frontmatter(F.col("t"), "name"), t="name: no") == ""


def test_json_object_and_tags(spark):
    cases = {"x {\"a\": 1} y": '{"a": 1}', "{\"a\": 1} y": '{"a": 1} y', "none": "", "} {": "", "```{}```": "{}"}
    for t, want in cases.items():
        assert one(spark, text.json_object(F.col("t")), t=t) == want
    assert one(spark, text.tagged(F.col("t")), t="a <summary> b </summary> c") == "b"
    assert one(spark, text.tagged(F.col("t")), t=" plain ") == "plain"


def test_nested_coercion():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}, "o": {"type": "object", "properties": {"b": {"type": "boolean"}}}}}
    given = {"n": " 12 ", "l": {"item": ["1.5", "x"]}, "o": {"b": "TRUE", "c": "TRUE"}, "z": "1"}
    assert coerce.coerce(given, schema) == {"n": 12, "l": [1.5, "x"], "o": {"b": True, "c": "TRUE"}, "z": "1"}
    for value, want in (("1_000", "1_000"), (True, True), ("inf", "inf")):
        assert coerce.coerce(value, {"type": "integer"}) == want
    assert coerce.coerce(7, {"type": "string"}) == "7" and coerce.coerce(True, {"type": "string"}) is True
    assert coerce.coerce("a, b,", {"type": "array"}) == ["a", "b"]


def test_rule_parse_keeps_inner_brackets(spark):
    got = one(spark, patterns.parse_rule(F.col("r")), r="Bash(a(b))")
    assert (got["tool"], got["pattern"]) == ("Bash", "a(b)")
    assert re.match(patterns.glob_to_regex("a").replace(r"\z", r"\Z"), "a")
