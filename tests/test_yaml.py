"""YAML headers against what a loader makes of them."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions.yaml import frontmatter_variant, yaml_json
from skein.sources import files

READ = [
    ("", None),
    ("a: 1", {"a": 1}),
    ("a:\nb: x", {"a": None, "b": "x"}),
    ("# note\n\na: 1 # more\nb: 'it''s' # c\nc: \"q: \\\"x\\\" # no\"\n", {"a": 1, "b": "it's", "c": 'q: "x" # no'}),
    ("- 1\n- -2\n- 3.5\n- .5\n- 1_000\n- +7\n- 007\n- 1e3\n- 1.0e+3", [1, -2, 3.5, 0.5, 1000, 7, "007", "1e3", 1000.0]),
    ("a: yes\nb: No\nc: ON\nd: off\ne: true\nf: ~\ng: null\nh: nulls", {"a": True, "b": False, "c": True, "d": False, "e": True, "f": None, "g": None, "h": "nulls"}),
    ("a:\n  b:\n    c: 1\n  d: 2\ne: 3", {"a": {"b": {"c": 1}, "d": 2}, "e": 3}),
    ("a:\n- 1\n- 2\nb: 3", {"a": [1, 2], "b": 3}),
    ("a:\n  - x: 1\n    y: 2\n  - x: 3\nb:", {"a": [{"x": 1, "y": 2}, {"x": 3}], "b": None}),
    ("- - 1\n  - 2\n- - 3\n-\n- a: 1", [[1, 2], [3], None, {"a": 1}]),
    ("- a:\n    - b: 1\n  c: 2\n-  d: 3\n   e: 4", [{"a": [{"b": 1}], "c": 2}, {"d": 3, "e": 4}]),
    ("a: [1, two, 'th,ree', [4], {b: c, 5: d}]\nb: {}\nc: []\nd: {x: {y: [z, ~]}}", {"a": [1, "two", "th,ree", [4], {"b": "c", "5": "d"}], "b": {}, "c": [], "d": {"x": {"y": ["z", None]}}}),
    ("a: http://x.y/z:1\nb: a:b\n'c d': e\n\"f\": g", {"a": "http://x.y/z:1", "b": "a:b", "c d": "e", "f": "g"}),
    ("a: |\n  one\n    two\n\n  three\nb: >\n  folded\n  text\n\n  next\nc: |-\n  bare\nd: >-\n  x\n  y", {"a": "one\n  two\n\nthree\n", "b": "folded text\nnext\n", "c": "bare", "d": "x y"}),
    ("- k: |\n    body: no key\n    # no comment\n  l: 1\n- |\n  text", [{"k": "body: no key\n# no comment\n", "l": 1}, "text\n"]),
    ("hooks:\n  - event: pre_tool_use\n    action:\n      type: command\n      command: >\n        make\n        test\n    once: true\nname: x", {"hooks": [{"event": "pre_tool_use", "action": {"type": "command", "command": "make test\n"}, "once": True}], "name": "x"}),
    ("a: \"tab\\tend\"\nb: 'back\\slash'\nc: é €", {"a": "tab\tend", "b": "back\\slash", "c": "é €"}),
    ("a: -\nb: - x\nc: -1x", {"a": "-", "b": "- x", "c": "-1x"}),
    ("just text", "just text"),
    ("a: 1\r\nb: 2\r\n", {"a": 1, "b": 2}),
]
WRONG = ["a: &x 1", "a: *x", "- !tag x", "a: 1\n  b: 2", "text\nmore", "a: [1, 2", "a: 1\n---\nb: 2", "\ta: 1", "a: {b: }}"]


def test_reads_what_a_loader_reads(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in READ)), "k int, t string").select("k", "t", yaml_json(F.col("t")).alias("y"))
    for r in df.collect():
        assert r["y"]["error"] is None, r
        assert json.loads(r["y"]["json"]) == READ[r["k"]][1], r


def test_reports_what_it_does_not_read(spark):
    df = spark.createDataFrame([(t,) for t in WRONG], "t string").select("t", yaml_json(F.col("t")).alias("y"))
    assert [r["t"] for r in df.collect() if r["y"]["error"] is None or r["y"]["json"] is not None] == []
    assert spark.createDataFrame([(None,)], "t string").select(yaml_json(F.col("t")).alias("y")).first()["y"] is None


def test_headers_as_variants(spark):
    texts = ["---\na:\n  b: [1, 2]\n---\n\nbody\n---\nmore", "no header", "---\na: 1", "---\n---\nx", "  \n---\na: &x 1\n---\nbody", None]
    out = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", frontmatter_variant(F.col("t")).alias("f")).select("k", "f.body", "f.error", F.try_variant_get("f.meta", "$.a.b[1]", "int").alias("v"))
    got = {r["k"]: (r["body"], r["error"], r["v"]) for r in out.collect()}
    assert got[0] == ("body\n---\nmore", None, 2) and got[1] == ("no header", "no closed header", None) and got[2][1] == "no closed header"
    assert got[3] == ("x", None, None) and got[4][0] == "body" and "anchors" in got[4][1]


AGENT = """---
name: reviewer
description: >
  Reads changes
  and says so
tools: [ReadFile, Grep]
disallowedTools:
  - Bash
model: Inherit
maxTurns: 12
hooks:
  - event: pre_tool_use
    condition: tool == Bash
    action: {type: command, command: "echo \\"x\\""}
    once: yes
---

You review."""


def test_agent_definitions_with_folded_texts_and_nested_hooks(spark):
    bad = ["---\nname: a\n---\nx", "---\nname: a\ndescription: b\nmaxTurns: 0\n---\nx", "---\nname: a\ndescription: b\npermissionMode: odd\n---\nx", "---\nname: &a b\ndescription: c\n---\n"]
    df = spark.createDataFrame([("good", AGENT), *((f"bad{k}", t) for k, t in enumerate(bad))], "path string, content string")
    (row,) = files.agent_defs(df).collect()
    assert (row["name"], row["description"], row["tools"], row["disallowed"], row["model"], row["max_turns"], row["prompt"]) == ("reviewer", "Reads changes and says so", ["ReadFile", "Grep"], ["Bash"], "inherit", 12, "You review.")
    hooks = files.agent_hooks(df.where("path = 'good'")).collect()
    assert [tuple(h) for h in hooks] == [("good", 0, "pre_tool_use", "tool == Bash", "command", 'echo "x"', True)]
    errors = {r["path"]: r["error"] for r in files.agent_errors(df).collect()}
    assert set(errors) == {"bad0", "bad1", "bad2", "bad3"} and "anchors" in errors["bad3"] and "description" in errors["bad0"]


@pytest.mark.parametrize("n", [400])
def test_long_headers(spark, n):
    text = "\n".join(f"k{i}:\n  - v{i}\n  - {{n: {i}}}" for i in range(n))
    y = spark.createDataFrame([(text,)], "t string").select(yaml_json(F.col("t")).alias("y")).first()["y"]
    assert json.loads(y["json"]) == {f"k{i}": [f"v{i}", {"n": i}] for i in range(n)}
