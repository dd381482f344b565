"""Typed calls, skills as SQL functions, and hooks around streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import typed
from skein.sources import skills
from skein.streaming import hooks

SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": ["number", "null"]}, "c": {"type": "array", "items": {"type": "object", "properties": {"d": {"type": "boolean"}, "e": {"type": "array", "items": {"type": "string"}}}}}, "f": {"type": "object"}, "g": {"type": "string", "enum": ["x", "y"]}}}


def test_arguments_take_the_types_of_their_schema(spark):
    typed.register(spark)
    texts = [
        '{"a": 1, "b": 2, "c": [{"d": true, "e": ["p", 7]}, {}], "f": {"k": [1], "l": "m"}, "g": "x", "more": 1}', '{"a": 1}', '{"b": 1}', '{"a": "1"}', '{"a": true}', '{"a": 1, "c": {}}', '{"a": 1, "c": [{"d": 1}]}',
        '{"a": 1, "g": "z"}', '{"a": 9223372036854775808}', "[1]", "no", None, '{"a": 1, "b": null, "c": null}', '{"a": 1, "b": NaN}',
    ]
    spark.createDataFrame(list(enumerate(texts)), "k int, arguments string").createOrReplaceTempView("typed_texts")
    out = spark.sql("SELECT k, t.* FROM typed_texts, LATERAL typed_arguments(arguments, :schema) AS t", args={"schema": json.dumps(SCHEMA)})
    assert out.schema.simpleString() == "struct<k:int,a:bigint,b:double,c:array<struct<d:boolean,e:array<string>>>,f:map<string,string>,g:string,error:string>"
    got = {r["k"]: r for r in out.collect()}
    assert len(got) == len(texts)
    first = got[0]
    assert (first["a"], first["b"], first["f"], first["g"], first["error"]) == (1, 2.0, {"k": "[1]", "l": "m"}, "x", None)
    assert [(c["d"], c["e"]) for c in first["c"]] == [(True, ["p", "7"]), (None, None)]
    errors = {k: r["error"] for k, r in got.items()}
    assert errors == {0: None, 1: None, 2: "a: missing", 3: "a: no integer", 4: "a: no integer", 5: "c: no array", 6: "c[0].d: no boolean", 7: "g: not one of x, y", 8: "a: no integer", 9: "arguments: no object", 10: "arguments: no JSON", 11: "arguments: missing", 12: None, 13: "b: no number"}


def test_a_schema_is_a_constant_and_may_be_empty(spark):
    typed.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM typed_arguments('{}', '{}')").collect()] == [(None,)]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT t.* FROM (SELECT '{}' AS s), LATERAL typed_arguments('{}', s) AS t").collect()
    with pytest.raises(Exception, match="cannot be named"):
        spark.sql("""SELECT * FROM typed_arguments('{}', '{"properties": {"error": {}}}')""").collect()


FILES = [
    ("/a.md", "---\nname: It-Is\ndescription: d\n---\n\nSay '$ARGUMENTS' and \\n \"$ARGUMENTS\"; DROP TABLE x --", 1), ("/b.md", "---\nname: plain\nmode: fork\n---\nDo it.\n", 1),
    ("/c.md", "---\nname: plain\n---\nA later file of the name.", 1), ("/d.md", "no header", 1), ("/e.md", "---\nname: 'x y'\n---\nx", 1), ("/f.md", "---\nname: &a b\n---\nx", 1),
]


def test_skills_become_sql_functions(spark):
    df = spark.createDataFrame(FILES, "path string, content string, mtime_ms long")
    errors = {r["path"]: r["error"] for r in skills.skill_rows(df).collect()}
    assert errors["/d.md"] == "no closed header" and errors["/e.md"] == "no valid name" and "anchors" in errors["/f.md"] and not (errors["/a.md"] or errors["/b.md"])
    known = skills.load_skills(df)
    assert [(s.name, s.mode) for s in known] == [("It-Is", "inline"), ("plain", "fork")]
    skills.register_skills(spark, known)
    calls = [("it-is", "o'k $1 \\"), ("plain", " "), ("PLAIN", "now"), ("plain", None), ("other", "x"), (None, "x")]
    got = [(r["mode"], r["prompt"]) for r in skills.run_skills(spark.createDataFrame(calls, "name string, arguments string"), known).collect()]
    said = FILES[0][1].split("---\n")[-1].lstrip("\n")
    assert got == [("inline", said.replace("$ARGUMENTS", "o'k $1 \\")), ("fork", "Do it.\n"), ("fork", "Do it.\n\n\nnow"), ("fork", "Do it.\n"), (None, None), (None, None)]
    assert [tuple(r) for r in skills.run_skill(spark, known[0], "'; DROP --").collect()] == [("inline", said.replace("$ARGUMENTS", "'; DROP --"))]
    with pytest.raises(ValueError):
        skills.register_skills(spark, [skills.Skill("a b", "", "inline", "x")])


HOOKS = [
    {"id": "tell", "event": "post", "condition": "tool == Bash", "action": {"type": "prompt", "message": "ran $TOOL_NAME on $EVENT"}},
    {"id": "send", "event": "post", "action": {"type": "http", "url": "http://h/$TOOL_NAME", "body": "$ARGUMENTS"}},
    {"id": "run", "event": "pre", "action": {"type": "command", "command": "echo $TOOL_NAME"}},
]


def test_effects_of_a_batch_that_fails_and_comes_again_are_there_once(spark, tmp_path):
    schema, folder, out = "id long, event string, tool string, args string", str(tmp_path / "effects"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    lost = [True]

    def deliver(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out)
        if epoch == 1 and lost[0]:
            lost[0] = False
            raise RuntimeError("driver lost in mid-batch")

    told = []
    metrics = {"n": F.count(F.lit(1)), "bash": F.count_if(F.col("tool") == "Bash")}
    rules = [("many", lambda m: m["n"] > 1), ("bash", lambda m: m["bash"] > 0)]
    handle = hooks.with_effects(deliver, HOOKS, folder, "event", "tool", "args", ("id",), metrics, rules, lambda label, epoch, m: told.append((label, epoch, m["n"])))

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)

    put([(1, "post", "Bash", '{"x": 1}'), (2, "pre", "Read", "{}"), (3, "other", "Bash", "{}")])
    run()
    put([(4, "post", "Read", '{"y": 2}')])
    with pytest.raises(Exception, match="mid-batch"):
        run()
    run()
    run()
    got = sorted(tuple(r) for r in hooks.kept_effects(spark, folder, "id long, " + hooks.EFFECT).select("id", "hook_id", "kind", "target", "text", "method", "epoch").collect())
    assert got == [(1, "send", "http", "http://h/Bash", '{"x": 1}', "POST", 0), (1, "tell", "prompt", None, "ran Bash on post", None, 0), (2, "run", "command", None, "echo Read", None, 0), (4, "send", "http", "http://h/Read", '{"y": 2}', "POST", 1)]
    assert spark.read.parquet(out).count() == 4
    assert sorted(told) == [("bash", 0, 3), ("many", 0, 3)]


def test_no_effects_kept_yet(spark, tmp_path):
    assert hooks.kept_effects(spark, str(tmp_path / "none")).collect() == []


def test_metrics_observed_on_the_way_decide_what_follows(spark, tmp_path):
    schema, told = "id long, tool string", []
    follow = hooks.Follow("load", [("many", lambda m: m["n"] > 1), ("bash", lambda m: m["bash"] > 0)], lambda label, epoch, m: told.append((label, epoch, m["n"])))
    spark.streams.addListener(follow)
    try:
        for batch in ([(1, "Bash"), (2, "Read")], [(3, "Bash")], [(4, "Read")]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            rows = hooks.observed(spark.readStream.schema(schema).json(str(tmp_path / "in")), "load", n=F.count(F.lit(1)), bash=F.count_if(F.col("tool") == "Bash"))
            rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
        until = time.monotonic() + 20
        while len(told) < 3 and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(follow)
    assert sorted(told) == [("bash", 0, 2), ("bash", 1, 1), ("many", 0, 2)]
