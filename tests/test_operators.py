"""Operators against walks over Python lists, sources by round trips, streams by draining them."""

import random

from pyspark.sql import functions as F

from skein.functions import registry
from skein.functions.text import approx_tokens
from skein.operators import budget, catalog, coordination, rules, transcript
from skein.plans import sources
from skein.sources import files, json_files, session_log
from skein.streaming import agents


def histories(spark, seed, n=60):
    r = random.Random(seed)
    rows = [(c, i, r.choice(["user", "assistant"]), "x" * r.choice([0, 3, 40, 400, 900])) for c in range(n) for i in range(r.randint(1, 12))]
    return rows, spark.createDataFrame(rows, "conv_id long, idx long, role string, content string")


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_keep_tail_is_the_walk(spark):
    rows, df = histories(spark, 1)
    got = {(r["conv_id"], r["idx"]) for r in transcript.keep_tail(df, enough_tokens=200, enough_rows=4, most_tokens=350).collect()}
    want = set()
    for c, own in by_conv(rows).items():
        total, n = 0, 0
        for r in reversed(own):
            t = int(len(r[3]) / 3.5)
            if n and (total >= 200 or n >= 4 or total + t > 350):
                break
            total, n = total + t, n + 1
            want.add((c, r[1]))
    assert got == want


def test_floor_of_the_sum_is_not_the_sum_of_floors(spark):
    df = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "user", "ab")], "conv_id long, idx long, role string, content string")
    assert transcript.conversation_tokens(df).first()["tokens"] == 1
    assert sum(r["tokens"] for r in transcript.token_estimates(df).collect()) == 0
    assert spark.range(1).select(approx_tokens(F.lit(7)).alias("t")).first()["t"] == 2


def test_spill_batch_is_greedy(spark):
    r = random.Random(3)
    rows = [(b, i, "y" * r.choice([50, 990, 1001, 1010, 1500, 4000])) for b in range(40) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "batch long, idx long, text string")
    got = {(x["batch"], x["idx"]) for x in budget.spill_batch(df, "batch", "idx", limit=4000, least=1000).where("spilled").collect()}
    shown = lambda n: len(f"[{n // 1024} KB kept]\n") + min(n, 1000) + (4 if n > 1000 else 0)
    want = set()
    for b, own in by_conv(rows).items():
        total = sum(len(x[2]) for x in own)
        for x in sorted(own, key=lambda x: (-len(x[2]), x[1])):
            if total <= 4000:
                break
            if len(x[2]) > 1000:
                total -= len(x[2]) - shown(len(x[2]))
                want.add((b, x[1]))
    assert got == want


def test_pairs_are_repaired(spark):
    uses = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 4, "b"), (2, 0, "a")], "conv_id long, idx long, id string")
    results = spark.createDataFrame([(1, 1, "a", "ok"), (1, 2, "z", "stray")], "conv_id long, idx long, id string, content string")
    got = {(r["conv_id"], r["idx"], r["sub"], r["kind"], r["id"]) for r in transcript.repair_pairs(uses, results).collect()}
    assert got == {(1, 0, 0, "use", "a"), (1, 0, 0, "use", "b"), (1, 4, 0, "use", "b"), (2, 0, 0, "use", "a"), (1, 1, 0, "result", "a"), (1, 0, 1, "synthetic", "b"), (2, 0, 1, "synthetic", "a")}


def test_replay_and_anchor(spark):
    rows, df = histories(spark, 5)
    marked = transcript.replay(df, F.col("idx") == 3).collect()
    assert all(r["idx"] >= 3 or len(by_conv(rows)[r["conv_id"]]) <= 3 for r in marked)
    anchored = {r["conv_id"]: r["tokens"] for r in transcript.anchored_tokens(df.withColumn("anchor", F.when(F.col("idx") == 2, 50).otherwise(0))).collect()}
    for c, own in by_conv(rows).items():
        tail = own[3:] if len(own) > 2 else own
        assert anchored[c] == (50 if len(own) > 2 else 0) + int(sum(len(x[3]) for x in tail) / 3.5)


def test_subcommands_and_severity(spark):
    table = [("Bash", "rm*", "deny"), ("Bash", "git*", "ask"), ("Bash", "*", "allow")]
    cases = {"ls": "allow", "git x": "ask", "git x; rm y": "deny", "": "allow"}
    for line, want in cases.items():
        assert spark.range(1).select(rules.evaluate_subcommands(F.lit("Bash"), F.lit(line), table).alias("e")).first()["e"] == want
    assert spark.range(1).select(rules.evaluate_rules(F.lit("Other"), F.lit("x"), table).alias("e")).first()["e"] is None


def test_merges(spark):
    rows = spark.createDataFrame([("k", 2, 1, "c"), ("k", 0, 5, "a"), ("l", 1, 2, "b"), ("k", 1, 3, "d")], "key string, layer int, seq int, value string")
    assert {(r["key"], r["value"]) for r in catalog.first_wins(rows, "key", "layer").collect()} == {("k", "a"), ("l", "b")}
    last = {r["key"]: (r["value"], r["first_layer"]) for r in catalog.last_wins(rows, "key", "layer", "seq", "value").collect()}
    assert last == {"k": ("c", 0), "l": ("b", 1)}


def test_free_name_has_no_limit(spark):
    first = lambda taken: catalog.free_name(spark.createDataFrame([(n,) for n in taken], "name string"), "team", "name").first()["name"]
    many = ["team", *(f"team-{k}" for k in range(1, 2501))]
    assert first(many) == "team-2501"
    assert first([n for n in many if n != "team-1700"]) == "team-1700"
    assert first(["team-2", "team-3"]) == first([]) == "team"
    assert first(["team", "team", None, "team-02", "team-x", "team-1", "team-9223372036854775807", "team-99999999999999999999", "team-3"]) == "team-2"


def test_unknown_activity_is_active(spark):
    m = spark.createDataFrame([("t", None), ("t", False), ("u", False)], "team string, is_active boolean")
    assert {r["team"]: r["all_idle"] for r in coordination.all_idle(m, "team").collect()} == {"t": False, "u": True}


def test_session_log_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("user", "hi é\n\"q\"", 5, None), ("assistant", "", None, None), ("user", '{"summary":"s","keep":[{"role":"assistant","content":"k"}]}', 6, "compact_boundary")], "role string, content string, ts long, type string")
    session_log.append(records, str(tmp_path / "log"), "role", "content", "ts", "type")
    (tmp_path / "log" / "part-noise.txt").write_text("\n  \nnot json\n[1]\n{\"content\": \"no role\"}\n")
    back = session_log.read(spark, str(tmp_path / "log"), F.lit(99))
    got = {(r["role"], r["content"], r["ts"], r["type"]) for r in back.collect()}
    assert ("user", "hi é\n\"q\"", 5, None) in got and ("assistant", "", 99, None) in got and len(got) == 3
    expanded = session_log.expand_markers(back.where("type is not null").withColumns({"conv_id": F.lit(1), "idx": F.lit(0)})).collect()
    assert [(r["sub"], r["role"], r["content"]) for r in sorted(expanded, key=lambda r: r["sub"])] == [(0, "user", "s"), (1, "assistant", "k")]


def test_memory_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nname: one\ntype: user\n---\nbody")
    (tmp_path / "sub" / "My Cmd.md").write_text("no block")
    (tmp_path / "MEMORY.md").write_text("index")
    found = files.read_files(spark, str(tmp_path))
    assert {(r["name"], r["type"]) for r in files.memory_headers(found, "user").collect()} == {("one", "user"), ("My Cmd", "")}
    names = {r["n"] for r in found.select(files.command_name(files.relative(F.col("path"), str(tmp_path))).alias("n")).collect()}
    assert "sub:my-cmd" in names or "sub:my%20cmd" in names


def test_includes(spark):
    rows = [("/a", "1\n@/b\n```\n@/b\n```"), ("/b", "2\n@/c\n@/a"), ("/c", "3\n@./none\n@user")]
    got = {r["file"]: r["content"] for r in files.expand_includes(spark.createDataFrame(rows, "file string, content string")).collect()}
    missing = "<!-- @ skipped: file not found -->"
    assert got["/c"] == f"3\n{missing}\n@user"
    assert got["/a"] == f"1\n<!-- included from /b -->\n2\n<!-- included from /c -->\n3\n{missing}\n@user\n@/a\n```\n@/b\n```"


def expanded(known, name, depth=5, path=()):
    """The same by plain recursion: (text of a file, its includes put in, down to a depth)."""
    out, fenced = [], False
    for line in known[name].split("\n"):
        bare = line.strip(" \t\x0b\x0c\r")
        target = bare[1:]
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced and bare[:1] == "@" and target.startswith(("./", "../", "~/", "/")) and " " not in target and "\t" not in target and target not in (*path, name):
            if target not in known:
                line = "<!-- @ skipped: file not found -->"
            else:
                body = expanded(known, target, depth - 1, (*path, name)) if depth else known[target]
                line = f"<!-- included from {target} -->\n{body}"
        out.append(line)
    return "\n".join(out)


def test_include_expand_reads_whole_texts(spark, tmp_path):
    long = "word " * 30
    texts = {0: long, 1: f"{long}\n@/d4\n  ```\n@/d2\n```\nend", 2: f"{long}\n\t@/d4 \r\n@@/d4\n@/d4 x\n@/none", 3: "", 4: f"```\n@/d2\n```\n@/d5\n\n{long}\n", 5: f"@/d6\n@/d6\n@ /d6{long}", 6: f"{long}\n```\n@/d1\nopen", 9: "\n@/d2\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    more = lambda k: ([f"@/d{k // 3}"] if k % 3 == 0 else []) + (["@./nowhere"] if k % 5 == 0 else []) + ["```\n@/d1\n```"]
    known = {f"/d{k}": "\n".join([t, *more(k)]) for k, t in texts.items()}
    got = {r["file"]: r["content"] for r in sources.include_expand(spark, str(tmp_path)).collect()}
    assert got == {k: expanded(known, k) for k in known}


def test_the_sixth_include_in_a_chain_is_put_in(spark):
    known = {f"/{k}": f"{k}\n@/{k + 1}\nend {k}" for k in range(8)} | {"/8": "last"}
    got = {r["file"]: r["content"] for r in files.expand_includes(spark.createDataFrame(list(known.items()), "file string, content string")).collect()}
    assert got == {k: expanded(known, k) for k in known}
    assert "\n<!-- included from /6 -->\n6\n@/7\nend 6\n" in got["/0"]


def test_mailboxes_that_are_no_json_are_empty(spark):
    df = spark.createDataFrame([("a", '[{"from":"x","text":"t","read":true,"approve":null}]'), ("b", "broken")], "box string, text string")
    rows = json_files.messages(df, "box").collect()
    assert [(r["box"], r["sender"], r["read"], r["approve"]) for r in rows] == [("a", "x", True, None)]


def test_breaker_stream(spark, tmp_path):
    r = random.Random(9)
    rows = [(k % 3, k, r.random() < 0.7) for k in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "key long, seq long, failed boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, failed boolean").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = agents.breaker(stream).writeStream.format("memory").queryName("streaks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(x["key"], x["seq"]): x["streak"] for x in spark.table("streaks").collect()}
    batch = budget.failure_streak(spark.createDataFrame(rows, "key long, seq long, failed boolean"), "key", ["seq"], F.col("failed")).collect()
    assert got == {(x["key"], x["seq"]): x["streak"] for x in batch}


def test_drain_stream(spark, tmp_path):
    rows = [("a", 1, "message"), ("a", 2, "shutdown_request"), ("b", 3, "message")]
    spark.createDataFrame(rows, "recipient string, id long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("recipient string, id long, kind string").parquet(str(tmp_path / "in"))
    seen = []
    agents.drain(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(r["id"] for r in df.collect())).awaitTermination(120)
    assert sorted(seen) == [2, 3]


def test_trace_tree_goes_to_the_last_level(spark):
    nodes = [("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 9)] + [("x", "y"), ("y", "x"), ("z", "unknown")]
    df = spark.createDataFrame(nodes, "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"], r["path"]) for r in coordination.trace_tree(df).collect()}
    assert got == {f"n{k}": ("n0", k, "/".join(f"n{j}" for j in range(k + 1))) for k in range(9)} | {"z": ("z", 0, "z"), "x": (None, None, None), "y": (None, None, None)}
    assert coordination.trace_tree(df, 3).agg(F.max("depth")).first()[0] == 3


def test_trace_tree_of_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    star = spark.range(n, n + 20_000).select("id", F.lit(n // 2).cast("long").alias("parent"))  # a hot parent, deep down
    loop = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-4, -3)], "id long, parent long")
    out = coordination.trace_tree(chain.union(star).union(loop), paths=False, limit=1000)
    right = F.when(F.col("id") < 0, F.col("root").isNull() & F.col("depth").isNull()).otherwise((F.col("root") == 0) & (F.col("depth") == F.when(F.col("id") < n, F.col("id")).otherwise(n // 2 + 1)))
    assert out.groupBy(right.alias("right")).count().collect() == [(True, n + 20_004)]


def test_trace_tree_of_no_nodes_and_of_roots_alone(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert coordination.trace_tree(empty).collect() == []
    assert [tuple(r) for r in coordination.trace_tree(spark.createDataFrame([("a", None)], "id string, parent string")).collect()] == [("a", "a", 0, "a")]


def test_settings_merge_as_a_walk(spark):
    r = random.Random(21)
    layer = lambda: ([r.choice("pq") for _ in range(r.randint(0, 2))], r.choice(["default", "plan"]), [(r.choice("abc"), str(r.randrange(9))) for _ in range(r.randint(0, 4))], [r.choice("xy")], r.random() < 0.5, r.random() < 0.5, r.choice(["", "t"]))
    kind = "struct<providers:array<string>,mode:string,servers:array<struct<name:string,value:string>>,hooks:array<string>,fork:boolean,verify:boolean,team:string>"
    rows = [(k, layer(), layer()) for k in range(60)]
    got = {x["k"]: x["m"] for x in spark.createDataFrame(rows, f"k int, b {kind}, o {kind}").select("k", catalog.merge_settings(F.col("b"), F.col("o")).alias("m")).collect()}
    for k, b, o in rows:
        servers, place = list(b[2]), {s[0]: i for i, s in enumerate(b[2])}
        for s in o[2]:
            if s[0] in place:
                servers[place[s[0]]] = s
            else:
                place[s[0]] = len(servers)
                servers.append(s)
        m = got[k]
        assert [tuple(s) for s in m["servers"]] == servers
        assert (m["providers"], m["mode"], m["hooks"], m["fork"], m["verify"], m["team"]) == (o[0] or b[0], o[1] if o[1] != "default" else b[1], b[3] + o[3], o[4], b[5] or o[5], o[6] or b[6])


def test_search_takes_a_scorer(spark):
    df = spark.createDataFrame([(1, "aa", "x"), (2, "a", "y"), (3, "b", None)], "id int, name string, about string")
    longest = lambda name, about, query: F.length(name) + F.length(about)
    assert [r["id"] for r in catalog.search(df, "", "name", "about", "id", 2, longest).collect()] == [1, 2]


def test_registry_types_and_dispatch(spark):
    tools = registry.Registry()
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "of": {"type": "object", "properties": {"x": {"type": "number"}}}}, "required": ["n"]}
    assert registry.ddl(schema) == "struct<`n`:bigint,`of`:struct<`x`:double>>"
    tools.register("double", "twice a number", schema)(lambda a: (a["n"] * 2).cast("string"))
    rows = [("double", '{"n": 4}'), ("double", "{}"), ("double", "no json"), ("other", "{}")]
    out = spark.createDataFrame(rows, "tool string, args string").select("tool", "args", tools.dispatch(F.col("tool"), F.col("args")).alias("r")).collect()
    assert [(x["r"]["output"], x["r"]["error"]) for x in out] == [("8", None), (None, "bad arguments of double"), (None, "bad arguments of double"), (None, "unknown tool: other")]


def test_session_meta_and_markers(spark, tmp_path):
    records = spark.createDataFrame([(1, 0, 5, None), (1, 1, 6, None), (2, 0, 9, None)], "conv_id long, idx long, ts long, type string")
    kept = spark.createDataFrame([(1, "so far", [("user", "hi")])], "conv_id long, summary string, keep array<struct<role:string,content:string>>")
    marked = session_log.marker(kept, F.lit(7).cast("long")).select("conv_id", F.lit(2).cast("long").alias("idx"), "role", "content", "ts", "type")
    every = records.select("conv_id", "idx", F.lit("user").alias("role"), F.lit("x").alias("content"), "ts", "type").union(marked)
    meta = session_log.meta_of(every)
    assert sorted(map(tuple, meta.collect())) == [(1, 2, 7), (2, 1, 9)]
    session_log.save_meta(meta, f"{tmp_path}/meta")
    (tmp_path / "meta" / "bad.json").write_text("{broken")
    assert sorted(map(tuple, session_log.load_meta(spark, f"{tmp_path}/meta").collect())) == [(1, 2, 7), (2, 1, 9)]
    replayed = session_log.expand_markers(every.where("idx = 2")).collect()
    assert [(x["role"], x["content"]) for x in sorted(replayed, key=lambda x: x["sub"])] == [("user", "so far"), ("user", "hi")]


def test_strict_frontmatter(spark):
    texts = {
        "---\nname: a\ntools:\n  - b\n  - 'c d'\nflow: [x, \"y\"]\n# note\nname: z # late\n---\n\nbody --- more\n": ({"tools": "b\nc d", "flow": "x\ny", "name": "z"}, "body --- more\n"),
        "  \n---\nk: 1\n---": ({"k": "1"}, ""),
        "name: a\n---\n": None, "---\nname: a": None, "---\n- a\n---\n": None, "---\nname a\n---\nb": None, "---\n---\nb": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", files.strict_frontmatter(F.col("text")).alias("f"))
    assert {r["text"]: r["f"] and (r["f"]["fields"], r["f"]["body"]) for r in df.collect()} == texts


def test_agents_with_includes(spark):
    rows = [("/a.md", "---\nname: a\ndescription: d\n---\n@/b.md\n"), ("/b.md", "inner")]
    expanded = files.expand_includes(spark.createDataFrame(rows, "file string, content string"))
    got = files.agent_defs(expanded, "file").collect()
    assert [(r["name"], "inner" in r["prompt"], r["max_turns"]) for r in got] == [("a", True, 200)]


def test_absolute_paths(spark):
    import os.path

    paths = ["/a/./b/../c", "a//b", "../../x", "/", "..", "/a/b/../../..", "./"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", rules.absolute(F.col("p"), "/w/d").alias("a"))
    assert {r["p"]: r["a"] for r in df.collect()} == {p: os.path.normpath(os.path.join("/w/d", p)) for p in paths}


def test_listeners_around_a_batch(spark, tmp_path):
    seen = []
    deliver = lambda batch, epoch: seen.append(("got", sorted(r["id"] for r in batch.collect())))
    handle = agents.hooked(deliver, [lambda b, e: b.where("id > 1"), lambda b, e: seen.append(("before", e))], [lambda b, e: seen.append(("after", b.count()))])
    handle(spark.createDataFrame([(1,), (2,), (3,)], "id int"), 4)
    assert seen == [("before", 4), ("got", [2, 3]), ("after", 2)]


def test_completions_come_once(spark, tmp_path):
    spark.createDataFrame([("a", "running"), ("a", "completed"), ("b", "failed"), ("a", "completed")], "id string, status string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, status string").json(f"{tmp_path}/in")
    agents.completions(stream).writeStream.format("memory").queryName("ended").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("ended").collect()) == ["a", "b"]
