"""Keyed sinks and stateful streams: second writes, failed attempts, restarts."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.sources import keyed
from skein.streaming import state

TEXTS = "id string, text string"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_a_second_spill_adds_new_keys_and_keeps_old_ones(spark, tmp_path):
    path = str(tmp_path / "spilled")
    put = lambda rows, batch, **kw: keyed.spill(spark.createDataFrame(rows, TEXTS), path, "id", batch, buckets=4, **kw)
    put([("a", "1"), ("b", "2"), ("b", "2"), (None, "x")], "one")
    put([("b", "other"), ("c", "3")], "two")
    assert rows_of(keyed.spilled(spark, path, TEXTS), "id", "text") == [("a", "1"), ("b", "2"), ("c", "3")]
    put([("b", "other"), ("c", "3"), ("d", "4")], "two")  # the batch again, with one row more
    put([], "three")
    assert rows_of(keyed.spilled(spark, path, TEXTS), "id", "text") == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    put([("e", "z"), ("e", "y")], "four", order=["text"])
    assert ("e", "y") in rows_of(keyed.spilled(spark, path, TEXTS), "id", "text")


def test_a_failed_spill_leaves_no_half(spark, tmp_path):
    path = str(tmp_path / "spilled")
    keyed.spill(spark.createDataFrame([("a", "1")], TEXTS), path, "id", "one", buckets=2)
    broken = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise("t").alias("text"))
    with pytest.raises(Exception, match="lost"):
        keyed.spill(broken, path, "id", "two", buckets=2)
    assert rows_of(keyed.spilled(spark, path, TEXTS), "id", "text") == [("a", "1")]
    keyed.spill(broken.where("id <> '39'"), path, "id", "two", buckets=2)
    assert keyed.spilled(spark, path, TEXTS).count() == 40


def test_backups_number_on_and_are_restored_as_of_an_edit(spark, tmp_path):
    path = str(tmp_path / "backups")
    put = lambda rows, batch: keyed.back_up(spark.createDataFrame(rows, "path string, seq long, content string"), path, batch, buckets=3)
    put([("/a", 1, "a1"), ("/a", 3, "a3"), ("/b", 2, None), ("/a", 3, "a3")], "one")
    put([("/a", 5, "a5"), ("/b", 6, "b6"), ("/c", 7, "c7")], "two")
    put([("/a", 5, "a5"), ("/b", 6, "b6"), ("/c", 7, "c7")], "two")
    got = keyed.backups(spark, path)
    assert rows_of(got, "path", "seq", "version", "content") == [("/a", 1, 1, "a1"), ("/a", 3, 2, "a3"), ("/a", 5, 3, "a5"), ("/b", 2, 1, None), ("/b", 6, 2, "b6"), ("/c", 7, 1, "c7")]
    assert {len(r["name"]) for r in got.where("content is not null").collect()} == {19}
    assert rows_of(keyed.restored(got, 4), "path", "version", "action", "content") == [("/a", 2, "restore", "a3"), ("/b", 1, "delete", None)]


def test_memories_go_to_the_folder_of_their_type(spark, tmp_path):
    root = str(tmp_path / "memories")
    schema = "name string, description string, type string, body string, seq long"
    put = lambda rows: keyed.write_memories(spark.createDataFrame(rows, schema), root)
    put([("Likes tea", "taste", "User", "b1", 1), ("Deploy", "", "project", "b2", 2), ("Odd", None, "strange", "b3", 3), ("None", "d", None, "b4", 4), (" ", "d", "user", "b5", 5), ("Talk", "d", "feedback", "b6", 6)])
    assert rows_of(keyed.read_memories(spark, root), "type", "name") == [("feedback", "Talk"), ("project", "Deploy"), ("reference", "None"), ("reference", "Odd"), ("user", "Likes tea")]
    put([("Likes tea", "new", "user", "b7", 7), ("Walks", "d", "user", "b8", 8), ("Walks", "d", "user", "b9", 9)])
    assert rows_of(keyed.read_memories(spark, root, flat="user"), "name", "body") == [("Likes tea", "b7"), ("Walks", "b9")]
    assert keyed.read_memories(spark, root).count() == 6
    lines = keyed.index_lines(keyed.read_memories(spark, root))
    assert ("user", "user/likes-tea.md", "- [Likes tea](user/likes-tea.md): new") in rows_of(lines, "type", "file", "line") and lines.count() == 6
    assert sorted(p.name for p in (tmp_path / "memories").iterdir() if p.is_dir()) == [f"type={t}" for t in sorted(keyed.MEMORY_TYPES)]


class Feed:
    """A folder of JSON batches that a stream reads, with the query's own checkpoint."""

    def __init__(self, spark, tmp_path, schema, build, name):
        self.spark, self.folder, self.schema, self.build, self.name = spark, tmp_path, schema, build, name
        (tmp_path / "in").mkdir()
        self.n = 0

    def push(self, rows):
        """One batch, after which the query ends; the next one restarts it from its checkpoint."""
        if rows:
            self.n += 1
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(str(self.folder / "in"))
        stream = self.build(self.spark.readStream.schema(self.schema).json(str(self.folder / "in")))
        out = self.folder / "out"
        before = self.rows()
        query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(self.folder / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert query.exception() is None
        after = self.rows()
        for r in before:
            after.remove(r)
        return sorted(after, key=str)

    def rows(self):
        out = self.folder / "out"
        return [tuple(r) for r in self.spark.read.parquet(str(out)).collect()] if (out / "_spark_metadata").exists() else []


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


MAIL = "recipient string, id string, seq long, kind string, sender string, text string, ts timestamp"
BEGAN = datetime.datetime(2024, 1, 1, 12)


def at(seconds):
    return BEGAN + datetime.timedelta(seconds=seconds)


def test_messages_are_handed_over_once_over_batches_and_restarts(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, MAIL, lambda s: state.consume(s, idle_ms=3_600_000), "mail")
    m = lambda to, i, kind="text", text="hi": (to, f"{to}{i}", i, kind, "lead", text, at(i))
    poll = lambda to: (to, None, None, "poll", None, None, at(9))
    assert feed.push([m("ann", 1), m("ann", 2), m("bob", 1), (None, "x", 1, "text", "lead", "lost", at(1)), ("ann", "x", 1, "text", "lead", "lost", None)]) == []
    assert [r[:3] for r in feed.push([poll("ann"), m("ann", 3)])] == [("ann", "ann1", 1), ("ann", "ann2", 2), ("ann", "ann3", 3)]
    # nothing unread, and a message that is sent again is known; bob is told to stop and nothing else
    got = feed.push([poll("ann"), m("ann", 2), m("bob", 2), ("bob", "bob9", 9, "shutdown_request", "lead", "stop", at(9)), poll("bob")])
    assert [r[:4] for r in got] == [("bob", "bob9", 9, "shutdown_request")]
    assert feed.push([poll("bob"), m("ann", 4, text="[shutdown] now"), m("ann", 5), poll("ann")]) == [("ann", "ann4", 4, "text", "lead", "[shutdown] now", False)]


def test_idle_recipients_get_their_messages_by_timer_and_ids_are_forgotten(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, MAIL, lambda s: state.consume(s, late="10 seconds", idle_ms=5000, forget_ms=20_000), "idle")
    assert feed.push([("ann", "a1", 1, "text", "lead", "hi", at(0)), ("ann", None, 2, "text", "lead", "no id", at(1)), ("ann", None, 3, "text", "lead", "no id", at(1))]) == []
    got = feed.push([("bob", "b1", 1, "text", "lead", "hi", at(100))])  # the watermark goes to 90
    assert [(r[0], r[2], r[-1]) for r in got] == [("ann", 1, True), ("ann", 2, True), ("ann", 3, True)]
    assert [r[:2] for r in feed.push([("ann", "a1", 1, "text", "lead", "hi", at(0)), ("cid", "c1", 1, "text", "lead", "x", at(300))])] == [("bob", "b1")]  # a1 is late by now
    kept = rocks.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "seen").load()
    assert {r["key"]["recipient"] for r in kept.collect()} <= {"cid"}


class Kept:
    """A state variable of one key in plain memory that counts the calls made to it; `get` of nothing is empty for lists and None for values."""

    def __init__(self, calls, value):
        self.calls, self.empty, self.value = calls, value, value

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return getattr(self, f"_{name}")(*args)

        return call

    def _exists(self):
        return bool(self.value)

    def _get(self):
        return iter(list(self.value)) if isinstance(self.value, list) else self.value

    def _update(self, value):
        self.value = value

    def _clear(self):
        self.value = type(self.empty)() if self.empty is not None else None

    def _appendValue(self, value):
        self.value = [*self.value, value]

    def _appendList(self, values):
        self.value = [*self.value, *values]

    def _put(self, values):
        self.value = list(values)

    def _containsKey(self, key):
        return key in self.value

    def _updateValue(self, key, value):
        self.value = {**self.value, key: value}

    def _removeKey(self, key):
        self.value = {k: v for k, v in self.value.items() if k != key}

    def _iterator(self):
        return iter(list(self.value.items()))

    def _registerTimer(self, at):
        pass

    _deleteTimer = _registerTimer


class Handle(Kept):
    def getListState(self, name, schema):
        return Kept(self.calls, [])

    def getMapState(self, name, key, value):
        return Kept(self.calls, {})

    def getValueState(self, name, schema):
        return Kept(self.calls, None)


def inbox(calls):
    box = state.Inbox(1000, 3_600_000)
    box.init(Handle(calls, None))
    row = lambda i, kind="text", text="hi": Row(id=i and f"m{i}", seq=i, kind=kind, sender="lead", text=text, ts_ms=i or 0)
    return row, lambda *rows: [r.seq for r in box.handleInputRows(("ann",), iter(rows), None)], box


def test_calls_to_the_state_do_not_grow_with_a_batch():
    """Each is a round trip between Python and the JVM."""
    made = []
    for n in (10, 900):
        calls = []
        row, take, _ = inbox(calls)
        assert take(*map(row, range(1, n))) == []
        assert take(*map(row, range(1, 2 * n)), row(None, "poll")) == list(range(1, 2 * n))
        made.append(len(calls))
    assert made[0] == made[1] < 20


def test_ids_beyond_the_list_are_known_too(monkeypatch):
    monkeypatch.setattr(state, "MOST_IDS", 3)
    monkeypatch.setattr(state, "HELD", 2)
    row, take, box = inbox([])
    assert take(row(1), row(2), row(1), row(3), row(4), row(5), row(5), row(4)) == []
    assert take(row(5), row(6), row(2), row(None, "poll"), row(6)) == [1, 2, 3, 4, 5, 6]
    assert take(row(4), row(6), row(1), row(None, "poll")) == []
    assert take(row(9, state.SHUTDOWN_KIND), row(8, state.SHUTDOWN_KIND), row(7), row(None), row(None)) == []
    assert take(row(10), row(None, "poll")) == [9] and take(row(None, "poll"), row(7), row(10)) == []
    after = type("Timers", (), {"getCurrentWatermarkInMs": lambda self: 4_000_000})()
    assert list(box.handleExpiredTimer(("ann",), after, None)) == [] and take(row(1), row(6), row(None, "poll")) == [1, 6]


def test_files_that_change_go_and_come_back(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "path string, mtime_ms long, size long, deleted boolean", state.watch, "watch")
    assert feed.push([("/a", 10, 5, False), ("/b", 10, 5, None), ("/c", 1, 1, True), ("/a", 9, 4, False)]) == [("/a", 10, 5, "new"), ("/b", 10, 5, "new")]
    assert feed.push([("/a", 20, 6, False), ("/b", 10, 5, False), (None, 1, 1, False)]) == [("/a", 20, 6, "changed")]
    assert feed.push([("/a", 30, 6, True), ("/b", 5, 9, False)]) == [("/a", 30, 6, "gone")]
    assert feed.push([("/a", 25, 7, False)]) == []  # late, older than the deletion
    assert feed.push([("/a", 40, 7, False), ("/b", 10, 6, False)]) == [("/a", 40, 7, "back"), ("/b", 10, 6, "changed")]


def test_transcripts_keep_nested_arguments(spark):
    from skein.sources import json_files

    good = '[{"role": "user", "content": "hi"}, {"role": "assistant", "tool_uses": [{"tool_use_id": "1", "tool_name": "T", "arguments": {"a": [{"b": 2}]}}]}, {"content": "no role"}, {"role": "user", "content": "", "tool_results": [{"tool_use_id": "1", "content": "r"}]}]'
    rows = json_files.transcripts(spark.createDataFrame([("a", good), ("b", "{}"), ("c", "no"), ("d", None), ("e", "[]")], "k string, text string"), "k")
    got = [(r["k"], r["idx"], r["role"], r["content"], r["n"], r["failed"]) for r in rows.select("*", F.try_variant_get(F.get("tool_uses", F.lit(0))["arguments"], "$.a[0].b", "int").alias("n"), F.get("tool_results", F.lit(0))["is_error"].alias("failed")).orderBy("idx").collect()]
    assert got == [("a", 0, "user", "hi", None, None), ("a", 1, "assistant", "", 2, None), ("a", 3, "user", "", None, False)]
