"""Mailboxes, tasks, traces, file versions and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.skew import LIMIT, join_dealt
from skein.tables import new_folder, shared_folder


def unread(messages: DataFrame) -> DataFrame:
    """What a consumer gets: messages that are not known to be read."""
    return messages.where(~F.col("read").eqNullSafe(True))


def consume(messages: DataFrame) -> DataFrame:
    """The mailbox after a drain."""
    return messages.withColumn("read", F.lit(True))


def broadcast(messages: DataFrame, members: DataFrame, sender: str = "sender", member: str = "member") -> DataFrame:
    """Each message to every member but its sender: as many rows as messages times members, by definition."""
    return messages.join(members, F.col(sender) != F.col(member)).withColumnRenamed(member, "recipient")


def recipients(messages: DataFrame, members: DataFrame, team: str, to: str = "recipient") -> DataFrame:
    """messages with member_id: the member (team, id, name, seq) of its team whose id is named, else the first registered of that name; null for unknown ones."""
    ids = members.select(F.col(team).alias("_t1"), F.col("id").alias("_id")).distinct()
    names = members.groupBy(F.col(team).alias("_t2"), F.col("name").alias("_name")).agg(F.min_by("id", "seq").alias("_named"))
    by_id = messages.join(ids, (F.col(team) == F.col("_t1")) & (F.col(to) == F.col("_id")), "left")
    both = by_id.join(names, (F.col(team) == F.col("_t2")) & (F.col(to) == F.col("_name")), "left")
    return both.withColumn("member_id", F.coalesce("_id", "_named")).drop("_t1", "_t2", "_id", "_name", "_named")


def after_shutdown(batch: DataFrame, key: str, is_shutdown: Column) -> DataFrame:
    """Of a drained batch with a shutdown request only the requests remain."""
    flagged = batch.withColumn("_down", F.coalesce(is_shutdown, F.lit(False)))
    any_down = F.max("_down").over(W.partitionBy(key))
    return flagged.withColumn("_any", any_down).where(~F.col("_any") | F.col("_down")).drop("_any", "_down")


def is_shutdown(kind: Column, text: Column) -> Column:
    return (kind == "shutdown_request") | text.startswith("[shutdown]")


def all_idle(members: DataFrame, key: str, active: str = "is_active") -> DataFrame:
    """No member that may be active: unknown counts as active."""
    return members.groupBy(key).agg(F.bool_and(F.col(active).eqNullSafe(False)).alias("all_idle"))


def progress(events: DataFrame, key: str, order: str, tokens: str, activity: str, last: int = 5) -> DataFrame:
    """Event count, the latest token count (assigned, not summed) and the last activities, newest last."""
    seq = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    ranked = events.withColumn("_nth", seq)
    recent = F.array_sort(F.collect_list(F.when(F.col("_nth") <= last, F.struct(order, activity))))
    return ranked.groupBy(key).agg(F.count("*").alias("n_events"), F.max_by(tokens, order).alias("tokens"), F.array_join(F.transform(recent, lambda s: s[activity]), ",").alias("activities"))


def trace_totals(nodes: DataFrame, trace: str, *values: str) -> DataFrame:
    return nodes.groupBy(trace).agg(F.count("*").alias("n_nodes"), *(F.sum(v).alias(f"total_{v}") for v in values))


def trace_tree(nodes: DataFrame, depth: int | None = None, paths: bool = True, limit: int = LIMIT) -> DataFrame:
    """(id, root, depth, path) of adjacency rows (id, parent), down to a depth if one is given: roots have no known parent. path is left out if not asked for: along a chain paths grow with its depth.

    Pointer doubling: each node knows an ancestor and how far it is; each round it asks that one for its own, so the distance doubles and a depth of n takes log n joins. Rounds are
    tables in the shared folder. A parent that many nodes ask is dealt over tasks. Nodes on a loop, or below one, have no root: root, depth and path are null.
    """
    spark, folder = nodes.sparkSession, new_folder(nodes.sparkSession)
    columns = ["id", "up", "root", "depth", *(["path"] if paths else [])]
    known = nodes.select(F.col("id").alias("_known")).distinct()
    start = nodes.select("id", "parent").join(known, F.col("parent") == F.col("_known"), "left")
    top = F.col("_known").isNull()
    start = start.select("id", F.col("_known").alias("up"), F.when(top, F.col("id")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), F.col("id").cast("string").alias("path")).select(*columns)
    rounds = []

    def keep(df: DataFrame) -> None:
        rounds.append(f"{folder}/round_{len(rounds)}")
        df.write.parquet(rounds[-1])

    keep(start)
    read = lambda *at: spark.read.schema(start.schema).parquet(*at)
    left = read(rounds[0]).where("root is null").count()
    most = left.bit_length()  # of rounds that a tree can need; what is open then hangs on a loop
    while left and len(rounds) <= most:
        # nodes whose root is known answer with it, the others with how far they are
        open_ = read(rounds[-1]).where("root is null")
        asked = open_.groupBy("up").agg(F.count("*").alias("_n")).withColumnRenamed("up", "_id")
        above = read(*rounds).where("root is not null").unionByName(open_).join(asked, F.col("id") == F.col("_id"))
        above = above.select(F.col("id").alias("up"), *(F.col(c).alias(f"_{c}") for c in columns[1:]), "_n")
        step = join_dealt(open_.drop("root"), above, ["up"], "_n", limit=limit, most=left)
        path = [F.concat_ws("/", "_path", "path").alias("path")] if paths else []
        keep(step.select("id", F.when(F.col("_root").isNull(), F.col("_up")).alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), *path))
        left = read(rounds[-1]).where("root is null").count()
    lost = [F.when(F.col("root").isNotNull(), F.col(c)).alias(c) for c in columns[3:]]
    out = read(*rounds).where("root is not null").unionByName(read(rounds[-1]).where("root is null")).select("id", "root", *lost)
    out = out.withColumn("depth", F.col("depth").cast("int"))
    return out if depth is None else out.where(F.col("depth") <= depth)


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, which on a cluster all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def rewind(backups: DataFrame, current: DataFrame, snapshot: int) -> DataFrame:
    """(path, action, version): as of a snapshot, the latest backup at or before it; none means the file came later and goes.

    backups (path, snapshot, version), current (path, version).
    """
    then = backups.where(F.col("snapshot") <= snapshot).groupBy("path").agg(F.max("version").alias("then"))
    joined = current.join(then, "path", "left")
    action = F.when(F.col("then").isNull(), "delete").when(F.col("then") == F.col("version"), "keep").otherwise("restore")
    return joined.select("path", action.alias("action"), F.coalesce("then", F.lit(0)).cast("long").alias("version"))


def newest_snapshots(snapshots: DataFrame, key: str, order: str, k: int = 100) -> DataFrame:
    return snapshots.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_nth") <= k).drop("_nth")


def retention(sessions: DataFrame, last_active: str, now: Column, days: int = 30) -> DataFrame:
    """Sessions that are deleted."""
    return sessions.where(F.col(last_active) < now - F.make_dt_interval(F.lit(days)))


def consolidation_gate(hours: Column, sessions: Column, minutes_since_scan: Column) -> Column:
    """A day since the last run, five sessions since, ten minutes since the last look; the first that fails names the state."""
    return F.when(hours < 24, "too soon").when(minutes_since_scan < 10, "throttled").when(sessions < 5, "too few").otherwise("run")


def correlate(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the answer to their id; only a known yes approves."""
    answers = responses.groupBy("request_id").agg(F.min_by("approve", "seq").alias("approve"), F.lit(True).alias("answered"))
    return requests.join(answers, "request_id", "left").withColumn("state", F.when(F.col("answered").isNull(), "pending").when(F.col("approve").eqNullSafe(True), "approved").otherwise("denied")).drop("answered")


def surfaced(memories: DataFrame, seen: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Chosen memories that exist and were not shown yet."""
    return memories.join(seen, key, "left_anti").join(chosen, key, "left_semi")


def full_reminder(iteration: Column, every: int = 5) -> Column:
    return (iteration - 1) % every == 0


def by_path_or_name(chosen: DataFrame, memories: DataFrame, key: str = "key") -> DataFrame:
    """chosen with path and mtime_ms of the memory (path, filename, mtime_ms, seq) whose path is the key, else of the first of that filename; others go."""
    of_path = memories.groupBy(F.col("path").alias("_p")).agg(F.max_by(F.struct("path", "mtime_ms"), "seq").alias("_by_path"))
    of_name = memories.groupBy(F.col("filename").alias("_f")).agg(F.min_by(F.struct("path", "mtime_ms"), "seq").alias("_by_name"))
    joined = chosen.join(of_path, F.col(key) == F.col("_p"), "left").join(of_name, F.col(key) == F.col("_f"), "left")
    found = joined.withColumn("_found", F.coalesce("_by_path", "_by_name")).where(F.col("_found").isNotNull())
    return found.select(*chosen.columns, "_found.path", "_found.mtime_ms")


def run_summary(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, result, num_turns, tool_calls, input_tokens, output_tokens) of each run's events (kind, text, tool, is_error, tokens_in, tokens_out).

    The result is all text in order, the calls are (name, is_error) in order, the tokens are those reported last.
    """
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    last = F.max(of("usage", F.struct(order, "tokens_in", "tokens_out")))
    return events.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(of("text", F.struct(order, "text")))), lambda s: s["text"]), "").alias("result"),
        F.count(of("turn", F.lit(1))).alias("num_turns"),
        F.transform(F.array_sort(F.collect_list(of("call", F.struct(order, "tool", "is_error")))), lambda s: F.struct(s["tool"].alias("name"), s["is_error"].alias("is_error"))).alias("tool_calls"),
        F.coalesce(last["tokens_in"], F.lit(0)).alias("input_tokens"),
        F.coalesce(last["tokens_out"], F.lit(0)).alias("output_tokens"),
    )


def trace_state(nodes: DataFrame, updates: DataFrame, done: DataFrame) -> DataFrame:
    """nodes (id, parent, status, tokens) after updates (id, seq, status, tokens): the last value given of each field, unknown ids ignored.

    Running children of the parents in done (parent) are completed.
    """
    given = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(f"_{c}")
    last = updates.groupBy("id").agg(given("status"), given("tokens"))
    rows = nodes.join(last, "id", "left").withColumns({"status": F.coalesce("_status", "status"), "tokens": F.coalesce("_tokens", "tokens")}).drop("_status", "_tokens")
    rows = rows.join(done.select("parent", F.lit(True).alias("_done")).distinct(), "parent", "left")
    ends = F.col("_done").isNotNull() & (F.col("status") == "running")
    return rows.withColumn("status", F.when(ends, "completed").otherwise(F.col("status"))).drop("_done")


def completed(tasks: DataFrame, handed: DataFrame, key: str = "id") -> DataFrame:
    """Ended tasks that were not handed over yet."""
    return tasks.where(F.col("status").isin("completed", "failed", "cancelled")).join(handed.select(key), key, "left_anti")


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state) of files (path, mtime_ms, size) that are new, changed in either stamp, or gone since they were known."""
    k = known.select(F.col("path").alias("_p"), F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"))
    both = listing.join(k, F.col("path") == F.col("_p"), "full_outer")
    state = F.when(F.col("_p").isNull(), "new").when(F.col("path").isNull(), "gone").when((F.col("mtime_ms") != F.col("_m")) | (F.col("size") != F.col("_s")), "changed")
    return both.select(F.coalesce("path", "_p").alias("path"), state.alias("state")).where("state is not null")
