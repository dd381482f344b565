"""Stateful streams over typed state: mailboxes that are consumed once, and files that are watched.

Both keep their state in the session's state store, which must be RocksDB's (`use_rocksdb`). A key's rows are taken one by one, written in runs of bounded size, and its list is read as it
was written, so no key's batch or backlog lies in memory whole; of ids, MOST_IDS do at most, and those of the last hour of one recipient when they are forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: How a shutdown request is known.
SHUTDOWN_KIND, SHUTDOWN_TEXT = "shutdown_request", "[shutdown]"

FIELDS = ("id", "seq", "kind", "sender", "text")
MESSAGE = "id string, seq long, kind string, sender string, text string"
INBOX_OUT = f"recipient string, {MESSAGE}, waited boolean"


#: So many ids of a recipient are kept as one list that a batch reads and extends at once; those beyond are looked up one by one.
MOST_IDS = 20_000
#: Messages, and characters of their texts, that are held before they go to the state in one call.
HELD, HELD_CHARS = 1000, 1 << 20


def _packed(ids: list[tuple]) -> tuple:
    return [i for i, _ in ids], [at for _, at in ids]


class Inbox(StatefulProcessor):
    """Unread messages of a recipient: kept until a poll or the idle timer, handed over once.

    A call to the state is a round trip to the JVM, so calls are made by key and not by message. Two rules spare more of them: there is something unread in the state only while
    the idle timer is set, and there are known ids only while the forget timer is.
    """

    def __init__(self, idle_ms: int, forget_ms: int):
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unread = handle.getListState("unread", MESSAGE)
        self.down = handle.getValueState("down", MESSAGE)
        self.recent = handle.getListState("recent", "ids array<string>, ts_ms array<long>")  # an element a batch: each is converted by itself
        self.seen = handle.getMapState("seen", "id string", "ts_ms long")
        self.due = handle.getValueState("due", "idle long, forget long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._due()
        idle, forget = before
        stored, polled, first, known, many = idle is not None, False, None, None, False
        down, told, mail, chars, fresh = None, False, [], 0, []
        for r in rows:
            if r.kind == "poll":
                polled = True
                continue
            if r.id is not None:
                if known is None:
                    known = {i for ids, _ in self.recent.get() for i in ids} if forget is not None else set()
                    many = forget is not None and self.seen.exists()
                if r.id in known or (many and self.seen.containsKey((r.id,))):
                    continue  # a message that came before, say of a source that was read again
                if len(known) < MOST_IDS:
                    known.add(r.id)
                    fresh.append((r.id, r.ts_ms))
                else:
                    self.seen.updateValue((r.id,), (r.ts_ms,))
                    many = True
            message = tuple(r[f] for f in FIELDS)
            if r.kind == SHUTDOWN_KIND or (r.text or "").startswith(SHUTDOWN_TEXT):
                if down is None and stored and self.down.exists():
                    down = tuple(self.down.get())
                if down is None or (down[1] or 0) <= (r.seq or 0):
                    down, told = message, True
            else:
                mail.append(message)
                chars += len(r.text or "")
                if len(mail) >= HELD or chars >= HELD_CHARS:
                    self.unread.appendList(mail)
                    stored, mail, chars = True, [], 0
            first = r.ts_ms if first is None else min(first, r.ts_ms)
        if fresh:
            self.recent.appendValue(_packed(fresh))
        if polled:
            yield from self._hand_over(key, False, stored, down, mail)
            if idle is not None:
                self.handle.deleteTimer(idle)
            idle = None
        else:
            if told:
                self.down.update(down)
            if mail:
                self.unread.appendList(mail)
            if first is not None and idle is None:
                idle = first + self.idle_ms
                self.handle.registerTimer(idle)
        if first is not None and forget is None:
            forget = first + self.forget_ms
            if forget != idle:
                self.handle.registerTimer(forget)
        if (idle, forget) != before:
            self.due.update((idle, forget))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        idle, forget = self._due()  # an earlier timer of this batch may have done it all
        now = timerValues.getCurrentWatermarkInMs()
        if idle is not None and idle <= now:
            yield from self._hand_over(key, True, True)
            idle = None
        if forget is not None and forget <= now:
            # a message before the watermark cannot come again, so its id need not be known
            known = [x for ids, ats in self.recent.get() for x in zip(ids, ats, strict=True)]
            left = [x for x in known if x[1] >= now]
            if left and len(left) < len(known):
                self.recent.put([_packed(left)])
            elif known and not left:
                self.recent.clear()
            if self.seen.exists():
                more = [(k[0], v[0]) for k, v in self.seen.iterator()]
                for i, at in more:
                    if at < now:
                        self.seen.removeKey((i,))
                left += [x for x in more if x[1] >= now]
            forget = min(at for _, at in left) + self.forget_ms if left else None
            if forget is not None:
                self.handle.registerTimer(forget)
        if idle is None and forget is None:
            self.due.clear()
        else:
            self.due.update((idle, forget))

    def _due(self) -> tuple:
        return tuple(self.due.get() or (None, None))

    def _hand_over(self, key, waited: bool, stored: bool, down: tuple | None = None, mail: list[tuple] = ()) -> Iterator[Row]:
        """A shutdown request alone, the last one, if there is any; else all unread messages: those in the state, if any are stored, then mail. Either way nothing stays unread."""
        if stored and down is None and self.down.exists():
            down = tuple(self.down.get())
        if down is not None:
            yield Row(recipient=key[0], **dict(zip(FIELDS, down, strict=True)), waited=waited)
        else:
            for some in (self.unread.get() if stored else (), mail):
                for m in some:
                    yield Row(recipient=key[0], **dict(zip(FIELDS, m, strict=True)), waited=waited)
        if stored:
            self.down.clear()
            self.unread.clear()

    def close(self) -> None:
        pass


def consume(messages: DataFrame, late: str = "1 hour", idle_ms: int = 1000, forget_ms: int = 3_600_000) -> DataFrame:
    """INBOX_OUT of a stream (recipient, id, seq, kind, sender, text, ts): messages as their recipient gets them.

    A row of kind ``poll`` asks for what is unread; without one it is handed over idle_ms after its first message, by the stream's own time. A message that has an id is taken once,
    however often it comes: its id is known until the watermark has passed it, and rows that are later than `late` are dropped. So the state holds what is unread and the ids of that time only.
    Rows without recipient or time have no mailbox.
    """
    rows = messages.where("recipient is not null and ts is not null").withWatermark("ts", late).select("recipient", *FIELDS, "ts", F.unix_millis("ts").alias("ts_ms"))
    return rows.groupBy("recipient").transformWithState(Inbox(idle_ms, forget_ms), INBOX_OUT, "append", "eventTime")


WATCH_OUT = "path string, mtime_ms long, size long, state string"


class Watched(StatefulProcessor):
    """The newest stamp of a file that is known, and whether the file is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "mtime_ms long, size long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = self.known.get() if self.known.exists() else None
        before, newest = at, at
        for r in rows:
            stamp = (r.mtime_ms, r.size, bool(r.deleted))
            # of one time a deletion counts last
            if newest is None or (stamp[0], stamp[2]) > (newest[0], newest[2]) or (stamp[0] == newest[0] and not stamp[2] and not newest[2] and (stamp[1] or 0) > (newest[1] or 0)):
                newest = stamp
        if newest is not None and (before is None or tuple(newest) != tuple(before)):
            self.known.update(tuple(newest))
            was_there, is_there = before is not None and not before[2], not newest[2]
            state = {(False, True): "back" if before is not None else "new", (True, True): "changed", (True, False): "gone"}.get((was_there, is_there))
            if state:
                yield Row(path=key[0], mtime_ms=newest[0], size=newest[1], state=state)

    def close(self) -> None:
        pass


def watch(listings: DataFrame) -> DataFrame:
    """WATCH_OUT of a stream (path, mtime_ms, size, deleted): what to load again. The newest version of a path wins, in whatever order versions come; a deletion is a row of its own, kept
    as a tombstone so that an older version that comes late brings nothing back. Rows of the stamps known already say nothing; a change within one batch is told once.
    """
    rows = listings.where("path is not null and mtime_ms is not null").select("path", "mtime_ms", "size", "deleted")
    return rows.groupBy("path").transformWithState(Watched(), WATCH_OUT, "append", "none")
