"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.coordination import after_shutdown


def breaker(results: DataFrame, key: str = "key", opens_at: int = 3) -> DataFrame:
    """(key, seq, streak, open) of a stream (key, seq, failed): failures in a row, kept as one number a key. Rows of a batch are taken in order of seq."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, failed in zip(rows["seq"], rows["failed"], strict=True):
            streak = streak + 1 if failed else 0
            out.append((k[0], seq, streak, streak >= opens_at))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["key", "seq", "streak", "open"])

    return results.select(F.col(key).alias("key"), "seq", "failed").groupBy("key").applyInPandasWithState(step, "key long, seq long, streak long, open boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def once(matches: DataFrame, key: str = "hook_id") -> DataFrame:
    """The first match of each hook that comes."""
    return matches.dropDuplicates([key])


def drain(messages: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None], key: str = "recipient"):
    """A query that hands each micro-batch over once its shutdown requests have pre-empted the rest; offsets mark what is read."""

    def handle(batch: DataFrame, epoch: int) -> None:
        deliver(after_shutdown(batch, key, F.col("kind") == "shutdown_request"), epoch)

    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hooked(deliver: Callable[[DataFrame, int], None], before: list[Callable] = (), after: list[Callable] = ()) -> Callable[[DataFrame, int], None]:
    """deliver with listeners around it, for foreachBatch: each of before may hand back another batch, each of after sees what was delivered."""

    def handle(batch: DataFrame, epoch: int) -> None:
        for listen in before:
            changed = listen(batch, epoch)
            batch = batch if changed is None else changed
        deliver(batch, epoch)
        for listen in after:
            listen(batch, epoch)

    return handle


def completions(tasks: DataFrame, key: str = "id") -> DataFrame:
    """Ended tasks of a stream (id, status, ...), each handed over once."""
    return tasks.where(F.col("status").isin("completed", "failed", "cancelled")).dropDuplicates([key])
