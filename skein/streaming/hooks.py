"""Hooks around a stream: what follows a batch is kept by its epoch, and metrics observed on the way decide what is done next.

An effect (a command, a prompt, a request) is a row, written to the partition of its epoch. A batch that is run again, after a failure or a restart, writes the same partition again, so an effect is there once; who carries effects
out reads whole epochs. Nothing is sent from here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from skein.functions.text import expand_variables
from skein.operators.rules import match_hooks

EFFECT = "hook_id string, nth int, kind string, target string, text string, method string"
#: Fields of each kind of action; a request is a POST if nothing else is said.
ACTIONS = {"command": ("", "command"), "prompt": ("", "message"), "http": ("url", "body"), "agent": ("", "prompt")}


def effects(events: DataFrame, hooks: list[dict], event: str, tool: str, arguments: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*carry, EFFECT) of the hooks (id, event, condition, action) that events match: texts and urls with ``$EVENT``, ``$TOOL_NAME`` and the like put in."""
    matches = match_hooks(events, hooks, event, tool, arguments)
    known = {"EVENT": F.col(event), "TOOL_NAME": F.col(tool), "ARGUMENTS": F.col(arguments)}
    empty = F.lit(None).cast("string")
    kind, target, text, method = empty, empty, empty, empty
    for h in hooks:
        action = h["action"]
        place, body = ACTIONS[action["type"]]
        here = F.col("hook_id") == h["id"]
        filled = lambda value: expand_variables(F.lit(value), known)
        kind = F.when(here, action["type"]).otherwise(kind)
        target = F.when(here, filled(action[place]) if place else empty).otherwise(target)
        text = F.when(here, filled(action[body]) if action.get(body) else empty).otherwise(text)
        method = F.when(here, action.get("method", "POST") if action["type"] == "http" else empty).otherwise(method)
    return matches.select(*carry, "hook_id", F.col("nth").cast("int").alias("nth"), kind.alias("kind"), target.alias("target"), text.alias("text"), method.alias("method"))


def keep_effects(rows: DataFrame, folder: str, epoch: int) -> None:
    """Effects of an epoch in the place of those that an earlier attempt at it left."""
    rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(folder)


def kept_effects(spark: SparkSession, folder: str, schema: str = EFFECT) -> DataFrame:
    """All effects with their epochs; none where nothing was kept yet."""
    try:
        return spark.read.schema(f"{schema}, epoch long").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, epoch long")


Rules = list[tuple[str, Callable[[dict], bool]]]


def with_effects(
    deliver: Callable[[DataFrame, int], None], hooks: list[dict], folder: str, event: str, tool: str, arguments: str, carry: tuple[str, ...] = (),
    metrics: dict[str, Column] | None = None, rules: Rules = (), then: Callable[[str, int, dict], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: effects of a batch's events are kept, then the batch is delivered. If that fails the epoch comes again and neither is there twice, provided that deliver too goes by epoch.

    metrics are aggregates over the batch, observed while its effects are written; after the delivery `then(label, epoch, metrics)` is called for each rule (label, condition) that they meet.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        seen, observation = batch, None
        if metrics:
            observation = Observation()
            seen = batch.observe(observation, *(c.alias(n) for n, c in metrics.items()))
        keep_effects(effects(seen, hooks, event, tool, arguments, carry), folder, epoch)
        deliver(batch, epoch)
        if observation:
            for label, holds in rules:
                if holds(observation.get):
                    then(label, epoch, observation.get)

    return handle


def observed(events: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """events, with aggregates worked out as they pass: no second reading, no job of their own. For a stream with one sink; in a foreachBatch each reading of the batch would count, see with_effects."""
    return events.observe(name, *(c.alias(n) for n, c in metrics.items()))


class Follow(StreamingQueryListener):
    """Calls `then(label, epoch, metrics)` for each rule (label, condition on the metrics) that a batch's observed metrics meet, once an epoch of a query."""

    def __init__(self, name: str, rules: list[tuple[str, Callable[[Row], bool]]], then: Callable[[str, int, Row], None]):
        self.name, self.rules, self.then = name, rules, then
        self.told: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics, key = (progress.observedMetrics or {}).get(self.name), (str(progress.id), progress.batchId)
        if metrics is None or not progress.numInputRows or key in self.told:
            return
        self.told.add(key)
        for label, holds in self.rules:
            if holds(metrics):
                self.then(label, progress.batchId, metrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
