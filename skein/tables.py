"""Loaders of the parquet carriers, with the columns a query names and no more."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as (conv_id, idx, role, content), user and assistant rows only."""
    rows = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return rows.where(F.col("role").isin("user", "assistant")).select("conv_id", F.col("turn").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("content"))


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small literal table: part of the plan, so no job and no serialised rows."""
    names = [f.split()[0] for f in schema.split(",")]
    kinds = [f.split()[1] for f in schema.split(",")]

    def struct(row: tuple) -> Column:
        return F.struct(*(F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds, strict=True)))

    return spark.range(1, numPartitions=1).select(F.inline(F.array(*map(struct, rows))))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which on a cluster all executors share; on a local master one is made where none is set."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp(prefix="skein-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one; what is in it goes when the driver ends."""
    path = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path
