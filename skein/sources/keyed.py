"""Sinks that keep a row a key: texts spilled once, and numbered backups of files.

A table is a folder of ``bucket=`` (of the key's hash) and ``batch=`` partitions. A write looks for its keys only in the buckets that it
touches, leaves out those that another batch holds, and replaces its own batch's partitions (dynamic overwrite). So a second write adds its new keys and keeps the old; the same
batch written again, after a failure or by a replayed stream, ends as if it had been written once. Until a write is committed its files lie apart and
no reader sees them. Two batches that are written at the same time should not hold the same keys.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _partitions(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table as it is, or nothing: partition columns keep their types whatever values occur."""
    schema = StructType([*like.schema.fields, StructField("bucket", IntegerType()), StructField("batch", StringType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def spill(rows: DataFrame, path: str, key: str, batch: str, order: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Keeps a row for each new key of rows, the first in `order` (by default any one); a key that another batch holds stays as it is. Rows without a key are left out."""
    mine = rows.where(F.col(key).isNotNull())
    if order:
        mine = mine.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")
    else:
        mine = mine.dropDuplicates([key])
    held = _partitions(rows.sparkSession, path, rows).where(F.col("batch") != batch).select("bucket", F.col(key).alias("_held"))
    mine = mine.withColumn("bucket", bucket_of(F.col(key), buckets))
    new = mine.join(held.withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & (F.col(key) == F.col("_held")), "left_anti")
    _write(new.withColumn("batch", F.lit(batch)), path)


def spilled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows kept so far."""
    return spark.read.schema(f"{schema}, bucket int, batch string").parquet(path).drop("bucket", "batch")


def backup_name(path: Column, version: Column) -> Column:
    """A backup's file: 16 digits of the path's hash, and the version."""
    return F.concat(F.left(F.sha2(path, 256), F.lit(16)), F.lit("@v"), version.cast("string"))


def back_up(edits: DataFrame, path: str, batch: str, buckets: int = BUCKETS) -> None:
    """Keeps edits (path, seq, content) as versions: a path's next numbers in the order of seq. A null content is a file that was not there: its number is used and nothing kept.

    The same edit (path, seq) twice in a batch counts once, with its greatest content.
    """
    rows = edits.where("path is not null and seq is not null").groupBy("path", "seq").agg(F.max("content").alias("content"))
    kept = rows.select("path", "seq", F.lit(0).cast("long").alias("version"), "content", F.lit("").alias("name"))
    held = _partitions(edits.sparkSession, path, kept).where(F.col("batch") != batch)
    last = held.groupBy("bucket", "path").agg(F.max("version").alias("_last"))
    rows = rows.withColumn("bucket", bucket_of(F.col("path"), buckets))
    nth = F.row_number().over(W.partitionBy("bucket", "path").orderBy("seq"))
    rows = rows.withColumn("_nth", nth).join(last, ["bucket", "path"], "left")
    version = (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("long")
    rows = rows.withColumn("version", version).withColumn("name", F.when(F.col("content").isNotNull(), backup_name(F.col("path"), F.col("version"))))
    _write(rows.select("path", "seq", "version", "content", "name", "bucket", F.lit(batch).alias("batch")), path)


def backups(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, version, content, name) of all versions."""
    return spilled(spark, path, "path string, seq long, version long, content string, name string")


def restored(versions: DataFrame, at: int) -> DataFrame:
    """(path, version, content, action) as of an edit's number: the latest version up to it; without content the file goes. Files first seen later are left alone."""
    then = versions.where(F.col("seq") <= at).groupBy("path").agg(F.max_by(F.struct("version", "content"), "version").alias("v"))
    return then.select("path", "v.version", "v.content", F.when(F.col("v.content").isNull(), "delete").otherwise("restore").alias("action"))


# --- memories, a folder a type ---------------------------------------------------------------------

#: Types that have a folder; any other goes to the last.
MEMORY_TYPES = ("user", "feedback", "project", "reference")


def write_memories(memories: DataFrame, root: str) -> None:
    """Keeps memories (name, description, type, body, seq) in the folder of their type: of a (type, name) the last stands. Types of this write are merged with what is there."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    new = memories.where(F.trim(F.coalesce("name", F.lit(""))) != "").select("name", "description", "body", "seq", F.when(kind.isin(*MEMORY_TYPES), kind).otherwise(MEMORY_TYPES[-1]).alias("type"))
    spark = memories.sparkSession
    try:
        held = spark.read.schema(new.schema).parquet(root).withColumn("_new", F.lit(0))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        held = new.limit(0).withColumn("_new", F.lit(0))
    touched = held.join(new.select("type").distinct(), "type", "left_semi")
    last = F.row_number().over(W.partitionBy("type", "name").orderBy(F.desc("_new"), F.desc("seq"), F.desc("body")))
    merged = touched.unionByName(new.withColumn("_new", F.lit(1))).withColumn("_nth", last).where("_nth = 1").drop("_nth", "_new")
    # read in full before the folders are replaced
    merged.checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(root)


def read_memories(spark: SparkSession, root: str, flat: str | None = None) -> DataFrame:
    """(name, description, body, seq, type): all types, or one folder alone, ordered by name."""
    rows = spark.read.schema("name string, description string, body string, seq long, type string").parquet(root)
    return rows if flat is None else rows.where(F.col("type") == flat).orderBy("name")


def index_lines(memories: DataFrame) -> DataFrame:
    """(type, file, line): a line a memory, by its file."""
    file = F.concat("type", F.lit("/"), F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", "-"), F.lit(".md"))
    text = F.concat(F.lit("- ["), "name", F.lit("]("), "file", F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    return memories.withColumn("file", file).groupBy("type", "file").agg(F.max_by(F.struct("name", "description"), "seq").alias("m")).select("type", "file", "m.*").select("type", "file", text.alias("line"))
