"""Scratch tables in the cluster's shared folder, byte buffers and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the word-based operators is a run of anything but these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset: on a local master a folder of our own, else an error, as executors could not read it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="skein-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that cut lineage: they survive lost executors, unlike cached blocks. What is left of them goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Forget tables that no later step reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def free_shuffles(self) -> None:
        """Shuffle files of finished jobs go when the driver collects its garbage; ask for that now."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def row_keys(id_: Column, text: Column) -> dict[str, Column]:
    """k1 and k2, by which rows of one id and one text, and only those, agree; the id alone would not tell null or repeated ones apart."""
    number = id_.cast("long")
    return {"k1": F.coalesce(number, F.xxhash64(F.lit(1), text)), "k2": F.xxhash64(number, text)}


def hot_limit(rows: int) -> int:
    """Rows of one key over which it is dealt over several tasks: at most 20,000 keys can have more, so a list of them may be broadcast."""
    return max(1024, rows // 20_000)


#: Up to so many rows in all, of a few numbers each, are no burden to a single task, whatever their keys.
FEW = 100_000


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], weight: str, limit: int, spread: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """big joined with small, whose column `weight` bounds the rows of big that have the key (it is dropped). most: the largest weight, where it is known.

    Keys over `limit` rows are dealt by a hash of big's columns `spread`, so that no task gets one key's rows alone. They are broadcast:
    the weights of big's N rows sum to N at most, so there are N / limit of them at most.
    """
    if most is not None and most <= limit:
        return big.join(small.drop(weight), keys, how)
    salts = F.ceil(F.col(weight) / limit).cast("int")
    hot = small.where(F.col(weight) > limit).select(*(F.col(k).alias(f"_{k}") for k in keys), salts.alias("_salts")).distinct()
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    dealt = big.join(F.broadcast(hot), on, "left").drop(*(f"_{k}" for k in keys))
    dealt = dealt.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))).drop("_salts")
    each = small.withColumn("_salt", F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))).drop(weight)
    return dealt.join(each, [*keys, "_salt"], how).drop("_salt")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda a plain column would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words of a text; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def word_count(text: Column) -> Column:
    """How many words a text has, without building them."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(WORD_GAP)) + 1).cast("long")


# --- numpy over Arrow string columns ---------------------------------------------------------------


def byte_slices(column, limit: int = 1 << 21):
    """Yields (first row, end row, bytes, offsets) over runs of rows of about limit bytes; null reads as empty. A longer text is a run of its own."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        array = array.cast(pa.large_binary()).fill_null(b"")
        if not len(array):
            continue
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        body = array.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(array):
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
            first = end


#: An odd multiplier of good dispersion; fixed so that reruns agree.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer strings are hashed one by one.
LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Strings:
    """Hashes of substrings of a buffer: 8 bytes at a time through a mixer that is no polynomial, all strings side by side."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        #: The 8 bytes from each place on.
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        """64-bit hashes of data[start:end]; equal strings have equal hashes wherever they stand. Each lane is a hash function of its own."""
        size = end - start
        h = mix(size.astype(np.uint64) * BASE + np.uint64((0x632BE59BD9B4E019 * (lane + 1)) % 2**64))
        live = np.arange(len(size))
        far = size > LONG
        if far.any():
            live = live[~far]
            raw = memoryview(np.ascontiguousarray(self.data))
            for k in np.flatnonzero(far):
                h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8, salt=bytes([lane])).digest(), "little")
        live = live[size[live] > 0]
        k = 0
        while len(live):
            rest = size[live] - k
            word = self.eight[start[live] + k] & _MASKS[np.minimum(rest, 8)]
            h[live] = mix((h[live] ^ word) * BASE + np.uint64(lane)) if lane else mix(h[live] ^ word)
            live = live[rest > 8]
            k += 8
        return h
