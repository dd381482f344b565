"""Joins that no single key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes; keys with more are dealt over several.
LIMIT = 100_000


def join_dealt(big: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str = "inner", limit: int = LIMIT, most: int | None = None) -> DataFrame:
    """big joined with small, whose column `weight` is the count of big's rows with the key (it is dropped).

    Keys over the limit are split by the place of their rows in big, and small's rows of them repeated. Of big's N rows at most N / limit keys can have
    more, so their list is broadcast: with the default a megabyte for each ten billion rows or so.
    most: a bound of the weights where one is known; up to the limit nothing need be dealt.
    """
    if most is not None and most <= limit:
        return big.join(small.drop(weight), keys, how)
    salts = F.ceil(F.col(weight) / limit).cast("int")
    hot = small.where(F.col(weight) > limit).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), salts.alias("_salts")).distinct()
    dealt = big.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left").drop(*(f"_hot_{k}" for k in keys))
    place = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_salts"))).cast("int")
    copies = F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))
    return dealt.withColumn("_salt", place).drop("_salts").join(small.withColumn("_salt", copies).drop(weight), [*keys, "_salt"], how).drop("_salt")
