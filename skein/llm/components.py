"""Connected components of an edge table, by alternating stars; every node ends at the smallest id it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import FEW, Scratch, hot_limit, join_hot


def _star(edges: DataFrame, large: bool, limit: int) -> DataFrame:
    """edges: (u, v), u > v. Each node hands its neighbours (large: those above it, small: those below) to its smallest one.

    The edges of a node with more than `limit` are dealt over several tasks.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_hot(near, least, ["u"], "n", limit, ["v"], most=FEW if limit == FEW else None).withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.where("u > v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node but the centres has one edge, to a centre: then every component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("n")).union(edges.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("n")))
    odd = ends.groupBy("node").agg(F.count("n").alias("up"), F.count("*").alias("all")).where("up > 1 or (up = 1 and all > 1)")
    return not odd.limit(1).count()


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes of edges (u, v) that are not their component's smallest. Goes on until every component is a star."""
    edges = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), f"{name}_0")
    n, k = 2 * edges.count(), 0
    limit = hot_limit(n) if n > FEW else FEW
    while not _are_stars(edges):
        k += 1
        edges = scratch.save(_star(_star(edges, True, limit), False, limit).distinct(), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
