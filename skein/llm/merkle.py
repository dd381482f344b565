"""Merkle manifest of a table: a tree over each group's ordered rows, and one over the groups' roots.

A list of nodes is ranked, then cut into blocks of 1,024. A block is an ordered array that native higher-order functions collapse: each level pairs
the one below with sequence, transform and slice, aggregate stacks ten levels, and each node's siblings are read from the stack by
position. The roots of the blocks are the list of the next round; n rows take log(n) / 10 rounds. On the way back each block's own path is put after those
of its nodes, so a node's path runs from its leaf to the root. A group's list may hold any share of all rows: ranks come from a range
partitioning by (group, key, leaf, row number) and the parts' counts, and nothing is gathered by group but one root.

A null key sorts first; rows of one key go by leaf; rows that agree in both have one leaf, so their order can't be seen but in their proofs, of which each gets one.
A null group is a group, the first. An empty table gives no rows. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import Scratch

LEVELS = 10  # of a block: 2 ** LEVELS nodes
#: In-partition numbers of monotonically_increasing_id.
_ROW_BITS = 33


def framed(value: Column) -> Column:
    """A value with its length before it, so that no two rows read alike; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(nodes: Column) -> Column:
    """One digest of an array of digests as text."""
    return F.sha2(F.array_join(nodes, ""), 256)


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (g, ...) with `rank` (from 0) and `n` within g, in the order of the columns, all of which are sorted through a range partitioning."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).withColumn("seq", F.monotonically_increasing_id())
    spread = scratch.save(spread, f"{name}_sorted").withColumn("part", F.shiftright("seq", _ROW_BITS).cast("int"))
    counts = spread.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("seq").alias("first"))  # parts + groups rows
    before = "coalesce(sum(c) OVER (PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    starts = counts.select("g", "part", F.expr(f"first - {before}").alias("origin"), F.expr("sum(c) OVER (PARTITION BY g)").alias("n"))
    return spread.join(starts, ["g", "part"]).withColumn("rank", F.col("seq") - F.col("origin")).drop("seq", "part", "origin")


def _stack(nodes: Column, levels: Column) -> Column:
    """The levels of a block, leaves first: as many arrays as levels, plus one."""

    def above(stack: Column, _: Column) -> Column:
        last = F.element_at(stack, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int"))
        return F.concat(stack, F.array(F.transform(runs, lambda i: joined(F.slice(last, 2 * i + 1, F.lit(2))))))

    steps = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= levels)
    return F.aggregate(steps, F.array(nodes), above)


def _siblings(stack: Column, at: Column, levels: Column) -> Column:
    """For each level the node beside at's, null where it stands alone, and whether at's is the right one."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: k < levels)
    up = lambda k: F.call_function("shiftright", at, k)

    def beside(k: Column) -> Column:
        odd = up(k) % 2 == 1
        node = F.get(F.get(stack, k), F.when(odd, up(k) - 1).otherwise(up(k) + 1))
        return F.struct(node.alias("node"), odd.alias("right"))

    return F.transform(steps, beside)


def _placed(e: Column) -> Column:
    """An item of a block with its node and its path up to the block's top."""
    at = (e["rank"] - F.shiftleft("block", LEVELS)).cast("int")
    node = F.get(F.element_at("stack", 1), at)
    return F.struct(e["rank"].alias("rank"), node.alias("node"), e["item"].alias("item"), _siblings(F.col("stack"), at, F.col("levels")).alias("own"))


def collapse(rows: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """rows (g, rank, n, node, item): the rounds' blocks (g, block, n, levels, stack, items, top); the last round has one block a group, whose top is the group's root.

    items are (rank, item) in order.
    """
    rounds, kind = [], rows.schema["item"].dataType
    while True:
        levels = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(LEVELS), F.length(F.bin(F.col("n") - 1))))
        block = F.shiftright("rank", LEVELS).alias("block")
        gathered = rows.groupBy("g", block).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "node", "item"))).alias("nodes"))
        stacked = gathered.withColumn("levels", levels).withColumn("stack", _stack(F.col("nodes.node"), F.col("levels")))
        items = F.transform("nodes", lambda e: F.struct(e["rank"].alias("rank"), e["item"].alias("item"))).alias("items")
        blocks = scratch.save(stacked.select("g", "block", "n", "levels", "stack", items, F.get(F.element_at("stack", -1), F.lit(0)).alias("top")), f"{name}_{len(rounds)}")
        rounds.append(blocks)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= 1 << LEVELS:
            return rounds
        above = F.greatest(F.lit(1), F.ceil(F.col("n") / (1 << LEVELS))).cast("long")
        rows = blocks.select("g", F.col("block").alias("rank"), above.alias("n"), F.col("top").alias("node"), F.lit(None).cast(kind).alias("item"))


PATH = "array<struct<node:string,right:boolean>>"


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, rank, node, item, path, ...) of all rows of the first round. above: (g, path, ...) a row a group, whose path and other columns each row gets too."""
    carried = [c for c in above.columns if c not in ("g", "path")]
    out = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        joint = blocks.join(out, ["g", "block"])
        own = F.transform("items", _placed)
        rows = joint.select("g", "path", *carried, F.explode(own).alias("e"))
        out = rows.select("g", F.col("e.rank").alias("block"), F.col("e.node").alias("node"), F.col("e.item").alias("item"), F.concat("e.own", "path").alias("path"), *carried)
        if blocks is not rounds[0]:
            out = out.drop("node", "item")
    return out.withColumnRenamed("block", "rank")


def prove(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (g, key, leaf, item) to (item, leaf, subroot, root, path): g is text or null, path the siblings from leaf to root."""
    numbered = scratch.save(rows.withColumn("g", F.coalesce(F.concat(F.lit("1"), "g"), F.lit("0"))).withColumn("uid", F.monotonically_increasing_id()), "leaves")
    leaves = ranked(numbered, ["key", "leaf", "uid"], scratch, "leaves").select("g", "rank", "n", F.col("leaf").alias("node"), "item")
    rounds = collapse(leaves, scratch, "blocks")
    subroots = rounds[-1].select("g", F.col("top").alias("node"))
    groups = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "node"), ["key"], scratch, "groups")
    group_rounds = collapse(groups.select("g", "rank", "n", "node", F.col("key").alias("item")), scratch, "group_blocks")
    top = group_rounds[-1].select("g", F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
    above = paths(group_rounds, top).select(F.col("item").alias("g"), F.col("node").alias("subroot"), "root", "path")
    return paths(rounds, above).select("item", F.col("node").alias("leaf"), "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    pair = lambda at, s: F.when(s["right"], F.concat(F.coalesce(s["node"], F.lit("")), at)).otherwise(F.concat(at, F.coalesce(s["node"], F.lit(""))))
    return F.aggregate(path, leaf, lambda at, s: F.sha2(pair(at, s), 256))


def manifest(df: DataFrame, columns: list[str], group: str, key: str, tampered: Column | None = None, changed: dict[str, Column] | None = None, carry: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """(*carry, leaf, subroot, root, path, folded_root) of each row of df, a leaf over the named columns.

    folded_root is worked out from the row's leaf and path. For rows where `tampered` holds the leaf is made anew, with the columns of `changed` in the place of
    df's own: it then fits the root only if nothing changed.
    """
    scratch = scratch or Scratch(df.sparkSession)
    over = lambda given: digest(*(framed(given.get(c, F.col(c))) for c in columns))
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, over(changed or {}))
    item = F.struct(*(F.col(c) for c in carry), other.alias("_other")).alias("item")
    proven = prove(df.select(F.col(group).cast("string").alias("g"), F.col(key).alias("key"), over({}).alias("leaf"), item), scratch)
    start = F.coalesce(F.col("item._other"), F.col("leaf"))
    return proven.select(*(F.col("item")[c].alias(c) for c in carry), "leaf", "subroot", "root", "path", fold(start, F.col("path")).alias("folded_root"))


def proof_digest(path: Column) -> Column:
    """One digest of the siblings of a path, leaf to root, left to right."""
    return joined(F.transform(path, lambda s: s["node"]))
