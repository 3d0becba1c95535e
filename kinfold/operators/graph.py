"""Connected blocks over bipartite edges.

Alternating large-star / small-star contraction (Kiveris et al., 2014): every round is two grouped
minima and two joins, the number of rounds grows with the logarithm of the longest chain, and a hub
with very many edges is a partial aggregate plus a join that Spark may split, never one task's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.functions.scalars import split_ids
from kinfold.operators.ordered import positions
from kinfold.session import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the edge list; the component is its smallest node."""
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    loops = cut(pairs.distinct())
    current = loops.where("u <> v")
    before = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        current = cut(small)
        now = _state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    nodes = loops.select(F.col("u").alias("node")).union(loops.select("v")).distinct()
    return nodes.join(current.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component"))


def group_source_edges(df: DataFrame, group: str, tokens: Column) -> DataFrame:
    """Distinct (group, source) pairs; groups without sources keep one row with a NULL source."""
    return df.select(group, F.explode_outer(tokens).alias("source")).distinct()


def connected_blocks(edges: DataFrame, group: str, prefix: str = "CVB", width: int = 4) -> DataFrame:
    """``(group, root, block)``: groups sharing sources, directly or through others, share a block.

    ``root`` is the smallest group of the block and blocks are numbered by root.
    """
    tagged = edges.select(
        F.concat(F.lit("g"), F.col(group).cast("string")).alias("g"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.concat(F.lit("g"), F.col(group).cast("string"))).alias("s"))
    label = components(tagged, "g", "s")
    member = edges.select(group).distinct().withColumn("node", F.concat(F.lit("g"), F.col(group).cast("string")))
    placed = member.join(label, "node").select(group, "component")
    roots = placed.groupBy("component").agg(F.min(group).alias("root"))
    numbered = positions(roots, [], "root").select("root", (F.col("position") + 1).alias("number"))
    digits = F.greatest(F.lit(width), F.length(F.col("number").cast("string")))
    named = roots.join(numbered, "root").select(
        "component", "root", F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), digits, F.lit("0"))).alias("block"))
    return placed.join(named, "component").select(group, "root", "block")


def dependency_blocks(df: DataFrame, a_block: str, b_block: str, prefix: str = "CCB") -> DataFrame:
    """Blocks joining two block systems: ``(a_block, root, block)``."""
    pairs = df.select(F.col(a_block), F.col(b_block).cast("string").alias("source")).distinct()
    return connected_blocks(pairs, a_block, prefix)


def union_edges(record_edges: DataFrame, registry: DataFrame, group: str, sources: str) -> DataFrame:
    """Edges from the record table and from the group registry together."""
    more = group_source_edges(registry, group, split_ids(sources))
    return record_edges.select(group, "source").union(more.select(group, "source")).distinct()
