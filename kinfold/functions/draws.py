"""Seeded draws from hashes.

``rand(seed)`` depends on how rows are laid out over partitions. A hash of the draw's own identity
does not: the same draw comes out after any repartitioning, retry or lost executor, and any SQL
engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SPAN = 4294967296.0
TASK_DRAWS = 1_000_000


def draw_int(*parts) -> Column:
    """32-bit integer from the first eight hex digits of ``md5('a:b:c')``."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 8), 16, 10).cast("bigint")


def draw_uniform(*parts) -> Column:
    return draw_int(*parts) / F.lit(SPAN)


def draw_index(n, *parts) -> Column:
    """Integer in ``[0, n)``."""
    return F.pmod(draw_int(*parts), n)


def replicate_column(replicates: int) -> Column:
    """Generator over ``1..replicates``; used on a handful of rows per unit."""
    return F.explode(F.sequence(F.lit(1), F.lit(replicates)))


def _draws(units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``(replicate, position)`` of every draw, dealt by position."""
    tasks = max(units.sparkSession.sparkContext.defaultParallelism, -(-units.count() * replicates // TASK_DRAWS))
    return units.repartition(tasks, "position").select(
        "n_units", F.col("position").alias("draw"), replicate_column(replicates).alias("replicate")
    ).select(
        "replicate",
        draw_index(F.col("n_units"), seed, F.col("replicate"), F.col("draw")).alias("position"),
    ).repartition(tasks, "position")


def bootstrap_counts(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """How often each unit is drawn in each replicate: ``(replicate, unit, weight)``.

    ``units`` holds one row per unit with its zero-based ``position`` and the number of units
    ``n_units``; it is counted and read twice. Every row makes ``replicates`` draws, and the units may come from one ordered
    window, so they are spread first, and a task's draws do not grow with the units;
    they are counted before the join that turns positions into units, and weights stand in for
    copied rows from then on. Draws are dealt by position once, for counting and for that join. Spark
    takes them for as many as the units, so no join may broadcast them: the result carries a hint.
    """
    draws = _draws(units, replicates, seed)
    counted = draws.groupBy("replicate", "position").agg(F.count("*").cast("double").alias("weight"))
    return counted.join(units.select(unit, "position").hint("merge"), "position").select(
        "replicate", unit, "weight"
    ).hint("merge")


def bootstrap_vectors(units: DataFrame, unit: str, replicates: int, seed: int, out: str) -> DataFrame:
    """The draws of :func:`bootstrap_counts` as one row per unit: ``out`` holds 1, then the unit's draws in each replicate."""
    counted = _draws(units, replicates, seed).groupBy("position").agg(*[
        F.count_if(F.col("replicate") == r).cast("int").alias(f"_{r}") for r in range(1, replicates + 1)])
    counts = [F.coalesce(f"_{r}", F.lit(0)) for r in range(1, replicates + 1)]
    return units.select(unit, "position").join(counted.hint("merge"), "position", "left").select(unit, F.array(F.lit(1), *counts).alias(out))


ROUNDS = 8
PRIME = 2147483647


def radices(n: int) -> tuple[int, int]:
    """Two numbers near the root of ``n`` whose product is ``n`` or a little more (at most a root more)."""
    if n <= 2:
        return 1, max(n, 1)
    root = max(2, math.isqrt(n))
    domain = n
    while True:
        for a in range(root, max(2, root // 4) - 1, -1):
            if domain % a == 0:
                return a, domain // a
        domain += 1


def shuffled_positions(df: DataFrame, position: str, n: int, keys: str, out: str) -> DataFrame:
    """Column ``out`` as :func:`shuffled_position` gives it, round by round in columns, which Spark compiles.

    Only what lands at ``n`` or above, one row in about ``sqrt(n)``, is walked on by that function. ``out`` is never null: else
    Spark would test that before a join, on an expression that doubles with every round.
    """
    a, b = radices(n)
    whole = lambda c: c.cast("bigint")
    kept = [c for c in df.columns if c != keys]
    named = [F.get(F.col(keys), F.lit(i)).alias(f"_k{i}") for i in range(ROUNDS)]
    row = df.select("*", *named, F.pmod(F.col(position), F.lit(b)).alias("_r"))
    row = row.withColumn("_l", whole((F.col(position) - F.col("_r")) / b))
    for i in range(ROUNDS):
        half, other, size = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
        row = row.withColumn("_m", (F.col(other) + F.col(f"_k{i}")) % PRIME)
        row = row.withColumn(half, (F.col(half) + (F.col("_m") * F.col("_m") % PRIME * 48271 + F.col(f"_k{i}")) % PRIME) % size)
    row = row.withColumn(out, F.col("_l") * b + F.col("_r"))
    if a * b > n:
        row = row.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(shuffled_position(F.col(position), n, F.col(keys))))
    return row.select(*kept, F.coalesce(out, F.lit(-1).cast("bigint")).alias(out))


def round_keys(*parts) -> Column:
    """Keys of one permutation, an array of ``ROUNDS`` numbers; made once per permutation, not per row."""
    return F.array(*[draw_int(*parts, F.lit(i)) % PRIME for i in range(ROUNDS)])


def shuffled_position(position: Column, n: int, keys: Column) -> Column:
    """Where the permutation of ``0..n-1`` with these :func:`round_keys` sends ``position``: no sort, no table of orders.

    A Feistel network on pairs (l, r) of mixed radices: in turn one half moves by a keyed hash of the other (a square modulo a
    prime, so that nothing overflows), which can be undone, so it is a bijection of the ``a * b >= n`` pairs. What lands at ``n`` or above goes through again until it is below;
    since that follows a cycle of the bijection and only ``a * b - n`` places lie above, so many more passes always do.
    """
    a, b = radices(n)
    whole = lambda c: c.cast("bigint")

    def step(state: Column, i: Column) -> Column:
        left, right, key = state["l"], state["r"], F.get(keys, i)
        even = i % 2 == 0
        moved = (F.when(even, right).otherwise(left) + key) % PRIME
        hashed = moved * moved % PRIME * 48271 + key
        return F.when(even, F.struct(((left + hashed % PRIME) % a).alias("l"), right.alias("r"))).otherwise(
            F.struct(left.alias("l"), ((right + hashed % PRIME) % b).alias("r")))

    def once(x: Column) -> Column:
        rest = F.pmod(x, F.lit(b))
        start = F.struct(whole((x - rest) / b).alias("l"), whole(rest).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(a * b - n)), whole(position), lambda x, i: F.when((i == 0) | (x >= n), once(x)).otherwise(x))
