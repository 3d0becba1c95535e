"""Join patterns: checked chains, enrichment, alignment, pairs, leave-one-out."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.operators.contracts import key_violations


def checked_inner(frames: Sequence[tuple[str, DataFrame]], key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Inner one-to-one chain on ``key`` and the contract rows that must be empty.

    Violations are key repeats on any side and records whose group differs between sides.
    """
    problems = None
    joined = None
    for name, frame in frames:
        bad = key_violations(frame, [key]).select(F.lit(f"repeated_key_{name}").alias("problem"), F.col(key).cast("string").alias("key"))
        problems = bad if problems is None else problems.unionByName(bad)
        if joined is None:
            joined = frame
        else:
            side = frame.withColumnRenamed(group, f"_{name}")
            joined = joined.join(side, key)
            clash = joined.where(F.col(group) != F.col(f"_{name}")).select(F.lit(f"group_differs_{name}").alias("problem"), F.col(key).cast("string").alias("key"))
            problems = problems.unionByName(clash)
            joined = joined.drop(f"_{name}")
    return joined, problems


def enrich(left: DataFrame, right: DataFrame, key: str, fill: Sequence[str], suffix: str = "_registry") -> DataFrame:
    """Left join; shared columns get a suffix and fill gaps on the left."""
    other = right.withColumnsRenamed({c: c + suffix for c in fill})
    return left.join(other, key, "left").withColumns({c: F.coalesce(c, c + suffix) for c in fill})


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Full outer alignment of two vectors; what one side lacks counts as 0."""
    return left.join(right, list(keys), "full_outer").withColumns({a: F.coalesce(a, F.lit(0.0)), b: F.coalesce(b, F.lit(0.0))})


def unordered_pairs(df: DataFrame, keys: Sequence[str], member: str, value: str) -> DataFrame:
    """Pairs ``left < right`` of ``member`` per key; for members bounded by configuration (repeats,
    partitions, models). One aggregation gathers a key's members and the pairs come from its array."""
    gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.col(value).alias("v")))).alias("_s"))
    opened = gathered.select(*keys, "_s", F.posexplode("_s").alias("_i", "_l"))
    paired = opened.select(*keys, "_l", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("_r"))
    return paired.select(*keys, F.col("_l.m").alias("left"), F.col("_r.m").alias("right"), F.col("_l.v").alias("left_value"), F.col("_r.v").alias("right_value"))


def leave_one_out_mean(df: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Mean over the other units, for every omitted unit: total minus the unit's own share."""
    own = df.groupBy(*keys, unit).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).alias("_n"))
    total = own.groupBy(*keys).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    joined = own.join(total, list(keys)) if keys else own.withColumns({"_ts": total.select("_ts").scalar(), "_tn": total.select("_tn").scalar()})
    rest = F.col("_tn") - F.col("_n")
    return joined.select(*keys, F.col(unit).alias("omitted"), rest.alias("remaining"), F.try_divide(F.col("_ts") - F.col("_s"), rest).alias("remaining_mean"))


def split_leaks(registry: DataFrame, units: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Units on both sides of a fold, at every level in ``units``; one row per level with its count."""
    levels = F.array(*[F.struct(F.lit(u).alias("level"), F.col(u).cast("string").alias("unit")) for u in units])
    long = registry.select(*keys, "partition", F.explode(levels).alias("e")).select(*keys, "partition", "e.*")
    sides = long.groupBy(*keys, "level", "unit").agg(
        F.max((F.col("partition") == "train").cast("int")).alias("_t"), F.max((F.col("partition") == "validation").cast("int")).alias("_v"))
    return sides.groupBy("level").agg(F.count_if((F.col("_t") == 1) & (F.col("_v") == 1)).alias("leaks"), F.count("*").alias("checked"))


def agreed_features(requested: DataFrame, reproduced: DataFrame, primary: DataFrame, name: Column) -> DataFrame:
    """Requested features found in both other lists under their normalised names, order kept."""
    normal = lambda d: d.select(name.alias("_f")).distinct()
    return requested.withColumn("_f", name).join(normal(reproduced), "_f", "left_semi").join(normal(primary), "_f", "left_semi").select(
        F.col("_f").alias("feature"), "position")
