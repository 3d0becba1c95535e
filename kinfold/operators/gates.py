"""Threshold gates: a specification of (metric, comparison, threshold) rows against measured values."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Spec = tuple[str, str, float]


def _holds(value: Column, op: str, limit: float) -> Column:
    compared = {">=": value >= limit, "<=": value <= limit, ">": value > limit, "<": value < limit}[op]
    return F.coalesce(compared, F.lit(False))


def evaluate(metrics: DataFrame, spec: Sequence[Spec], keys: Sequence[str] = ()) -> DataFrame:
    """One row per check from one wide row of metrics per key: value, threshold, passed. NULL fails."""
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(op).alias("comparison"), F.lit(float(t)).alias("threshold"),
                     F.col(m).cast("double").alias("value"), _holds(F.col(m), op, t).alias("passed")) for m, op, t in spec]
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("e")).select(*keys, "e.*")


def verdict(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All checks of a key, and the failed ones by name (a gate has a handful of checks)."""
    return checks.groupBy(*keys).agg(
        F.bool_and("passed").alias("passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric")))), "; ").alias("failed"))


def readiness(metrics: DataFrame, exploratory: Sequence[Spec], robust: Sequence[Spec], keys: Sequence[str] = (),
              verified: Column | None = None) -> DataFrame:
    """not_ready / exploratory / robust: the highest level whose whole specification holds."""
    every = lambda spec: reduce(lambda a, b: a & b, [_holds(F.col(m), op, t) for m, op, t in spec])
    confirmed = F.lit(True) if verified is None else verified
    strong = every(robust) & confirmed
    level = F.when(strong, "robust").when(every(exploratory), "exploratory").otherwise("not_ready")
    return metrics.select(*keys, every(exploratory).alias("exploratory_ready"), every(robust).alias("statistically_robust"), level.alias("level"))


def quality_panel(missing: DataFrame, recovery: DataFrame, max_missing: float, max_gap: float, min_r: float) -> DataFrame:
    """Features passing missingness, label gap and masked recovery (mean over repeats)."""
    mean = recovery.groupBy("feature").agg(F.avg("pearson_r").alias("pearson_r"))
    both = missing.join(mean, "feature", "left")
    flags = {"passes_missingness": _holds(F.col("missing_fraction"), "<=", max_missing), "passes_label_gap": _holds(F.col("label_gap"), "<=", max_gap),
             "passes_recovery": _holds(F.col("pearson_r"), ">=", min_r)}
    return both.select("feature", "missing_fraction", "label_gap", "pearson_r", *[c.alias(n) for n, c in flags.items()],
                       reduce(lambda a, b: a & b, flags.values()).alias("retained"))


def placement(decision: DataFrame, passed: str, rank_passed: str) -> DataFrame:
    """Where a result may be shown, from the gate's flags."""
    where = F.when(F.col(passed), "main_text").when(F.col(rank_passed), "supplement").otherwise("diagnostic_only")
    return decision.withColumn("placement", where)


def revision_table(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Current against previous run, or a row saying that none was provided."""
    now = current.withColumn("revision", F.lit("current"))
    if previous is not None:
        return now.unionByName(previous.withColumn("revision", F.lit("previous")))
    gone = now.limit(1).select(*[F.lit(None).cast(now.schema[c].dataType).alias(c) for c in current.columns], F.lit("previous_not_provided").alias("revision"))
    return now.unionByName(gone)
