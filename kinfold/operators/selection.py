"""Rule-based choices: tolerance then tie-break order. Inputs are metric tables, one row per candidate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def within_tolerance(df: DataFrame, keys: Sequence[str], metric: str, tolerance: float) -> DataFrame:
    """Candidates whose metric is within ``tolerance`` of the key's best."""
    best = df.groupBy(*keys).agg(F.max(metric).alias("_best")) if keys else None
    if keys:
        joined = df.join(best, list(keys))
    else:
        joined = df.withColumn("_best", df.agg(F.max(metric)).scalar())
    return joined.where(F.col(metric) >= F.col("_best") - F.lit(tolerance)).drop("_best")


def best_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in a full tie order; a bounded number of candidates per key."""
    if not keys:
        return df.orderBy(*order).limit(1)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def select_binary(metrics: DataFrame, keys: Sequence[str] = (), tolerance: float = 0.005) -> DataFrame:
    """AUC within tolerance, then AP, AUC spread, F1, name."""
    near = within_tolerance(metrics, keys, "roc_auc", tolerance)
    return best_row(near, keys, F.col("average_precision").desc(), F.col("roc_auc_sd").asc(), F.col("f1").desc(), F.col("model"))


MULTICLASS_ORDER = ("balanced_accuracy", "min_recall", "ovr_auc")


def rank_multiclass(metrics: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Full ranking: candidates within tolerance of the best macro-F1 first, then the tie-break metrics."""
    best = metrics.agg(F.max("macro_f1")).scalar()
    near = F.col("macro_f1") >= best - F.lit(tolerance)
    order = [F.col("near_best").desc(), *[F.coalesce(F.col(c), F.lit(0.0)).desc() for c in MULTICLASS_ORDER], F.col("fold_sd"),
             F.col("macro_f1").desc(), F.col("model")]
    # one row per model family
    return metrics.withColumn("near_best", near).withColumn(
        "selection_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def choose_threshold(grid: DataFrame, keys: Sequence[str], min_recall: float = 0.55, min_specificity: float = 0.55) -> DataFrame:
    """Best grid threshold per key: constrained when possible, else over all with a status."""
    ok = (F.col("recall") >= min_recall) & (F.col("specificity") >= min_specificity)
    any_ok = grid.groupBy(*keys).agg(F.bool_or(ok).alias("_any"))
    pool = grid.withColumn("_ok", ok).join(any_ok, list(keys)).where(F.col("_ok") | ~F.col("_any"))
    chosen = best_row(pool, keys, F.col("f1").desc(), F.col("balanced_accuracy").desc(),
                      F.round(F.abs(F.col("threshold") - 0.5), 9), F.col("threshold"))
    return chosen.withColumn("threshold_status", F.when(F.col("_any"), "constraints_met").otherwise("constraint_not_met")).drop("_ok", "_any")


def choose_trial(trials: DataFrame, keys: Sequence[str], tolerance: float = 0.005, iterative: Sequence[str] = ("mlp",),
                 family: str = "model") -> DataFrame:
    """Completed trials; AUC within tolerance; AP, fold sd, complexity, number.

    Of ``iterative`` families the converged trials only, where there are any; other families have no such rule.
    """
    done = trials.where("state = 'COMPLETE'")
    settled = F.col("converged") | ~F.col(family).isin(*iterative)
    conv = done.groupBy(*keys).agg(F.bool_or(settled).alias("_any"))
    pool = done.join(conv, list(keys)).where(settled | ~F.col("_any")).drop("_any")
    near = within_tolerance(pool, keys, "roc_auc", tolerance)
    return best_row(near, keys, F.col("average_precision").desc(), F.col("fold_sd"), F.col("complexity"), F.col("trial_number"))


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """First ``n`` rows per key with their rank; Spark limits each key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
