"""Statistics on values: robust scaling, bins, densities, correlation structure, calibration lines."""

from __future__ import annotations

import math
from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from kinfold.operators import graph
from kinfold.operators.metrics import ece, reliability, spearman
from kinfold.operators.ordered import attach, exact_quantiles, hot_keys, medians, ordered_totals
from kinfold.session import cut


def robust_z(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD), with the sample sd where the MAD is 0 and NULL where both are.

    The rows are written once: the median, the deviations and the result all read them.
    """
    keys = list(keys)
    df = cut(df)
    hot = hot_keys(df, keys)
    center = medians(df, keys, {"_mid": value}, hot, also=[F.stddev_samp(value).alias("_sd")])
    away = attach(df, center, keys).withColumn("_d", F.abs(F.col(value) - F.col("_mid")))
    spread = medians(away, keys, {"_mad": "_d"}, hot)
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * 1.4826).when(F.col("_sd") > 0, F.col("_sd"))
    return attach(away, spread, keys).select(*df.columns, ((F.col(value) - F.col("_mid")) / scale).alias(out))


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """One-based quantile bin: interpolated edges, right-closed, repeated edges merged."""
    names = [f"_q{i}" for i in range(bins + 1)]
    edges = exact_quantiles(df, keys, {n: (value, i / bins) for i, n in enumerate(names)})
    packed = edges.select(*keys, F.array_distinct(F.array(*names)).alias("_edges"))
    placed = attach(df, packed, keys)
    code = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(1))
    return placed.select(*df.columns, code.alias(out))


def percentile_of_score(probe: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean-kind percentile of each probe value among the reference values of its key.

    Both sides share one running total, so no pair of values is ever formed.
    """
    keys = list(keys)
    both = reference.select(*keys, value, F.lit(1).alias("_r")).union(probe.select(*keys, value, F.lit(0)))
    level = ordered_totals(both, keys, value, {"r": F.col("_r")})
    at = level.select(*keys, value, F.try_divide((2 * F.col("r_before") + F.col("r")) * F.lit(50.0), F.col("r_all").cast("double")).alias("percentile"))
    return probe.join(at, [*keys, value])


def relative_location(probe: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """Where each probe value lies between the medians of the reference's two classes: 0 at that of class 0, 1 at that of class 1.

    NULL where a class is absent from the key or both medians are equal.
    """
    keys = list(keys)
    middle = exact_quantiles(reference, [*keys, label], {"_m": (value, 0.5)})
    both = middle.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == c, F.col("_m"))).alias(f"_m{c}") for c in (0, 1)])
    gap = F.col("_m1") - F.col("_m0")
    return probe.join(both, keys, "left").withColumn("relative_location", F.when(gap != 0, (F.col(value) - F.col("_m0")) / gap)).drop("_m0", "_m1")


def density(df: DataFrame, keys: Sequence[str], value: str, points: int) -> DataFrame:
    """Gaussian kernel density on an even grid with Scott's bandwidth.

    Each row adds to ``points`` running sums; rows are not multiplied by the grid.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"),
                                 (F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("_h"))
    at = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / F.lit(float(points - 1))
    rows = attach(df.where(F.col(value).isNotNull()), span, keys)
    sums = rows.groupBy(*keys, "_lo", "_hi", "_n", "_h").agg(*[
        F.sum(F.exp(F.lit(-0.5) * F.pow((at(F.lit(i)) - F.col(value)) / F.col("_h"), F.lit(2.0)))).alias(f"_s{i}") for i in range(points)])
    opened = sums.select("*", F.posexplode(F.array(*[F.col(f"_s{i}") for i in range(points)])).alias("point", "_s"))
    return opened.select(*keys, "point", at(F.col("point")).alias("x"),
                         (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def correlation_difference(df: DataFrame, features: Sequence[str], left_prefix: str, right_prefix: str, min_pairs: int) -> DataFrame:
    """Pearson of every feature pair in two versions of the values and their difference; one aggregation."""
    entries = []
    for a, b in combinations(sorted(features), 2):
        n = F.count_if(F.col(left_prefix + a).isNotNull() & F.col(left_prefix + b).isNotNull())
        entries.append(F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), n.alias("n_observed"),
                                F.when(n >= min_pairs, F.corr(left_prefix + a, left_prefix + b)).alias("observed_r"),
                                F.corr(right_prefix + a, right_prefix + b).alias("completed_r")))
    rows = df.agg(F.array(*entries).alias("_a")).select(F.explode("_a").alias("e")).select("e.*")
    return rows.withColumn("difference", F.col("completed_r") - F.col("observed_r"))


def spearman_pairs(df: DataFrame, features: Sequence[str], min_pairs: int) -> DataFrame:
    """Pairwise-complete absolute Spearman of every feature pair."""
    pairs = [F.struct(F.lit(a).alias("l"), F.lit(b).alias("r"), F.col(a).alias("x"), F.col(b).alias("y"))
             for a, b in combinations(sorted(features), 2)]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    rho = spearman(long, ["l", "r"], "x", "y", "rho", min_rows=min_pairs)
    return rho.select("l", "r", F.coalesce(F.abs("rho"), F.lit(0.0)).alias("rho"))


def correlation_clusters(df: DataFrame, features: Sequence[str], threshold: float, min_pairs: int) -> DataFrame:
    """Feature clusters (components of the graph of pairs at the threshold) and neighbours by strength."""
    pairs = cut(spearman_pairs(df, features, min_pairs))  # one row per pair of features, read by the graph and the result
    both = pairs.union(pairs.select("r", "l", "rho")).toDF("feature", "other", "rho")
    strong = both.select("feature", F.when(F.col("rho") >= threshold, F.col("other")).otherwise(F.col("feature")).alias("other"))
    label = graph.components(strong, "feature", "other").select(F.col("node").alias("feature"), F.col("component").alias("cluster"))
    near = both.groupBy("feature").agg(
        F.max("rho").alias("max_abs_rho"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rho") >= threshold, F.struct((-F.col("rho")).alias("s"), F.col("other").alias("o"))))),
                                 lambda s: s["o"]), ";").alias("neighbours"))
    return label.join(near, "feature")


def calibration_diagnostics(df: DataFrame, unit: str, target: str, p: str, bins: int) -> DataFrame:
    """Per class: OVR Brier, OVR ECE and the slope and intercept of a logistic line on the logit.

    The line is fitted by Newton steps; each step is one aggregation of five sums per class, so all
    classes are fitted together and no rows leave the cluster.
    """
    clip = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = cut(df.select(unit, target, p, F.ln(clip / (1 - clip)).alias("_x")))  # read once per Newton step
    brier = rows.groupBy(unit).agg(F.avg(F.pow(F.col(p) - F.col(target), F.lit(2.0))).alias("brier"), F.count("*").alias("n"),
                                   F.sum(target).cast("bigint").alias("positives"))
    bins_table = reliability(rows, [unit], target, p, bins, "right")
    lines = logistic_line(rows, unit, target, "_x")
    return brier.join(ece(bins_table, [unit]), unit).join(lines, unit)


def logistic_line(rows: DataFrame, unit: str, target: str, x: str, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """``(unit, slope, intercept)`` of a two-parameter logistic fit per unit; NULL without both outcomes.

    Units are classes (a configured few), so the parameters between steps are a handful of numbers.
    """
    spark = rows.sparkSession
    both = rows.groupBy(unit).agg(F.min(target).alias("a"), F.max(target).alias("b"))
    params = {r[unit]: [0.0, 0.0] if r["a"] != r["b"] else None for r in both.collect()}
    for _ in range(steps):
        state = spark.createDataFrame([(u, *v) for u, v in params.items() if v is not None], f"{unit} int, _s double, _i double") \
            if any(v is not None for v in params.values()) else None
        if state is None:
            break
        eta = F.col("_s") * F.col(x) + F.col("_i")
        mu = 1 / (1 + F.exp(-eta))
        w = mu * (1 - mu)
        sums = rows.join(state, unit).groupBy(unit).agg(
            F.sum((F.col(target) - mu) * F.col(x)).alias("gs"), F.sum(F.col(target) - mu).alias("gi"),
            F.sum(w * F.col(x) * F.col(x)).alias("hss"), F.sum(w * F.col(x)).alias("hsi"), F.sum(w).alias("hii")).collect()
        moved = 0.0
        for r in sums:
            det = r["hss"] * r["hii"] - r["hsi"] ** 2
            if det <= 0:
                continue
            ds = (r["gs"] * r["hii"] - r["gi"] * r["hsi"]) / det
            di = (r["gi"] * r["hss"] - r["gs"] * r["hsi"]) / det
            size = max(abs(ds), abs(di))
            shrink = min(1.0, 5.0 / size) if size else 1.0
            params[r[unit]] = [params[r[unit]][0] + ds * shrink, params[r[unit]][1] + di * shrink]
            moved = max(moved, size)
        if moved < tolerance:
            break
    return spark.createDataFrame(
        [(u, *(v or (None, None))) for u, v in params.items()], f"{unit} int, slope double, intercept double")
