"""Association of two tasks at group level."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from kinfold.operators import metrics as M, resample as B, statistics as T, vectors as V, weights as W
from kinfold.operators.ordered import exact_quantiles, hot_keys, medians
from kinfold.session import cut


def feature_concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two per-feature summaries ``(feature, importance, rho)`` side by side (rows are features).

    Only within-task shares, ranks and signs are compared, never raw magnitudes.
    """
    def side(df, p):
        total = df.agg(F.sum("importance")).scalar()
        share = F.when(total > 0, F.col("importance") / total)
        return df.select("feature", F.col("rho").alias(f"{p}_rho"), share.alias(f"{p}_share"), (F.signum("rho") * share).alias(f"{p}_signed"))
    both = side(a, "a").join(side(b, "b"), "feature").withColumn("_all", F.lit(1))
    ranked = W.min_ranks(W.min_ranks(both, ["_all"], "a_share", "a_rank"), ["_all"], "b_share", "b_rank").drop("_all")
    return ranked.withColumn("direction_agreement", (F.signum("a_rho") == F.signum("b_rho")).cast("int"))


def concordance_summary(table: DataFrame, n: int) -> DataFrame:
    keyed = table.withColumn("pair", F.lit("a|b"))
    test = B.exact_cosine_permutation(keyed, ["pair"], "feature", "a_signed", "b_signed", n)
    counts = keyed.groupBy("pair").agg(F.count("*").alias("shared_features"), F.sum("direction_agreement").cast("bigint").alias("agreements"))
    return test.join(counts, "pair")


def binned_dependence(df: DataFrame, bins: int, block: str, replicates: int, seed: int) -> DataFrame:
    """Per (feature, task, value bin): medians and block-bootstrap interval of the robust z-scored attribution.

    ``df``: (feature, task, group_id, block, value, shap) at group level. Bins come from the values of a
    feature, each group's once, and are the same for both tasks: ``bins`` of them, or as many as there are different
    values. Features of under four different values are left out.
    """
    df = cut(df)
    values = cut(df.where("value is not null").select("feature", "group_id", "value").distinct())
    spread = values.groupBy("feature").agg(F.least(F.countDistinct("value"), F.lit(bins)).alias("_q")).where("_q >= least(4, {})".format(bins))
    sized = cut(values.join(spread, "feature"))
    parts = [T.quantile_bins(sized.where(F.col("_q") == q).drop("_q"), ["feature"], "value", q) for q in range(min(4, bins), bins + 1)]
    bin_of = reduce(DataFrame.unionByName, [p.select("feature", "group_id", "value", "bin") for p in parts])
    binned = df.join(bin_of, ["feature", "group_id", "value"])
    z = cut(T.robust_z(binned.where("shap is not null"), ["feature", "task"], "shap", "z"))
    keys = ["feature", "task", "bin"]
    shown = medians(z, keys, {"x_median": "value", "y_median": "z"}, also=[
        F.countDistinct("group_id").alias("n_groups"), F.countDistinct(block).alias("n_blocks")])
    ci = B.bin_median_interval(z, ["feature", "task"], "bin", block, "z", replicates, seed)
    return shown.join(ci.select(*keys, "ci_low", "ci_high"), keys, "left")


def associations(groups: DataFrame, comparisons: Mapping[str, tuple[str, str]], block: str, replicates: int, permutations: int, seed: int) -> DataFrame:
    """Component-level Spearman inference for each declared pair, with FDR over the pairs (a handful)."""
    groups = cut(groups)
    rows = [B.component_inference(groups, block, x, y, replicates, permutations, seed + i * 1000).withColumn("analysis", F.lit(n))
            for i, (n, (x, y)) in enumerate(comparisons.items())]
    return M.benjamini_hochberg(cut(reduce(DataFrame.unionByName, rows)), [], "permutation_p")  # read twice there


def support_quantiles(groups: DataFrame, score: str, outcome: str, bins: int, block: str, replicates: int, seed: int) -> DataFrame:
    """Outcome median with interval per quantile group of a score."""
    rows = cut(T.quantile_bins(groups.dropna(subset=[score, outcome]), [], score, bins))
    shown = medians(rows, ["bin"], {"outcome_median": outcome}, also=[
        F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.count("*").alias("n_groups"), F.countDistinct(block).alias("n_blocks")])
    ci = B.bin_median_interval(rows, [], "bin", block, outcome, replicates, seed)
    return shown.join(ci.select("bin", "ci_low", "ci_high"), "bin")


def joint_state(groups: DataFrame, u: str, s: str, values: DataFrame) -> DataFrame:
    """Four-quadrant state by the two medians, and the median robust z of each feature in it.

    ``values``: (group_id, feature, value). Medians are descriptive cuts, not thresholds of the domain. All four states have a row per
    feature, also one without groups (count 0, null median); groups and blocks are those of the state, with or without the feature.
    """
    kept = cut(groups.dropna(subset=[u, s]))
    cuts = exact_quantiles(kept, [], {"u": (u, 0.5), "s": (s, 0.5)})
    u_cut, s_cut = cuts.select("u").scalar(), cuts.select("s").scalar()
    state = F.concat(F.when(F.col(s) >= s_cut, "high S").otherwise("low S"), F.lit(" / "), F.when(F.col(u) >= u_cut, "high U").otherwise("low U"))
    placed = kept.select("group_id", "block", state.alias("joint_state"))
    z = T.robust_z(values.join(kept.select("group_id"), "group_id", "left_semi"), ["feature"], "value", "z")
    middle = medians(z.join(placed, "group_id"), ["joint_state", "feature"], {"median_z": "z"})
    size = placed.groupBy("joint_state").agg(F.countDistinct("group_id").alias("n_groups"), F.countDistinct("block").alias("n_blocks"))
    states = F.array(*[F.lit(f"{a} S / {b} U") for b in ("low", "high") for a in ("low", "high")])
    grid = values.select("feature").distinct().withColumn("joint_state", F.explode(states))
    zero = F.lit(0).cast("long")
    return grid.join(size, "joint_state", "left").join(middle, ["joint_state", "feature"], "left").select(
        "joint_state", "feature", "median_z", F.coalesce("n_groups", zero).alias("n_groups"), F.coalesce("n_blocks", zero).alias("n_blocks"),
        F.lit(u_cut).cast("double").alias("u_cut"), F.lit(s_cut).cast("double").alias("s_cut"))


def coupling_cosine(values: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Cosine of two signed-share vectors per group."""
    shares = V.signed_share(V.signed_share(values, [key], left, "_l"), [key], right, "_r")
    return V.cosine(shares, [key], "_l", "_r")
