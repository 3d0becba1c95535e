"""Summaries of per-record attributions: importance, stability over partitions, influence of blocks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.functions.scalars import passed_names, same_sign
from kinfold.operators import joins as J, metrics as M, resample as B, weights as W
from kinfold.operators.deletion import spearman_without
from kinfold.operators.ordered import FEW, exact_quantiles, medians
from kinfold.operators.selection import top_n
from kinfold.session import cut


def group_by_repeat(df: DataFrame) -> DataFrame:
    """Record attributions to one row per (feature, repeat, group)."""
    return medians(df, ["feature", "repeat", "group_id"], {"shap": "shap", "completed": "completed"}, also=[
        F.min("block").alias("block"), F.avg("imputed").alias("imputed")], bound=["group_id"])


def global_importance(df: DataFrame, replicates: int, seed: int, top: int = 10) -> DataFrame:
    """Importance and stability per feature; ``top`` is the rank up to which a repeat counts as one at the top.

    Records are reduced to (feature, repeat, group) once and written; everything after works on that.
    """
    per_repeat = cut(group_by_repeat(df))
    imp = per_repeat.groupBy("feature", "repeat").agg(F.avg(F.abs("shap")).alias("imp"))
    ranks = W.importance_ranks(imp, ["repeat"], "feature", "imp")
    rank_stats = ranks.groupBy("feature").agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("rank_sd"),
                                              F.count_if(F.col("rank") <= top).alias("top_repeat_count"))
    rho = M.spearman(per_repeat, ["feature", "repeat"], "completed", "shap")
    sign = F.coalesce(F.signum("rho"), F.lit(0.0))
    # sign 0 counts as a sign of its own
    agreement = rho.groupBy("feature").agg(
        (F.greatest(F.count_if(sign == 1), F.count_if(sign == -1), F.count_if(sign == 0)) / F.count("*")).alias("direction_agreement"))
    # rows per key are repeats, a configured few
    overall = cut(medians(per_repeat, ["feature", "group_id"], {"shap": "shap", "completed": "completed"}, hot=FEW, also=[
        F.min("block").alias("block"), F.avg("imputed").alias("imputed")]))
    size = B.mean_abs_interval(overall, ["feature"], "group_id", "shap", replicates, seed).select(
        "feature", F.col("estimate").alias("mean_abs"), F.col("ci_low").alias("mean_abs_low"), F.col("ci_high").alias("mean_abs_high"))
    way = B.spearman_interval(overall, ["feature"], "group_id", "completed", "shap", replicates, seed).select(
        "feature", F.col("estimate").alias("direction"), F.col("ci_low").alias("direction_low"), F.col("ci_high").alias("direction_high"))
    gaps = overall.groupBy("feature").agg(F.avg("imputed").alias("imputed_fraction"))
    out = size
    for part in (rank_stats, agreement, way, gaps):
        out = out.join(part, "feature")
    total = size.agg(F.sum("mean_abs")).scalar()
    out = out.withColumns({
        "normalized_importance": F.col("mean_abs") / total,
        "ci_excludes_zero": F.coalesce((F.col("direction_low") > 0) | (F.col("direction_high") < 0), F.lit(False))})
    return W.importance_ranks(out.withColumn("_all", F.lit(1)), ["_all"], "feature", "mean_abs", "new_rank").drop("_all")


def partition_importance(df: DataFrame) -> DataFrame:
    """Mean absolute attribution per (class, partition, feature), absent features as 0 (features x partitions rows)."""
    imp = cut(df.groupBy("class", "repeat", "fold", "feature").agg(F.avg(F.abs("shap")).alias("imp")))
    imp = imp.withColumn("partition", F.concat_ws(":", "repeat", "fold"))
    every = imp.select("class", "partition").distinct().join(imp.select("class", "feature").distinct(), "class")
    return every.join(imp.select("class", "partition", "feature", "imp"), ["class", "partition", "feature"], "left").withColumn("imp", F.coalesce("imp", F.lit(0.0)))


def rank_stability(df: DataFrame, top: int) -> DataFrame:
    """Over all partition pairs of a class: Spearman of importances and Jaccard of the top sets."""
    imp = cut(W.importance_ranks(partition_importance(df), ["class", "partition"], "feature", "imp"))
    packed = imp.withColumn("v", F.struct("imp", "rank"))
    pairs = J.unordered_pairs(packed, ["class", "feature"], "partition", "v").select(
        "class", "left", "right", "feature", F.col("left_value.imp").alias("a"), F.col("right_value.imp").alias("b"),
        F.col("left_value.rank").alias("ra"), F.col("right_value.rank").alias("rb"))
    rho = M.spearman_small(pairs, ["class", "left", "right"], "a", "b")
    both = F.count_if((F.col("ra") <= top) & (F.col("rb") <= top))
    either = F.count_if((F.col("ra") <= top) | (F.col("rb") <= top))
    sets = pairs.groupBy("class", "left", "right").agg((both / either).alias("jaccard"), (both / F.lit(float(top))).alias("overlap"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rho.join(sets, ["class", "left", "right"]).groupBy("class").agg(
        F.count("*").alias("comparisons"), q("rho", 0.5).alias("median_rho"), q("rho", 0.025).alias("rho_q025"), q("rho", 0.975).alias("rho_q975"),
        F.avg("jaccard").alias("mean_jaccard"), F.min("jaccard").alias("min_jaccard"), F.min("overlap").alias("min_overlap"))


def block_influence(df: DataFrame, primary: Sequence[str], top: int) -> DataFrame:
    """Deleting one block: change of ranks, top set and primary directions, without refitting.

    Importances after deletion are totals minus the block's share, directions come from :mod:`deletion`, which ranks once.
    """
    groups = cut(medians(df, ["class", "feature", "group_id", "block"], {"completed": "completed"}, also=[
        F.avg(F.abs("shap")).alias("mean_abs"), F.avg("shap").alias("shap")], bound=["group_id"]))
    base = groups.groupBy("class", "feature").agg(F.avg("mean_abs").alias("base"))
    left = J.leave_one_out_mean(groups, ["class", "feature"], "block", "mean_abs")
    both = cut(W.importance_ranks(W.importance_ranks(
        left.join(base, ["class", "feature"]), ["class", "omitted"], "feature", "base", "r0"), ["class", "omitted"], "feature", "remaining_mean", "r1"))
    rho = M.spearman_small(both, ["class", "omitted"], "base", "remaining_mean", "rank_rho").drop("n")
    inside = both.groupBy("class", "omitted").agg((
        F.count_if((F.col("r0") <= top) & (F.col("r1") <= top)) / F.count_if((F.col("r0") <= top) | (F.col("r1") <= top))).alias("jaccard"),
        F.max("remaining").alias("remaining_groups"))
    chosen = groups.where(F.col("feature").isin(*primary))
    whole = M.spearman(chosen, ["class", "feature"], "completed", "shap", "rho_full").drop("n")
    less = spearman_without(chosen, ["class", "feature"], "block", ["group_id"], "completed", "shap", "rho_less").withColumnRenamed("block", "omitted")
    # a block without rows of a feature leaves its direction as it is
    kept = chosen.where("block is not null")
    blocks = groups.where("block is not null").select("class", F.col("block").alias("omitted")).distinct()
    absent = blocks.join(kept.select("class", "feature").distinct(), "class").join(
        kept.where("completed is not null and shap is not null").select("class", "feature", F.col("block").alias("omitted")).distinct(), ["class", "feature", "omitted"], "left_anti")
    unchanged = absent.join(M.spearman(kept, ["class", "feature"], "completed", "shap", "rho_less").drop("n"), ["class", "feature"])
    each = less.unionByName(unchanged.select(*less.columns)).join(whole, ["class", "feature"])
    flip = (F.signum("rho_full") * F.signum("rho_less")) < 0
    change = each.groupBy("class", "omitted").agg(
        F.max(F.abs(F.col("rho_less") - F.col("rho_full"))).alias("max_direction_change"), F.count_if(flip).alias("sign_flips"))
    return rho.join(inside, ["class", "omitted"]).join(change, ["class", "omitted"], "left")


def stability_checks(rule: dict) -> dict[str, Column]:
    """Named predicates over an importance table; ``rule`` holds the thresholds."""
    c = F.col
    return {
        "rank_range": c("new_rank") <= rule["max_rank"], "rank_sd": c("rank_sd") <= rule["max_rank_sd"],
        "direction_agreement": c("direction_agreement") >= rule["min_agreement"], "direction_ci": c("ci_excludes_zero"),
        "missing_fraction": c("imputed_fraction") <= rule["max_missing"], "label_gap": c("label_gap") <= rule["max_gap"],
        "quality_panel": c("in_quality_panel")}


def reproducibility(importance: DataFrame, locked: DataFrame, rule: dict) -> DataFrame:
    """Locked features against the importance table: status and failed checks; absent ones are named."""
    checks = stability_checks(rule)
    failed = passed_names(checks, ";")
    found = locked.join(importance, "feature", "left")
    reason = F.when(F.col("new_rank").isNull(), "feature_not_in_retained_panel").when(failed == "", "all_checks_passed").otherwise(failed)
    return found.select("feature", "new_rank", F.when(reason == "all_checks_passed", "reproduced").otherwise("not_reproduced").alias("status"), reason.alias("reason"))


def availability(df: DataFrame, keys: Sequence[str], value: str, shap: str) -> DataFrame:
    both = F.col(value).isNotNull() & F.col(shap).isNotNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n_valid"), F.count_if(both).alias("n_available"), F.avg(both.cast("double")).alias("availability"))
