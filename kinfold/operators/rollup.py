"""Aggregation across evaluation levels: record, group, stratum, repeat, block."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.operators.ordered import FEW, exact_quantiles, hot_keys, medians
from kinfold.functions.scalars import first_max
from kinfold.session import cut


def group_registry(df: DataFrame, group: str, label: str, block: str) -> DataFrame:
    """One row per group: label, block, their distinct counts (1 when constant) and size.

    ``min`` / ``max`` decide constancy, so no distinct sets are kept.
    """
    same = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))
    return df.groupBy(group).agg(
        F.min(label).alias(label), F.min(block).alias(block), F.count("*").alias("n_records"),
        same(label).alias("label_constant"), same(block).alias("block_constant"))


def group_scores(df: DataFrame, keys: Sequence[str], group: str, target: str, block: str, score: str) -> DataFrame:
    """Record scores to one group score: median (primary), mean (sensitivity), record count."""
    ids = [*keys, group]
    return medians(df, ids, {score: score}, also=[
        F.min(target).alias(target), F.min(block).alias(block), F.avg(score).alias("mean_score"), F.count("*").alias("n_records")], bound=[group])


def class_strata(df: DataFrame, keys: Sequence[str], group: str, true: str, block: str, scores: Sequence[str]) -> DataFrame:
    """Record class scores to group x class strata: per-class medians and the first-max class."""
    ids = [*keys, group, true]
    return medians(df, ids, {s: s for s in scores}, also=[
        F.min(block).alias(block), F.count("*").alias("n_records")], bound=[group]).withColumns({
        "predicted": first_max(scores), "stratum_id": F.concat_ws("|", group, true)})


def consensus(group_scores: DataFrame, keys: Sequence[str], group: str, repeats: int, threshold: float = 0.5,
              prediction: str | None = None) -> DataFrame:
    """Group scores over repeats; the rows per key are the repeats, a configured few.

    Votes are the stored ``prediction`` of each repeat, made with its fold's own threshold, where that column is
    named; else the score at ``threshold``.
    """
    ids = [*keys, group]
    vote = (F.col(prediction) if prediction else F.col("score") >= threshold).cast("double")
    out = group_scores.groupBy(*ids).agg(
        F.min("target").alias("target"), F.min("block").alias("block"), F.percentile("score", F.lit(0.5)).alias("score"),
        F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("score_sd"), F.avg(vote).alias("vote_fraction"),
        F.countDistinct("repeat").alias("repeats"))
    return out.withColumns({"complete": F.col("repeats") == repeats, "prediction": (F.col("vote_fraction") >= 0.5).cast("int")})


def mean_over_repeats(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(s).alias(s) for s in scores], F.countDistinct("repeat").alias("repeats"))


def ensemble_records(df: DataFrame, ids: Sequence[str], score: str, overlap: str) -> DataFrame:
    """One row per record over the outer models (a configured few): location, spread, overlap share."""
    q = lambda p: F.percentile(score, F.lit(p))
    return df.groupBy(*ids).agg(
        q(0.5).alias("score_median"), F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_sd"),
        q(0.25).alias("score_q25"), q(0.75).alias("score_q75"), F.avg(F.col(overlap).cast("double")).alias("overlap_fraction"),
        F.count("*").alias("n_models")).withColumn("score_iqr", F.col("score_q75") - F.col("score_q25"))


def ensemble_groups(records: DataFrame, group: str) -> DataFrame:
    """Group level of the ensemble: quartiles of record medians, MAD, median spread."""
    records = cut(records)
    hot = hot_keys(records, [group])
    q = exact_quantiles(records, [group], {
        "ensemble_median": ("score_median", 0.5), "ensemble_q25": ("score_median", 0.25),
        "ensemble_q75": ("score_median", 0.75), "sd_median": ("score_sd", 0.5), "iqr_median": ("score_iqr", 0.5)}, hot,
        also=[F.avg("overlap_fraction").alias("overlap_fraction"), F.count("*").alias("n_records")])
    away = records.join(q.select(group, "ensemble_median"), group).select(
        group, F.abs(F.col("score_median") - F.col("ensemble_median")).alias("_d"))
    mad = medians(away, [group], {"ensemble_mad": "_d"}, hot)
    return q.join(mad, group).withColumn("ensemble_iqr", F.col("ensemble_q75") - F.col("ensemble_q25"))


def attribution_rollup(df: DataFrame, keys: Sequence[str], group: str, by_partition: Sequence[str], reducers: Mapping[str, tuple[str, str]],
                       observed_flag: str | None = None) -> DataFrame:
    """Record -> (partition, group) -> group. ``reducers`` maps a column to its two reducers.

    A reducer is ``median`` or ``mean``.
    """
    ids = [*keys, *by_partition, group]
    first = _reduce(df, ids, {c: a for c, (a, _) in reducers.items()}, None)
    return _reduce(first, [*keys, group], {c: b for c, (_, b) in reducers.items()}, "bounded")


def _reduce(df, ids, how, bounded):
    mids = {c: c for c, h in how.items() if h == "median"}
    means = [F.avg(c).alias(c) for c, h in how.items() if h == "mean"]
    if bounded:
        return medians(df, ids, mids, hot=FEW, also=means)  # rows per key are partitions or repeats
    return medians(df, ids, mids, also=means, bound=ids[-1:])


def record_bridge(df: DataFrame, record: str, features: Sequence[str], feature: str = "feature") -> DataFrame:
    """One row per record: score location and spread over repeats, thresholds, per-feature attribution.

    Two aggregations of the long table: per (record, repeat) once for the score, then one grouped pass
    with a column per locked feature.
    """
    f = F.col(feature)
    per = [agg for name in features for agg in (
        F.avg(F.when(f == name, F.col("shap"))).alias(f"shap_mean_{name}"),
        F.stddev_samp(F.when(f == name, F.col("shap"))).alias(f"shap_sd_{name}"),
        F.avg(F.when(f == name, F.col("imputed").cast("double"))).alias(f"imputed_fraction_{name}"))]
    first = F.col(feature) == features[0]
    return df.where(f.isin(*features)).groupBy(record).agg(
        F.percentile(F.when(first, F.col("score")), F.lit(0.5)).alias("score_median"),
        F.avg(F.when(first, F.col("score"))).alias("score_mean"), F.stddev_samp(F.when(first, F.col("score"))).alias("score_sd"),
        F.min("threshold").alias("threshold_min"), F.max("threshold").alias("threshold_max"),
        F.countDistinct("repeat").alias("repeats"),
        F.array_join(F.array_sort(F.collect_set("parameter_hash")), ";").alias("parameter_hashes"), *per)


def constant(column: str) -> Column:
    """The one value of a column in its group, NULL when it varies."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def coupling_groups(df: DataFrame, group: str, constants: Sequence[str], medians_of: Mapping[str, str], source: str, kind: str) -> DataFrame:
    """One row per group: constant columns with a check, medians, distinct sources, most frequent class.

    The class is the lowest one on ties; it is found from counts, which partial aggregation shrinks first.
    """
    kinds = df.groupBy(group, kind).agg(F.count("*").alias("_n"))
    top = kinds.groupBy(group).agg(F.min_by(kind, F.struct(-F.col("_n"), F.col(kind))).alias(f"{kind}_mode"))
    main = medians(df, [group], medians_of, also=[
        F.count("*").alias("n_records"), *[constant(c).alias(c) for c in constants],
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"{c}_constant") for c in constants]])
    sources = df.select(group, source).distinct().groupBy(group).agg(F.count(source).alias("n_sources"))
    return main.join(sources, group).join(top, group)


def trial_budget(trials: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s)
    return trials.groupBy(*keys).agg(
        count("COMPLETE").alias("complete"), count("PRUNED").alias("pruned"), count("FAIL").alias("failed"),
        F.count("*").alias("total_trials"), F.sum("seconds").alias("total_seconds"),
        ((count("COMPLETE") == budget) & (count("PRUNED") == 0) & (count("FAIL") == 0)).alias("exact_budget"))


def error_audit(df: DataFrame, keys: Sequence[str], true: str, predicted: str, k: int) -> DataFrame:
    """Per key: rows, correct, predicted-as counts, recall."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(true) == F.col(predicted)).alias("correct"),
        *[F.count_if(F.col(predicted) == c).alias(f"as_{c}") for c in range(k)]).withColumn("recall", F.col("correct") / F.col("n"))


def coverage(df: DataFrame, keys: Sequence[str], evaluable: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(evaluable).alias("evaluable"),
                                 F.avg(evaluable.cast("double")).alias("coverage"))


def class_source_summary(df: DataFrame, label: str, group: str, block: str) -> DataFrame:
    """Totals over all rows and per class in one GROUPING SETS aggregation."""
    return df.groupingSets([[label], []], label).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("records"), F.countDistinct(group).alias("n_groups"),
        F.countDistinct(block).alias("n_blocks")).select(
        F.when(F.col("_g") > 0, F.lit("ALL")).otherwise(F.col(label)).alias(label), "records", "n_groups", "n_blocks")


def block_label_audit(df: DataFrame, label: str, group: str, block: str) -> DataFrame:
    """Per block: classes present and how many of its groups are mixed. Groups are reduced first."""
    per_group = df.groupBy(block, group).agg(F.count("*").alias("_n"), F.collect_set(label).alias("_k"))
    return per_group.groupBy(block).agg(
        F.sum("_n").alias("records"), F.count("*").alias("n_groups"), F.count_if(F.size("_k") > 1).alias("mixed_groups"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_k")))), ";").alias("classes"))


def class_support(df: DataFrame, label: str, group: str, block: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("records"), F.countDistinct(group).alias("n_groups"), F.countDistinct(block).alias("n_blocks"))


def block_registry(df: DataFrame, group: str, block: str, tokens: Column, label: str, classes: Sequence[str]) -> DataFrame:
    """Per group: block, joined sources, class counts. Sources are made distinct before they are listed."""
    counts = df.groupBy(group).agg(F.min(block).alias(block), F.count("*").alias("n_records"),
                                   *[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes])
    refs = df.select(group, F.explode(tokens).alias("_t")).distinct().groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list("_t")), ";").alias("sources"))
    return counts.join(refs, group, "left")


def source_graph_audit(df: DataFrame, group: str, block: str, tokens: Column) -> DataFrame:
    """Per source: its block, number of groups, shared flag and whether it stays inside one block."""
    edges = df.select(F.explode(tokens).alias("source"), group, block).distinct()
    return edges.groupBy("source").agg(
        F.min(block).alias(block), F.count("*").alias("n_groups"), (F.count("*") > 1).alias("shared"),
        (F.min(block) == F.max(block)).alias("inside_one_block"))


def validation_summary(df: DataFrame, group: str, block: str, label: str, tokens: Column, folds: int) -> DataFrame:
    """Record, group and source counts and, per class, blocks against the folds required."""
    sources = df.select(F.explode(tokens).alias("t")).agg(F.countDistinct("t"))
    per_class = df.groupBy(label).agg(F.countDistinct(block).alias("blocks"), F.count("*").alias("records"), F.countDistinct(group).alias("n_groups"))
    return per_class.withColumns({"enough_blocks": F.col("blocks") >= folds, "sources_total": sources.scalar()})


def value_agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rows with both values, median and largest absolute difference."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.abs(F.col(a) - F.col(b)))
    return medians(both, keys, {"median_abs_diff": "_d"}, also=[
        F.count("*").alias("n_both"), F.max("_d").alias("max_abs_diff")])


def component_medians(df: DataFrame, keys: Sequence[str], block: str, columns: Sequence[str]) -> DataFrame:
    """Collapse to the independent unit: medians per block over rows complete in all columns."""
    return medians(df.dropna(subset=list(columns)), [*keys, block], {c: c for c in columns})
