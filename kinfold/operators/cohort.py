"""Cohort building: coercion audits, group status, exclusion rules, screens, attrition."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.functions.scalars import number


def cells(df: DataFrame, ids: Sequence[str], features: Sequence[str], name: str = "feature",
          value: str = "value") -> DataFrame:
    """Wide to long: one row per record and feature."""
    return df.unpivot(list(ids), list(features), name, value)


def coercion_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: observed, non-numeric, negative and missing-after counts, in one pass.

    All counters are computed in a single scan and only then turned into rows, so the input is not
    multiplied by the number of features.
    """
    def counters(f):
        text, value = F.col(f), F.col(f).try_cast("double")
        finite = number(f)
        return F.struct(
            F.lit(f).alias("feature"),
            F.count_if(text.isNotNull()).alias("observed"),
            F.count_if(text.isNotNull() & finite.isNull()).alias("not_numeric"),
            F.count_if(finite < 0).alias("negative"),
            F.count_if(finite.isNull() | (finite < 0)).alias("missing_after"))
    return df.agg(F.array(*[counters(f) for f in features]).alias("_a")).select(F.explode("_a").alias("_e")).select("_e.*")


def numeric_columns(df: DataFrame, columns: Sequence[str], excluded: Sequence[str], share: float = 0.8) -> DataFrame:
    """Numeric share of the non-missing values per column and whether the column qualifies."""
    candidates = [c for c in columns if c not in excluded]
    stats = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n_values"),
                 F.count(F.col(c).try_cast("double")).alias("n_numeric")) for c in candidates]).alias("_a"))
    out = stats.select(F.explode("_a").alias("_e")).select("_e.*")
    part = F.try_divide(F.col("n_numeric"), F.col("n_values"))
    return out.select("column", "n_values", "n_numeric", F.coalesce(part >= share, F.lit(False)).alias("is_feature"))


def group_status(df: DataFrame, group: str, label: str) -> DataFrame:
    agg = df.groupBy(group).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count("*").alias("n_records"),
        F.count_if(F.coalesce(~F.col(label).isin(0, 1), F.lit(True))).alias("_bad"))
    status = (
        F.when(F.col("_bad") > 0, "invalid_label")
        .when((F.col("_lo") == 0) & (F.col("_hi") == 0), "stable_negative")
        .when((F.col("_lo") == 1) & (F.col("_hi") == 1), "stable_positive")
        .otherwise("mixed_uncertain"))
    return agg.select(group, "n_records", status.alias("status"))


def missing_fraction(features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNull().cast("double") for f in features]) / F.lit(float(len(features)))


def class_matrix(df: DataFrame, group: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Group x class counts (a pivot with known columns: one partial aggregate, no extra job)."""
    return df.groupBy(group).agg(*[F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes])


def _totals(classes):
    cols = [F.col(f"n_{c}") for c in classes]
    total = reduce(lambda a, b: a + b, cols)
    return total, F.greatest(*cols), reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in cols])


def mixed_or_small_groups(matrix: DataFrame, group: str, classes: Sequence[str], minority: float, minimum: int) -> DataFrame:
    total, top, kinds = _totals(classes)
    return matrix.where(((kinds > 1) & ((total - top) / total >= minority)) | (total < minimum)).select(group)


def excluded_groups(matrix: DataFrame, registry: DataFrame, group: str, classes: Sequence[str], kind: str,
                    hard_kinds: Sequence[str], minority: float, minimum: int, manual: Sequence = ()) -> DataFrame:
    """Groups out by kind, strong mixing, size or by name."""
    hard = registry.where(F.col(kind).isin(*hard_kinds)).select(group)
    named = registry.where(F.col(group).isin(*manual)).select(group)
    return hard.union(mixed_or_small_groups(matrix, group, classes, minority, minimum)).union(named).distinct()


def majority_class(matrix: DataFrame, group: str, classes: Sequence[str], minority: float) -> DataFrame:
    """Majority class of weakly mixed groups; the earlier class wins ties."""
    total, top, _ = _totals(classes)
    order = F.coalesce(*[F.when(F.col(f"n_{c}") == top, F.lit(c)) for c in classes])
    return matrix.where((total - top > 0) & ((total - top) / total < minority)).select(group, order.alias("majority_label"))


def attrition(df: DataFrame, group: str, label: str, classes: Sequence[str], excluded: DataFrame, majority: DataFrame) -> DataFrame:
    """First exclusion reason per record."""
    flagged = df.join(excluded.select(group, F.lit(True).alias("_out")), group, "left").join(majority, group, "left")
    status = (
        F.when(~F.col(label).isin(*classes), "excluded_label")
        .when(F.col("_out"), "excluded_group")
        .when(F.col("majority_label").isNotNull() & (F.col(label) != F.col("majority_label")), "excluded_minority")
        .otherwise("retained"))
    return flagged.withColumn("filter_status", status).drop("_out", "majority_label")


def cohort_flow(df: DataFrame, stage: str, group: str, total: str = "source_records") -> DataFrame:
    """Records and groups per stage plus a grand total, in one aggregation."""
    return (
        df.groupingSets([[stage], []], stage)
        .agg(F.grouping_id().alias("_g"), F.count("*").alias("records"), F.countDistinct(group).alias("n_groups"))
        .select(F.when(F.col("_g") > 0, F.lit(total)).otherwise(F.col(stage)).alias("stage"), "records", "n_groups"))


def missingness(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Missing share overall and per binary label, and the absolute gap; one scan."""
    def stats(f):
        gone = F.col(f).isNull().cast("double")
        return F.struct(F.lit(f).alias("feature"), F.avg(gone).alias("missing_fraction"),
                        F.avg(F.when(F.col(label) == 0, gone)).alias("missing_label_0"),
                        F.avg(F.when(F.col(label) == 1, gone)).alias("missing_label_1"))
    rows = df.agg(F.array(*[stats(f) for f in features]).alias("_a")).select(F.explode("_a").alias("_e")).select("_e.*")
    return rows.withColumn("label_gap", F.abs(F.col("missing_label_1") - F.col("missing_label_0")))


def screen(df: DataFrame, features: Sequence[str], direct: Sequence[str], banned: Sequence[str], max_missing: float) -> DataFrame:
    """Keep / drop decision per feature."""
    stats = df.agg(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.avg(F.col(f).isNull().cast("double")).alias("missing_fraction"),
                 F.coalesce(F.min(f) == F.max(f), F.lit(True)).alias("_flat")) for f in features]).alias("_a"))
    rows = stats.select(F.explode("_a").alias("_e")).select("_e.*")
    decision = (
        F.when(F.col("feature").isin(*direct), "excluded_direct")
        .when(F.col("feature").isin(*banned), "excluded_named")
        .when(F.col("missing_fraction") > max_missing, "excluded_missingness")
        .when(F.col("_flat"), "excluded_constant")
        .otherwise("retained"))
    return rows.select("feature", "missing_fraction", decision.alias("decision"))


def group_flags(df: DataFrame, group: str, label: str, domain: DataFrame, minimum: int, abstained: DataFrame, model_recall: DataFrame,
                models_needed: int, recall_limit: float) -> DataFrame:
    """One row per group and kind of finding, with reasons joined."""
    per_group = df.groupBy(group).agg(
        F.count("*").alias("n_records"), F.count_if(F.col(label).isNull()).alias("n_missing"),
        F.array_sort(F.collect_set(label)).alias("_kinds"))
    base = per_group.join(domain, group, "left").withColumn("n_types", F.size("_kinds").cast("bigint"))
    checks = {
        "mixed_type_group": (F.col("n_types") > 1, F.concat(F.lit("types="), F.array_join("_kinds", ","))),
        "out_of_domain_group": (F.coalesce(F.col("domain") == "out_of_domain", F.lit(False)), F.concat(F.lit("domain="), F.col("domain"))),
        "low_sample_group": (F.col("n_records") < minimum, F.concat(F.lit("n="), F.col("n_records"))),
        "missing_label": (F.col("n_missing") > 0, F.concat(F.lit("n_missing="), F.col("n_missing"))),
    }
    joined = lambda i: F.array_join(F.array_compact(F.array(*[
        F.when(c, F.lit(n) if i == 0 else d) for n, (c, d) in checks.items()])), "; ")
    first = base.select(group, joined(0).alias("flag"), joined(1).alias("detail"), "n_records").where("flag <> ''")
    abstain = abstained.groupBy(group).agg(F.count("*").alias("_n")).join(per_group, group).select(
        group, F.lit("high_missingness_abstain").alias("flag"), F.concat(F.lit("n_abstained="), F.col("_n")).alias("detail"), "n_records")
    weak = model_recall.where((F.col("n_models") >= models_needed) & (F.col("median_recall") < recall_limit)).join(per_group, group).select(
        group, F.lit("consistent_cross_model_error").alias("flag"),
        F.concat(F.lit("n_models="), F.col("n_models")).alias("detail"), "n_records")
    return first.unionByName(abstain).unionByName(weak).dropDuplicates([group, "flag", "detail"])
