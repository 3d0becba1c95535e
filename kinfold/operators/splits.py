"""Grouped, stratified splits as a registry of (seed, fold, block) rows."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.operators.ordered import ordered_totals


def block_classes(df: DataFrame, block: str, class_code: str, k: int) -> DataFrame:
    """Per block: rows per class, total and dominant class (lowest code on ties)."""
    counts = [F.count_if(F.col(class_code) == c).alias(f"n_{c}") for c in range(k)]
    agg = df.groupBy(block).agg(*counts, F.count("*").alias("n"))
    tops = F.array(*[F.col(f"n_{c}") for c in range(k)])
    return agg.withColumn("stratum", (F.array_position(tops, F.array_max(tops)) - 1).cast("int"))


def deal_folds(blocks: DataFrame, block: str, folds: int, seeds: Sequence[int]) -> DataFrame:
    """Deal blocks to folds, largest first, snake order, within their dominant class.

    The order is (size descending, hash of seed and block), so each seed gives another split of equal
    balance. Positions come from running totals per (seed, stratum); no task orders a whole stratum.
    """
    tries = blocks.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    place = F.struct((-F.col("n")).alias("a"), F.md5(F.concat_ws(":", "seed", block)).alias("b"), F.col(block).alias("c"))
    keyed = tries.withColumn("_place", place)
    ranked = ordered_totals(keyed, ["seed", "stratum"], "_place", {"one": F.lit(1)})
    turn = F.floor(F.col("one_before") / folds)
    slot = F.pmod(F.col("one_before"), F.lit(folds))
    fold = F.when(turn % 2 == 0, slot).otherwise(folds - 1 - slot).cast("int")
    return ranked.select("seed", "stratum", F.col("_place.c").alias(block), fold.alias("fold"))


def fold_validity(dealt: DataFrame, blocks: DataFrame, block: str, k: int, folds: int, counts_prefix: str = "n_") -> DataFrame:
    """Per seed: does every fold hold every class in validation and in training?"""
    sizes = blocks.select(block, *[f"{counts_prefix}{c}" for c in range(k)])
    per_fold = dealt.join(sizes, block).groupBy("seed", "fold").agg(
        *[F.sum(f"{counts_prefix}{c}").alias(f"v{c}") for c in range(k)])
    totals = sizes.agg(*[F.sum(f"{counts_prefix}{c}").alias(f"t{c}") for c in range(k)])
    total = lambda c: totals.select(f"t{c}").scalar()
    good = reduce(lambda a, b: a & b, [(F.col(f"v{c}") > 0) & (total(c) - F.col(f"v{c}") > 0) for c in range(k)])
    return per_fold.groupBy("seed").agg(
        (F.bool_and(good) & (F.count("*") == folds)).alias("valid"), F.count("*").alias("folds"))


def first_valid(dealt: DataFrame, validity: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """The split of the smallest valid seed that is not forbidden."""
    usable = validity.where("valid")
    if forbidden is not None:
        usable = usable.join(forbidden.select("seed"), "seed", "left_anti")
    return dealt.where(F.col("seed") == usable.agg(F.min("seed")).scalar())


def grouped_split(df: DataFrame, block: str, class_code: str, k: int, folds: int, seeds: Sequence[int],
                  forbidden: DataFrame | None = None) -> DataFrame:
    blocks = block_classes(df, block, class_code, k)
    dealt = deal_folds(blocks, block, folds, seeds)
    return first_valid(dealt, fold_validity(dealt, blocks, block, k, folds), forbidden)


def inner_split(df: DataFrame, block: str, class_code: str, k: int, wanted: Sequence[int], seed: int) -> DataFrame:
    """First fold number in ``wanted`` (e.g. 4 then 3) that gives a valid split."""
    blocks = block_classes(df, block, class_code, k)
    offered = []
    for order, folds in enumerate(wanted):
        dealt = deal_folds(blocks, block, folds, [seed])
        valid = fold_validity(dealt, blocks, block, k, folds)
        offered.append(dealt.join(valid.where("valid").select("seed"), "seed", "left_semi").select(
            F.lit(order).alias("_order"), F.lit(folds).alias("folds"), "seed", block, "fold"))
    every = reduce(DataFrame.unionByName, offered)
    return every.where(F.col("_order") == every.agg(F.min("_order")).scalar()).drop("_order")


def split_registry(df: DataFrame, dealt: DataFrame, group: str, block: str) -> DataFrame:
    """(seed, fold, partition, group, block): every group is validation once and training otherwise."""
    groups = df.select(group, block).distinct().join(dealt.select("seed", block, F.col("fold").alias("own")), block)
    n = dealt.groupBy("seed").agg((F.max("fold") + 1).alias("_k"))
    rows = groups.join(n, "seed").withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.select("seed", "fold", F.when(F.col("fold") == F.col("own"), "validation").otherwise("train").alias("partition"), group, block)


def overlap(registry: DataFrame, unit: str, keys: Sequence[str]) -> DataFrame:
    """Units found on both sides of a fold; empty when the split is clean."""
    return registry.groupBy(*keys, unit).agg(F.countDistinct("partition").alias("sides")).where("sides > 1")


def holdout_candidates(df: DataFrame, dealt: DataFrame, group: str, block: str, class_code: str, k: int,
                       share: float = 0.2, min_groups: int = 2) -> DataFrame:
    """Objective of each (seed, fold) as a holdout: size deviation plus class-share L1 deviation.

    Only labels and blocks enter, no scores. Counts are taken per block once; candidates combine block
    counts, so rows are not repeated per seed. Groups never span blocks, so group counts add up too.
    """
    per_block = df.groupBy(block).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(class_code) == c).alias(f"n_{c}") for c in range(k)],
        *[F.countDistinct(F.when(F.col(class_code) == c, F.col(group))).alias(f"g_{c}") for c in range(k)])
    names = ["n"] + [f"{p}_{c}" for c in range(k) for p in ("n", "g")]
    all_rows = per_block.agg(*[F.sum(c).alias(c) for c in names])
    total = lambda c: all_rows.select(c).scalar()
    held = dealt.join(per_block, block).groupBy("seed", "fold").agg(*[F.sum(c).alias(c) for c in names])
    drift = reduce(lambda a, b: a + b, [
        F.abs(F.col(f"n_{c}") / F.col("n") - total(f"n_{c}") / total("n")) for c in range(k)])
    eligible = reduce(lambda a, b: a & b, [
        (F.col(f"g_{c}") >= min_groups) & (total(f"g_{c}") - F.col(f"g_{c}") >= min_groups) for c in range(k)])
    return held.select("seed", "fold", F.col("n").alias("held_records"), eligible.alias("eligible"),
                       (F.abs(F.col("n") / total("n") - share) + drift).alias("objective"))


def choose_holdout(candidates: DataFrame) -> DataFrame:
    """Smallest objective among eligible candidates (seeds x folds rows)."""
    return candidates.where("eligible").orderBy(F.round("objective", 12), "seed", "fold").limit(1)


def fold_registry(records: DataFrame, dealt: DataFrame, block: str, record: str, kept: DataFrame, features: Sequence[str],
                  max_missing: float) -> DataFrame:
    """Validation rows per fold with retained features, missing share over them and abstention reason.

    ``kept`` holds (fold, feature). Missing counts use one array per record, not one row per cell.
    """
    lists = kept.groupBy("fold").agg(F.array_sort(F.collect_list("feature")).alias("_kept"))
    absent = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features])
    rows = records.join(dealt.select(block, "fold"), block).join(lists, "fold")
    share = F.size(F.array_intersect(F.array_compact(absent), F.col("_kept"))) / F.size("_kept")
    return rows.select(
        record, block, "fold", F.size("_kept").cast("bigint").alias("retained_features"), share.alias("missing_share"),
        F.when(share >= max_missing, "missing_share").alias("abstain_reason"))
