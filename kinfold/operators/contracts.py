"""Contracts: fail-fast checks as rows, canonical hashes, protocol comparison."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def payload_hash(df: DataFrame, part: str, text: Column) -> DataFrame:
    """Order-independent hash of a table from one aggregation.

    Every row's SHA-256 is cut into eight 32-bit numbers; their sums over all rows and the row count are
    hashed again. Sums commute, so partial aggregation does the work and no task gathers rows, however
    many there are; a changed, added, dropped or repeated row changes the sums.
    """
    digest = df.select(F.sha2(text, 256).alias("_d"))
    piece = lambda i: F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(piece(i)).cast("decimal(38,0)").cast("string").alias(f"_p{i}") for i in range(8)]
    return digest.agg(F.count("*").alias("rows"), *sums).select(
        F.lit(part).alias("part"), F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[f"_p{i}" for i in range(8)]), 256).alias("payload_hash"), "rows")


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are NULL or repeat; empty when the contract holds."""
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where(absent | (F.col("n_rows") > 1))


def check(df: DataFrame, name: str, passed: Column, evidence: Column, fatal: bool = True) -> DataFrame:
    """One ledger row from one aggregate over ``df``."""
    return df.agg(passed.alias("passed"), evidence.cast("string").alias("evidence")).select(
        F.lit(name).alias("check"), "passed", "evidence", F.lit(fatal).alias("fatal"))


def ledger(checks: Sequence[DataFrame], run_id: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, checks)
    return rows.withColumn("run_id", F.lit(run_id))


def raise_on_failure(entries: DataFrame) -> None:
    """Raise with the names of failed fatal checks (one row per check, so few rows)."""
    failed = [r["check"] for r in entries.where(F.col("fatal") & ~F.col("passed")).collect()]
    if failed:
        raise RuntimeError(f"integrity checks failed: {failed}")


def latest_run(history: DataFrame, order: str) -> DataFrame:
    """Last entry of every check over a ledger's history."""
    rest = [c for c in history.columns if c != "check"]
    return history.groupBy("check").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e")).select("check", "_e.*")


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields whose value differs between two contracts ``(field, value)``."""
    return (
        old.select("field", F.col("value").alias("old_value"))
        .join(new.select("field", F.col("value").alias("new_value")), "field", "full_outer")
        .where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    )


def missing_outputs(required: DataFrame, inventory: DataFrame) -> DataFrame:
    return required.select("path").join(inventory.select("path"), "path", "left_anti")


def hash_agreement(contracts: DataFrame, field: str = "protocol_hash") -> DataFrame:
    return contracts.agg(
        F.countDistinct(field).alias("distinct_hashes"), F.count("*").alias("contracts"),
        (F.countDistinct(field) == 1).alias("agree"))


def source_checks(records: DataFrame, groups: DataFrame, record: str, group: str, label: str,
                  sources: str, run_id: str) -> DataFrame:
    """The five source-table checks as ledger rows."""
    per_record = records.groupBy(record).count()
    per_group = groups.groupBy(group).count()
    orphans = records.select(group).distinct().join(groups.select(group), group, "left_anti")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    repeated = zero(F.when((F.col("count") > 1) | F.col(record).isNull(), 1).otherwise(0))
    repeated_group = zero(F.when((F.col("count") > 1) | F.col(group).isNull(), 1).otherwise(0))
    bad_label = zero(F.when(F.coalesce(F.col(label).isin(0, 1), F.lit(False)), 0).otherwise(1))
    no_source = zero(F.when(F.coalesce(F.trim(F.col(sources)), F.lit("")) == "", 1).otherwise(0))
    return ledger([
        check(per_record, "unique_record_id", repeated == 0, repeated),
        check(records, "binary_label", bad_label == 0, bad_label),
        check(orphans, "traceable_group", F.count("*") == 0, F.count("*")),
        check(records, "source_present", no_source == 0, no_source),
        check(per_group, "unique_group_registry", repeated_group == 0, repeated_group),
    ], run_id)


def record_access(spark: SparkSession, path: str, event: str, limit: int) -> None:
    """Append one access to a frozen contract's ledger; refuse beyond ``limit``."""
    history = spark.read.parquet(path)
    used = history.where(F.col("event") == event).count()
    if used >= limit:
        raise RuntimeError(f"{event} was already recorded {used} times")
    history.where("event = 'frozen'").withColumns(
        {"event": F.lit(event), "access": F.lit(used + 1)}).write.mode("append").parquet(path)
