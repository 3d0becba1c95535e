"""Table sources and sinks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kinfold.functions.scalars import number


def require_columns(df: DataFrame, required: Sequence[str], label: str) -> DataFrame:
    """Fail at planning time when a column is absent; no job is run."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks required columns: {missing}")
    return df


def column_contract(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The same contract as rows ``(column, present, filled)``, for a ledger; ``filled`` counts values that are not null."""
    filled = lambda c: F.count(F.col(c)) if c in df.columns else F.count(F.lit(None))
    cells = [F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), filled(c).alias("filled")) for c in required]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, or CSV / JSON with a declared schema; only ``columns`` are read where the format allows."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("encoding", "UTF-8").csv(path)
        # a byte order mark sticks to the first header
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))
    elif fmt == "json":
        df = reader.option("multiLine", True).json(path)
    else:
        df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """One feature name per line; blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("feature")).where(F.col("feature") != "")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def write_payload(df: DataFrame, path: str) -> str:
    """One JSON document per row; nested structs stay nested."""
    df.write.mode("overwrite").json(path)
    return path


def typed_records(records: DataFrame, groups: DataFrame, group: str, label: str, classes: Sequence[str],
                  features: Sequence[str], excluded: DataFrame, majority: DataFrame,
                  derived: dict[str, Column]) -> DataFrame:
    """Known classes only, without excluded groups and minority rows, features coerced, registry joined.

    ``excluded`` holds group ids, ``majority`` holds (group, majority_label) of weakly mixed groups.
    """
    normal = F.upper(F.trim(F.col(label)))
    kept = records.withColumn(label, normal).where(F.col(label).isin(*classes))
    kept = kept.join(excluded.select(group), group, "left_anti").join(majority, group, "left")
    kept = kept.where(F.col("majority_label").isNull() | (F.col(label) == F.col("majority_label")))
    kept = kept.withColumns({f: F.when(number(f) >= 0, number(f)) for f in features})
    return kept.withColumns(derived).drop("majority_label").join(groups, group, "left")


def last_write_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append ``new`` to ``old``; rows with the same key are replaced by the newer ones.

    ``max_by`` on the batch number merges map-side, so a key repeated very often stays cheap.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    row = F.struct(*rest)
    order = F.struct("_batch", *rest)
    return both.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select(*keys, "_row.*").select(*old.columns)
