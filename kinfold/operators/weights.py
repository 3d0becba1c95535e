"""Record weights from group and class sizes, and rank tables of bounded size."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def inverse_group_weights(df: DataFrame, group: str, out: str = "weight") -> DataFrame:
    """1 / group size, scaled to mean 1 over records.

    The mean of 1/n over records is groups / records, so the small size table gives the scale and the
    records are read once, joined to their group's size (Spark splits a hot group in that join).
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    scale = sizes.agg((F.sum("_n") / F.count("*")).alias("s")).scalar()
    return df.join(sizes, group).select(*df.columns, (scale / F.col("_n")).alias(out))


def balanced_group_weights(df: DataFrame, group: str, label: str, classes: int, out: str = "weight") -> DataFrame:
    """Class-balance weight n / (k·n_class) times 1 / group size, scaled to mean 1.

    ``df.groupBy(group, label)`` counts carry everything the factors need.
    """
    cells = df.groupBy(group, label).agg(F.count("*").alias("_gc"))
    by_group = cells.groupBy(group).agg(F.sum("_gc").alias("_g"))
    by_class = cells.groupBy(label).agg(F.sum("_gc").alias("_c"))
    n = cells.agg(F.sum("_gc")).scalar()
    raw = cells.join(by_group, group).join(by_class, label).withColumn("_w", n / (F.lit(float(classes)) * F.col("_c")) / F.col("_g"))
    mean = raw.agg(F.sum(F.col("_w") * F.col("_gc")) / F.sum("_gc")).scalar()
    return df.join(raw.select(group, label, (F.col("_w") / mean).alias(out)), [group, label]).select(*df.columns, out)


def importance_ranks(df: DataFrame, keys: Sequence[str], feature: str, value: str, out: str = "rank") -> DataFrame:
    """1..p per key by descending importance, feature name as tie-break. Rows per key are features."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(feature))
    return df.withColumn(out, F.row_number().over(w))


def min_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Descending rank, ties share the smallest. Rows per key are features."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())))


def category_ranks(df: DataFrame, keys: Sequence[str], category: str, value: str) -> DataFrame:
    """Average rank in the key truncated to an integer, and the size of the category. Rows are features."""
    w = Window.partitionBy(*keys)
    tied = F.count("*").over(Window.partitionBy(*keys, value))
    average = F.rank().over(w.orderBy(F.col(value).desc())) + (tied - 1) / F.lit(2.0)
    return df.withColumns({"rank": average.cast("int"), "category_size": F.count("*").over(Window.partitionBy(*keys, category))})


def winners(df: DataFrame, keys: Sequence[str], member: str, *order) -> DataFrame:
    """Winner per key in a full tie order, then how often each member won."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.groupBy(member).agg(F.count("*").alias("wins"))


def keep_one(df: DataFrame, keys: Sequence[str], order, last: bool = False) -> DataFrame:
    """First (or last) row per key. Merged map-side, so repeated keys never pile up in one task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)
