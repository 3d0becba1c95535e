"""Vector arithmetic on the long form (one row per unit and component)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def share(df: DataFrame, keys: Sequence[str], value: str, out: str, norm: Column | None = None) -> DataFrame:
    """``value`` over the total of ``norm`` (default: the value itself) in its key.

    Totals are aggregated (with map-side partial sums) and joined, so a key with very many rows is
    never sorted into one task as a window would do. A zero total gives NULL.
    """
    total = df.groupBy(*keys).agg(F.sum(F.col(value) if norm is None else norm).alias("_total"))
    return df.join(total, list(keys)).select(
        *df.columns, F.when(F.col("_total") != 0, F.col(value) / F.col("_total")).alias(out))


def signed_share(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of the L1 norm, sign kept."""
    return share(df, keys, value, out, norm=F.abs(F.col(value)))


def cosine(df: DataFrame, keys: Sequence[str], left: str, right: str, out: str = "cosine") -> DataFrame:
    """Cosine of two component columns per key; NULL components are skipped."""
    product = F.sqrt(F.sum(F.col(left) * F.col(left))) * F.sqrt(F.sum(F.col(right) * F.col(right)))
    return df.groupBy(*keys).agg(
        F.when(product > 0, F.sum(F.col(left) * F.col(right)) / product).alias(out))
