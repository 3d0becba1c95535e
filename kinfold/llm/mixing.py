"""Mixing sources to target weights by systematic sampling.

Sources get a share of all words by weight, but at most ``most`` times their own words; what a source can't take
is shared among the others by weight. A document is then expected ``target / source_size`` times. Expected copies are
summed along the documents of a source in order of size, one random offset per source is added, and a
document is emitted once per whole number that its own stretch of the sum crosses. In order of size, neighbours are of
like size, so a source's taken words miss its target by about one document.

The prefix sums need a document's place within its source. A source may hold a third of all rows, so places come
from one range-partitioned sort of (source, size, key): rows are numbered inside partitions, and the
counts of earlier partitions, one row per partition and source, are added.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.functions.draws import draw_uniform
from kinfold.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    """Words of a text; null has none."""
    spaced = F.coalesce(F.col(text), F.lit(""))
    for gap in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def placed(df: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``place``, the position (from 1) within ``key`` in the given order; null is a key."""
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, key, *order).sortWithinPartitions(key, *order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    runs = dealt.groupBy("_part", key).agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("p"), F.col(key).alias("k"), (before - F.col("first") + 1).alias("shift"))
    joined = dealt.join(runs, (F.col("_part") == F.col("p")) & F.col(key).eqNullSafe(F.col("k")))
    return joined.select(*df.columns, (F.col("_row") + F.col("shift")).alias("place"))


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``(source, source_size)`` with ``target`` added.

    Sources are weighed by code point order, null last, ``weights`` repeating. With caps sorted by cap per
    weight, the sources at their cap are the first ones: up to the first whose share, taken from what the earlier ones
    leave, lies within its cap.
    """
    by_name = placed(sources.withColumn("last", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1)), "one", ["last", "source"])
    pattern = F.array(*[F.lit(w) for w in weights])
    own = by_name.select("source", "source_size", F.element_at(pattern, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("weight"))
    own = own.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = own.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    # caps and weights of earlier sources, by distinct ratio; sums of long values are exact
    level = own.groupBy("ratio").agg(F.sum("cap").alias("cap_at"), F.sum("weight").alias("weight_at"))
    earlier = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    swept = level.select("ratio", F.coalesce(F.sum("cap_at").over(earlier), F.lit(0)).alias("caps"), F.coalesce(F.sum("weight_at").over(earlier), F.lit(0)).alias("used"))
    share = (F.col("total") - F.col("caps")) / (F.col("all_weight") - F.col("used"))
    whole = total.select(F.struct("*").alias("t"))
    first = swept.withColumn("t", whole.scalar()).select("ratio", "caps", "used", "t.*").withColumn("share", share).where("share <= ratio").agg(F.min_by("share", "ratio").alias("share"))
    return own.withColumn("share", first.scalar()).select(
        "source", "source_size", F.when(F.col("share").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight"))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3,
        seed: int = 7) -> DataFrame:
    """One row per row of ``df``: ``(key, size, source_size, target, copies, taken)``.

    ``copies`` is how often the mix holds the row, ``most`` at most, and ``taken`` its words times that. Null sources
    are one source; null and empty texts have size 0 and are never taken; repeated rows are rows of their own,
    ties in size go by key. Runs agree, since the offsets are hashes of seed and source. Other columns are not read;
    an empty table gives no rows.
    """
    sized = cut(df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size")))
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    goals = goals.select(F.col("source").alias("s"), "source_size", "target")
    taking = placed(sized.where("size > 0"), "source", ["size", "id"]).unionByName(sized.where("size = 0").withColumn("place", F.lit(None).cast("long")))
    joined = taking.join(goals, F.col("source").eqNullSafe(F.col("s")))
    each = F.col("target") / F.col("source_size")
    offset = draw_uniform(seed, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    crossed = F.floor(F.col("place") * each + offset) - F.floor((F.col("place") - 1) * each + offset)
    copies = F.coalesce(F.least(crossed, F.lit(most)), F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(key), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
