"""Running totals, ranks and quantiles that never put an unbounded key into one task.

A window ordered over all rows of a key runs in a single task. That is right while keys are small,
so the rows per key are measured first (or stated by a caller who already knows a bound). Above
``HOT_ROWS`` a key is cut into value buckets: totals are accumulated inside a bucket, and the sums of
earlier buckets, one row per bucket, are added. The cut points are the values with the smallest
hashes; results are exact for any cut points. Equal values are aggregated before either path, so a
value holding a third of all rows is one row by then.

The aggregated values of very large keys are written to the shared folder once, because the bucketed
path reads them several times and recomputing the input for every branch would cost more than one
compact write. Ordinary keys stay in one lazy plan.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.session import cut

SAMPLES = 256
HOT_ROWS = 2_000_000
FEW_ROWS = 4_096


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on ``keys``; without keys ``other`` is a single row and comes in as a scalar subquery."""
    if keys:
        return df.join(other, list(keys))
    row = other.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none (the usual case).

    One aggregation over the key columns alone. The answer is at most rows / limit keys.
    """
    if not keys:
        return df.limit(0) if df.count() > limit else None  # only told apart from None
    found = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    return None if found.isEmpty() else cut(found)


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key."""
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return sizes.agg(F.max("count")).first()[0] or 0


def _edges(level: DataFrame, keys: Sequence[str], order: str, samples: int, by: str | None = None) -> DataFrame:
    """Sorted cut points per key: the values with the smallest hashes, or those of the rows with the smallest if ``by`` tells rows apart.

    Only hashes in the share of the hash range that holds about four times as many values are sorted, so
    this reads a key's rows once. Should fewer lie there, there are fewer buckets.
    """
    sizes = cut(level.groupBy(*keys).agg(F.count("*").alias("_n")))  # written: its file size decides whether it is broadcast
    most = F.lit(2.0 ** 63) * F.least(F.lit(4.0 * samples) / F.col("_n"), F.lit(1.0))
    hashed = level.select(*keys, order, F.xxhash64(*([order] if by is None else [order, by])).alias("_hash"))
    few = attach(hashed, sizes, keys).where(F.abs(F.col("_hash").cast("double")) <= most)
    by_hash = Window.partitionBy(*keys).orderBy("_hash", order)
    picked = few.withColumn("_pick", F.row_number().over(by_hash)).where(F.col("_pick") <= samples)
    return picked.groupBy(*keys).agg(F.array_sort(F.collect_set(order)).alias("_edges"))


def below(df: DataFrame, edges: str | Column, value: Column, samples: int, out: str, including: bool = False) -> DataFrame:
    """Add ``out``: how many of the sorted ``edges``, ``samples`` at most, are smaller than ``value`` (or equal, with ``including``), by halving steps.

    One column per step: Spark compiles these into the scan, a function over the array would be interpreted.
    """
    df = df.withColumn(out, F.lit(0))
    for i in reversed(range(samples.bit_length())):
        edge = F.get(edges, F.col(out) + F.lit((1 << i) - 1))
        step = F.when(edge <= value if including else edge < value, 1 << i).otherwise(0)
        df = df.withColumn(out, F.col(out) + step)
    return df


def with_buckets(level: DataFrame, keys: Sequence[str], order: str, samples: int = SAMPLES) -> DataFrame:
    """Attach ``_bucket``: larger values, later buckets. The edges are written, so every reader of the
    result sees the same ones, and their file size decides whether they are broadcast."""
    edges = cut(_edges(level, keys, order, samples))
    placed = level.join(edges, list(keys)) if keys else level.withColumn("_edges", edges.scalar())
    return below(placed, "_edges", F.col(order), samples, "_bucket").drop("_edges")


def _cells(sums: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Sums per key and ``_bucket`` with ``<t>_off`` of earlier buckets and ``<t>_all`` of the key.

    ``_cell`` is one number for key and bucket: windows sort by it and the value, not by all key columns. The
    table is written, so its numbers are the same for every reader and its file size decides whether it is broadcast.
    """
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return cut(sums.select(
        "*", *[F.coalesce(F.sum(f"{t}_sum").over(earlier), F.lit(0)).alias(f"{t}_off") for t in totals],
        *[F.sum(f"{t}_sum").over(whole).alias(f"{t}_all") for t in totals]).withColumn("_cell", F.monotonically_increasing_id()))


def ordered_totals(df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, Column],
                   max_rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per (keys, value of ``order``) with, for every total ``t``:

    ``t`` at the value, ``t_before`` over strictly smaller values and ``t_all`` over the key.
    ``max_rows`` states a known bound on the distinct values per key and saves measuring it.
    """
    keys = list(keys)
    level = (
        df.where(F.col(order).isNotNull()).groupBy(*keys, order)
        .agg(*[F.sum(c).alias(t) for t, c in totals.items()])
    )
    if max_rows is None:
        # rows bound distinct values; counting them reads the key columns only
        max_rows = largest_key(df, keys)
    if max_rows > hot_rows:
        level = cut(level)
        max_rows = largest_key(level, keys)
    if max_rows <= hot_rows:
        part = Window.partitionBy(*keys)
        lower = part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return level.select(
            "*", *[F.coalesce(F.sum(t).over(lower), F.lit(0)).alias(f"{t}_before") for t in totals],
            *[F.sum(t).over(part).alias(f"{t}_all") for t in totals])
    placed = with_buckets(level, keys, order)
    offsets = _cells(placed.groupBy(*keys, "_bucket").agg(*[F.sum(t).alias(f"{t}_sum") for t in totals]), keys, list(totals))
    inside = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, [*keys, "_bucket"]).select(
        *keys, order, *totals,
        *[(F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"{t}_off")).alias(f"{t}_before") for t in totals],
        *[F.col(f"{t}_all") for t in totals])


def positions(df: DataFrame, keys: Sequence[str], order: str, max_rows: int | None = None,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Zero-based ``position`` of each distinct ``order`` value within ``keys``, and ``n_units``."""
    ranked = ordered_totals(df.select(*keys, order).distinct(), keys, order, {"n": F.lit(1)}, max_rows, hot_rows)
    return ranked.select(
        *keys, order, F.col("n_before").cast("bigint").alias("position"), F.col("n_all").cast("bigint").alias("n_units"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank", weight: Column | None = None,
                  max_rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Tie-averaged rank of each distinct value (weights count as copies)."""
    ranked = ordered_totals(df, keys, value, {"w": F.lit(1.0) if weight is None else weight}, max_rows, hot_rows)
    return ranked.select(
        *keys, value, (F.col("w_before") + (F.col("w") + 1) / 2).alias(rank), F.col("w_all").alias("n_all"))


def row_ranks(df: DataFrame, keys: Sequence[str], value: str, other: str, weight: str, rank: str, samples: int = SAMPLES,
              measured: DataFrame | None = None) -> DataFrame:
    """Add the tie-averaged ``rank`` of ``value`` within very large keys, and ``<rank>_all``, the weight of the key.

    Rows stay rows: they are dealt by value buckets once and nothing is joined back by value. A cut point has
    a bucket of its own, whose rank needs only the bucket's sum, so those rows are spread by ``other``; cut points are
    drawn from rows, and a value that holds much of a key is one of them all but surely. ``measured`` holds the same rows
    where those of ``df`` are dear to read again.
    """
    keys = list(keys)
    rows = df if measured is None else measured
    edges = cut(_edges(rows, keys, value, samples, by=other))
    tied = F.coalesce(F.get("_edges", F.col("_at")) == F.col(value), F.lit(False))

    def place(rows: DataFrame) -> DataFrame:
        rows = rows.join(edges, keys) if keys else rows.withColumn("_edges", edges.scalar())
        return below(rows, "_edges", F.col(value), samples, "_at").withColumn("_tied", tied).withColumn(
            "_bucket", F.col("_at") * 2 + F.col("_tied").cast("int")).drop("_edges", "_at")

    offsets = _cells(place(rows).groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_w_sum")), keys, ["_w"])
    spread = F.when(F.col("_tied"), F.pmod(F.xxhash64(other), F.lit(samples))).otherwise(F.lit(0))
    placed = place(df).join(offsets, [*keys, "_bucket"]).withColumn("_part", F.col("_cell") * samples + spread)
    upto = F.sum(weight).over(Window.partitionBy("_part").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum(weight).over(Window.partitionBy("_part", value))
    found = placed.withColumns({"_upto": upto, "_equal": equal})
    within = F.when(F.col("_tied"), (F.col("_w_sum") + 1) / 2).otherwise(F.col("_upto") - F.col("_equal") + (F.col("_equal") + 1) / 2)
    return found.select(*df.columns, (F.col("_w_off") + within).alias(rank), F.col("_w_all").alias(f"{rank}_all"))


def _hot_quantiles(hot: DataFrame, keys: list[str], specs: Mapping[str, tuple[str, float]]) -> DataFrame:
    columns = sorted({c for c, _ in specs.values()})
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = hot.select(*keys, F.explode(entries).alias("cell")).select(*keys, "cell.column", "cell.value")
    ranked = ordered_totals(long, [*keys, "column"], "value", {"n": F.lit(1)})
    picks = []
    for out, (column, prob) in specs.items():
        at = (F.col("n_all") - 1) * F.lit(float(prob))
        low, high = F.floor(at), F.ceil(at)
        covers = lambda i: (F.col("n_before") <= i) & (i < F.col("n_before") + F.col("n"))
        own = F.col("column") == column
        picks += [
            F.max(F.when(own & covers(low), F.col("value"))).alias(f"{out}_lo"),
            F.max(F.when(own & covers(high), F.col("value"))).alias(f"{out}_hi"),
            F.max(F.when(own, at - low)).alias(f"{out}_share")]
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"{o}_lo") + (F.col(f"{o}_hi") - F.col(f"{o}_lo")) * F.col(f"{o}_share")).alias(o) for o in specs])


def _middle(values: Column, prob: float) -> Column:
    """The linear-interpolated quantile of an array's values, in the arithmetic of ``percentile``."""
    sorted_ = F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(float(prob))
    low, high = F.get(sorted_, F.floor(at).cast("int")), F.get(sorted_, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _percentiles(df: DataFrame, keys: list[str], specs: Mapping[str, tuple[str, float]], also: Sequence[Column]) -> DataFrame:
    """``percentile`` of every spec; those of a column share one table of its values."""
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    of = {c: [o for o, (own, _) in specs.items() if own == c] for c in columns}
    found = df.groupBy(*keys).agg(*[F.percentile(F.col(c), F.array(*[F.lit(float(specs[o][1])) for o in of[c]])).alias(f"_p{i}") for i, c in enumerate(columns)], *also)
    kept = found.columns[len(keys) + len(columns):]
    return found.select(*keys, *[F.get(f"_p{columns.index(c)}", F.lit(of[c].index(o))).alias(o) for o, (c, _) in specs.items()], *kept)


MEASURE = object()
FEW = object()


def _few(df: DataFrame, keys: Sequence[str], bound: Sequence[str] | None) -> tuple[bool, int]:
    """Whether every key has few rows, and the rows of the largest (of ``bound``, if those decide it)."""
    most = largest_key(df, bound) if bound and set(bound) != set(keys) else None
    if most is None or most > FEW_ROWS:
        most = largest_key(df, keys)
    return most <= FEW_ROWS, most


def exact_quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]],
                    hot=MEASURE, hot_rows: int = HOT_ROWS, also: Sequence[Column] = (), bound: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key; ``specs`` maps output to (column, probability).

    Keys of a few rows each are sorted as arrays: ``percentile`` builds and ships a hash table for each key. It holds a key's
    values in one task, which is right for ordinary keys. Keys above
    ``hot_rows`` rows take the bucketed path instead. ``hot`` is what :func:`hot_keys` returned, when
    a caller measured already, None, or FEW when the rows per key are a few by configuration. ``also``
    are further aggregates, computed in the same pass. ``bound`` may name some of the keys whose rows, over all the others, are likely few
    already: cheaper to measure.
    """
    keys = list(keys)
    few = hot is FEW
    if hot is MEASURE:
        few, most = _few(df, keys, bound) if keys else (False, 0)
        hot = None if keys and most <= hot_rows else hot_keys(df, keys, hot_rows)
    if few and hot_rows >= FEW_ROWS:
        columns = sorted({c for c, _ in specs.values()})
        lists = df.groupBy(*keys).agg(*[F.collect_list(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)], *also)
        kept = [c for c in lists.columns[len(keys) + len(columns):]]
        return lists.select(*keys, *[_middle(F.col(f"_v{columns.index(c)}"), p).alias(o) for o, (c, p) in specs.items()], *kept)
    if hot is None or hot is FEW:
        return _percentiles(df, keys, specs, also)
    used = sorted({c for c, _ in specs.values()})
    if not keys:
        found = _hot_quantiles(df.select(F.lit(1).alias("_one"), *used), ["_one"], specs).drop("_one")
        return attach(found, df.agg(*also), []) if also else found
    cold = _percentiles(df.join(hot, keys, "left_anti"), keys, specs, also)
    large = df.join(hot, keys, "left_semi")
    found = _hot_quantiles(large.select(*keys, *used), keys, specs)
    return cold.unionByName(found.join(large.groupBy(*keys).agg(*also), keys) if also else found)


def medians(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], hot=MEASURE,
            hot_rows: int = HOT_ROWS, also: Sequence[Column] = (), bound: Sequence[str] | None = None) -> DataFrame:
    return exact_quantiles(df, keys, {o: (c, 0.5) for o, c in columns.items()}, hot, hot_rows, also, bound)
