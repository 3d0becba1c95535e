"""Tie-averaged Spearman of all bootstrap replicates at once.

A row brings its weights of all replicates as a vector. Rows are sorted once by each side, not once per replicate: running sums of the
vectors give every replicate's ranks, and the centred ranks of one side travel with the row to the sort by the other. Keys of many rows are
cut into value buckets as in :mod:`ordered`; a cut point is a bucket of its own, where all rows have the same rank.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from kinfold.operators.ordered import _edges, below
from kinfold.session import cut

BUCKET_ROWS = 50_000
MOST_BUCKETS = 1_024


def _bucketed(rows: DataFrame, edges: DataFrame | None, keys: list[str], value: str, samples: int, out: str) -> DataFrame:
    """Add ``out``: an even number between cut points, an odd one at a cut point."""
    if edges is None:
        return rows.withColumn(out, F.lit(0))
    if keys:
        other = edges.withColumnsRenamed({c: f"_of_{c}" for c in keys})
        rows = rows.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]), "left").drop(*[f"_of_{c}" for c in keys])
    else:
        rows = rows.withColumn("_edges", edges.scalar())
    rows = below(rows, "_edges", F.col(value), samples, "_at")
    at_cut = F.coalesce(F.get("_edges", F.col("_at")) == F.col(value), F.lit(False))
    return rows.withColumn(out, F.col("_at") * 2 + at_cut.cast("int")).drop("_edges", "_at")


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(-1, n).astype(np.int64)


def _centred(values: np.ndarray, weights: np.ndarray, bucket: pa.Table, at_cut: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """``(order, ranks, new)``: rows by value, twice their centred ranks in every replicate, and how many values there are."""
    before, own, whole = (np.array(bucket.column(c)[0].as_py(), np.int64) for c in ("_before", "_own", "_whole"))
    if at_cut:
        return np.arange(len(values)), np.broadcast_to(2 * before + own - whole, weights.shape), 0
    order = np.argsort(values, kind="stable")
    v = values[order]
    change = v[1:] != v[:-1]
    if v.dtype.kind == "f":
        change &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    ends = np.append(np.flatnonzero(change), len(v) - 1)
    upto = np.cumsum(weights[order], axis=0)[ends]
    lower = np.concatenate([np.zeros((1, weights.shape[1]), np.int64), upto[:-1]])
    # rank less its mean: before + lower + (equal + 1) / 2 - (whole + 1) / 2
    ranks = 2 * before + lower + upto - whole
    return order, np.repeat(ranks, np.diff(np.append(-1, ends)), axis=0), len(ends)


def _numeric(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def replicate_spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, weights: str, replicates: int, largest: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(keys, replicate, rho, n, kinds)`` for replicates 0 to ``replicates`` - 1, the entries of the array ``weights``.

    ``n`` is the sum of the weights, ``kinds`` the number of different x of all rows, ``rho`` NULL where a side does not vary.
    ``rows`` have both values; ``largest`` bounds the rows of a key.
    """
    keys = list(keys)
    samples = 0 if largest <= bucket_rows else min(MOST_BUCKETS, math.ceil(largest / bucket_rows))
    parts = max(1, samples // 8)
    placed = rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(weights).alias("_w"))
    bare = placed.select(*keys, "_x", "_y")
    for v, other in (("x", "y"), ("y", "x")):
        edges = cut(_edges(bare, keys, f"_{v}", samples, by=f"_{other}")) if samples else None
        placed = _bucketed(placed, edges, keys, f"_{v}", samples, f"_b{v}")
        spread = F.when(F.col(f"_b{v}") % 2 == 1, F.pmod(F.xxhash64(f"_{other}"), F.lit(parts)).cast("int")).otherwise(F.lit(0))
        placed = placed.withColumn(f"_p{v}", spread)
    placed = cut(placed)

    def buckets(v: str) -> DataFrame:
        """One row per key, bucket and part: vectors of the weights before the bucket, in it and of the key."""
        sums = placed.groupBy(*keys, f"_b{v}").agg(*[F.sum(F.get("_w", F.lit(r))).alias(f"_{r}") for r in range(replicates)])
        whole = Window.partitionBy(*keys)
        earlier = whole.orderBy(f"_b{v}").rowsBetween(Window.unboundedPreceding, -1)
        every = lambda f: F.array(*[f(F.col(f"_{r}")) for r in range(replicates)])
        vectors = sums.select(*keys, f"_b{v}", every(lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias("_before"), every(lambda c: c).alias("_own"),
                              every(lambda c: F.sum(c).over(whole)).alias("_whole"))
        dealt = F.when(F.col(f"_b{v}") % 2 == 1, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
        return cut(vectors.withColumn(f"_p{v}", F.explode(dealt)))

    of_x, of_y = buckets("x"), buckets("y")
    most = of_x.agg(F.max(F.array_max("_whole"))).first()[0] or 0
    kind, arrow = ("int", pa.int32()) if most < 1 << 30 else ("long", pa.int64())
    named = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    types = {c: placed.schema[c].dataType.simpleString() for c in ("_y", "_by", "_py")}

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, "_y", "_by", "_py", "_w"]
        if not len(left):
            return pa.table([pa.array([], left.schema.field(c).type) for c in names] + [pa.array([], pa.list_(arrow)), pa.array([], pa.int32())], names=names + ["_r", "_new"])
        w = _matrix(left.column("_w"), replicates)
        order, ranks, new = _centred(_numeric(left.column("_x")), w, right, left.column("_bx")[0].as_py() % 2 == 1)
        lists = pa.ListArray.from_arrays(np.arange(len(left) + 1, dtype=np.int32) * replicates, pa.array(ranks.ravel(), arrow))
        first = np.zeros(len(left), np.int32)
        first[0] = new
        return pa.table([left.column(c).take(pa.array(order)) for c in names] + [lists, pa.array(first)], names=names + ["_r", "_new"])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_n", "_ab", "_aa", "_bb"]
        if not len(left):
            return pa.table([pa.array([], left.schema.field(c).type) for c in keys] + [pa.array([], pa.list_(pa.float64()))] * 4 + [pa.array([], pa.int64())], names=[*keys, *names, "_new"])
        w, a = _matrix(left.column("_w"), replicates), _matrix(left.column("_r"), replicates)
        order, b, _ = _centred(_numeric(left.column("_y")), w, right, left.column("_by")[0].as_py() % 2 == 1)
        w, a = w[order].astype(float), a[order].astype(float)
        sums = [w.sum(0), (w * a * b).sum(0), (w * a * a).sum(0), (w * b * b).sum(0)]
        return pa.table([left.column(c).slice(0, 1) for c in keys] + [pa.array([s.tolist()], pa.list_(pa.float64())) for s in sums] +
                        [pa.array([pc.sum(left.column("_new")).as_py()], pa.int64())], names=[*keys, *names, "_new"])

    cells = lambda df, v: df.groupBy(*keys, f"_b{v}", f"_p{v}")
    vectors = f"_w {placed.schema['_w'].dataType.simpleString()}, _r array<{kind}>, _new int"
    head = f"{named}, " if named else ""
    by_x = cells(placed, "x").cogroup(cells(of_x, "x")).applyInArrow(
        ranked, f"{head}_y {types['_y']}, _by {types['_by']}, _py {types['_py']}, {vectors}")
    sums = cut(cells(by_x, "y").cogroup(cells(of_y, "y")).applyInArrow(
        summed, f"{head}_n array<double>, _ab array<double>, _aa array<double>, _bb array<double>, _new long"))
    # values at cut points are counted by their buckets
    at_cuts = of_x.where("_bx % 2 = 1 and _px = 0").select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), *[F.lit(0.0).alias(c) for c in ("_n", "_ab", "_aa", "_bb")], F.lit(1).cast("long").alias("_new"))
    opened = sums.select(*keys, "_new", F.posexplode(F.arrays_zip("_n", "_ab", "_aa", "_bb")).alias("replicate", "s")).select(*keys, "replicate", "s._n", "s._ab", "s._aa", "s._bb", "_new")
    total = opened.unionByName(at_cuts).groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("_n", "_ab", "_aa", "_bb")], F.sum("_new").alias("kinds"))
    varied = (F.col("_aa") > 0) & (F.col("_bb") > 0)
    return total.select(*keys, "replicate", F.when(varied, F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho"), F.col("_n").cast("bigint").alias("n"), "kinds")
