"""Spearman correlation with one block deleted, for every block, without ranking the rest again.

Without block B the centred rank of row i falls by e_i = c_i - k/2, where c_i counts B's k rows below i (ties count half). The
sums of products without B are then sums over all rows, minus those of B's rows. Their linear terms come from running totals. The product
of both corrections counts, for each pair (j, k) of B's rows, the rows above j in x and above k in y: a dominance count,
answered from a grid of rank buckets and inside the two buckets of the query.

Work grows with the sum of squared block sizes, so it is for blocks whose square is at most the rows of the key and that have ``PAIRED``
rows at most; ranking the rest again is cheaper for others, see :func:`spearman_without`.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kinfold.operators.metrics import spearman
from kinfold.operators.ordered import ordered_totals, positions
from kinfold.session import cut

PAIRED = 256
BUCKET = 4096


def dominating(px: np.ndarray, py: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """Points with ``px >= tx`` and ``py >= ty`` for every query, bit by bit over the ranks of ``py`` in order of ``px``."""
    n = len(px)
    ranks = np.empty(n, dtype=np.int64)
    ranks[np.argsort(py, kind="stable")] = np.arange(n)
    order = np.argsort(px, kind="stable")
    row, below = ranks[order], np.searchsorted(np.sort(py), ty)
    low, high = np.searchsorted(px[order], tx), np.full(len(tx), n)
    found = high - low
    for bit in reversed(range(n.bit_length())):
        zero = (row >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        set_, l, h = (below >> bit) & 1 == 1, before[low], before[high]
        found = found - np.where(set_, h - l, 0)  # these have a smaller rank
        low, high = np.where(set_, before[-1] + low - l, l), np.where(set_, before[-1] + high - h, h)
        row = np.concatenate([row[zero], row[~zero]])
    return found


def _counted(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(points):
        return pd.DataFrame({"_b": np.empty(0, np.int64), "_d": np.empty(0, np.int64)})
    hits = dominating(*(points[c].to_numpy(np.int64) for c in ("_px", "_py")), *(queries[c].to_numpy(np.int64) for c in ("_tx", "_ty")))
    return queries.assign(_d=hits).groupby("_b", as_index=False)["_d"].sum()


def dominance_sums(points: DataFrame, queries: DataFrame, keys: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """``(_b, _d)``: points ``(_px, _py)`` at or above ``(_tx, _ty)``, summed over the queries of a ``_b``.

    ``_px`` and ``_py`` number the points of a key from 0, so that a bucket holds ``bucket`` points.
    """
    keys = list(keys)
    slot = lambda c: F.floor(F.col(c) / bucket).cast("long")
    points = points.select(*keys, "_px", "_py", slot("_px").alias("_bx"), slot("_py").alias("_by"))
    queries = queries.select(*keys, "_b", "_tx", "_ty", slot("_tx").alias("_bx"), slot("_ty").alias("_by"))
    local = lambda at, p, q: p.groupBy(*keys, at).cogroup(q.groupBy(*keys, at)).applyInPandas(_counted, "_b long, _d long")
    same_x = local("_bx", points, queries)
    later_x = local("_by", points.select(*keys, "_by", F.col("_bx").alias("_px"), "_py"),
                    queries.select(*keys, "_by", "_b", (F.col("_bx") + 1).alias("_tx"), "_ty"))
    cells = points.groupBy(*keys, "_bx", "_by").agg(F.count("*").alias("_c"))
    side = points.groupBy(*keys).agg(F.max("_bx").alias("_g")).withColumn("_bx", F.explode(F.sequence(F.lit(0).cast("long"), "_g")))
    grid = side.withColumn("_by", F.explode(F.sequence(F.lit(0).cast("long"), "_g"))).drop("_g").join(cells, [*keys, "_bx", "_by"], "left")
    after = lambda part, by: F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, part).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = grid.withColumn("_c", after("_bx", "_by")).withColumn("_c", after("_by", "_bx"))
    asked = queries.groupBy(*keys, "_b", "_bx", "_by").agg(F.count("*").alias("_q"))
    later = asked.hint("merge").join(above, [*keys, "_bx", "_by"]).select("_b", (F.col("_q") * F.col("_c")).alias("_d"))
    return same_x.unionByName(later_x).unionByName(later).groupBy("_b").agg(F.sum("_d").alias("_d"))


def _ranked(df: DataFrame, keys: list[str], ids: list[str], x: str, y: str) -> DataFrame:
    """Rows with, for both values, rows below, ties, a position of their own, the centred rank, and its sums above each row."""
    rows = df
    for v, c in (("x", x), ("y", y)):
        level = ordered_totals(rows, keys, c, {"n": F.lit(1)}).select(*keys, c, F.col("n_before").alias(f"_l{v}"), F.col("n").alias(f"_e{v}"), F.col("n_all").alias("_n"))
        place = positions(rows.withColumn("_o", F.struct(c, *ids)), keys, "_o").select(*keys, F.col("_o.*"), F.col("position").alias(f"_p{v}"))
        rows = rows.drop("_n").join(level.hint("merge"), [*keys, c]).join(place.hint("merge"), [*keys, c, *ids])
        rows = rows.withColumn(f"_{v}", F.col(f"_l{v}") + (F.col(f"_e{v}") - F.col("_n")) / 2)
    rows = cut(rows)
    for v, c in (("x", x), ("y", y)):
        level = ordered_totals(rows, keys, c, {"a": F.col("_x"), "b": F.col("_y")})
        above = lambda t: (F.col(f"{t}_all") - F.col(f"{t}_before") - F.col(t) / 2)
        rows = rows.join(level.hint("merge").select(*keys, c, above("a").alias(f"_x_{v}"), above("b").alias(f"_y_{v}")), [*keys, c])
    return cut(rows)


def spearman_paired(df: DataFrame, keys: Sequence[str], block: str, ids: Sequence[str], x: str, y: str, out: str, only: DataFrame,
                    min_rows: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``(keys, block, out)``: Spearman over the rows of other blocks, for the blocks (keys, block) of ``only``, by pairs inside a block."""
    keys = list(keys)
    rows = _ranked(df.select(*dict.fromkeys([*keys, block, *ids, x, y])), keys, list(ids), x, y)
    named = ["_lx", "_ex", "_ly", "_ey", "_x", "_y", "_x_x", "_x_y", "_y_x", "_y_y"]
    packed = rows.join(only, [*keys, block], "left_semi").groupBy(*keys, block, "_n").agg(F.collect_list(F.struct("_px", *named)).alias("_m"))
    packed = cut(packed.withColumn("_b", F.monotonically_increasing_id()))
    pairs = packed.select(*keys, "_b", "_n", "_m", F.explode("_m").alias("i")).select(*keys, "_b", "_n", "i", F.explode("_m").alias("j"))
    steps = lambda v, r: F.array(F.col(f"{r}._l{v}"), F.col(f"{r}._l{v}") + F.col(f"{r}._e{v}"))  # at or above, above: a tie counts half
    # pairs and queries are many times what Spark takes them for: no join broadcasts them
    asked = pairs.select(*keys, "_b", F.explode(steps("x", "i")).alias("_tx"), "j").select(*keys, "_b", "_tx", F.explode(steps("y", "j")).alias("_ty"))
    both = dominance_sums(rows, asked, keys, bucket)
    below = lambda v: F.when(F.col(f"j._l{v}") < F.col(f"i._l{v}"), 1.0).when(F.col(f"j._l{v}") == F.col(f"i._l{v}"), 0.5).otherwise(0.0)

    def square(v):  # rows above both, ties of both a quarter
        tied = F.col(f"j._l{v}") == F.col(f"i._l{v}")
        upper = F.greatest(F.struct(F.col(f"i._l{v}").alias("l"), F.col(f"i._e{v}").alias("e")), F.struct(F.col(f"j._l{v}").alias("l"), F.col(f"j._e{v}").alias("e")))
        return F.col("_n") - upper["l"] - upper["e"] * F.when(tied, 0.75).otherwise(0.5)

    inner = pairs.groupBy("_b", "_n", "i").agg(F.count("*").alias("_k"), *[F.sum(below(v)).alias(f"_c{v}") for v in "xy"], *[F.sum(square(v)).alias(f"_q{v}") for v in "xy"])
    left = {v: F.col(f"i._{v}") - (F.col(f"_c{v}") - F.col("_k") / 2) for v in "xy"}  # centred ranks of the deleted rows, as if they had stayed
    total = {v: F.col("_n") - F.col(f"i._l{v}") - F.col(f"i._e{v}") / 2 for v in "xy"}
    sums = inner.groupBy("_b").agg(
        F.max("_k").alias("_k"), *[F.sum(left[a] * left[b]).alias(f"_in_{a}{b}") for a, b in ("xx", "yy", "xy")],
        *[F.sum(total[v]).alias(f"_t{v}") for v in "xy"], *[F.sum(f"_q{v}").alias(f"_q{v}") for v in "xy"],
        *[F.sum(f"i._{a}_{b}").alias(f"_s{a}{b}") for a in "xy" for b in "xy"])
    whole = rows.groupBy(*keys).agg(*[F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"_{a}{b}") for a, b in ("xx", "yy", "xy")])
    got = packed.drop("_m").hint("merge").join(sums, "_b").join(both.hint("merge"), "_b", "left").join(whole, keys)
    even = F.col("_n") * F.col("_k") * F.col("_k") / 4
    k, c = F.col("_k"), F.col
    xx = c("_xx") - 2 * c("_sxx") + c("_qx") - k * c("_tx") + even - c("_in_xx")
    yy = c("_yy") - 2 * c("_syy") + c("_qy") - k * c("_ty") + even - c("_in_yy")
    xy = c("_xy") - c("_sxy") - c("_syx") + F.coalesce("_d", F.lit(0)) / 4 - k / 2 * (c("_tx") + c("_ty")) + even - c("_in_xy")
    rest = F.col("_n") - k
    spread = rest * (rest - 1) / 8  # the least sum of squares of ranks that differ is twice this
    return got.select(*keys, block, F.when((rest >= min_rows) & (xx > spread) & (yy > spread), xy / F.sqrt(xx * yy)).alias(out))


def spearman_without(df: DataFrame, keys: Sequence[str], block: str, ids: Sequence[str], x: str, y: str, out: str, paired: int = PAIRED, bucket: int = BUCKET) -> DataFrame:
    """``(keys, block, out)``: Spearman without the rows of a block, for every block of a key. Rows without a block or a value take no part.

    Blocks of over ``paired`` rows, or more than the root of their key's, are few: the rest is ranked again for each of them.
    """
    keys = list(keys)
    rows = cut(df.where(F.col(block).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()))
    sizes = cut(rows.groupBy(*keys, block).agg(F.count("*").alias("_k")).join(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys))
    small = (F.col("_k") <= paired) & (F.col("_k") * F.col("_k") <= F.col("_n"))
    pick = lambda c: sizes.where(c).select(*keys, block)
    few = pick(~small).withColumnRenamed(block, "_without")
    again = spearman(rows.join(few, keys).where(F.col(block) != F.col("_without")), [*keys, "_without"], x, y, out)
    return spearman_paired(rows, keys, block, ids, x, y, out, pick(small), bucket=bucket).unionByName(
        again.select(*keys, F.col("_without").alias(block), out))
