"""Fold-local scaling, distance-weighted nearest-neighbour completion, feature and row screens."""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators.ordered import exact_quantiles
from kinfold.operators.rollup import medians
from kinfold.session import cut

CHUNK = 8192
BOXES = 4096
CELLS = 4_000_000  # box bounds are computed for so many (row, box, component) cells at a time
RECIPIENTS = 65_536  # the most a task holds while donors stream past
FIRST = 1_024
STATE = ["chunk", "fold", "pattern", "x", "distance", "donor", "value"]


def training_cells(df: DataFrame, record: str, own_fold: str, folds: int, features: Sequence[str]) -> DataFrame:
    """(fold, feature, value) of training rows: each row trains every fold but its own."""
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col(own_fold)))
    # unpivot reads each column once; an exploded array would be copied by the optimiser into the filters it infers
    cells = df.unpivot([record, own_fold], list(features), "feature", "value").where(F.col("value").isNotNull())
    return cells.select(record, others.alias("fold"), "feature", "value")


def robust_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median and IQR of log1p values per (fold, feature); zero IQR becomes 1."""
    logs = cells.withColumn("_z", F.log1p("value"))
    q = exact_quantiles(logs, keys, {"center": ("_z", 0.5), "_a": ("_z", 0.25), "_b": ("_z", 0.75)})
    iqr = F.col("_b") - F.col("_a")
    return q.select(*keys, "center", F.when(iqr > 0, iqr).otherwise(F.lit(1.0)).alias("scale"))


def standard_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population sd of log1p values per (fold, feature); zero sd becomes 1."""
    agg = cells.groupBy(*keys).agg(F.avg(F.log1p("value")).alias("center"), F.stddev_pop(F.log1p("value")).alias("_s"))
    return agg.select(*keys, "center", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0)).alias("scale"))


def scaled_rows(df: DataFrame, stats: DataFrame, record: str, own_fold: str, folds: int, features: Sequence[str]) -> DataFrame:
    """(fold, record, is_training, x array) scaled with each fold's statistics.

    The statistics of a fold are one row with a struct per feature; there are folds x features of them.
    """
    wide = stats.groupBy("fold").agg(*[
        F.max(F.when(F.col("feature") == f, F.struct("center", "scale"))).alias(f"_s_{f}") for f in features])
    rows = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(wide, "fold")
    z = [(F.log1p(F.col(f)) - F.col(f"_s_{f}.center")) / F.col(f"_s_{f}.scale") for f in features]
    return rows.select("fold", record, (F.col("fold") != F.col(own_fold)).alias("is_training"), F.array(*z).alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, p: int) -> np.ndarray:
    """Lists of ``p`` doubles as rows, null as NaN."""
    return np.array(pc.list_flatten(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column])).to_numpy(), dtype=float).reshape(-1, p)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


@np.errstate(all="ignore")
def _distances(want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Distances over the components that both have (NaN without one), summed in their order: rows and columns broadcast."""
    p = want.shape[-1]
    total = common = 0.0
    for j in range(p):
        gap = want[..., j] - have[..., j]
        seen = ~np.isnan(gap)
        total = total + np.where(seen, gap * gap, 0.0)
        common = common + seen
    return np.where(common > 0, np.sqrt(p / common * total), np.nan)


@np.errstate(all="ignore")  # infinite values end in full comparisons
def nearest_donors(want: np.ndarray, have: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, component, donor, distance)`` of the k nearest donors of every missing cell; equal distances go to the earlier donor.

    Matrix products give all distances up to rounding. The few smallest of a row are computed again as sums in order, and
    stand where the k-th of them is below all others by more than that rounding; other rows are computed in full.
    """
    p, n = want.shape[1], len(have)
    lacks, usable = np.isnan(want), ~np.isnan(have)
    b, mb = np.nan_to_num(have), usable.astype(float)
    b2, longest = b * b, float((b * b).sum(1).max(initial=0.0))
    out = []

    def pick(rows: np.ndarray, donors: np.ndarray, exact: np.ndarray, beyond: np.ndarray | None) -> np.ndarray:
        """Appends the nearest of each row's ``donors`` (in order); returns rows for which others may be as near as ``beyond``."""
        unsure = np.zeros(len(rows), bool)
        found = []
        for j in range(p):
            own = np.flatnonzero(lacks[rows, j])
            if not len(own):
                continue
            d = np.where(usable[donors[own], j] & ~np.isnan(exact[own]), exact[own], np.inf)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, best, axis=1)
            if beyond is not None:
                unsure[own] |= ~(dist[:, -1] ** 2 * (1 + 1e-12) < beyond[own]) if best.shape[1] == k else True
            found.append((own, j, np.take_along_axis(donors[own], best, axis=1), dist))
        for own, j, chosen, dist in found:
            ok = np.isfinite(dist) & ~unsure[own][:, None]
            out.append((np.repeat(rows[own], dist.shape[1])[ok.ravel()], np.full(int(ok.sum()), j), chosen[ok], dist[ok]))
        return rows[unsure]

    few = 4 * k + 16
    again = np.flatnonzero(lacks.any(1))
    if n > 2 * few:
        step, wanted, again = max(1, CELLS // (2 * n)), again, []
        for at in range(0, len(wanted), step):
            rows = wanted[at:at + step]
            a, ma = np.nan_to_num(want[rows]), (~lacks[rows]).astype(float)
            total = (a * a) @ mb.T
            total -= 2 * (a @ b.T)
            total += ma @ b2.T
            # a product or sum of p terms is off by p roundings of its size at most, and common components are counted exactly
            slack = 16 * (p + 4) * np.finfo(float).eps * ((a * a).sum(1) + longest) * p
            common = ma @ mb.T
            total *= p / common
            total[common == 0] = np.inf
            donors = np.argpartition(total, few, axis=1)[:, :few + 1]
            edge = np.take_along_axis(total, donors[:, few:], axis=1)[:, 0] - slack
            donors = np.sort(donors[:, :few], axis=1)
            again.append(pick(rows, donors, _distances(want[rows][:, None], have[donors]), edge))
        again = np.concatenate(again) if again else np.zeros(0, int)
    step = max(1, CELLS // (8 * max(n, 1)))
    for at in range(0, len(again), step):
        rows = again[at:at + step]
        pick(rows, np.broadcast_to(np.arange(n), (len(rows), n)), _distances(want[rows][:, None], have[None]), None)
    if not out:
        return (np.zeros(0, int),) * 3 + (np.zeros(0),)
    return tuple(np.concatenate(c) for c in zip(*out))


def lower_bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray, seen_by: np.ndarray, size: np.ndarray, lacks: np.ndarray) -> np.ndarray:
    """(row, box) matrix: no donor of the box is nearer to the row than this.

    ``low`` / ``high`` / ``seen_by`` are (box, component): range of the observed values (NaN if no donor has the
    component) and how many donors have it; ``size`` is the number of donors and ``lacks`` the most components
    that one donor lacks of those that others of its box have. The distance is the root of p times the mean
    squared gap over common components. A donor drops at most ``lacks`` components from that mean, so the
    smallest mean after taking out that many of the largest gaps bounds it. Infinite if nothing is in common.
    """
    p = x.shape[1]
    gap = np.maximum(np.maximum(low[None] - x[:, None, :], x[:, None, :] - high[None]), 0.0)
    common = ~np.isnan(gap)
    square = np.where(common, gap * gap, 0.0)
    total, n = square.sum(axis=2), common.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, total / n, np.inf)
        most = int(lacks.max(initial=0))
        if most:
            loose = common & (seen_by < size[:, None])[None]
            largest = -np.sort(-np.where(loose, square, 0.0), axis=2)[:, :, :most]
            out = np.cumsum(largest, axis=2)
            allowed = np.minimum(loose.sum(axis=2), lacks[None])
            for t in range(1, most + 1):
                left = np.where((t <= allowed) & (n > t), (total - out[:, :, t - 1]) / (n - t), np.inf)
                mean = np.minimum(mean, left)
    # the differences above lose at most rounding errors of the total
    return np.sqrt(np.maximum(p * (mean - 1e-12 * total), 0.0)) * (1 - 1e-9)


def _chosen(x: np.ndarray, box: dict[str, np.ndarray], k: int, reach: np.ndarray | None) -> np.ndarray:
    """(row, box) matrix: the nearest boxes that hold k donors for each missing component, or with ``reach`` all others within it."""
    bound = lower_bounds(x, box["low"], box["high"], box["seen_by"], box["size"], box["lacks"])
    order = np.argsort(bound, axis=1, kind="stable")
    miss = np.isnan(x)
    have = np.cumsum(box["seen_by"][order], axis=1)
    enough = ((have >= k) | ~miss[:, None, :]).all(axis=2)
    # nearest boxes up to the first that completes k donors for every missing component, else all
    last = np.where(enough.any(axis=1), enough.argmax(axis=1), enough.shape[1] - 1)
    first = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(first, order, np.arange(bound.shape[1])[None] <= last[:, None], axis=1)
    if reach is None:
        return first
    needed = (miss[:, None, :] & (box["seen_by"] > 0)[None] & (bound[:, :, None] <= reach[:, None, :])).any(axis=2)
    return needed & ~first & np.isfinite(bound)


def _choices(batch: pa.RecordBatch, boxes: dict[int, dict[str, np.ndarray]], k: int, reach_of) -> Iterator[tuple]:
    """``(fold, box, part, x, at, chosen)``: rows of a batch a piece at a time, of each fold that has boxes."""
    folds = batch.column("fold").to_numpy()
    for fold in np.unique(folds):
        if fold not in boxes:
            continue
        box = boxes[fold]
        part = batch.filter(pa.array(folds == fold))
        x = _matrix(part.column("x"), box["low"].shape[1])
        reach = reach_of(part, x)
        step = max(1, CELLS // box["low"].size)
        for at in range(0, len(x), step):
            yield fold, box, part, x, at, _chosen(x[at:at + step], box, k, None if reach is None else reach[at:at + step])


def _route(boxes: dict[int, dict[str, np.ndarray]], k: int, again: bool):
    def reach_of(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray | None:
        if not again:
            return None
        reach = _matrix(part.column("reach"), x.shape[1])
        return np.where(np.isnan(reach), np.inf, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("fold", pa.int32()), ("pattern", batch.schema.field("pattern").type), ("x", pa.list_(pa.float64())), ("box", pa.int32())])
            for fold, box, part, x, at, chosen in _choices(batch, boxes, k, reach_of):
                rows, cols = np.nonzero(chosen)
                for low in range(0, len(rows), 1 << 16):
                    own = at + rows[low:low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), fold), pa.int32()), part.column("pattern").take(pa.array(own)), _lists(x[own]),
                        pa.array(box["box"][cols[low:low + (1 << 16)]], pa.int32())], schema=schema)
    return run


def _meet(boxes: dict[int, dict[str, np.ndarray]], k: int, again: bool):
    def reach_of(part: pa.RecordBatch, x: np.ndarray) -> np.ndarray | None:
        if not again:
            return None
        reach = np.full(x.shape, -np.inf)
        reach[np.isnan(x)] = _flat(part.column("distance")).reshape(-1, k)[:, -1]
        return reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int32()), ("fold", pa.int32()), ("box", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for fold, box, part, _, at, chosen in _choices(batch, boxes, k, reach_of):
                chunks = part.column("chunk").to_numpy()[at:at + len(chosen)]
                for chunk in np.unique(chunks):
                    n = chosen[chunks == chunk].sum(0)
                    met = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(met), chunk), pa.int32()), pa.array(np.full(len(met), fold), pa.int32()),
                        pa.array(box["box"][met], pa.int32()), pa.array(n[met], pa.int64())], schema=schema)
    return run


def _curve(x: str) -> Column:
    """A space-filling key: the leading bits of all squashed components, then the next."""
    level = F.transform(x, lambda v: F.when(v.isNull(), 4).otherwise(F.floor(F.lit(7.999) / (1 + F.exp(-v)))).cast("int"))
    bit = lambda i: F.array_join(F.transform(level, lambda q: F.shiftright(q, i).bitwiseAND(F.lit(1)).cast("string")), "")
    return F.concat(bit(2), bit(1), bit(0))


def donor_boxes(donors: DataFrame, p: int, chunk: int = CHUNK) -> tuple[DataFrame, dict[int, dict[str, np.ndarray]]]:
    """Donors (fold, record, x) with a box each, and per fold the boxes' ranges.

    Donors are ordered by missing mask, then by a space-filling key (the leading bits of all squashed
    components, then the next), and cut by range into boxes of about ``chunk`` rows; at most ``BOXES`` of them, so the
    table of ranges that the tasks get is bounded by configuration: (BOXES + folds) x p entries.
    """
    n = donors.count()
    count = max(1, min(BOXES, math.ceil(n / chunk)))
    mask = F.array_join(F.transform("x", lambda v: F.when(v.isNull(), "1").otherwise("0")), "")
    placed = cut(donors.withColumns({"_m": mask, "_c": _curve("x")}).repartitionByRange(count, "fold", "_m", "_c", "record").select(
        "fold", "record", "x", F.spark_partition_id().alias("box")))
    ranges = placed.select("fold", "box", F.posexplode("x").alias("j", "v")).groupBy("fold", "box", "j").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("seen_by"), F.count("*").alias("size")).toPandas()
    gaps = placed.groupBy("fold", "box").agg(F.max(F.size(F.filter("x", lambda v: v.isNull()))).alias("lacks")).toPandas().set_index(["fold", "box"])["lacks"]
    out = {}
    for fold, part in ranges.sort_values(["box", "j"]).groupby("fold"):
        grid = lambda c: part[c].to_numpy(dtype=float).reshape(-1, p)
        names = part["box"].to_numpy()[::p]
        seen_by = grid("seen_by")
        out[int(fold)] = {"box": names, "low": grid("low"), "high": grid("high"), "seen_by": seen_by, "size": grid("size")[:, 0],
                          "lacks": np.array([gaps[(fold, b)] for b in names]) - (seen_by == 0).sum(axis=1)}
    return placed, out


def routed(patterns: DataFrame, boxes: dict[int, dict[str, np.ndarray]], k: int) -> DataFrame:
    """(fold, pattern, x, box): the boxes a recipient has to be compared with.

    Without a column ``reach``, its nearest boxes that hold k donors for each missing component. With
    ``reach`` (per component the distance of the k-th donor found so far, null: unbounded), all further boxes within it.
    """
    kind = patterns.schema["pattern"].dataType.simpleString()
    return patterns.mapInArrow(_route(boxes, k, "reach" in patterns.columns), f"fold int, pattern {kind}, x array<double>, box int")


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False)


def _order(ids: np.ndarray) -> np.ndarray:
    """Integers in the order of the ids, null first."""
    if ids.dtype.kind in "iu":
        return ids
    place = {v: i for i, v in enumerate(sorted(set(ids.tolist()), key=lambda v: (v is not None, v)))}
    return np.array([place[v] for v in ids.tolist()], np.int64)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist() + [None], dtype=object)[:-1] if column.null_count else column.to_numpy(zero_copy_only=False)


class Nearest:
    """The k nearest donors so far of every missing cell of some recipients, while donors pass by."""

    def __init__(self, x: np.ndarray, k: int, distance: np.ndarray | None = None, donor: np.ndarray | None = None, value: np.ndarray | None = None):
        self.x, self.k, self.lacks = x, k, np.isnan(x)
        self.row, self.component = np.nonzero(self.lacks)
        self.number = np.full(x.shape, -1, np.int32)
        self.number[self.lacks] = np.arange(len(self.row))
        size = (len(self.row), k)
        self.distance = np.full(size, np.inf) if distance is None else np.array(distance).reshape(size)
        self.value = np.full(size, np.nan) if value is None else np.array(value).reshape(size)
        self.donor = None if donor is None else np.array(donor).reshape(size)
        #: Per missing cell the distance of its k-th donor; no donor beyond can be chosen.
        self.reach = np.full(x.shape, -np.inf)
        self.reach[self.lacks] = self.distance[:, -1]

    def meet(self, have: np.ndarray, ids: np.ndarray, box: dict[str, np.ndarray]) -> None:
        """Takes in donors of a box, whose ranges ``box`` holds in its only row."""
        order = np.argsort(_order(ids), kind="stable")
        have, ids = have[order], ids[order]
        if self.donor is None:
            self.donor = np.full(self.distance.shape, ids[0], dtype=ids.dtype)
        elif self.donor.dtype != ids.dtype:
            self.donor, ids = self.donor.astype(object), ids.astype(object)
        step = max(1, CELLS // have.shape[1])
        bound = np.concatenate([lower_bounds(self.x[at:at + step], *[box[c] for c in ("low", "high", "seen_by", "size", "lacks")])[:, 0]
                                for at in range(0, len(self.x), step)]) if len(self.x) else np.zeros(0)
        held = box["seen_by"][0] > 0
        at = 0
        while at < len(have):
            far = np.where(held, self.reach, -np.inf).max(axis=1, initial=-np.inf)
            rows = np.flatnonzero((bound <= far) & np.isfinite(bound))
            unbounded = np.isinf(far[rows])
            # until a row has k donors for its cells it meets a few at a time
            to = min(len(have), at + FIRST) if unbounded.any() else len(have)
            if unbounded.any():
                self._whole(rows[unbounded], have[at:to], ids[at:to])
            self._within(rows[~unbounded], far[rows[~unbounded]], have[at:to], ids[at:to])
            at = to

    def _whole(self, rows: np.ndarray, have: np.ndarray, ids: np.ndarray) -> None:
        row, component, donor, distance = nearest_donors(self.x[rows], have, self.k)
        self._merge(self.number[rows[row], component], distance, ids[donor], have[donor, component])

    @np.errstate(all="ignore")  # what overflows in single precision goes to _whole
    def _within(self, rows: np.ndarray, far: np.ndarray, have: np.ndarray, ids: np.ndarray) -> None:
        """Donors within a finite distance ``far`` of a row, by one product of single precision.

        The squared distance times common components over p is at most ``far`` squared times them over p, which is linear in the donor's
        components, their squares and its mask. A product of 3p terms is off by so many roundings of the terms' sizes at most; what may be
        within is computed again as a sum in order.
        """
        p, usable, b = have.shape[1], ~np.isnan(have), np.nan_to_num(have)
        right = np.concatenate([usable, b, b * b], axis=1).astype(np.float32).T
        longest = float((b * b).sum(1).max(initial=0.0))
        step = max(1, CELLS // max(len(have), 1))
        for at in range(0, len(rows), step):
            own = rows[at:at + step]
            a, seen = np.nan_to_num(self.x[own]), ~self.lacks[own]
            left = np.concatenate([a * a - (far[at:at + step] ** 2 / p * (1 + 1e-12))[:, None] * seen, -2 * a, seen], axis=1)
            size = np.abs(left[:, :p]).sum(1) + 2 * np.sqrt((a * a).sum(1) * longest) + longest
            sure = size < 1e30  # else single precision may overflow
            if not sure.all():
                self._whole(own[~sure], have, ids)
                own, left, size = own[sure], left[sure], size[sure]
            slack = ((3 * p + 32) * 2.0 ** -24 * 1.01 * size + 1e-30).astype(np.float32)
            row, donor = np.divmod(np.flatnonzero(left.astype(np.float32) @ right <= slack[:, None]), len(have))
            for low in range(0, len(row), 1 << 16):
                r, d = own[row[low:low + (1 << 16)]], donor[low:low + (1 << 16)]
                distance = _distances(self.x[r], have[d])
                pair, component = np.nonzero(usable[d] & (distance[:, None] <= self.reach[r]))
                self._merge(self.number[r[pair], component], distance[pair], ids[d[pair]], have[d[pair], component])

    def _merge(self, cell: np.ndarray, distance: np.ndarray, donor: np.ndarray, value: np.ndarray) -> None:
        """The k nearest of each cell's old donors and new ones; equal distances go to the smaller id."""
        if not len(cell):
            return
        touched = np.unique(cell)
        cells = np.concatenate([np.repeat(touched, self.k), cell])
        all_ = [np.concatenate([old[touched].ravel(), new]) for old, new in ((self.distance, distance), (self.donor, donor), (self.value, value))]
        order = np.lexsort((_order(all_[1]), all_[0], cells))
        chosen = order[np.searchsorted(cells[order], touched)[:, None] + np.arange(self.k)]
        self.distance[touched], self.donor[touched], self.value[touched] = (c[chosen] for c in all_)
        self.reach[self.row[touched], self.component[touched]] = self.distance[touched, -1]


def _stream(k: int, p: int, boxes: dict[int, dict[str, np.ndarray]]):
    """Runs over rows sorted by chunk, fold and turn: recipients first, then donors box by box."""
    where = {(fold, int(name)): (box, i) for fold, box in boxes.items() for i, name in enumerate(box["box"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], None

        def begin() -> Nearest:
            state = lambda c, values=_flat: np.concatenate([values(h.column(c)) for h in held])
            x = np.concatenate([_matrix(h.column("x"), p) for h in held])
            if held[0].column("distance").null_count:
                return Nearest(x, k)
            return Nearest(x, k, state("distance"), state("donor", lambda c: _ids(pc.list_flatten(c))), state("value"))

        def end() -> Iterator[pa.RecordBatch]:
            done = found or (begin() if held else None)
            at = 0
            for h in held:
                own = (np.searchsorted(done.row, [at, at + len(h)])) * k
                first = np.searchsorted(done.row, np.arange(at, at + len(h) + 1)) * k - own[0]
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), c) for c in (
                    pa.array(done.distance.ravel()[own[0]:own[1]]),
                    pa.nulls(own[1] - own[0], h.schema.field("donor").type.value_type) if done.donor is None else
                    pa.array(done.donor.ravel()[own[0]:own[1]], h.schema.field("donor").type.value_type),
                    pa.array(done.value.ravel()[own[0]:own[1]]))]
                at += len(h)
                yield pa.RecordBatch.from_arrays([h.column(c) for c in ("chunk", "fold", "pattern", "x")] + lists, names=STATE)

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("chunk", "fold", "turn", "box")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1 if len(batch) else []
            for low, high in zip([0, *edges], [*edges, len(batch)]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                own = (int(keys[0][low]), int(keys[1][low]))
                if own != key:
                    yield from end()
                    key, held, found = own, [], None
                if keys[3][low] < 0:
                    held.append(part)
                    continue
                if found is None:
                    found = begin()
                box, i = where[own[1], int(keys[3][low])]
                found.meet(_matrix(part.column("x"), p), _ids(part.column("record")), {c: box[c][i:i + 1] for c in ("low", "high", "seen_by", "size", "lacks")})
        yield from end()
    return run


def _search(patterns: DataFrame, donors: DataFrame, pairs: DataFrame, boxes: dict[int, dict[str, np.ndarray]], k: int, p: int, chunks: int) -> DataFrame:
    """``patterns`` with their nearest donors among the boxes that their chunk meets: lists of k entries for each missing component.

    A task holds the recipients of a chunk, and the donors stream past them, those of the box that most of them are near to first.
    """
    record = donors.schema["record"].dataType.simpleString()
    null = lambda kind: F.lit(None).cast(kind)
    state = lambda c, kind: F.col(c) if c in patterns.columns else null(kind)
    lists = {"distance": "array<double>", "donor": f"array<{record}>", "value": "array<double>"}
    left = patterns.select("chunk", "fold", F.lit(-1).cast("long").alias("turn"), F.lit(-1).alias("box"), "pattern", null(record).alias("record"), "x",
                           *[state(c, kind).alias(c) for c, kind in lists.items()])
    pattern = patterns.schema["pattern"].dataType.simpleString()
    turn = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("chunk", "fold").orderBy(F.desc("n"), "box")).cast("long"))  # a row per chunk and box
    right = donors.join(turn, ["fold", "box"]).select("chunk", "fold", "turn", "box", null(pattern).alias("pattern"), "record", "x", *[null(kind).alias(c) for c, kind in lists.items()])
    rows = left.union(right).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "fold", "turn")
    return rows.mapInArrow(_stream(k, p, boxes), f"chunk int, fold int, pattern {pattern}, x array<double>, " + ", ".join(f"{c} {kind}" for c, kind in lists.items()))


def _means(k: int, p: int):
    """Inverse-distance means per missing cell that has a donor; the mean of those at distance 0 if there are any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, component = np.nonzero(np.isnan(_matrix(batch.column("x"), p)))
            distance, value = (_flat(batch.column(c)).reshape(-1, k) for c in ("distance", "value"))
            used = np.isfinite(distance)
            same = distance == 0
            weight = np.where(same.any(1)[:, None], same, np.where(used, 1 / np.where(used & ~same, distance, 1), 0.0))
            total = weight.sum(1)
            has = np.flatnonzero(total > 0)
            z = (np.where(weight > 0, value, 0.0) * weight).sum(1)[has] / total[has]
            yield pa.RecordBatch.from_arrays([
                batch.column("fold").take(pa.array(row[has])), batch.column("pattern").take(pa.array(row[has])), pa.array(component[has], pa.int32()), pa.array(z)],
                names=["fold", "pattern", "feature_index", "z"])
    return run


def knn_completion(scaled: DataFrame, record: str, features: Sequence[str], k: int, chunk: int = CHUNK) -> DataFrame:
    """(fold, record, feature, z) for every missing cell: inverse-distance mean of the k nearest donors.

    The search is exact but compares only what it must. Donors lie in boxes (see ``donor_boxes``); a task holds a chunk of recipients
    and the donors of those boxes stream past that hold k donors for each missing component nearest to one of them. The k-th
    distances found so far bound what a recipient is compared with, and a second search over all other boxes that can hold a nearer or
    equally near donor. Only the k nearest leave a task.
    Copies are merged first and stay exact: recipients with the same pattern share one search, and of donors
    with the same vector only the k smallest ids can ever be chosen. A cell without any usable donor gets the training mean.
    Ids may be of any type; equal distances go to the smaller id.
    """
    scaled = cut(scaled)
    p = len(features)
    has_gap = F.exists("x", lambda v: v.isNull())
    recipients = scaled.where(has_gap).select("fold", record, "x")
    patterns = cut(recipients.select("fold", "x").distinct())
    same = Window.partitionBy("fold", "x").orderBy(record)
    donors, boxes = donor_boxes(cut(scaled.where("is_training").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).select(
        "fold", F.col(record).alias("record"), "x")), p, chunk)
    # as many chunks as cores, or a multiple of them: donors travel once per chunk
    cores = scaled.sparkSession.sparkContext.defaultParallelism
    chunks = cores * max(1, math.ceil(patterns.count() / (cores * RECIPIENTS)))
    patterns = cut(patterns.withColumns({"_c": _curve("x"), "_h": F.xxhash64("x")}).repartitionByRange(chunks, "fold", "_c", "_h").select(
        F.spark_partition_id().alias("chunk"), "fold", F.monotonically_increasing_id().alias("pattern"), "x"))
    meets = lambda rows, again: cut(rows.mapInArrow(_meet(boxes, k, again), "chunk int, fold int, box int, n long").groupBy("chunk", "fold", "box").agg(F.sum("n").alias("n")))
    first = meets(patterns, False)
    near = cut(_search(patterns, donors, first, boxes, k, p, chunks))
    if any(len(b["box"]) > 1 for b in boxes.values()):
        more = cut(meets(near, True).join(first, ["chunk", "fold", "box"], "left_anti"))
        if not more.isEmpty():
            wanting = more.select("chunk", "fold").distinct()
            near = near.join(wanting, ["chunk", "fold"], "left_anti").unionByName(
                _search(near.join(wanting, ["chunk", "fold"], "left_semi"), donors, more, boxes, k, p, chunks))
    filled = near.mapInArrow(_means(k, p), "fold int, pattern long, feature_index int, z double")
    means = scaled.where("is_training").groupBy("fold").agg(F.array(*[F.avg(F.col("x")[j]) for j in range(len(features))]).alias("_mean"))
    gaps = recipients.join(patterns.drop("chunk"), ["fold", "x"]).select(
        "fold", record, "pattern", F.posexplode("x").alias("feature_index", "v")).where("v is null").drop("v")
    names = F.array(*[F.lit(f) for f in features])
    return gaps.join(filled, ["fold", "pattern", "feature_index"], "left").join(means, "fold").select(
        "fold", record, F.element_at(names, F.col("feature_index") + 1).alias("feature"),
        F.coalesce("z", F.element_at("_mean", F.col("feature_index") + 1)).alias("z"), F.col("z").isNotNull().alias("from_donors"))


def complete(df: DataFrame, record: str, own_fold: str, folds: int, features: Sequence[str], k: int, robust: bool = True) -> DataFrame:
    """Completed raw values of the missing cells: (fold, record, feature, value)."""
    cells = training_cells(df, record, own_fold, folds, features)
    stats = cut((robust_stats if robust else standard_stats)(cells, ["fold", "feature"]))
    z = knn_completion(scaled_rows(df, stats, record, own_fold, folds, features), record, features, k)
    return z.join(stats, ["fold", "feature"]).select(
        "fold", record, "feature", F.greatest(F.expm1(F.col("z") * F.col("scale") + F.col("center")), F.lit(0.0)).alias("value"))


def fold_feature_screen(cells_missing: DataFrame, max_missing: float, excluded: Sequence[str]) -> DataFrame:
    """Kept features per fold from (fold, feature, missing_share) of the training rows."""
    return cells_missing.where((F.col("missing_share") <= max_missing) & ~F.col("feature").isin(*excluded)).select("fold", "feature", "missing_share")


def fold_missingness(df: DataFrame, own_fold: str, folds: int, features: Sequence[str]) -> DataFrame:
    """Missing share per (fold, feature) over training rows: totals minus the fold's own rows."""
    own = df.groupBy(F.col(own_fold).alias("fold")).agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    long = own.unpivot(["fold", "n"], list(features), "feature", "m")
    others = lambda c: (F.sum(c).over(Window.partitionBy("feature")) - F.col(c)).cast("double")  # one row per fold and feature
    return long.select("fold", "feature", F.try_divide(others("m"), others("n")).alias("missing_share"))


def masked_recovery(df: DataFrame, record: str, features: Sequence[str], k: int, fraction: float, minimum: int, repeats: int, seed: int) -> DataFrame:
    """Hide observed cells, complete them, compare: Pearson and MAE / IQR per (repeat, feature)."""
    from functools import reduce

    from kinfold.operators.resample import random_mask

    base = cut(df.select(record, *features))
    cells = base.unpivot(record, list(features), "feature", "value").where("value is not null")
    out = []
    for repeat in range(1, repeats + 1):
        hidden = cut(random_mask(cells, ["feature"], record, fraction, minimum, f"{seed}:{repeat}"))
        gone = hidden.groupBy(record).agg(F.collect_set("feature").alias("_gone"))
        shown = base.join(gone, record, "left").select(record, F.lit(-1).alias("own_fold"), *[
            F.when(~F.coalesce(F.array_contains("_gone", f), F.lit(False)), F.col(f)).alias(f) for f in features])
        guess = complete(shown, record, "own_fold", 1, features, k)
        out.append(hidden.join(cells, ["feature", record]).join(guess.select(record, "feature", F.col("value").alias("guess")), ["feature", record]).withColumn("repeat", F.lit(repeat)))
    both = cut(reduce(DataFrame.unionByName, out).withColumn("err", F.abs(F.col("value") - F.col("guess"))))
    q = exact_quantiles(both, ["repeat", "feature"], {"_a": ("value", 0.25), "_b": ("value", 0.75)}, also=[
        F.count("*").alias("masked"), F.corr("value", "guess").alias("pearson_r"), F.avg("err").alias("_mae")])
    return q.select("repeat", "feature", "masked", "pearson_r", (F.col("_mae") / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-12))).alias("normalized_mae"))
