"""Binary and multiclass metrics per key, from counts and running totals.

Rank metrics (AUC, average precision, curves) go through :mod:`ordered`, so one (model, repeat)
may hold any number of rows. Everything else is one partial aggregation.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.operators.ordered import HOT_ROWS, attach, below, largest_key, ordered_totals, row_ranks, with_buckets
from kinfold.session import cut


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


# --- binary ------------------------------------------------------------------------------------

def score_levels(df: DataFrame, keys: Sequence[str], target: str, score: str,
                 weight: Column | None = None, max_rows: int | None = None) -> DataFrame:
    """Per distinct score: positives and negatives at, below (``_before``) and overall (``_all``)."""
    w = F.lit(1.0) if weight is None else weight
    return ordered_totals(df, keys, score, {
        "pos": F.when(F.col(target) == 1, w).otherwise(F.lit(0.0)),
        "neg": F.when(F.col(target) == 0, w).otherwise(F.lit(0.0))}, max_rows)


def curve_points(levels: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """ROC and precision-recall points, one per distinct score used as threshold."""
    tp = F.col("pos_all") - F.col("pos_before")
    fp = F.col("neg_all") - F.col("neg_before")
    return levels.select(
        *keys, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        F.try_divide(fp, F.col("neg_all")).alias("fpr"), F.try_divide(tp, F.col("pos_all")).alias("tpr"),
        F.try_divide(tp, tp + fp).alias("precision"))


def rank_metrics(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; NULL when a class is absent."""
    return _rank_aggregates(levels, keys, [])


def _rank_aggregates(levels: DataFrame, keys: Sequence[str], also: Sequence[Column]) -> DataFrame:
    tp = F.col("pos_all") - F.col("pos_before")
    fp = F.col("neg_all") - F.col("neg_before")
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pos, neg = F.max("pos_all"), F.max("neg_all")
    both = (pos > 0) & (neg > 0)
    return levels.groupBy(*keys).agg(
        F.when(both, won / (pos * neg)).alias("roc_auc"),
        F.when(pos > 0, F.sum(F.col("pos") * F.try_divide(tp, tp + fp)) / pos).alias("average_precision"), *also)


def auc_ap(df: DataFrame, keys: Sequence[str], target: str = "target", score: str = "score",
           weight: Column | None = None, max_rows: int | None = None) -> DataFrame:
    return rank_metrics(score_levels(df, keys, target, score, weight, max_rows), keys)


def confusion2(df: DataFrame, keys: Sequence[str], target: str, predicted: Column) -> DataFrame:
    t = F.col(target)
    return df.groupBy(*keys).agg(
        F.count_if((t == 1) & predicted).alias("tp"), F.count_if((t == 0) & predicted).alias("fp"),
        F.count_if((t == 0) & ~predicted).alias("tn"), F.count_if((t == 1) & ~predicted).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall, specificity, F1 (0 when empty) and balanced accuracy from tp/fp/tn/fn.

    Balanced accuracy averages the recall of the classes that occur.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    has1, has0 = (tp + fn > 0), (tn + fp > 0)
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": recall, "specificity": spec,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": F.when(has1 & has0, (recall + spec) / 2).when(has1, recall).when(has0, spec)})


def threshold_metrics(df: DataFrame, keys: Sequence[str], target: str, score: str, threshold) -> DataFrame:
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return binary_ratios(confusion2(df, keys, target, F.col(score) >= cut))


def grid_metrics(df: DataFrame, keys: Sequence[str], target: str, score: str, grid: Sequence[float]) -> DataFrame:
    """Threshold metrics at every grid point.

    Each score is placed once among the (few, sorted) grid points and counted there; running totals
    over the grid give every confusion table, instead of repeating all rows per threshold.
    """
    points = F.array(*[F.lit(float(g)) for g in grid])
    # by compiled halving steps; a filter over the points would be interpreted for every row
    placed = below(df.select(*keys, target, score), points, F.col(score), len(grid), "_slot", including=True)
    counted = placed.groupBy(*keys, "_slot").agg(
        F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) == 0).alias("_n"))
    # per key at most len(grid) + 1 slots: arrays indexed by slot
    slots = counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", F.struct("_p", "_n")))).alias("_m"))
    at = lambda i, f: F.coalesce(F.element_at("_m", i.cast("int"))[f], F.lit(0))
    index = F.sequence(F.lit(0), F.lit(len(grid)))
    arrays = slots.select(*keys, F.transform(index, lambda i: at(i, "_p")).alias("_ps"),
                          F.transform(index, lambda i: at(i, "_n")).alias("_ns"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    opened = arrays.select(*keys, "_ps", "_ns", F.posexplode(points).alias("_i", "threshold"))
    above = lambda a: total(F.slice(a, F.col("_i") + 2, F.lit(len(grid) + 1)))
    counts = opened.select(
        *keys, "threshold", above("_ps").alias("tp"), above("_ns").alias("fp"),
        (total(F.col("_ns")) - above("_ns")).alias("tn"), (total(F.col("_ps")) - above("_ps")).alias("fn"))
    return binary_ratios(counts)


def binary_metrics(df: DataFrame, keys: Sequence[str], target: str = "target", score: str = "score",
                   threshold: float = 0.5, max_rows: int | None = None) -> DataFrame:
    """AUC, AP and threshold metrics together: the score levels already hold the confusion counts."""
    levels = score_levels(df, keys, target, score, max_rows=max_rows)
    above = F.col(score) >= F.lit(float(threshold))
    count = lambda side, called: F.sum(F.when(called, F.col(side)).otherwise(F.lit(0.0))).cast("bigint")
    return binary_ratios(_rank_aggregates(levels, keys, [
        count("pos", above).alias("tp"), count("neg", above).alias("fp"),
        count("neg", ~above).alias("tn"), count("pos", ~above).alias("fn")]))


# --- multiclass --------------------------------------------------------------------------------

def cell(t: int, p: int) -> str:
    return f"c{t}{p}"


def confusion(df: DataFrame, keys: Sequence[str], true: str, predicted: str, k: int,
              weight: Column | None = None) -> DataFrame:
    """k x k counts as k² columns ``c<true><predicted>``: additive, so they can be summed per block,
    weighted by draws and reduced again without touching the rows."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys).agg(*[
        F.sum(F.when((F.col(true) == t) & (F.col(predicted) == p), w).otherwise(F.lit(0.0))).alias(cell(t, p))
        for t in range(k) for p in range(k)])


def class_metrics(conf: DataFrame, k: int, labels: str = "seen", names: Sequence[str] | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, macro-F1 and balanced accuracy as columns.

    ``labels='seen'`` averages F1 over classes present in truth or prediction, ``'fixed'`` over all.
    """
    names = list(names or range(k))
    out, f1s, seen, recalls, present = {}, [], [], [], []
    for i in range(k):
        tp = F.col(cell(i, i))
        support = _add([F.col(cell(i, p)) for p in range(k)])
        called = _add([F.col(cell(t, i)) for t in range(k)])
        out[f"precision_{names[i]}"] = _ratio(tp, called)
        out[f"recall_{names[i]}"] = _ratio(tp, support)
        out[f"f1_{names[i]}"] = _ratio(2 * tp, support + called)
        out[f"support_{names[i]}"] = support
        f1s.append(out[f"f1_{names[i]}"])
        recalls.append(out[f"recall_{names[i]}"])
        seen.append((support + called > 0).cast("double"))
        present.append((support > 0).cast("double"))
    if labels == "fixed":
        out["macro_f1"] = _add(f1s) / F.lit(float(k))
    else:
        out["macro_f1"] = F.try_divide(_add([f * s for f, s in zip(f1s, seen)]), _add(seen))
    out["balanced_accuracy"] = F.try_divide(_add([r * s for r, s in zip(recalls, present)]), _add(present))
    return conf.withColumns(out)


def one_vs_rest(df: DataFrame, keys: Sequence[str], true: str, scores: Sequence[str]) -> DataFrame:
    """One row per unit and class: ``(class_code, target, score)``."""
    entries = F.array(*[F.struct(F.lit(i).alias("class_code"), F.col(c).alias("score")) for i, c in enumerate(scores)])
    return df.select(*keys, true, F.explode(entries).alias("e")).select(
        *keys, "e.class_code", (F.col(true) == F.col("e.class_code")).cast("int").alias("target"), "e.score")


def ovr_auc(df: DataFrame, keys: Sequence[str], true: str, scores: Sequence[str]) -> DataFrame:
    """Macro one-vs-rest AUC; classes lacking an outcome are skipped."""
    per_class = auc_ap(one_vs_rest(df, keys, true, scores), [*keys, "class_code"])
    return per_class.groupBy(*keys).agg(F.avg("roc_auc").alias("ovr_auc"))


def dense_crosstab(conf: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """All class pairs as rows, with counts and row shares."""
    k = len(classes)
    entries = []
    for t in range(k):
        support = _add([F.col(cell(t, p)) for p in range(k)])
        entries += [F.struct(F.lit(classes[t]).alias("true_class"), F.lit(classes[p]).alias("predicted_class"),
                             F.col(cell(t, p)).cast("bigint").alias("n"),
                             F.try_divide(F.col(cell(t, p)), support).alias("row_share")) for p in range(k)]
    return conf.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


# --- calibration -------------------------------------------------------------------------------

def log_loss_of(scores: Sequence[str], true: str) -> Column:
    """Row log loss on the scores as they are (clipped at 1e-15, not renormalised)."""
    p = F.element_at(F.array(*[F.col(c) for c in scores]), (F.col(true) + 1).cast("int"))
    return -F.ln(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0)))


def brier_of(scores: Sequence[str], true: str) -> Column:
    return _add([F.pow(F.col(c) - (F.col(true) == i).cast("double"), F.lit(2.0)) for i, c in enumerate(scores)])


def probability_bin(p: Column, bins: int, closed: str) -> Column:
    """Equal-width bin of a probability. ``closed='right'``: (lo, hi]; ``'left'``: [lo, hi), last closed.

    Edges are compared as values (``i / bins``), so a probability equal to an edge lands where the
    declared side says.
    """
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    below = (lambda e: e < p) if closed == "right" else (lambda e: e <= p)
    return F.size(F.filter(edges, below))


def reliability(df: DataFrame, keys: Sequence[str], outcome: str, p: str, bins: int, closed: str) -> DataFrame:
    return df.select(*keys, outcome, p, probability_bin(F.col(p), bins, closed).alias("bin")).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_probability"),
        F.avg(F.col(outcome).cast("double")).alias("observed_fraction"))


def ece(bins_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("mean_probability") - F.col("observed_fraction"))
    return bins_table.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def _tempered_loss(scores: Sequence[str], true: str, t: Column) -> Column:
    logs = [F.ln(F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1.0))) / t for c in scores]
    top = F.greatest(*logs)
    total = _add([F.exp(x - top) for x in logs])
    own = F.element_at(F.array(*logs), (F.col(true) + 1).cast("int"))
    return F.ln(total) + top - own


def fit_temperature(df: DataFrame, keys: Sequence[str], true: str, scores: Sequence[str], low: float = 0.25,
                    high: float = 4.0, points: int = 25, rounds: int = 3, minimum: int = 30) -> DataFrame:
    """Temperature with the smallest mean log loss per key, by a log-spaced grid refined ``rounds`` times.

    One pass per round computes the loss of every grid point at once (``points`` sums per row, no row
    copies); the next grid spans the neighbours of the best point. Below ``minimum`` rows, or with a
    class missing, the temperature stays 1.
    """
    import math

    k = len(scores)
    keys = list(keys)
    rows = df.where(_add([F.col(c).isNotNull().cast("int") for c in scores]) == k)
    span = None
    for _ in range(rounds):
        if span is None:
            source = rows.withColumns({"_lo": F.lit(math.log(low)), "_hi": F.lit(math.log(high))})
        else:
            source = attach(rows, span, keys)
        at = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(i / (points - 1))
        loss = source.groupBy(*keys).agg(
            F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"), F.count("*").alias("n"),
            *[F.max((F.col(true) == c).cast("int")).alias(f"_k{c}") for c in range(k)],
            *[F.avg(_tempered_loss(scores, true, F.exp(at(i)))).alias(f"_l{i}") for i in range(points)],
            F.avg(_tempered_loss(scores, true, F.lit(1.0))).alias("loss_before"))
        losses = F.array(*[F.col(f"_l{i}") for i in range(points)])
        best = F.array_position(losses, F.array_min(losses)) - 1
        step = (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
        found = loss.select(
            *keys, "n", _add([F.col(f"_k{c}") for c in range(k)]).alias("_classes"), "loss_before",
            F.array_min(losses).alias("loss_after"), (F.col("_lo") + step * best).alias("_log_t"),
            F.greatest(F.col("_lo"), F.col("_lo") + step * (best - 1)).alias("_nlo"),
            F.least(F.col("_hi"), F.col("_lo") + step * (best + 1)).alias("_nhi"))
        span = found.select(*keys, F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"))
    fitted = (F.col("n") >= minimum) & (F.col("_classes") == k)
    return found.select(
        *keys, F.col("n").alias("records"), fitted.alias("fitted"),
        F.when(fitted, F.exp("_log_t")).otherwise(F.lit(1.0)).alias("temperature"),
        F.col("loss_before"), F.when(fitted, F.col("loss_after")).otherwise(F.col("loss_before")).alias("loss_after"))


# --- correlation and intervals -----------------------------------------------------------------

def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho", weight: Column | None = None,
             min_rows: int = 3, min_distinct: int = 2, max_rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Tie-averaged Spearman per key; NULL below ``min_rows`` rows or ``min_distinct`` distinct x (2 for y).

    Equal (x, y) pairs are merged first (among many rows only where about half of them are equal), weights count as copies. The mean of the ranks is known,
    (n + 1) / 2, so the correlation is one aggregate of centred products. Keys with many rows get their
    ranks from windows inside buckets, one shuffle per side, others from windows over the merged pairs.
    """
    keys = list(keys)
    w = F.lit(1.0) if weight is None else weight
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    merged = lambda rows, w: rows.where(both).groupBy(*keys, x, y).agg(F.sum(w).alias("_w"))
    if max_rows is None:
        max_rows = largest_key(df, keys)
    if max_rows > hot_rows:
        # written as they come: a filter on computed values would compute them twice
        rows = cut(df.select(*keys, x, y, w.alias("_w")))
        found = rows.where(both).groupBy(*keys).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(x, y)).alias("d"))
        sizes = found.agg(F.max("n").alias("n"), F.sum("n").alias("all"), F.sum("d").alias("kinds")).first()
        pairs, max_rows = rows.where(both), sizes["n"] or 0
        if 2 * (sizes["kinds"] or 0) < (sizes["all"] or 0):
            pairs = cut(merged(rows, F.col("_w")))
            max_rows = largest_key(pairs, keys)
        elif max_rows <= hot_rows:
            pairs = merged(rows, F.col("_w"))
    else:
        pairs = merged(df, w)
    wcol = F.col("_w")
    if max_rows <= hot_rows:
        part = Window.partitionBy(*keys)

        def rank(c):
            upto = F.sum("_w").over(part.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
            tied = F.sum("_w").over(Window.partitionBy(*keys, c))
            return upto - tied + (tied + 1) / 2

        ranked = pairs.withColumns({"_rx": rank(x), "_ry": rank(y), "_n": F.sum("_w").over(part)})
    else:
        ranked = row_ranks(row_ranks(pairs, keys, x, y, "_w", "_rx"), keys, y, x, "_w", "_ry", measured=pairs).withColumnRenamed("_ry_all", "_n")
    a = F.col("_rx") - (F.col("_n") + 1) / 2
    b = F.col("_ry") - (F.col("_n") + 1) / 2
    distinct = F.countDistinct(x) if min_distinct > 2 else F.when(F.min(x) < F.max(x), 2).otherwise(1)
    sums = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.sum(wcol * a * b).alias("_ab"), F.sum(wcol * a * a).alias("_aa"), F.sum(wcol * b * b).alias("_bb"),
        distinct.alias("_dx"))
    ok = (F.col("_n") >= min_rows) & (F.col("_dx") >= min_distinct) & (F.col("_aa") > 0) & (F.col("_bb") > 0)
    return sums.select(*keys, F.when(ok, F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias(out), F.col("_n").cast("bigint").alias("n"))


def spearman_small(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho", min_rows: int = 3,
                   min_distinct: int = 2) -> DataFrame:
    """Spearman where the rows per key are bounded by configuration (features, models, folds): plain windows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    def rank(c):
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / F.lit(2.0)
    ranked = rows.withColumns({"_rx": rank(x), "_ry": rank(y)})
    ok = (F.count("*") >= min_rows) & (F.countDistinct(x) >= min_distinct) & (F.countDistinct(y) >= 2)
    return ranked.groupBy(*keys).agg(F.when(ok, F.corr("_rx", "_ry")).alias(out), F.count("*").alias("n"))


# Two-sided 95 % Student-t quantiles by degrees of freedom.
T975 = (12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987, 2.5705818366147395,
        2.4469118487916806, 2.3646242510102993, 2.3060041350333704, 2.2621571627409915, 2.2281388519649385,
        2.200985160082949, 2.1788128296634177, 2.1603686564610127, 2.1447866879169273, 2.131449545559323,
        2.1199052992210112, 2.1098155778331806, 2.10092204024096, 2.093024054408263, 2.0859634472658364)


def t_975(df: Column) -> Column:
    """Table up to 20 degrees of freedom, Cornish-Fisher expansion beyond (error below 1e-6 there)."""
    z = 1.959963984540054
    n = df.cast("double")
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    expanded = F.lit(z) + _add([F.lit(t) / F.pow(n, F.lit(float(i + 1))) for i, t in enumerate(terms)])
    table = F.array(*[F.lit(v) for v in T975])
    return F.when(df <= len(T975), F.try_element_at(table, df.cast("int"))).otherwise(expanded)


def mean_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample sd and 95 % t interval over the rows of a key; a single value is its own interval."""
    agg = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.when(F.col("n") > 1, t_975(F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n").cast("double"))).when(F.col("n") == 1, 0.0)
    return agg.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


# --- p-values ----------------------------------------------------------------------------------

def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, out: str = "fdr_q", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Step-up FDR per key; NULL p-values pass through.

    ``q(p) = min over p' >= p of p'·n / rank(p')`` where the rank of tied values is their last one.
    The suffix minimum of a very large key takes bucket minima first.
    """
    keys = list(keys)
    level = cut(ordered_totals(df, keys, p, {"n": F.lit(1)}, hot_rows=hot_rows).select(
        *keys, p, (F.col(p) * F.col("n_all") / (F.col("n_before") + F.col("n"))).alias("_raw")))
    later = lambda *by: Window.partitionBy(*by).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    if largest_key(level, keys) <= hot_rows:
        q = level.withColumn("_q", F.min("_raw").over(later(*keys)))
    else:
        placed = with_buckets(level, keys, p)
        after = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
        tails = placed.groupBy(*keys, "_bucket").agg(F.min("_raw").alias("_m")).withColumn("_tail", F.min("_m").over(after))
        inside = placed.withColumn("_in", F.min("_raw").over(later(*keys, "_bucket")))
        q = inside.join(tails.select(*keys, "_bucket", "_tail"), [*keys, "_bucket"]).withColumn("_q", F.least("_in", "_tail"))
    q = q.select(*keys, p, F.least("_q", F.lit(1.0)).alias(out))
    return df.join(q, [*keys, p], "left").select(*df.columns, out)
