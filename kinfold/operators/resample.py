"""Bootstrap, permutation and masking by hashed draws.

A replicate is a column, not a loop: draws are counted per unit and replicate, joined to values that
were reduced per unit beforehand, and every statistic takes the counts as weights. Rows are never
copied, and all replicates of an analysis are one job.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinfold.functions.draws import bootstrap_counts, bootstrap_vectors, draw_uniform, replicate_column, round_keys, shuffled_positions
from kinfold.operators import metrics as M
from kinfold.operators.ordered import attach, average_ranks, largest_key, ordered_totals, positions
from kinfold.operators.replicates import replicate_spearman
from kinfold.session import cut

BROADCAST_ROWS = 500_000  # components beyond which ranks are shuffled to the permutations, whatever their compressed size


def unit_draws(df: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """``(replicate, unit, weight)``; units are numbered by their order."""
    units = cut(positions(df.where(F.col(unit).isNotNull()).select(unit), [], unit))
    return bootstrap_counts(units, unit, replicates, seed)


def unit_vectors(df: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """``(unit, _drawn)``: 1, then how often the unit is drawn in each replicate."""
    units = cut(positions(df.where(F.col(unit).isNotNull()).select(unit), [], unit))
    return bootstrap_vectors(units, unit, replicates, seed, "_drawn")


def interval(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.025, high: float = 0.975, also: Sequence[Column] = ()) -> DataFrame:
    """Percentile interval over replicates (a configured number of rows per key); NULLs are dropped and counted out.

    ``also`` are further aggregates of the same rows.
    """
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*keys).agg(q(low).alias("ci_low"), q(high).alias("ci_high"), q(0.5).alias("replicate_median"),
                                 F.avg(value).alias("replicate_mean"), F.count(value).alias("replicates_valid"), *also)


def pairwise_auc(scores: DataFrame, unit: str, models: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Difference of AUC for every pair of models, as observed and under resampling of ``unit``.

    ``scores``: one row per (model, group). Replicates lacking a class give NULL and are skipped. The observed scores
    are replicate 0, each unit drawn once, so one sort serves them and the draws.
    """
    scores = cut(scores)
    draws = unit_draws(scores, unit, replicates, seed).select(unit, "replicate", F.col("weight").cast("long").alias("weight"))
    once = scores.where(F.col(unit).isNotNull()).select(unit).distinct().select(unit, F.lit(0).alias("replicate"), F.lit(1).cast("long").alias("weight"))
    rows = scores.join(draws.unionByName(once).hint("merge"), unit)  # a union drops the hint of the draws
    auc = M.auc_ap(rows, ["replicate", "model"], weight=F.col("weight"), max_rows=largest_key(scores, ["model"]))
    wide = auc.groupBy("replicate").agg(*[F.max(F.when(F.col("model") == m, F.col("roc_auc"))).alias(m) for m in models])
    pairs = F.array(*[F.struct(F.lit(a).alias("left_model"), F.lit(b).alias("right_model"), (F.col(a) - F.col(b)).alias("difference"))
                      for a, b in combinations(sorted(models), 2)])
    long = wide.select("replicate", F.explode(pairs).alias("p")).select("replicate", "p.*")
    drawn = F.when(F.col("replicate") > 0, F.col("difference"))
    return interval(long.withColumns({"_all": F.col("difference"), "difference": drawn}), ["left_model", "right_model"], "difference", also=[
        F.max(F.when(F.col("replicate") == 0, F.col("_all"))).alias("observed")])


def block_confusions(df: DataFrame, keys: Sequence[str], block: str, true: str, predicted: str, k: int) -> DataFrame:
    return M.confusion(df, [*keys, block], true, predicted, k)


def resampled_confusions(per_block: DataFrame, keys: Sequence[str], block: str, draws: DataFrame, k: int) -> DataFrame:
    """Per replicate: confusion counts summed over drawn blocks. Rows are blocks, not records."""
    names = [M.cell(t, p) for t in range(k) for p in range(k)]
    return per_block.join(draws, block).groupBy("replicate", *keys).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in names])


def macro_f1_difference(strata: DataFrame, block: str, left: str, right: str, k: int, replicates: int, seed: int) -> DataFrame:
    """Macro-F1 difference of two models under block resampling, from per-block confusion counts."""
    per_block = cut(block_confusions(strata.where(F.col("model").isin(left, right)), ["model"], block, "true_code", "predicted", k))
    draws = unit_draws(per_block, block, replicates, seed)
    each = M.class_metrics(resampled_confusions(per_block, ["model"], block, draws, k), k)
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_f1")))
    return interval(each.groupBy("replicate").agg((side(left) - side(right)).alias("difference")), [], "difference")


def class_metric_intervals(strata: DataFrame, block: str, names: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Estimate and block-bootstrap interval of every class-wise and overall metric."""
    k = len(names)
    per_block = cut(block_confusions(strata, [], block, "true_code", "predicted", k))
    draws = unit_draws(per_block, block, replicates, seed)
    measures = ["macro_f1", "balanced_accuracy", *[f"{m}_{n}" for m in ("precision", "recall", "f1") for n in names]]
    long = lambda d, ids, v: d.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias(v)) for m in measures])).alias("e")).select(*ids, "e.*")
    cells = [M.cell(t, p) for t in range(k) for p in range(k)]
    whole = M.class_metrics(per_block.agg(*[F.sum(c).alias(c) for c in cells]), k, names=names)
    each = M.class_metrics(resampled_confusions(per_block, [], block, draws, k), k, names=names)
    return long(whole, [], "estimate").join(interval(long(each, ["replicate"], "value"), ["metric"], "value"), "metric")


def mean_abs_interval(df: DataFrame, keys: Sequence[str], unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Mean absolute value and its interval over resampled units."""
    df = cut(df.select(*keys, unit, value))
    draws = unit_draws(df, unit, replicates, seed)
    per_unit = df.groupBy(*keys, unit).agg(F.sum(F.abs(value)).alias("_s"), F.count(value).alias("_n"))
    each = per_unit.join(draws, unit).groupBy(*keys, "replicate").agg(
        (F.sum(F.col("weight") * F.col("_s")) / F.sum(F.col("weight") * F.col("_n"))).alias("mean_abs"))
    whole = per_unit.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("estimate"))
    return attach(whole, interval(each, keys, "mean_abs"), keys)


def spearman_interval(df: DataFrame, keys: Sequence[str], unit: str, x: str, y: str, replicates: int, seed: int,
                      min_rows: int = 8, min_distinct: int = 4) -> DataFrame:
    """Spearman direction with an interval from resampling ``unit`` (group or cluster).

    Re-ranking inside each replicate happens on weights, for all replicates in two sorts; the estimate is the replicate that has every row once.
    """
    keys = list(keys)
    rows = cut(df.select(*dict.fromkeys([*keys, unit, x, y])).where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    vectors = unit_vectors(rows, unit, replicates, seed)
    # rows without a unit are never drawn
    never = F.array(F.lit(1), *[F.lit(0)] * replicates)
    drawn = rows.join(vectors.hint("merge"), unit, "left").withColumn("_drawn", F.coalesce("_drawn", never))
    found = cut(replicate_spearman(drawn, keys, x, y, "_drawn", replicates + 1, largest_key(rows, keys)))
    valid = (F.col("n") >= min_rows) & (F.col("kinds") >= min_distinct)
    whole = found.where("replicate = 0").groupBy(*keys).agg(F.max(F.when(valid, F.col("rho"))).alias("estimate"), F.max("n").alias("n"))
    each = found.where("replicate > 0 and n > 0").withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
    return attach(whole, interval(each, keys, "rho"), keys)


def sign_consistency(df: DataFrame, keys: Sequence[str], rho: str, expected: int) -> DataFrame:
    """Share of the more frequent sign over finite, non-zero partition correlations, and availability."""
    r = F.col(rho)
    finite = r.isNotNull() & (r != 0)
    n = F.count_if(finite)
    top = F.greatest(F.count_if(r > 0), F.count_if(r < 0))
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(top.cast("double"), n.cast("double")), F.lit(0.0)).alias("sign_consistency"),
                                 n.alias("partitions"), (n / F.lit(float(expected))).alias("availability"))


def permutation_spearman(components: DataFrame, unit: str, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """Null correlations of randomly re-paired components: ``(replicate, rho)``.

    Ranks do not change under re-pairing, so each replicate is one sum of products, and since the permutations are
    :func:`shuffled_position`'s, keyed by seed and replicate, none of them is sorted.
    """
    # ranks of distinct values, joined back to the components
    rx, ry = (average_ranks(components, [], c, f"_r{i}") for i, c in enumerate((x, y)))
    ranked = components.join(rx.drop("n_all"), x).join(ry, y)
    numbered = cut(ranked.join(positions(components.select(unit), [], unit).select(unit, "position"), unit).select("position", "_r0", "_r1", "n_all"))
    n = numbered.count()
    mid = (n + 1) / 2
    centred = [(F.col(f"_r{i}") - mid).alias(f"_{c}") for i, c in enumerate("ab")]
    # sums of squares do not change under re-pairing
    norm = numbered.select(*centred).agg(F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b")))).scalar()
    # spread before the rows multiply, so that all cores share the hashing
    spread = numbered.select("position", centred[0]).repartition(components.sparkSession.sparkContext.defaultParallelism, "position")
    named = components.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"), round_keys(seed, F.col("id")).alias("keys"))
    moved = shuffled_positions(spread.crossJoin(named), "position", n, "keys", "target").select("replicate", "target", "_a")
    others = numbered.select(F.col("position").alias("target"), centred[1])
    paired = moved.join(others.hint("shuffle_hash") if n > BROADCAST_ROWS else others, "target")
    return paired.groupBy("replicate").agg(F.try_divide(F.sum(F.col("_a") * F.col("_b")), norm).alias("rho"))


def permutation_p(null: DataFrame, observed: Column, value: str = "rho", tolerance: float = 1e-12) -> Column:
    """Two-sided p-value column over a null table: (1 + #{|null| >= |observed|}) / (1 + N)."""
    return (1 + F.count_if(F.abs(value) >= F.abs(observed) - tolerance)) / (1 + F.count(value))


def component_inference(df: DataFrame, unit: str, x: str, y: str, replicates: int, permutations: int = 9_999, seed: int = 0) -> DataFrame:
    """Spearman between component medians with bootstrap interval and permutation p."""
    from kinfold.operators.rollup import component_medians

    comp = cut(component_medians(df, [], unit, [x, y]))
    boot = cut(spearman_interval(comp, [], unit, x, y, replicates, seed, min_rows=8, min_distinct=2))
    null = permutation_spearman(comp, unit, x, y, permutations, seed)
    observed = boot.select("estimate").scalar()
    p = null.agg(permutation_p(null, observed).alias("permutation_p"), F.count("rho").alias("permutations_valid"))
    return attach(boot.select("estimate", "ci_low", "ci_high", F.col("n").alias("components"), F.col("replicates_valid").alias("bootstraps_valid")), p, [])


def weighted_medians(df: DataFrame, keys: Sequence[str], value: str, weight: Column, out: str, max_rows: int | None) -> DataFrame:
    """Median where integer weights stand for copies."""
    level = ordered_totals(df, keys, value, {"w": weight}, max_rows)
    at = (F.col("w_all") - 1) / 2
    covers = lambda i: (F.col("w_before") <= i) & (i < F.col("w_before") + F.col("w"))
    return level.groupBy(*keys).agg(
        ((F.max(F.when(covers(F.floor(at)), F.col(value))) + F.max(F.when(covers(F.ceil(at)), F.col(value)))) / 2).alias(out))


def bin_median_interval(df: DataFrame, keys: Sequence[str], bin_column: str, unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Interval of the median per bin under resampling of blocks."""
    rows = cut(df.select(*keys, bin_column, unit, value).where(F.col(value).isNotNull()))
    draws = unit_draws(rows, unit, replicates, seed)
    each = weighted_medians(rows.join(draws, unit), [*keys, bin_column, "replicate"], value, F.col("weight"), "median",
                            largest_key(rows, [*keys, bin_column]))
    return interval(each, [*keys, bin_column], "median")


def label_orders(n: int) -> Column:
    """All orders of 0..n-1 as an array of arrays, grown one position at a time (n is at most 8)."""
    if n > 8:
        raise ValueError("exact permutation is for at most 8 labels")
    orders = F.array(F.array().cast("array<int>"))
    for _ in range(n):
        free = lambda done: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ~F.array_contains(done, i))
        orders = F.flatten(F.transform(orders, lambda done: F.transform(free(done), lambda i: F.concat(done, F.array(i)))))
    return orders


def exact_cosine_permutation(df: DataFrame, keys: Sequence[str], label: str, left: str, right: str, n: int) -> DataFrame:
    """Cosine of two vectors per key against every order of one vector's labels.

    A key's vector has at most ``n`` components (8 at most), so it fits an array; a longer one is an error. Every key is
    permuted over its own number of components. The identity order counts through the tolerance. A vector of zeros has no
    cosine and no p value.
    """
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(label, left, right))).alias("_v"))
    arrays = packed.select(
        *keys, F.transform("_v", lambda s: s[left]).alias("_l"), F.transform("_v", lambda s: s[right]).alias("_r"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(F.col("_l"), F.col("_l")) * dot(F.col("_r"), F.col("_r")))
    base = arrays.withColumns({"_norm": F.nullif(norm, F.lit(0.0)), "observed": F.try_divide(dot(F.col("_l"), F.col("_r")), norm)})
    # small literal arrays: n! orders, at most 40,320
    size = F.size("_r")
    orders = F.raise_error(F.lit(f"a vector has more than {n} components")).cast("array<array<int>>")
    for k in range(n, 0, -1):
        orders = F.when(size == k, label_orders(k)).otherwise(orders)
    every = base.withColumn("_o", F.explode(orders))
    moved = F.transform("_o", lambda i: F.element_at("_r", i + 1))
    null = every.select(*keys, "observed", (dot(F.col("_l"), moved) / F.col("_norm")).alias("rho"))
    p = F.when(F.max("observed").isNotNull(), permutation_p(null, F.col("observed")))
    return null.groupBy(*keys).agg(F.max("observed").alias("cosine"), p.alias("exact_p"), F.count("*").alias("orders"))


def leave_one_label_permutation(df: DataFrame, keys: Sequence[str], label: str, left: str, right: str, n: int) -> DataFrame:
    """:func:`exact_cosine_permutation` of all labels (``omitted`` is null) and with each label left out, plus ``retained`` labels.

    Each variant is permuted over the orders of its own labels; shares need not be scaled anew, since a cosine has no scale.
    """
    omitted = df.groupBy(*keys).agg(F.concat(F.array(F.lit(None).cast(df.schema[label].dataType)), F.sort_array(F.collect_set(label))).alias("_all"))
    variants = df.join(omitted, list(keys)).withColumn("omitted", F.explode("_all")).where(~F.col(label).eqNullSafe(F.col("omitted")))
    tested = exact_cosine_permutation(variants, [*keys, "omitted"], label, left, right, n)
    sizes = variants.groupBy(*keys, "omitted").agg(F.count("*").alias("retained")).withColumnRenamed("omitted", "_o")
    return tested.join(sizes, list(keys)).where(F.col("omitted").eqNullSafe(F.col("_o"))).drop("_o")


def weighted_resample(df: DataFrame, order: str, weight: Column, seed: int) -> DataFrame:
    """n draws with replacement in proportion to weight: ``(draw, order)``.

    Draw i looks for the record whose cumulative-weight interval holds u·W. Intervals and draws meet
    on equal-width cells of the weight axis, an equi-join, then the exact bounds decide.
    """
    level = cut(ordered_totals(df, [], order, {"w": weight.cast("double"), "n": F.lit(1)}))
    facts = level.agg(F.max("w_all").alias("total"), F.max("n_all").alias("n")).first()  # two numbers
    total, n = float(facts["total"] or 0.0), int(facts["n"] or 0)
    width = total / max(n, 1)
    slot = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spans = level.where("w > 0").select(order, F.col("w_before").alias("_lo"), (F.col("w_before") + F.col("w")).alias("_hi"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi")))))
    draws = level.select(F.col("n_before").cast("bigint").alias("draw")).withColumn("_t", draw_uniform(seed, F.col("draw")) * F.lit(total)).withColumn("_cell", slot(F.col("_t")))
    hit = draws.join(spans, "_cell").where((F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_hi")))
    return hit.select("draw", order)


def random_mask(cells: DataFrame, keys: Sequence[str], record: str, fraction: float, minimum: int, seed, need: int = 10) -> DataFrame:
    """Observed cells chosen per key: ``max(minimum, round(n·fraction))`` of them, in hash order.

    Nothing is sorted but one slot of the hashes per key: counts per slot (the first 16 bits) tell which slots are chosen whole,
    and only the one where the last chosen cell lies is ordered.
    """
    keys = list(keys)
    hashed = cells.select(*keys, record, F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, record)).alias("_h")).withColumn("_slot", F.substring("_h", 1, 4))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = hashed.groupBy(*keys, "_slot").agg(F.count("*").alias("_n")).select(
        *keys, "_slot", "_n", F.sum("_n").over(whole).alias("_all"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    size = F.least(F.col("_all"), F.greatest(F.lit(minimum), F.round(F.col("_all") * fraction))).cast("bigint")
    slots = cut(slots.withColumn("_size", size).where((F.col("_all") >= need) & (F.col("_before") < F.col("_size"))))
    other = slots.withColumnsRenamed({c: f"_of_{c}" for c in [*keys, "_slot"]})
    near = hashed.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_slot"]]))
    inside = near.where(F.col("_before") + F.col("_n") <= F.col("_size")).select(*keys, record).distinct()
    order = F.struct(F.col("_h").alias("h"), F.col(record).alias("r"))
    edge = near.where(F.col("_before") + F.col("_n") > F.col("_size")).withColumn("_o", order)
    ranked = ordered_totals(edge, [*keys, "_before", "_size"], "_o", {"n": F.lit(1)})
    return inside.unionByName(ranked.where(F.col("_before") + F.col("n_before") < F.col("_size")).select(*keys, F.col("_o.r").alias(record)))
