"""The bucketed path for very large keys gives the same answers as the plain one and as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import metrics as M, ordered as O


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "k": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]),
        "v": np.where(rng.random(3000) < 0.33, 0.5, np.round(rng.normal(size=3000), 2)),  # one value holds a third
        "y": np.round(rng.normal(size=3000), 1), "t": rng.integers(0, 2, 3000)})
    return pdf, spark.createDataFrame(pdf).cache()


def sort(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("keys", [["k"], []])
def test_totals_paths_agree(frame, keys):
    _, df = frame
    plain = sort(O.ordered_totals(df, keys, "v", {"n": F.lit(1), "s": F.col("t")}), [*keys, "v"])
    hot = sort(O.ordered_totals(df, keys, "v", {"n": F.lit(1), "s": F.col("t")}, hot_rows=5), [*keys, "v"])
    pd.testing.assert_frame_equal(plain, hot[plain.columns], check_dtype=False)


def test_quantiles_paths_agree(frame):
    pdf, df = frame
    specs = {"q1": ("v", 0.25), "q2": ("v", 0.5), "q3": ("y", 0.9)}
    also = [F.count("*").alias("n")]
    hot = sort(O.exact_quantiles(df, ["k"], specs, hot_rows=1000, also=also), "k")  # only "a" is hot
    for _, row in hot.iterrows():
        part = pdf[pdf.k == row.k]
        assert row.q1 == pytest.approx(part.v.quantile(0.25))
        assert row.q2 == pytest.approx(part.v.median())
        assert row.q3 == pytest.approx(part.y.quantile(0.9))
        assert row.n == len(part)
    whole = O.exact_quantiles(df, [], {"q": ("v", 0.3)}, hot_rows=10).toPandas()
    assert whole.q[0] == pytest.approx(pdf.v.quantile(0.3))


def test_spearman_paths_agree(frame):
    pdf, df = frame
    hot = sort(M.spearman(df, ["k"], "v", "y", hot_rows=5), "k")
    for _, row in hot.iterrows():
        part = pdf[pdf.k == row.k]
        assert row.rho == pytest.approx(part.v.rank().corr(part.y.rank()))


def test_weighted_spearman_equals_copies(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 60).astype(float), "y": rng.normal(size=60), "w": rng.integers(1, 4, 60).astype(float)})
    got = M.spearman(spark.createDataFrame(pdf), [], "x", "y", weight=F.col("w")).first()
    full = pdf.loc[pdf.index.repeat(pdf.w.astype(int))]
    assert got["rho"] == pytest.approx(full.x.rank().corr(full.y.rank()))
    assert got["n"] == int(pdf.w.sum())


def test_auc_ap_against_brute_force(frame):
    pdf, df = frame
    got = sort(M.auc_ap(df, ["k"], "t", "v"), "k")
    for _, row in got.iterrows():
        part = pdf[pdf.k == row.k]
        pos, neg = part.v[part.t == 1].to_numpy(), part.v[part.t == 0].to_numpy()
        wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
        assert row.roc_auc == pytest.approx(wins)
        total, ap = len(pos), 0.0
        for s in np.unique(part.v):
            called = part[part.v >= s]
            ap += (part.t[part.v == s].sum() / total) * called.t.mean()
        assert row.average_precision == pytest.approx(ap)


def test_auc_edge_cases(spark):
    rows = [("tied", 1, 0.5), ("tied", 0, 0.5), ("tied", 0, 0.5), ("one", 1, 0.2), ("one", 1, 0.9), ("null", 1, None), ("null", 1, 0.7), ("null", 0, 0.1)]
    got = {r["k"]: r["roc_auc"] for r in M.auc_ap(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").collect()}
    assert got == {"tied": 0.5, "one": None, "null": 1.0}


@pytest.mark.parametrize("hot_rows", [O.HOT_ROWS, 3])
def test_fdr(spark, hot_rows):
    p = [0.01, 0.02, 0.02, 0.04, 0.5, None, 0.9, 0.03]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = {r["i"]: r["fdr_q"] for r in M.benjamini_hochberg(df, [], "p", hot_rows=hot_rows).collect()}
    valid = sorted((v, i) for i, v in enumerate(p) if v is not None)
    n, best, want = len(valid), 1.0, {5: None}
    for rank in range(n, 0, -1):
        v, i = valid[rank - 1]
        best = min(best, v * n / rank)
        want[i] = best
    assert got.keys() == want.keys()
    assert all(got[i] is None if want[i] is None else got[i] == pytest.approx(want[i]) for i in want)


def test_buckets_are_found_by_compiled_steps(frame):
    pdf, df = frame
    placed = O.with_buckets(df, ["k"], "v", samples=37)
    assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
    got = placed.select("k", "v", "_bucket").toPandas()
    for _, part in got.groupby("k"):
        # 37 cut points at most, larger values in later buckets, equal values together
        level = part.groupby("v")["_bucket"].agg(["min", "max"])
        assert (level["min"] == level["max"]).all() and level["min"].is_monotonic_increasing
        assert 10 < part["_bucket"].nunique() <= 38


def test_cut_points_are_few_hashes(spark):
    df = spark.range(20000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    edges = O._edges(df, ["k"], "v", 16)
    by_hash = df.select("v", F.xxhash64("v").alias("h")).toPandas().sort_values("h")
    found = edges.first()["_edges"]
    assert len(found) == 16 and found == sorted(found)
    share = 4 * 16 / 20000
    assert (by_hash.set_index("v")["h"][found].abs() <= share * 2.0 ** 63).all()


def test_row_ranks_spread_a_heavy_value(frame):
    pdf, df = frame
    one = df.select("k", "v", "y", F.lit(1.0).alias("w"))
    got = O.row_ranks(one, ["k"], "v", "y", "w", "r", samples=37).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank())
    by = ["k", "v", "y"]
    pd.testing.assert_series_equal(got.sort_values(by)["r"].reset_index(drop=True), want.sort_values(by)["r"].reset_index(drop=True))
    assert (got.r_all == got.k.map(pdf.k.value_counts())).all()
    joins = O.row_ranks(one, [], "v", "y", "w", "r").toPandas()  # without keys
    assert sorted(joins.r) == sorted(pdf.v.rank())


def test_spearman_of_many_rows_computes_values_once(frame):
    pdf, df = frame
    calls = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    for y in ("y", "t"):  # few equal pairs, many equal pairs
        rows = df.select("k", "v", y).mapInPandas(count, f"k string, v double, {y} double")
        calls.value = 0
        got = sort(M.spearman(rows, ["k"], "v", y, hot_rows=5), "k")
        assert calls.value == 2 * len(pdf)  # the sizes of the keys, and the values
        for _, row in got.iterrows():
            part = pdf[pdf.k == row.k]
            assert row.rho == pytest.approx(part.v.rank().corr(part[y].rank())) and row.n == len(part)


def test_correlation_clusters_rank_once(spark):
    from kinfold.operators import statistics as T
    rows = spark.range(50).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("c"))
    got = T.correlation_clusters(rows, ["a", "b", "c"], 0.85, 20)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # ranks were written, not planned again
    assert {r["feature"]: r["cluster"] for r in got.collect()} == {"a": "a", "b": "a", "c": "c"}


def test_small_keys_are_sorted_as_arrays(spark):
    """Few rows per key: no hash table per key, same quantiles as ``percentile``, nulls left out, an empty key null."""
    rows = [(k, None if i % 4 == 3 else float((i * 7919 + k) % 11) / 3, k % 5) for k in range(40) for i in range(1 + k % 9)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "k int, v double, b int")
    got = O.exact_quantiles(df, ["k"], {"m": ("v", 0.5), "q": ("v", 0.3)}, also=[F.min("b").alias("b"), F.count("*").alias("n")], bound=["b"])
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.3)).alias("q"), F.min("b").alias("b"), F.count("*").alias("n"))
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(want.collect(), key=lambda r: r["k"])


def test_records_are_dealt_by_group_in_bounded_tasks(spark, monkeypatch):
    """Group medians of scores need no exchange after rows are copied per model, and tasks grow with the table."""
    from kinfold.plans import fixtures, metric_queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "TASK_RECORDS", 100)
    records = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert fixtures.class_oof(spark, sf).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-records // 100))
    plan = metric_queries.strata(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate explode")]


def test_draws_are_spread_over_bounded_tasks(spark, monkeypatch):
    """Units come from one ordered window; their draws must not stay in its task, nor grow with the units."""
    from kinfold.functions import draws
    from kinfold.operators import resample as B

    units = spark.range(50).withColumnRenamed("id", "u")
    want = sorted(B.unit_draws(units, "u", 20, 3).collect())
    monkeypatch.setattr(draws, "TASK_DRAWS", 10)
    got = B.unit_draws(units, "u", 20, 3)
    plan = got._jdf.queryExecution().toString()
    assert plan.count(", 100), REPARTITION_BY_NUM") >= 2
    assert sorted(got.collect()) == want


def test_mask_orders_one_slot_only(spark):
    """Chosen cells are those with the smallest hashes, and only one slot of the hashes is ordered."""
    import hashlib

    from kinfold.operators import resample as B

    rows = [(f, r) for f, n in (("a", 3000), ("b", 9), ("c", 12)) for r in range(n)]
    df = spark.createDataFrame(rows + [("a", 7)], "feature string, record_id long")  # one cell twice
    got = B.random_mask(df, ["feature"], "record_id", 0.1, 5, 9)
    want = set()
    for f, n in (("a", 3001), ("c", 12)):
        own = sorted((hashlib.md5(f"9:{f}:{r}".encode()).hexdigest(), r) for g, r in rows + [("a", 7)] if g == f)
        size = min(n, max(5, round(n * 0.1)))
        want |= {(f, r) for i, (_, r) in enumerate(own) if own.index(own[i]) < size}
    assert sorted((x.feature, x.record_id) for x in got.collect()) == sorted(want)
    assert "_slot" in got._jdf.queryExecution().toString()
