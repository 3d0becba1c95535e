import numpy as np
import pandas as pd
import pytest

from kinfold.operators import deletion


def test_dominating_counts_points_above():
    rng = np.random.default_rng(3)
    px, py = rng.integers(0, 40, 300), rng.permutation(300)
    tx, ty = rng.integers(-1, 43, 500), rng.integers(-1, 303, 500)
    want = ((px[None] >= tx[:, None]) & (py[None] >= ty[:, None])).sum(1)
    assert (deletion.dominating(px, py, tx, ty) == want).all()


@pytest.mark.parametrize("paired", [0, 3, 256])
def test_spearman_without_each_block(spark, paired):
    rng = np.random.default_rng(5)
    n = 150
    table = pd.DataFrame({"k": np.repeat(["a", "b"], n), "id": np.arange(2 * n), "block": rng.integers(0, 40, 2 * n) ** 2 // 40,
                          "x": rng.integers(0, 25, 2 * n) * 1.0, "y": np.round(rng.normal(size=2 * n), 1)})
    table.loc[table.k == "b", "x"] = 1.0
    table.loc[n + 3, "x"] = 2.0  # without this row's block all of b is tied
    df = spark.createDataFrame(table)
    got = {(r["k"], r["block"]): r["rho"] for r in deletion.spearman_without(df, ["k"], "block", ["id"], "x", "y", "rho", paired=paired, bucket=16).collect()}
    assert len(got) == len(table[["k", "block"]].drop_duplicates())
    for (k, b), rho in got.items():
        rest = table[(table.k == k) & (table.block != b)]
        if rest.x.nunique() < 2:
            assert rho is None
        else:
            assert rho == pytest.approx(rest.x.rank().corr(rest.y.rank()), abs=1e-12)
