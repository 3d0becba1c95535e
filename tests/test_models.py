"""Model jobs: invariants that do not depend on the exact fit."""

from itertools import permutations

import numpy as np
import pytest

import __spark_entry__ as entry
from kinfold.operators import trees

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", ["l1_random_forest", "l2_gradient_boosting", "l3_kernel_svm", "l4_mlp_resampled"])
def test_every_row_is_scored_once(spark, name):
    got = run(spark, name)
    assert got.vec_id.is_unique and len(got) == 500
    assert got.score.between(0, 1).all()
    # a block is in one fold only
    assert (got.groupby("block").fold.nunique() == 1).all()


def test_three_class_scores_sum_to_one(spark):
    got = run(spark, "l2_gradient_boosting_3class")
    assert np.allclose(got[["s0", "s1", "s2"]].sum(axis=1), 1)
    assert (got.predicted == got[["s0", "s1", "s2"]].to_numpy().argmax(axis=1)).all()


def test_saved_model_scores_the_same(spark):
    got = run(spark, "s12_model_bundle")
    assert np.allclose(got.score, got.reloaded_score)


def test_attribution_adds_up(spark):
    got = run(spark, "x1_tree_attribution")
    assert got.additivity_error.max() < 1e-9 and got.reproduction_error.max() < 1e-8


def test_calibration_keeps_order_and_sums(spark):
    got = run(spark, "l12_calibrated_validation")
    assert np.allclose(got[["c0", "c1", "c2"]].sum(axis=1), 1)
    assert (got[["c0", "c1", "c2"]].to_numpy().argmax(axis=1) == got.predicted).all()


def test_tree_attribution_against_definition():
    inf = np.inf
    # two trees over three features; fractions are cover shares along each path
    leaves = [
        (1.0, [(0, -inf, 0.5, 0.4)]), (4.0, [(0, 0.5, inf, 0.6), (1, -inf, 1.0, 0.3)]), (2.0, [(0, 0.5, inf, 0.6), (1, 1.0, inf, 0.7)]),
        (-1.0, [(2, -inf, 0.0, 0.5), (0, -inf, 0.2, 0.25)]), (3.0, [(2, -inf, 0.0, 0.5), (0, 0.2, inf, 0.75)]), (0.5, [(2, 0.0, inf, 0.5)])]

    def value(row, known):
        total = 0.0
        for v, path in leaves:
            for f, lo, hi, z in path:
                v *= float(lo < row[f] <= hi) if f in known else z
            total += v
        return total

    x = np.array([[0.1, 2.0, -1.0], [0.9, 0.5, 1.0], [0.6, 3.0, -0.5]])
    got = trees.explain_matrix(x, leaves, 3)
    for i, row in enumerate(x):
        want = np.zeros(3)
        for order in permutations(range(3)):
            known = set()
            for f in order:
                before = value(row, known)
                known.add(f)
                want[f] += (value(row, known) - before) / 6
        assert got[i] == pytest.approx(want)
        assert trees.base_value(leaves) + got[i].sum() == pytest.approx(value(row, {0, 1, 2}))
