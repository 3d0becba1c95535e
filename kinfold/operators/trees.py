"""Exact path-dependent tree attribution (Lundberg et al., 2018) of saved tree ensembles.

A fitted ensemble is a table of nodes; its size is bounded by trees x 2^depth, so its leaf paths are
shipped with the task. Rows stay distributed: each Arrow batch is explained with array arithmetic,
one pass per leaf.
"""

from __future__ import annotations

from math import factorial
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.session import scratch_path

MAX_NODES = 2_000_000


def ensemble_nodes(spark: SparkSession, model) -> DataFrame:
    """Node table of a fitted random forest or boosted ensemble."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    return spark.read.parquet(path + "/data")


def leaf_paths(spark: SparkSession, model, kind: str, target_class: int = 1) -> list:
    """``[(value, [(feature, low, high, fraction)])]`` per leaf.

    ``fraction`` is the share of weighted training cover that follows the path's splits on that feature.
    For ``rf`` the value is the class share of the leaf over the number of trees, for ``gbt`` the leaf
    prediction times the tree weight.
    """
    nodes = ensemble_nodes(spark, model)
    if nodes.count() > MAX_NODES:
        raise ValueError("ensemble is too large to ship with tasks")
    rows = nodes.select("treeID", "nodeData.*").collect()
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights) if kind == "gbt" else [1.0 / len(trees)] * len(trees)
    cover = (lambda r: float(r["impurityStats"][0])) if kind == "gbt" else (lambda r: float(sum(r["impurityStats"])))
    leaves = []
    for tree, nodes_of in trees.items():
        stack = [(nodes_of[0], {})]
        while stack:
            node, path = stack.pop()
            if node["leftChild"] < 0:
                value = node["prediction"] if kind == "gbt" else node["impurityStats"][target_class] / sum(node["impurityStats"])
                leaves.append((float(value) * weights[tree], [(f, lo, hi, z) for f, (lo, hi, z) in path.items()]))
                continue
            f = node["split"]["featureIndex"]
            cut_at = float(node["split"]["leftCategoriesOrThreshold"][0])
            left, right = nodes_of[node["leftChild"]], nodes_of[node["rightChild"]]
            lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
            total = cover(node)
            stack.append((left, {**path, f: (lo, min(hi, cut_at), z * cover(left) / total)}))
            stack.append((right, {**path, f: (max(lo, cut_at), hi, z * cover(right) / total)}))
    return leaves


def base_value(leaves: list) -> float:
    return float(sum(v * np.prod([z for *_, z in path]) for v, path in leaves))


def explain_matrix(x: np.ndarray, leaves: list, features: int) -> np.ndarray:
    """Attribution matrix: each leaf adds its value times the Shapley weight of following its splits."""
    phi = np.zeros((len(x), features))
    for value, path in leaves:
        d = len(path)
        if d == 0:
            continue
        follows = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in path]
        share = [z for *_, z in path]
        order = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
        for j in range(d):
            # coefficients of the product over the other splits: subsets by size
            poly = [np.ones(len(x))]
            for i in range(d):
                if i == j:
                    continue
                grown = [c * share[i] for c in poly] + [np.zeros(len(x))]
                for s, c in enumerate(poly):
                    grown[s + 1] = grown[s + 1] + c * follows[i]
                poly = grown
            total = sum(w * c for w, c in zip(order, poly))
            phi[:, path[j][0]] += value * (follows[j] - share[j]) * total
    return phi


def explain(rows: DataFrame, ids: Sequence[str], features: Sequence[str], leaves: list) -> DataFrame:
    """Long attributions: ids, feature, shap, completed value, base_value, model_output."""
    base = base_value(leaves)
    names = list(features)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*ids).schema) + ", phi array<double>, model_output double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(float)
            out = batch[list(ids)].copy()
            phi = explain_matrix(x, leaves, len(names))
            margin = np.zeros(len(x))
            for value, path in leaves:
                hit = np.ones(len(x), dtype=bool)
                for f, lo, hi, _ in path:
                    hit &= (x[:, f] > lo) & (x[:, f] <= hi)
                margin += value * hit
            out["phi"] = list(phi)
            out["model_output"] = margin
            yield out

    return rows.select(*ids, *names).mapInPandas(run, schema).withColumn("base_value", F.lit(base))


def additivity(explained: DataFrame) -> DataFrame:
    """|base + sum of attributions - output| per row."""
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    return explained.withColumn("additivity_error", F.abs(F.col("base_value") + total - F.col("model_output")))


def long_form(explained: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    return explained.select(*ids, "base_value", "model_output", F.posexplode("phi").alias("_i", "shap")).select(
        *ids, "base_value", "model_output", F.element_at(names, F.col("_i") + 1).alias("feature"), "shap")
