"""Model families on ``pyspark.ml``: preparation, fitting, scoring, tuning, nested grouped evaluation.

Folds are prepared once and written; every family and trial reads that table. Fits are independent
Spark jobs started from a few threads, so small fits share the cluster (FAIR pools where configured).
The driver holds parameters, model handles and metric rows, never records.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.functions.draws import draw_uniform
from kinfold.functions.scalars import argmax, complexity, softmax, squash
from kinfold.operators import impute as I, metrics as M, rollup as R, weights as W
from kinfold.operators.resample import weighted_resample
from kinfold.session import cut

FAMILIES = ("gbt", "mlp", "rf", "svm")
SCORE_TYPE = {"rf": "probability", "gbt": "probability", "mlp": "probability", "svm": "squashed_decision"}


# --- search spaces -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Space:
    """One parameter: ``int``, ``float``, ``log`` (log-uniform float) or ``choice``; ``when`` = (other, minimum)."""
    name: str
    kind: str
    low: float = 0.0
    high: float = 0.0
    choices: tuple = ()
    when: tuple | None = None


SPACES = {
    "rf": (Space("n_estimators", "int", 10, 40), Space("max_depth", "int", 2, 6), Space("min_leaf", "int", 1, 8)),
    "gbt": (Space("n_estimators", "int", 5, 15), Space("max_depth", "int", 2, 4), Space("learning_rate", "log", 0.02, 0.3)),
    "svm": (Space("C", "log", 0.1, 50.0), Space("gamma", "log", 0.01, 1.0), Space("components", "choice", choices=(32.0, 64.0))),
    "mlp": (Space("layers", "int", 1, 2), Space("hidden_1", "int", 8, 24), Space("hidden_2", "int", 4, 12, when=("layers", 2)), Space("step", "log", 0.01, 0.3)),
}


def trial_parameters(model: str, number: Column, seed: int) -> Column:
    """Parameter map of a trial from hashed uniforms: the same trial number gives the same parameters anywhere."""
    values: dict[str, Column] = {}
    for s in SPACES[model]:
        u = draw_uniform(seed, model, s.name, number)
        if s.kind == "int":
            v = F.lit(s.low) + F.floor(u * (s.high - s.low + 1))
        elif s.kind == "float":
            v = F.lit(s.low) + u * (s.high - s.low)
        elif s.kind == "log":
            v = F.exp(F.lit(math.log(s.low)) + u * (math.log(s.high) - math.log(s.low)))
        else:
            v = F.element_at(F.array(*[F.lit(float(c)) for c in s.choices]), (F.floor(u * len(s.choices)) + 1).cast("int"))
        if s.when:
            v = F.when(values[s.when[0]] >= s.when[1], v)
        values[s.name] = v.cast("double")
    return F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())


def trial_table(numbers: DataFrame, number: str, models: Sequence[str], seed: int) -> DataFrame:
    parts = [numbers.select(F.lit(m).alias("model"), F.col(number).alias("trial_number"), trial_parameters(m, F.col(number), seed).alias("params")) for m in models]
    return reduce(DataFrame.unionByName, parts)


# --- preparation -------------------------------------------------------------------------------

def prepare_folds(df: DataFrame, record: str, own_fold: str, folds: int, features: Sequence[str], k: int, robust: bool = True) -> DataFrame:
    """Completed features of every row as each fold sees it: (fold, is_training, record, ids, features).

    Statistics and donors come from the fold's training rows only. Written once, read by every model.
    """
    ids = [c for c in df.columns if c not in features]
    df = cut(df)
    guess = I.complete(df, record, own_fold, folds, features, k, robust).groupBy("fold", record).agg(*[
        F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"_g_{f}") for f in features])
    rows = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(guess, ["fold", record], "left")
    return cut(rows.select("fold", (F.col("fold") != F.col(own_fold)).alias("is_training"), *ids,
                           *[F.coalesce(f, f"_g_{f}").alias(f) for f in features], *[F.col(f).isNull().cast("int").alias(f"imputed_{f}") for f in features]))


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def standardizer(train: DataFrame, features: Sequence[str]) -> SQLTransformer:
    """Mean / sd scaling as a savable stage; one aggregate row of statistics."""
    row = train.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    terms = ", ".join(f"({_quoted(f)} - {float(row[f'm{i}'])!r}D) / {float(row[f's{i}'] or 1.0)!r}D AS z_{i}" for i, f in enumerate(features))
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def fourier_features(inputs: int, components: int, gamma: float, seed: int) -> SQLTransformer:
    """Random Fourier features of the RBF kernel (Rahimi and Recht, 2007) over ``z_0..``; a linear SVM on
    them approximates the kernel machine and scales with rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (components, inputs))
    b = rng.uniform(0.0, 2 * math.pi, components)
    scale = math.sqrt(2.0 / components)
    terms = ", ".join(
        f"{scale!r}D * cos({' + '.join(f'{float(w[j, i])!r}D * z_{i}' for i in range(inputs))} + {float(b[j])!r}D) AS rff_{j}" for j in range(components))
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


# --- fitting and scoring -----------------------------------------------------------------------

@dataclass
class Fitted:
    model: PipelineModel
    family: str
    classes: int
    params: dict
    features: list
    converged: bool = True
    iterations: int = 0
    metadata: dict = field(default_factory=dict)


def _weighted(train: DataFrame, group: str, label: str, classes: int) -> DataFrame:
    if classes == 2:
        return W.inverse_group_weights(train, group)
    return W.balanced_group_weights(train, group, label, classes)


def fit(train: DataFrame, family: str, params: dict, features: Sequence[str], label: str, group: str, record: str, classes: int, seed: int) -> Fitted:
    """Fit one family on weighted rows; the MLP has no weights and takes a weighted resample instead."""
    p = dict(params)
    features = list(features)
    rows = cut(_weighted(train.withColumn("label", F.col(label).cast("double")), group, "label", classes))
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    iterations, converged = 0, True
    if family == "rf":
        est = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
                                     minInstancesPerNode=int(p.get("min_leaf", 1)), impurity="gini" if classes == 2 else "entropy", seed=seed)
        stages = [assemble, est]
    elif family == "gbt":
        est = GBTClassifier(labelCol="label", weightCol="weight", maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]), seed=seed)
        stages = [assemble, est if classes == 2 else OneVsRest(classifier=est, labelCol="label", weightCol="weight")]
    elif family == "svm":
        n = int(p.get("components", 32))
        # the loss is a weighted mean here and a weighted sum where C is defined
        total = float(rows.agg(F.sum("weight")).first()[0] or 1.0)
        est = LinearSVC(labelCol="label", weightCol="weight", regParam=1.0 / (float(p["C"]) * total), maxIter=50)
        stages = [standardizer(rows, features), fourier_features(len(features), n, float(p["gamma"]), seed),
                  VectorAssembler(inputCols=[f"rff_{j}" for j in range(n)], outputCol="features"),
                  est if classes == 2 else OneVsRest(classifier=est, labelCol="label", weightCol="weight")]
    elif family == "mlp":
        picked = weighted_resample(rows, record, F.col("weight"), seed)
        rows = cut(picked.join(rows, record))
        hidden = [int(p["hidden_1"])] + ([int(p["hidden_2"])] if p.get("hidden_2") else [])
        est = MultilayerPerceptronClassifier(labelCol="label", layers=[len(features), *hidden, classes], maxIter=60, stepSize=float(p["step"]), seed=seed)
        stages = [standardizer(rows, features), VectorAssembler(inputCols=[f"z_{i}" for i in range(len(features))], outputCol="features"), est]
    else:
        raise ValueError(f"unknown model family {family}")
    model = Pipeline(stages=stages).fit(rows)
    last = model.stages[-1]
    if hasattr(est, "getMaxIter") and getattr(last, "hasSummary", False):
        iterations = int(last.summary().totalIterations) if callable(last.summary) else int(last.summary.totalIterations)
        converged = iterations < est.getMaxIter()
    return Fitted(model, family, classes, p, features, converged, iterations)


def score(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """``rows`` plus ``score`` (binary) or ``s0..`` (multiclass) and the predicted class. Stateless."""
    out = fitted.model.transform(rows)
    keep = [F.col(c) for c in rows.columns]
    if fitted.classes == 2:
        if fitted.family == "svm":
            value = squash(vector_to_array("rawPrediction")[1])
        else:
            value = vector_to_array("probability")[1]
        return out.select(*keep, value.alias("score"))
    has_probability = "probability" in out.columns
    raw = vector_to_array("probability") if has_probability else softmax(vector_to_array("rawPrediction"))
    with_scores = out.select(*keep, raw.alias("_s"))
    return with_scores.select(*keep, *[F.col("_s")[i].alias(f"s{i}") for i in range(fitted.classes)], argmax(F.col("_s")).alias("predicted"))


def save_bundle(fitted: Fitted, path: str) -> str:
    fitted.model.write().overwrite().save(path)
    meta = {"family": fitted.family, "classes": fitted.classes, "params": fitted.params, "features": fitted.features}
    SparkSession.active().createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(path + "_meta")
    return path


def load_bundle(spark, path: str) -> Fitted:
    meta = json.loads(spark.read.text(path + "_meta").first()[0])
    return Fitted(PipelineModel.load(path), meta["family"], meta["classes"], meta["params"], meta["features"])


def run_jobs(jobs: Sequence, threads: int = 4) -> list:
    """Start independent Spark jobs from a few threads; results keep their order."""
    spark = SparkSession.active()

    def wrapped(job):
        return inheritable_thread_target(spark)(job)()
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(wrapped, jobs))


# --- tuning and nested evaluation --------------------------------------------------------------

def out_of_fold(prepared: DataFrame, folds: Sequence[int], family: str, params: dict, features: Sequence[str], label: str, group: str, record: str,
                classes: int, seed: int, keep: Sequence[str]) -> DataFrame:
    """Scores of every validation row by the model that did not see its fold."""
    parts = []
    for f in folds:
        part = prepared.where(F.col("fold") == f)
        model = fit(part.where("is_training"), family, params, features, label, group, record, classes, seed + f)
        scored = score(model, part.where("not is_training"))
        columns = ["score"] if classes == 2 else [f"s{i}" for i in range(classes)] + ["predicted"]
        parts.append(scored.select("fold", record, group, label, *keep, *columns).withColumn("converged", F.lit(model.converged)))
    return cut(reduce(DataFrame.unionByName, parts))


def evaluate_trial(oof: DataFrame, group: str, label: str, family: str, params: dict) -> DataFrame:
    """Pooled group metrics of one trial, spread over folds and complexity: one row."""
    groups = cut(R.group_scores(oof.withColumn("one", F.lit(1)), ["one"], group, label, "fold", "score"))
    pooled = M.binary_metrics(groups, ["one"], label, "score").drop("one")
    spread = M.auc_ap(groups, ["fold"], label, "score").agg(F.stddev_samp("roc_auc").alias("fold_sd"))
    size = complexity(F.lit(family), F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(float(v)))]))
    return pooled.withColumns({"fold_sd": spread.scalar(), "complexity": size, "converged": oof.agg(F.bool_and("converged")).scalar()})


def tune(prepared: DataFrame, folds: Sequence[int], family: str, trials: DataFrame, features: Sequence[str], label: str, group: str, record: str,
         seed: int, done: DataFrame | None = None, threads: int = 4) -> tuple[DataFrame, dict]:
    """Evaluate the trials that are not done yet, as concurrent jobs.

    Returns one row per trial and the out-of-fold scores of each trial by number.
    """
    todo = trials.where(F.col("model") == family)
    if done is not None:
        todo = todo.join(done, ["model", "trial_number"], "left_anti")
    rows = todo.orderBy("trial_number").collect()  # the trial budget: a configured few

    def job(r):
        def run():
            oof = out_of_fold(prepared, folds, family, r["params"], features, label, group, record, 2, seed + int(r["trial_number"]), [])
            row = cut(evaluate_trial(oof, group, label, family, r["params"]).select(
                F.lit(family).alias("model"), F.lit(int(r["trial_number"])).alias("trial_number"), F.lit("COMPLETE").alias("state"),
                F.lit(json.dumps(r["params"])).alias("params_json"), "roc_auc", "average_precision", "f1", "fold_sd", "complexity", "converged"))
            return row, oof
        return run

    finished = run_jobs([job(r) for r in rows], threads)
    return reduce(DataFrame.unionByName, [row for row, _ in finished]), {int(r["trial_number"]): oof for r, (_, oof) in zip(rows, finished)}


def nested_evaluation(df: DataFrame, features: Sequence[str], label: str, group: str, block: str, record: str, trials: DataFrame,
                      repeats: int = 1, outer: int = 2, inner: int = 2, families: Sequence[str] = FAMILIES, k: int = 5, seed: int = 42, threads: int = 8):
    """Repeated nested grouped evaluation.

    Per repeat: grouped outer folds; per outer fold: inner folds over its training blocks, trials, choice
    of trial and threshold on inner scores, refit, outer scores. Returns (record OOF, trial table,
    {(repeat, fold, family): Fitted}).
    """
    from kinfold.operators import selection as S, splits

    df = cut(df)
    oof_parts, trial_parts, bundles = [], [], {}
    for repeat in range(1, repeats + 1):
        dealt = cut(splits.grouped_split(df, block, label, 2, outer, [seed + repeat * 10000 + i for i in range(4)]))
        placed = df.join(dealt.select(block, F.col("fold").alias("own_fold")), block)
        prepared = prepare_folds(placed, record, "own_fold", outer, features, k)
        jobs, names = [], []
        for fold in range(outer):
            train = placed.where(F.col("own_fold") != fold).drop("own_fold")
            parts = cut(splits.inner_split(train, block, label, 2, [inner, 2], seed + repeat * 10000 + fold * 1000))
            n_inner = parts.first()["folds"]
            inner_prepared = prepare_folds(train.join(parts.select(block, F.col("fold").alias("own_fold")), block), record, "own_fold", n_inner, features, k)
            outer_rows = prepared.where(F.col("fold") == fold)

            def job(family, index, fold=fold, repeat=repeat, inner_prepared=inner_prepared, n_inner=n_inner, outer_rows=outer_rows):
                def run():
                    base = seed + repeat * 10000 + fold * 1000 + index * 100
                    results, scores = tune(inner_prepared, range(n_inner), family, trials, features, label, group, record, base, threads=1)
                    best = S.choose_trial(results.withColumn("one", F.lit(1)), ["one"]).first()
                    params = json.loads(best["params_json"])
                    groups = R.group_scores(scores[int(best["trial_number"])].withColumn("one", F.lit(1)), ["one"], group, label, "fold", "score")
                    cutoff = S.choose_threshold(M.grid_metrics(groups, ["one"], label, "score", [round(0.1 + i * 0.005, 3) for i in range(161)]), ["one"]).first()
                    model = fit(outer_rows.where("is_training"), family, params, features, label, group, record, 2, base)
                    scored = score(model, outer_rows.where("not is_training")).select(
                        record, group, block, F.col(label).alias("target"), "score", F.lit(family).alias("model"), F.lit(repeat).alias("repeat"),
                        F.lit(fold).alias("outer_fold"), F.lit(float(cutoff["threshold"])).alias("threshold"), F.lit(cutoff["threshold_status"]).alias("threshold_status"),
                        F.lit(SCORE_TYPE[family]).alias("score_type"), F.sha2(F.lit(best["params_json"]), 256).alias("parameter_hash"), F.lit(model.converged).alias("optimizer_converged"))
                    return cut(scored), results.withColumns({"repeat": F.lit(repeat), "outer_fold": F.lit(fold)}), model
                return run

            for index, family in enumerate(families):
                jobs.append(job(family, index))
                names.append((repeat, fold, family))
        # all folds and families of a repeat are independent jobs
        for (scored, results, model), name in zip(run_jobs(jobs, threads), names):
            oof_parts.append(scored)
            trial_parts.append(results)
            bundles[name] = model
    return reduce(DataFrame.unionByName, oof_parts), reduce(DataFrame.unionByName, trial_parts), bundles


def holdout_evaluation(fitted: Fitted, holdout: DataFrame, group: str, label: str, block: str, evaluable: Column, names: Sequence[str]):
    """One-time scoring of a holdout: (record and stratum metrics, coverage by class)."""
    k = fitted.classes
    cover = R.coverage(holdout, [label], evaluable)
    scored = cut(score(fitted, holdout.where(evaluable)).withColumn("true_code", F.col(label)))
    record_level = M.class_metrics(M.confusion(scored, [], "true_code", "predicted", k), k, names=names).withColumn("level", F.lit("record"))
    strata = R.class_strata(scored, [], group, "true_code", block, [f"s{i}" for i in range(k)])
    stratum_level = M.class_metrics(M.confusion(strata, [], "true_code", "predicted", k), k, names=names).withColumn("level", F.lit("stratum"))
    return record_level.unionByName(stratum_level), cover


def calibrated_validation(prepared: DataFrame, folds: int, family: str, params: dict, features: Sequence[str], label: str, group: str, block: str, record: str,
                          classes: int, seed: int) -> DataFrame:
    """Out-of-fold class scores, raw and temperature-calibrated.

    The temperature of a fold is fitted on the out-of-fold scores of the other folds. Their models never saw the rows they
    scored, but they were trained on this fold's rows, labels included: the temperature is not free of them. A strict
    version scores the other folds with models trained without this fold too.
    """
    from kinfold.functions.scalars import temper

    names = [f"s{i}" for i in range(classes)]
    oof = out_of_fold(prepared, range(folds), family, params, features, label, group, record, classes, seed, [block])
    others = oof.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("fold"))).alias("target_fold"), F.col(label).alias("true_code"), *names)
    t = M.fit_temperature(others, ["target_fold"], "true_code", names).select(F.col("target_fold").alias("fold"), "temperature", "fitted")
    both = oof.join(t, "fold").withColumn("_c", temper(F.array(*names), "temperature"))
    return both.select("fold", record, group, block, F.col(label).alias("true_code"), *names, *[F.col("_c")[i].alias(f"c{i}") for i in range(classes)], "predicted", "temperature", "fitted")
