"""Model jobs (I4, L1-L8, L10-L12, S12) and model attribution.

Rows are the given embedding vectors: eight components as features with hashed gaps, groups of
neighbouring ids with one label, blocks of groups.
"""

from pyspark.sql import functions as F

from kinfold.operators import metrics as M, models as L, rollup as R, selection as S, splits, trees as X
from kinfold.plans.fixtures import table
from kinfold.plans.impute_queries import masked
from kinfold.plans.metric_queries import rounded
from kinfold.plans.registry import query
from kinfold.session import cut, scratch_path

DIMS = [f"x{i}" for i in range(8)]
NAMES = ["c0", "c1", "c2"]
DEFAULTS = {
    "rf": {"n_estimators": 15, "max_depth": 4, "min_leaf": 2}, "gbt": {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.2},
    "svm": {"C": 5.0, "gamma": 0.1, "components": 32}, "mlp": {"hidden_1": 12, "step": 0.1},
}
IDS = dict(label="target", group="group_id", record="vec_id")


def rows(spark, sf):
    """Vectors with group, block, binary target and three-class code."""
    base = masked(spark, sf, len(DIMS)).drop("label", "own_fold")
    raw = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("raw"))
    slab = F.floor(F.col("vec_id") / 40)
    return base.join(raw, "vec_id").select(
        "vec_id", (slab * 10 + F.col("raw")).cast("bigint").alias("group_id"), F.floor(F.col("vec_id") / 80).cast("bigint").alias("block"),
        (F.col("raw") % 2).cast("int").alias("target"), (F.col("raw") % 3).cast("int").alias("code3"), *DIMS)


def prepared(spark, sf, folds=2, label="target", k=2):
    base = cut(rows(spark, sf))
    dealt = splits.grouped_split(base, "block", label, k, folds, [42, 43, 44])
    placed = base.join(dealt.select("block", F.col("fold").alias("own_fold")), "block")
    return L.prepare_folds(placed, "vec_id", "own_fold", folds, DIMS, 5)


def oof(spark, sf, family, classes=2):
    ready = prepared(spark, sf, label="target" if classes == 2 else "code3", k=classes)
    return L.out_of_fold(ready, range(2), family, DEFAULTS[family], DIMS, "target" if classes == 2 else "code3", "group_id", "vec_id", classes, 42, ["block"])


@query("i4_standardised_features")
def i4(spark, sf):
    ready = prepared(spark, sf)
    first = ready.where("fold = 0")
    scaled = L.standardizer(first.where("is_training"), DIMS).transform(first)
    return scaled.select("vec_id", "is_training", *[f"z_{i}" for i in range(len(DIMS))])


@query("l1_random_forest")
def l1(spark, sf):
    return oof(spark, sf, "rf")


@query("l1_random_forest_3class")
def l1b(spark, sf):
    return oof(spark, sf, "rf", 3)


@query("l2_gradient_boosting")
def l2(spark, sf):
    return oof(spark, sf, "gbt")


@query("l2_gradient_boosting_3class")
def l2b(spark, sf):
    return oof(spark, sf, "gbt", 3)


@query("l3_kernel_svm")
def l3(spark, sf):
    return oof(spark, sf, "svm")


@query("l4_mlp_resampled")
def l4(spark, sf):
    return oof(spark, sf, "mlp")


@query("l5_fit_predict_labelled")
def l5(spark, sf):
    first = prepared(spark, sf).where("fold = 0")
    model = L.fit(first.where("is_training"), "svm", DEFAULTS["svm"], DIMS, "target", "group_id", "vec_id", 2, 42)
    return L.score(model, first.where("not is_training")).select(
        "vec_id", "target", "score", F.lit(L.SCORE_TYPE["svm"]).alias("score_type"), F.lit(model.converged).alias("converged"), F.lit(model.iterations).alias("iterations"))


def _u(model, name):
    return f"CAST('0x' || substr(md5('5:{model}:{name}:' || p_partkey), 1, 8) AS BIGINT) / 4294967296::DOUBLE"


def _space_sql():
    parts = []
    for model, space in L.SPACES.items():
        for s in space:
            u = _u(model, s.name)
            if s.kind == "int":
                v = f"{s.low} + floor({u} * {s.high - s.low + 1})"
            elif s.kind == "log":
                v = f"exp(ln({s.low!r}::DOUBLE) + {u} * (ln({s.high!r}::DOUBLE) - ln({s.low!r}::DOUBLE)))"
            else:
                v = f"[{', '.join(map(repr, s.choices))}][CAST(floor({u} * {len(s.choices)}) AS INTEGER) + 1]"
            where = ""
            if s.when:
                other = next(o for o in space if o.name == s.when[0])
                where = f" WHERE {other.low} + floor({_u(model, other.name)} * {other.high - other.low + 1}) >= {s.when[1]}"
            parts.append(f"SELECT '{model}' AS model, p_partkey AS trial_number, '{s.name}' AS name, round(CAST({v} AS DOUBLE), 6) AS value FROM part{where}")
    return " UNION ALL ".join(parts)


@query("l6_trial_space", _space_sql())
def l6(spark, sf):
    trials = L.trial_table(table(spark, sf, "part").select("p_partkey"), "p_partkey", L.FAMILIES, 5)
    return rounded(trials.select("model", "trial_number", F.explode("params").alias("name", "value")), ["value"])


def trial_numbers(spark, sf, n):
    """The first trial numbers, read from the parts table: the trial budget."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("trial")).orderBy("trial").limit(n)


@query("l7_trial_evaluation")
def l7(spark, sf):
    ready = prepared(spark, sf)
    trials = cut(L.trial_table(trial_numbers(spark, sf, 3), "trial", ["rf", "gbt"], 5))
    done, _ = L.tune(ready, range(2), "rf", trials.where("trial_number < 1"), DIMS, "target", "group_id", "vec_id", 42)
    # resume: finished trials are skipped
    rest, _ = L.tune(ready, range(2), "rf", trials, DIMS, "target", "group_id", "vec_id", 42, done=done.select("model", "trial_number"))
    return done.unionByName(rest)


def nested(spark, sf, families=L.FAMILIES):
    trials = cut(L.trial_table(trial_numbers(spark, sf, 1), "trial", families, 5))
    return L.nested_evaluation(rows(spark, sf), DIMS, "target", "group_id", "block", "vec_id", trials, repeats=1, outer=2, inner=2, families=families)


@query("l8_nested_evaluation")
def l8(spark, sf):
    scored, _, _ = nested(spark, sf)
    return R.group_scores(scored, ["model", "repeat", "outer_fold"], "group_id", "target", "block", "score")


def three_class_model(spark, sf):
    ready = cut(prepared(spark, sf, label="code3", k=3).where("fold = 0"))
    model = L.fit(ready.where("is_training"), "rf", DEFAULTS["rf"], DIMS, "code3", "group_id", "vec_id", 3, 42)
    return ready, model


@query("l10_holdout_evaluation")
def l10(spark, sf):
    ready, model = three_class_model(spark, sf)
    gaps = sum((F.col(f"imputed_{f}") for f in DIMS), F.lit(0))
    got, _ = L.holdout_evaluation(model, ready.where("not is_training"), "group_id", "code3", "block", gaps < 3, NAMES)
    return got.select("level", "macro_f1", "balanced_accuracy", *[f"f1_{n}" for n in NAMES])


@query("l11_challenge_scoring")
def l11(spark, sf):
    """Every outer model scores the records of groups it must not be judged on."""
    ready = prepared(spark, sf)
    challenge = ready.where((F.col("group_id") % 7 == 0))
    parts = []
    for f in range(2):
        model = L.fit(ready.where((F.col("fold") == f) & F.col("is_training") & (F.col("group_id") % 7 != 0)), "rf", DEFAULTS["rf"], DIMS, "target", "group_id", "vec_id", 2, 42 + f)
        trained = cut(ready.where((F.col("fold") == f) & F.col("is_training") & (F.col("group_id") % 7 != 0)).select("block").distinct().withColumn("overlap", F.lit(True)))
        scored = L.score(model, challenge.where(F.col("fold") == f).drop("target", "code3")).select("vec_id", "group_id", "block", "score", F.lit(f).alias("outer_model"))
        parts.append(scored.join(trained, "block", "left").withColumn("overlap", F.coalesce("overlap", F.lit(False))))
    return R.ensemble_records(parts[0].unionByName(parts[1]), ["vec_id", "group_id", "block"], "score", "overlap")


@query("l12_calibrated_validation")
def l12(spark, sf):
    ready = prepared(spark, sf, label="code3", k=3)
    return L.calibrated_validation(ready, 2, "rf", DEFAULTS["rf"], DIMS, "code3", "group_id", "block", "vec_id", 3, 42)


@query("s12_model_bundle")
def s12(spark, sf):
    first = cut(prepared(spark, sf).where("fold = 0"))
    model = L.fit(first.where("is_training"), "gbt", DEFAULTS["gbt"], DIMS, "target", "group_id", "vec_id", 2, 42)
    again = L.load_bundle(spark, L.save_bundle(model, scratch_path(spark, "bundle")))
    fresh = first.where("not is_training")
    return L.score(model, fresh).select("vec_id", "score").join(L.score(again, fresh).select("vec_id", F.col("score").alias("reloaded_score")), "vec_id")


def explained(spark, sf, family="gbt", ready=None, folds=(0, 1), repeat=1, seed=42):
    """Cross-fitted attributions: every row explained by the model that did not see its fold."""
    ready = prepared(spark, sf) if ready is None else ready
    parts = []
    for f in folds:
        part = ready.where(F.col("fold") == f)
        model = L.fit(part.where("is_training"), family, DEFAULTS[family], DIMS, "target", "group_id", "vec_id", 2, seed + f)
        leaves = X.leaf_paths(spark, model.model.stages[-1], family)
        seen = X.explain(part.where("not is_training"), ["fold", "vec_id", "group_id", "block"], DIMS, leaves)
        scored = L.score(model, part.where("not is_training")).select("vec_id", "score")
        parts.append(seen.join(scored, "vec_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return X.additivity(cut(out)).withColumn("repeat", F.lit(repeat))


@query("x1_tree_attribution")
def x1(spark, sf):
    got = explained(spark, sf, "gbt").withColumn("family", F.lit("gbt")).unionByName(explained(spark, sf, "rf").withColumn("family", F.lit("rf")))
    # a boosted margin m gives the probability 1 / (1 + exp(-2m)); a forest's output is the probability
    link = F.when(F.col("family") == "gbt", 1 / (1 + F.exp(-2 * F.col("model_output")))).otherwise(F.col("model_output"))
    return got.select("family", "fold", "vec_id", "base_value", "model_output", "score", "additivity_error", F.abs(link - F.col("score")).alias("reproduction_error"))


@query("x2_oof_attribution")
def x2(spark, sf):
    ready = prepared(spark, sf)
    got = explained(spark, sf, "gbt", ready)
    long = X.long_form(got, ["repeat", "fold", "vec_id", "group_id", "block"], DIMS)
    flags = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("completed"), F.when(F.col(f"imputed_{f}") == 0, F.col(f)).alias("observed"), F.col(f"imputed_{f}").alias("imputed")) for f in DIMS])
    values = ready.where("not is_training").select("fold", "vec_id", F.explode(flags).alias("e")).select("fold", "vec_id", "e.*")
    return long.join(values, ["fold", "vec_id", "feature"])


@query("x3_repeated_attribution")
def x3(spark, sf):
    base = cut(rows(spark, sf))
    parts = []
    for repeat, seed in enumerate((101, 202), start=1):
        dealt = splits.grouped_split(base, "block", "target", 2, 2, [seed])
        ready = L.prepare_folds(base.join(dealt.select("block", F.col("fold").alias("own_fold")), "block"), "vec_id", "own_fold", 2, DIMS, 5)
        parts.append(explained(spark, sf, "rf", ready, repeat=repeat, seed=seed))
    long = X.long_form(parts[0].unionByName(parts[1]), ["repeat", "fold", "vec_id", "group_id"], DIMS)
    return long.groupBy("repeat", "fold", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs"), F.count("*").alias("n"))


def panel_metrics(spark, sf, features, name):
    ready = prepared(spark, sf)
    got = L.out_of_fold(ready, range(2), "rf", DEFAULTS["rf"], features, "target", "group_id", "vec_id", 2, 42, [])
    groups = R.group_scores(got.withColumn("panel", F.lit(name)), ["panel"], "group_id", "target", "fold", "score")
    return M.binary_metrics(groups, ["panel"], "target", "score").select("panel", "roc_auc", "average_precision", "f1")


@query("x7_panel_sensitivity")
def x7(spark, sf):
    full = panel_metrics(spark, sf, DIMS, "full")
    return full.unionByName(panel_metrics(spark, sf, DIMS[:5], "quality_panel"))


@query("x8_missing_indicator_sensitivity")
def x8(spark, sf):
    full = panel_metrics(spark, sf, DIMS, "full")
    return full.unionByName(panel_metrics(spark, sf, DIMS + [f"imputed_{f}" for f in DIMS], "with_indicators_pooled"))
