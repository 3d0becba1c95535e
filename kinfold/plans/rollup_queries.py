"""Evaluation-level rollups (A10-A22, A27, A30, A31), set operations (U) and reshaping (R)."""

from pyspark.sql import functions as F

from kinfold.functions.draws import draw_uniform
from kinfold.functions.scalars import category
from kinfold.operators import cohort as C, joins as J, metrics as M, ordered as O, rollup as R, selection as K
from kinfold.plans.fixtures import CLASSES, FEATURES, attr, class_oof, oof, records, stable, table, with_views
from kinfold.plans.metric_queries import TRIALS, group_scores, rounded, strata, trials
from kinfold.plans.registry import query
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)


@query("a10_group_scores", with_views("oof", """
SELECT model, repeat, group_id, min(target) AS target, min(block) AS block, round(median(score), 6) AS score, round(avg(score), 6) AS mean_score, count(*) AS n_records FROM oof GROUP BY 1, 2, 3"""))
def a10(spark, sf):
    return rounded(group_scores(spark, sf), ["score", "mean_score"])


@query("a11_class_strata", with_views("strata_pred", """
SELECT model, repeat, group_id, true_code, block, n_records, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, predicted, group_id || '|' || true_code AS stratum_id FROM strata_pred"""))
def a11(spark, sf):
    return rounded(strata(spark, sf), ["s0", "s1", "s2"])


@query("a12_consensus", with_views("group_oof", """
SELECT model, group_id, min(target) AS target, min(block) AS block, round(median(score), 6) AS score, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS score_sd,
 round(avg(CAST(score >= 0.44::DOUBLE + repeat * 0.03::DOUBLE AS INTEGER)), 6) AS vote_fraction, count(DISTINCT repeat) AS repeats, count(DISTINCT repeat) = 3 AS complete,
 CAST(avg(CAST(score >= 0.44::DOUBLE + repeat * 0.03::DOUBLE AS INTEGER)) >= 0.5 AS INTEGER) AS prediction FROM group_oof GROUP BY 1, 2"""))
def a12(spark, sf):
    stored = group_scores(spark, sf).withColumn("prediction", F.col("score") >= F.lit(0.44) + F.col("repeat") * F.lit(0.03))
    return rounded(R.consensus(stored, ["model"], "group_id", 3, prediction="prediction"), ["score", "mean_score", "score_sd", "vote_fraction"])


@query("a13_mean_over_repeats", with_views("class_oof", """
SELECT model, record_id, round(avg(s0), 6) AS s0, round(avg(s1), 6) AS s1, round(avg(s2), 6) AS s2, count(DISTINCT repeat) AS repeats FROM class_oof GROUP BY 1, 2"""))
def a13(spark, sf):
    return rounded(R.mean_over_repeats(class_oof(spark, sf), ["model", "record_id"], ["s0", "s1", "s2"]), ["s0", "s1", "s2"])


CHALLENGE = """
ch AS (SELECT record_id, group_id, block, m, o, 0.7::DOUBLE * (CAST('0x' || substr(md5(concat_ws(':', 'outer', m, o, record_id)), 1, 8) AS BIGINT) / 4294967296::DOUBLE) + label * 0.2::DOUBLE AS score,
  block % 5 = o AS overlap FROM records, (SELECT range AS m FROM range(1, 4)), (SELECT range AS o FROM range(0, 5)) WHERE group_id % 25 = 0),
er AS (SELECT record_id, group_id, block, median(score) AS score_median, avg(score) AS score_mean, stddev_samp(score) AS score_sd, quantile_cont(score, 0.25) AS score_q25, quantile_cont(score, 0.75) AS score_q75,
  avg(CAST(overlap AS INTEGER)) AS overlap_fraction, count(*) AS n_models, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS score_iqr FROM ch GROUP BY 1, 2, 3)
"""


def challenge(spark, sf):
    """Scores of the mixed groups by 15 outer models (3 repeats x 5 folds)."""
    base = records(spark, sf).where("group_id % 25 = 0").select("record_id", "group_id", "block", "label")
    rows = base.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(4))))
    u = draw_uniform("outer", F.col("m"), F.col("o"), F.col("record_id"))
    return rows.select("record_id", "group_id", "block", "m", "o", (F.lit(0.7) * u + F.col("label") * F.lit(0.2)).alias("score"), (F.col("block") % 5 == F.col("o")).alias("overlap"))


ENSEMBLE_COLS = ["score_median", "score_mean", "score_sd", "score_q25", "score_q75", "overlap_fraction", "score_iqr"]


@query("a14_ensemble_summary", with_views("records", "WITH " + CHALLENGE + """,
 q AS (SELECT group_id, median(score_median) AS ensemble_median, quantile_cont(score_median, 0.25) AS ensemble_q25, quantile_cont(score_median, 0.75) AS ensemble_q75, median(score_sd) AS sd_median, median(score_iqr) AS iqr_median,
  avg(overlap_fraction) AS overlap_fraction, count(*) AS n_records FROM er GROUP BY 1), d AS (SELECT group_id, median(abs(score_median - ensemble_median)) AS ensemble_mad FROM er JOIN q USING (group_id) GROUP BY 1)
SELECT group_id, round(ensemble_median, 6) AS ensemble_median, round(ensemble_q25, 6) AS ensemble_q25, round(ensemble_q75, 6) AS ensemble_q75, round(ensemble_mad, 6) AS ensemble_mad, round(sd_median, 6) AS sd_median,
 round(iqr_median, 6) AS iqr_median, round(overlap_fraction, 6) AS overlap_fraction, n_records, round(ensemble_q75 - ensemble_q25, 6) AS ensemble_iqr FROM q JOIN d USING (group_id)"""))
def a14(spark, sf):
    per_record = R.ensemble_records(challenge(spark, sf), ["record_id", "group_id", "block"], "score", "overlap")
    return rounded(R.ensemble_groups(per_record, "group_id"), ["ensemble_median", "ensemble_q25", "ensemble_q75", "ensemble_mad", "sd_median", "iqr_median", "overlap_fraction", "ensemble_iqr"])


@query("a15_nonoverlap_ensemble", with_views("records", "WITH " + CHALLENGE + """
SELECT record_id, group_id, round(median(score) FILTER (NOT overlap), 6) AS score_median, round(avg(score) FILTER (NOT overlap), 6) AS score_mean, round(stddev_samp(score) FILTER (NOT overlap), 6) AS score_sd, count(*) FILTER (NOT overlap) AS n_models FROM ch GROUP BY 1, 2"""))
def a15(spark, sf):
    clean = challenge(spark, sf).where("not overlap")
    return rounded(R.ensemble_records(clean, ["record_id", "group_id"], "score", "overlap").select("record_id", "group_id", "score_median", "score_mean", "score_sd", "n_models"), ["score_median", "score_mean", "score_sd"])


@query("a16_attribution_rollup", with_views("attr", """
WITH p AS (SELECT class, feature, repeat, group_id, median(shap) AS shap, median(completed) AS completed, avg(imputed) AS imputed FROM attr GROUP BY 1, 2, 3, 4)
SELECT class, feature, group_id, round(median(shap), 6) AS shap, round(median(completed), 6) AS completed, round(avg(imputed), 6) AS imputed FROM p GROUP BY 1, 2, 3"""))
def a16(spark, sf):
    got = R.attribution_rollup(attr(spark, sf, by="group_id"), ["class", "feature"], "group_id", ["repeat"], {"shap": ("median", "median"), "completed": ("median", "median"), "imputed": ("mean", "mean")})
    return rounded(got, ["shap", "completed", "imputed"])


@query("a17_partition_rollup", with_views("attr", """
WITH p AS (SELECT class, feature, repeat, fold, group_id, median(shap) AS shap, median(completed) AS completed FROM attr GROUP BY 1, 2, 3, 4, 5)
SELECT class, feature, group_id, round(avg(shap), 6) AS shap, round(median(completed), 6) AS completed FROM p GROUP BY 1, 2, 3"""))
def a17(spark, sf):
    got = R.attribution_rollup(attr(spark, sf, by="group_id"), ["class", "feature"], "group_id", ["repeat", "fold"], {"shap": ("median", "mean"), "completed": ("median", "median")})
    return rounded(got, ["shap", "completed"])


@query("a18_record_bridge", with_views("attr", """
WITH a AS (SELECT *, shap + 0.5 AS score, 0.4 + fold * 0.05 AS threshold, 'h' || fold AS ph FROM attr WHERE class = 'P' AND feature IN ('f_total', 'f_bal'))
SELECT record_id, round(median(score) FILTER (feature = 'f_total'), 6) AS score_median, round(avg(score) FILTER (feature = 'f_total'), 6) AS score_mean, round(stddev_samp(score) FILTER (feature = 'f_total'), 6) AS score_sd,
 round(min(threshold)::DOUBLE, 6) AS threshold_min, round(max(threshold)::DOUBLE, 6) AS threshold_max, count(DISTINCT repeat) AS repeats, string_agg(DISTINCT ph, ';' ORDER BY ph) AS parameter_hashes,
 round(avg(shap) FILTER (feature = 'f_total'), 6) AS shap_mean_f_total, round(stddev_samp(shap) FILTER (feature = 'f_total'), 6) AS shap_sd_f_total, round(avg(imputed) FILTER (feature = 'f_total'), 6) AS imputed_fraction_f_total,
 round(avg(shap) FILTER (feature = 'f_bal'), 6) AS shap_mean_f_bal, round(stddev_samp(shap) FILTER (feature = 'f_bal'), 6) AS shap_sd_f_bal, round(avg(imputed) FILTER (feature = 'f_bal'), 6) AS imputed_fraction_f_bal FROM a GROUP BY 1"""))
def a18(spark, sf):
    rows = attr(spark, sf).where("class = 'P'").select("*", (F.col("shap") + 0.5).alias("score"), (F.lit(0.4) + F.col("fold") * 0.05).alias("threshold"), F.concat(F.lit("h"), "fold").alias("parameter_hash"))
    got = R.record_bridge(rows, "record_id", ["f_total", "f_bal"])
    return rounded(got, [c for c in got.columns if c not in ("record_id", "repeats", "parameter_hashes")])


@query("a19_coupling_groups", with_views("records", """
WITH k AS (SELECT group_id, class3, count(*) AS n FROM records GROUP BY 1, 2), t AS (SELECT group_id, class3, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, class3) AS rn FROM k)
SELECT group_id, count(*) AS n_records, CASE WHEN min(block) = max(block) THEN min(block) END AS block, CASE WHEN min(label) = max(label) THEN min(label) ELSE -1 END AS label, min(block) = max(block) AS block_constant, min(label) = max(label) AS label_constant,
 round(median(f_total), 6) AS m_total, round(median(f_qty), 6) AS m_qty, count(DISTINCT source_ids) AS n_sources, any_value(t.class3) AS class3_mode FROM records r JOIN (SELECT * FROM t WHERE rn = 1) t USING (group_id) GROUP BY 1"""))
def a19(spark, sf):
    got = R.coupling_groups(records(spark, sf), "group_id", ["block", "label"], {"m_total": "f_total", "m_qty": "f_qty"}, "source_ids", "class3")
    return rounded(got.withColumn("label", F.coalesce("label", F.lit(-1))), ["m_total", "m_qty"])


@query("a20_trial_budget", "WITH " + TRIALS + """
SELECT model, fold, count(*) FILTER (state = 'COMPLETE') AS complete, count(*) FILTER (state = 'PRUNED') AS pruned, count(*) FILTER (state = 'FAIL') AS failed, count(*) AS total_trials, round(sum(seconds), 4) AS total_seconds, count(*) FILTER (state = 'COMPLETE') = 100 AND count(*) FILTER (state = 'PRUNED') = 0 AND count(*) FILTER (state = 'FAIL') = 0 AS exact_budget FROM trials GROUP BY 1, 2""")
def a20(spark, sf):
    return R.trial_budget(trials(spark, sf), ["model", "fold"], 100).withColumn("total_seconds", F.round("total_seconds", 4))


PRED = "pred AS (SELECT *, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS predicted FROM class_oof)"


def predictions(spark, sf):
    from kinfold.functions.scalars import first_max
    return class_oof(spark, sf).withColumn("predicted", first_max(["s0", "s1", "s2"]))


@query("a21_group_error_audit", with_views("class_oof", f"""
WITH {PRED} SELECT model, group_id, true_code, count(*) AS n, count(*) FILTER (true_code = predicted) AS correct, count(*) FILTER (predicted = 0) AS as_0, count(*) FILTER (predicted = 1) AS as_1, count(*) FILTER (predicted = 2) AS as_2,
 round(count(*) FILTER (true_code = predicted) * 1.0::DOUBLE / count(*), 6) AS recall FROM pred GROUP BY 1, 2, 3"""))
def a21(spark, sf):
    return rounded(R.error_audit(predictions(spark, sf), ["model", "group_id", "true_code"], "true_code", "predicted", 3), ["recall"])


@query("a22_coverage", with_views("records", """
SELECT 'class' AS level, class3 AS unit, count(*) AS total, count(f_qty) AS evaluable, round(avg(CAST(f_qty IS NOT NULL AS INTEGER)), 6) AS coverage FROM records GROUP BY 2
UNION ALL SELECT 'block', CAST(block AS VARCHAR), count(*), count(f_qty), round(avg(CAST(f_qty IS NOT NULL AS INTEGER)), 6) FROM records GROUP BY block"""))
def a22(spark, sf):
    base = records(spark, sf)
    level = lambda name, col: R.coverage(base.withColumn("unit", F.col(col).cast("string")), ["unit"], F.col("f_qty").isNotNull()).select(F.lit(name).alias("level"), "unit", "total", "evaluable", r6("coverage").alias("coverage"))
    return level("class", "class3").unionByName(level("block", "block"))


@query("a27_dense_crosstab", with_views("class_oof", f"""
WITH {PRED}, g AS (SELECT DISTINCT model, t.t AS true_code, p.p AS predicted FROM pred, (SELECT range AS t FROM range(3)) t, (SELECT range AS p FROM range(3)) p), n AS (SELECT model, true_code, predicted, count(*) AS n FROM pred GROUP BY 1, 2, 3)
SELECT model, CASE true_code WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS true_class, CASE predicted WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted_class, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1.0::DOUBLE / sum(n) OVER (PARTITION BY model, true_code), 6) AS row_share FROM g LEFT JOIN n USING (model, true_code, predicted)"""))
def a27(spark, sf):
    conf = M.confusion(predictions(spark, sf), ["model"], "true_code", "predicted", 3)
    return rounded(M.dense_crosstab(conf, ["model"], CLASSES), ["row_share"])


@query("a30_value_agreement", with_views("attr", """
SELECT feature, count(*) AS n_both, round(max(abs(observed - completed * 1.25)), 4) AS max_abs_diff, round(median(abs(observed - completed * 1.25)), 4) AS median_abs_diff FROM attr WHERE observed IS NOT NULL AND class = 'F' AND repeat = 1 GROUP BY 1"""))
def a30(spark, sf):
    rows = attr(spark, sf).where("class = 'F' and repeat = 1").withColumn("other", F.col("completed") * 1.25)
    got = R.value_agreement(rows, ["feature"], "observed", "other")
    return got.withColumns({c: F.round(c, 4) for c in ("max_abs_diff", "median_abs_diff")})


@query("a31_component_medians", with_views("records", """
SELECT block, round(median(f_total), 6) AS f_total, round(median(f_qty), 6) AS f_qty FROM records WHERE f_total IS NOT NULL AND f_qty IS NOT NULL GROUP BY 1"""))
def a31(spark, sf):
    return rounded(R.component_medians(records(spark, sf), [], "block", ["f_total", "f_qty"]), ["f_total", "f_qty"])


# --- sets and shapes ---------------------------------------------------------------------------

@query("u1_concat_parts", with_views("records", """
SELECT record_id, 'primary' AS part FROM records WHERE group_id % 25 <> 0 UNION ALL SELECT record_id, 'challenge' FROM records WHERE group_id % 25 = 0"""))
def u1(spark, sf):
    base = records(spark, sf)
    part = lambda cond, name: base.where(cond).select("record_id", F.lit(name).alias("part"))
    return part("group_id % 25 <> 0", "primary").unionByName(part("group_id % 25 = 0", "challenge"))


TOPS = """
i AS (SELECT group_id, repeat, feature, avg(abs(shap)) AS imp FROM attr GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY group_id, repeat ORDER BY imp DESC, feature) AS rk FROM i),
a AS (SELECT group_id, list_sort(list(feature)) FILTER (repeat = 1) AS f1, list_sort(list(feature)) FILTER (repeat = 2) AS f2 FROM t WHERE rk <= 3 GROUP BY 1)
"""


def tops(spark, sf):
    imp = attr(spark, sf).groupBy("group_id", "repeat", "feature").agg(F.avg(F.abs("shap")).alias("imp"))
    top = K.top_n(imp, ["group_id", "repeat"], 3, F.col("imp").desc(), F.col("feature"))
    side = lambda r: F.array_sort(F.collect_list(F.when(F.col("repeat") == r, F.col("feature"))))
    return top.groupBy("group_id").agg(side(1).alias("f1"), side(2).alias("f2"))


@query("u2_top_overlap", with_views("attr", "WITH " + TOPS.replace("list_sort(list(feature)) FILTER (repeat = 1)", "list(feature) FILTER (repeat = 1)").replace("list_sort(list(feature)) FILTER (repeat = 2)", "list(feature) FILTER (repeat = 2)") + "SELECT group_id, round(len(list_intersect(f1, f2)) / 3.0::DOUBLE, 6) AS overlap FROM a"))
def u2(spark, sf):
    return tops(spark, sf).select("group_id", r6(F.size(F.array_intersect("f1", "f2")) / F.lit(3.0)).alias("overlap"))


@query("u3_top_jaccard", with_views("attr", "WITH " + TOPS.replace("list_sort(list(feature)) FILTER (repeat = 1)", "list(feature) FILTER (repeat = 1)").replace("list_sort(list(feature)) FILTER (repeat = 2)", "list(feature) FILTER (repeat = 2)") + "SELECT group_id, round(len(list_intersect(f1, f2)) * 1.0::DOUBLE / len(list_distinct(list_concat(f1, f2))), 6) AS jaccard FROM a"))
def u3(spark, sf):
    return tops(spark, sf).select("group_id", r6(F.size(F.array_intersect("f1", "f2")) / F.size(F.array_union("f1", "f2"))).alias("jaccard"))


@query("u4_set_difference", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount = 0""")
def u4(spark, sf):
    lines = table(spark, sf, "lineitem")
    gone = lines.where("l_discount = 0").select("l_partkey", "l_suppkey")
    return lines.where("l_quantity > 40").select("l_partkey", "l_suppkey").distinct().join(gone, ["l_partkey", "l_suppkey"], "left_anti")


@query("u5_distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u5(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("r1_wide_to_long", with_views("cells", "SELECT record_id, group_id, feature, observed AS value FROM cells"))
def r1(spark, sf):
    return C.cells(records(spark, sf), ["record_id", "group_id"], FEATURES)


@query("r2_long_to_wide", with_views("group_oof", """
SELECT group_id, repeat, round(max(score) FILTER (model = 'gbt'), 6) AS gbt, round(max(score) FILTER (model = 'mlp'), 6) AS mlp, round(max(score) FILTER (model = 'rf'), 6) AS rf, round(max(score) FILTER (model = 'svm'), 6) AS svm FROM group_oof GROUP BY 1, 2"""))
def r2(spark, sf):
    wide = group_scores(spark, sf).groupBy("group_id", "repeat").pivot("model", ["gbt", "mlp", "rf", "svm"]).agg(F.first("score"))
    return rounded(wide, ["gbt", "mlp", "rf", "svm"])


@query("r3_matrix_to_pairs", with_views("records", "SELECT " + ", ".join([]) + """ l, r, round(v, 6) AS correlation FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS l, '{b}' AS r, corr({a}, {b}) AS v FROM records" for i, a in enumerate(sorted(FEATURES)) for b in sorted(FEATURES)[i + 1:]) + ")"))
def r3(spark, sf):
    from kinfold.operators.statistics import correlation_difference
    base = records(spark, sf)
    both = base.select(*[F.col(f).alias(f"o_{f}") for f in FEATURES], *[F.col(f).alias(f"c_{f}") for f in FEATURES])
    pairs = correlation_difference(both, FEATURES, "o_", "c_", 1)
    return pairs.select(F.col("left_feature").alias("l"), F.col("right_feature").alias("r"), r6("completed_r").alias("correlation"))
