"""Metrics and statistics (M) and rule-based choices (K)."""

from pyspark.sql import functions as F

from kinfold.operators import metrics as M, ordered as O, rollup as R, selection as K, statistics as T
from kinfold.plans.fixtures import CLASSES, FEATURES, attr, class_oof, oof, records, stable, table, with_views
from kinfold.plans.registry import query
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)
rounded = lambda df, names: df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])
S3 = ["s0", "s1", "s2"]

AUC = """
ranked AS (SELECT model, repeat, target, rank() OVER (PARTITION BY model, repeat ORDER BY score)
  + (count(*) OVER (PARTITION BY model, repeat, score) - 1) / 2.0::DOUBLE AS rk FROM {0}),
auc AS (SELECT model, repeat, (sum(rk) FILTER (target = 1) - sum(target)::DOUBLE * (sum(target) + 1) / 2)
  / (sum(target)::DOUBLE * (count(*) - sum(target))) AS roc_auc FROM ranked GROUP BY 1, 2),
lev AS (SELECT model, repeat, score, sum(target) AS pos, count(*) AS n FROM {0} GROUP BY 1, 2, 3),
cum AS (SELECT model, repeat, score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY model, repeat) AS p
  FROM lev WINDOW w AS (PARTITION BY model, repeat ORDER BY score DESC)),
ap AS (SELECT model, repeat, sum(pos * 1.0::DOUBLE / p * tp / called) AS average_precision FROM cum GROUP BY 1, 2),
thr AS (SELECT model, repeat, count(*) FILTER (target = 1 AND score >= 0.5) AS tp, count(*) FILTER (target = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (target = 0 AND score < 0.5) AS tn, count(*) FILTER (target = 1 AND score < 0.5) AS fn FROM {0} GROUP BY 1, 2),
rat AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) ELSE 0 END AS precision, tp * 1.0::DOUBLE / nullif(tp + fn, 0) AS recall,
  tn * 1.0::DOUBLE / nullif(tn + fp, 0) AS specificity, (tp * 1.0::DOUBLE / nullif(tp + fn, 0) + tn * 1.0::DOUBLE / nullif(tn + fp, 0)) / 2 AS balanced_accuracy FROM thr)
"""
BY_REPEAT = "WITH " + AUC.format("group_oof") + """, by_repeat AS (SELECT model, repeat, roc_auc, average_precision, f1, balanced_accuracy
  FROM auc JOIN ap USING (model, repeat) JOIN rat USING (model, repeat))"""


def group_scores(spark, sf):
    return R.group_scores(oof(spark, sf, by="group_id"), ["model", "repeat"], "group_id", "target", "block", "score")


def by_repeat(spark, sf):
    return M.binary_metrics(group_scores(spark, sf), ["model", "repeat"])


@query("m1_roc_auc", with_views("oof", "WITH " + AUC.format("oof") + "SELECT model, repeat, round(roc_auc, 6) AS roc_auc FROM auc"))
def m1(spark, sf):
    return M.auc_ap(oof(spark, sf), ["model", "repeat"]).select("model", "repeat", r6("roc_auc").alias("roc_auc"))


@query("m2_average_precision", with_views("oof", "WITH " + AUC.format("oof") + "SELECT model, repeat, round(average_precision, 6) AS average_precision FROM ap"))
def m2(spark, sf):
    return M.auc_ap(oof(spark, sf), ["model", "repeat"]).select("model", "repeat", r6("average_precision").alias("average_precision"))


@query("m3_threshold_metrics", with_views("oof", "WITH " + AUC.format("oof") + """
SELECT model, repeat, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity,
 round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM rat"""))
def m3(spark, sf):
    got = M.threshold_metrics(oof(spark, sf), ["model", "repeat"], "target", "score", 0.5)
    return rounded(got, ["precision", "recall", "specificity", "f1", "balanced_accuracy"])


@query("m4_repeat_metrics", with_views("group_oof", BY_REPEAT + """
SELECT model, repeat, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(f1, 6) AS f1,
 round(balanced_accuracy, 6) AS balanced_accuracy FROM by_repeat"""))
def m4(spark, sf):
    got = by_repeat(spark, sf).select("model", "repeat", "roc_auc", "average_precision", "f1", "balanced_accuracy")
    return rounded(got, ["roc_auc", "average_precision", "f1", "balanced_accuracy"])


MULTI = """
x AS (SELECT {key}, true_code, predicted FROM strata_pred),
k AS (SELECT DISTINCT {key}, c FROM x, (SELECT CAST(range AS INTEGER) AS c FROM range(3))),
per AS (SELECT {key}, c, count(*) FILTER (true_code = c AND predicted = c) AS tp, count(*) FILTER (true_code = c) AS support,
  count(*) FILTER (predicted = c) AS called FROM k JOIN x USING ({key}) GROUP BY {key}, c),
pr AS (SELECT *, CASE WHEN called > 0 THEN tp * 1.0::DOUBLE / called ELSE 0 END AS p, CASE WHEN support > 0 THEN tp * 1.0::DOUBLE / support ELSE 0 END AS r,
  CASE WHEN support + called > 0 THEN 2.0::DOUBLE * tp / (support + called) ELSE 0 END AS f FROM per),
mm AS (SELECT {key}, avg(f) FILTER (support + called > 0) AS macro_f1, avg(r) FILTER (support > 0) AS balanced_accuracy, min(r) AS min_recall FROM pr GROUP BY {key})
"""


def strata(spark, sf):
    return R.class_strata(class_oof(spark, sf, by="group_id"), ["model", "repeat"], "group_id", "true_code", "block", S3)


def multi(spark, sf, keys=("model", "repeat"), labels="seen"):
    return M.class_metrics(M.confusion(strata(spark, sf), list(keys), "true_code", "predicted", 3), 3, labels, CLASSES)


@query("m5_multiclass_metrics", with_views("strata_pred", "WITH " + MULTI.format(key="model, repeat") + """
SELECT model, repeat, CASE c WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
 support, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM pr JOIN mm USING (model, repeat)"""))
def m5(spark, sf):
    wide = multi(spark, sf)
    rows = F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(f"{m}_{c}").alias(m) for m in ("precision", "recall", "f1")],
                              F.col(f"support_{c}").cast("bigint").alias("support")) for c in CLASSES])
    out = wide.select("model", "repeat", F.explode(rows).alias("e"), "macro_f1", "balanced_accuracy").select(
        "model", "repeat", "e.*", "macro_f1", "balanced_accuracy")
    return rounded(out, ["precision", "recall", "f1", "macro_f1", "balanced_accuracy"])


OVR = """
ovr AS (SELECT {key}, c AS class_code, CAST(true_code = c AS INTEGER) AS target, CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS score
  FROM {src}, (SELECT CAST(range AS INTEGER) AS c FROM range(3))),
rk AS (SELECT {key}, class_code, target, rank() OVER (PARTITION BY {key}, class_code ORDER BY score)
  + (count(*) OVER (PARTITION BY {key}, class_code, score) - 1) / 2.0::DOUBLE AS rk FROM ovr),
oa AS (SELECT {key}, class_code, (sum(rk) FILTER (target = 1) - sum(target)::DOUBLE * (sum(target) + 1) / 2)
  / nullif(sum(target)::DOUBLE * (count(*) - sum(target)), 0) AS auc FROM rk GROUP BY {key}, class_code),
om AS (SELECT {key}, avg(auc) AS ovr_auc FROM oa GROUP BY {key})
"""


@query("m6_macro_ovr_auc", with_views("strata", "WITH " + OVR.format(key="model, repeat", src="strata") + "SELECT model, repeat, round(ovr_auc, 6) AS ovr_auc FROM om"))
def m6(spark, sf):
    return M.ovr_auc(strata(spark, sf), ["model", "repeat"], "true_code", S3).select("model", "repeat", r6("ovr_auc").alias("ovr_auc"))


@query("m7_fixed_label_macro_f1", with_views("strata_pred", "WITH " + MULTI.format(key="model") + """
SELECT model, round(avg(f), 6) AS macro_f1 FROM pr GROUP BY 1"""))
def m7(spark, sf):
    return multi(spark, sf, ["model"], "fixed").select("model", r6("macro_f1").alias("macro_f1"))


@query("m8_logloss_brier", with_views("strata", """
SELECT model, repeat, round(avg(-ln(greatest(CASE true_code WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END, 1e-15))), 6) AS log_loss,
 round(avg(power(s0 - CAST(true_code = 0 AS INTEGER), 2) + power(s1 - CAST(true_code = 1 AS INTEGER), 2) + power(s2 - CAST(true_code = 2 AS INTEGER), 2)), 6) AS brier,
 count(*) AS n FROM strata GROUP BY 1, 2"""))
def m8(spark, sf):
    return strata(spark, sf).groupBy("model", "repeat").agg(
        r6(F.avg(M.log_loss_of(S3, "true_code"))).alias("log_loss"), r6(F.avg(M.brier_of(S3, "true_code"))).alias("brier"),
        F.count("*").alias("n"))


def top_label(df):
    conf = F.greatest(*S3)
    return df.select("model", "repeat", conf.alias("p"), (F.col("true_code") == F.col("predicted")).cast("int").alias("hit"))


@query("m9_ece_right_closed", with_views("strata_pred", """
WITH b AS (SELECT model, repeat, greatest(CAST(ceil(greatest(s0, s1, s2) * 10) AS INTEGER) - 1, 0) AS bin, greatest(s0, s1, s2) AS p, CAST(true_code = predicted AS INTEGER) AS hit FROM strata_pred),
 g AS (SELECT model, repeat, bin, count(*) AS n, avg(p) AS mp, avg(hit) AS mo FROM b GROUP BY 1, 2, 3)
SELECT model, repeat, round(sum(n * abs(mp - mo)) / sum(n), 6) AS ece FROM g GROUP BY 1, 2"""))
def m9(spark, sf):
    bins = M.reliability(top_label(strata(spark, sf)), ["model", "repeat"], "hit", "p", 10, "right")
    return M.ece(bins, ["model", "repeat"]).select("model", "repeat", r6("ece").alias("ece"))


@query("m10_reliability_bins", with_views("class_oof", """
WITH u AS (SELECT group_id, true_code, avg(s0) AS s0, avg(s1) AS s1, avg(s2) AS s2 FROM class_oof WHERE model = 'gbt' AND repeat = 1 GROUP BY 1, 2),
 b AS (SELECT CASE c WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS class, CASE c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS p,
  CAST(true_code = c AS INTEGER) AS hit FROM u, (SELECT range AS c FROM range(3)))
SELECT class, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_probability, round(avg(hit), 6) AS observed_fraction FROM b GROUP BY 1, 2"""))
def m10(spark, sf):
    one = class_oof(spark, sf).where("model = 'gbt' and repeat = 1")
    units = one.groupBy("group_id", "true_code").agg(*[F.avg(c).alias(c) for c in S3])
    rows = M.one_vs_rest(units, [], "true_code", S3).withColumn("class", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("class_code") + 1))
    return rounded(M.reliability(rows, ["class"], "target", "score", 10, "left"), ["mean_probability", "observed_fraction"])


@query("m11_calibration_diagnostics")
def m11(spark, sf):
    one = M.one_vs_rest(strata(spark, sf).where("model = 'gbt' and repeat = 1"), [], "true_code", S3)
    return T.calibration_diagnostics(one, "class_code", "target", "score", 10)


@query("m12_temperature_fit", with_views("strata", """
WITH t AS (SELECT i AS j, exp(ln(0.25) + (ln(4.0) - ln(0.25)) * i / 24.0::DOUBLE) AS t FROM (SELECT range AS i FROM range(25))),
 l0 AS (SELECT model, repeat, true_code, ln(greatest(s0, 1e-12)) AS a, ln(greatest(s1, 1e-12)) AS b, ln(greatest(s2, 1e-12)) AS c FROM strata),
 loss AS (SELECT model, repeat, j, t, avg(ln(exp(a / t) + exp(b / t) + exp(c / t)) - CASE true_code WHEN 0 THEN a WHEN 1 THEN b ELSE c END / t) AS loss FROM l0, t GROUP BY 1, 2, 3, 4)
SELECT model, repeat, round(arg_min(t, loss), 6) AS temperature, round(min(loss), 6) AS loss_after FROM loss GROUP BY 1, 2"""))
def m12(spark, sf):
    got = M.fit_temperature(strata(spark, sf), ["model", "repeat"], "true_code", S3, rounds=1)
    return got.select("model", "repeat", r6("temperature").alias("temperature"), r6("loss_after").alias("loss_after"))


@query("m13_mean_interval", with_views("group_oof", BY_REPEAT + """
SELECT model, round(avg(roc_auc), 6) AS mean, round(stddev_samp(roc_auc), 6) AS sd, count(*) AS n,
 round(avg(roc_auc) - 4.302652729911275 * stddev_samp(roc_auc) / sqrt(3), 6) AS ci_low, round(avg(roc_auc) + 4.302652729911275 * stddev_samp(roc_auc) / sqrt(3), 6) AS ci_high
FROM by_repeat GROUP BY 1"""))
def m13(spark, sf):
    return rounded(M.mean_interval(by_repeat(spark, sf), ["model"], "roc_auc"), ["mean", "sd", "ci_low", "ci_high"])


@query("m14_spearman", with_views("attr", """
WITH r AS (SELECT repeat, class, feature, rank() OVER (PARTITION BY repeat, class, feature ORDER BY completed) + (count(*) OVER (PARTITION BY repeat, class, feature, completed) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY repeat, class, feature ORDER BY shap) + (count(*) OVER (PARTITION BY repeat, class, feature, shap) - 1) / 2.0::DOUBLE AS ry FROM attr)
SELECT repeat, class, feature, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1, 2, 3"""))
def m14(spark, sf):
    return rounded(M.spearman(attr(spark, sf), ["repeat", "class", "feature"], "completed", "shap"), ["rho"])


@query("m15_pearson_difference", with_views("attr", """
WITH c AS (SELECT record_id, feature, median(observed) AS o, median(completed) AS d FROM attr WHERE class = 'F' GROUP BY 1, 2),
 p AS (SELECT a.feature AS left_feature, b.feature AS right_feature, count(a.o + b.o) AS n_observed, regr_r2(a.o, b.o) AS r2,
  corr(a.o, b.o) AS observed_r, corr(a.d, b.d) AS completed_r FROM c a JOIN c b USING (record_id) WHERE a.feature < b.feature GROUP BY 1, 2)
SELECT left_feature, right_feature, n_observed, round(CASE WHEN n_observed >= 20 THEN observed_r END, 6) AS observed_r,
 round(completed_r, 6) AS completed_r, round(CASE WHEN n_observed >= 20 THEN completed_r - observed_r END, 6) AS difference FROM p"""))
def m15(spark, sf):
    one = attr(spark, sf).where("class = 'F'")
    cells = O.medians(one, ["record_id", "feature"], {"observed": "observed", "completed": "completed"}, hot=None)
    wide = lambda v: cells.groupBy("record_id").agg(*[F.max(F.when(F.col("feature") == f, F.col(v))).alias(f"{v[0]}_{f}") for f in FEATURES])
    both = wide("observed").join(wide("completed"), "record_id")
    return rounded(T.correlation_difference(both, FEATURES, "o_", "c_", 20), ["observed_r", "completed_r", "difference"])


@query("m16_spearman_clusters", with_views("records", """
WITH long AS (""" + " UNION ALL ".join(f"SELECT record_id, '{f}' AS feature, {f} AS v FROM records" for f in FEATURES) + """),
 pr AS (SELECT a.feature AS l, b.feature AS r, a.v AS x, b.v AS y FROM long a JOIN long b USING (record_id) WHERE a.feature < b.feature AND a.v IS NOT NULL AND b.v IS NOT NULL),
 rk AS (SELECT l, r, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2.0::DOUBLE AS ry FROM pr),
 c AS (SELECT l, r, abs(corr(rx, ry)) AS rho FROM rk GROUP BY 1, 2),
 e AS (SELECT l AS a, r AS b, rho FROM c UNION ALL SELECT r, l, rho FROM c),
 reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b AND e.rho >= 0.85),
 comp AS (SELECT a AS feature, min(b) AS cluster FROM reach GROUP BY 1)
SELECT comp.feature, cluster, round(max(rho), 6) AS max_abs_rho, coalesce(string_agg(CASE WHEN rho >= 0.85 THEN e.b END, ';' ORDER BY rho DESC, e.b), '') AS neighbours
FROM comp JOIN e ON e.a = comp.feature GROUP BY 1, 2""", recursive=True))
def m16(spark, sf):
    return rounded(T.correlation_clusters(records(spark, sf), FEATURES, 0.85, 20), ["max_abs_rho"])


@query("m17_robust_z", with_views("attr", """
WITH g AS (SELECT class, feature, group_id, median(shap) AS v FROM attr WHERE repeat = 1 GROUP BY 1, 2, 3),
 m AS (SELECT class, feature, median(v) AS med, stddev_samp(v) AS sd FROM g GROUP BY 1, 2),
 d AS (SELECT class, feature, median(abs(v - med)) AS mad FROM g JOIN m USING (class, feature) GROUP BY 1, 2)
SELECT class, feature, group_id, round((v - med) / CASE WHEN mad * 1.4826 > 0 THEN mad * 1.4826 ELSE nullif(sd, 0) END, 5) AS z FROM g JOIN m USING (class, feature) JOIN d USING (class, feature)"""))
def m17(spark, sf):
    units = O.medians(attr(spark, sf).where("repeat = 1"), ["class", "feature", "group_id"], {"v": "shap"})
    return T.robust_z(units, ["class", "feature"], "v", "z").select("class", "feature", "group_id", F.round("z", 5).alias("z"))


@query("m18_quantile_bins", with_views("records", """
WITH e AS (SELECT class3, unnest(list_sort(list_distinct(quantile_cont(f_qty, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))) AS edge FROM records GROUP BY 1)
SELECT record_id, CAST(greatest(count(*) FILTER (f_qty > edge), 1) AS INTEGER) AS bin FROM records JOIN e USING (class3) WHERE f_qty IS NOT NULL GROUP BY record_id"""))
def m18(spark, sf):
    binned = T.quantile_bins(records(spark, sf).where("f_qty is not null"), ["class3"], "f_qty", 5)
    return binned.select("record_id", "bin")


@query("m19_percentile_of_score", with_views("records", """
WITH ref AS (SELECT class3, group_id, median(f_total) AS v, max(label) AS label FROM records WHERE group_id % 25 <> 0 GROUP BY 1, 2),
 mid AS (SELECT class3, median(v) FILTER (label = 0) AS m0, median(v) FILTER (label = 1) AS m1 FROM ref GROUP BY 1),
 probe AS (SELECT class3, group_id, median(f_total) AS v FROM records WHERE group_id % 25 = 0 GROUP BY 1, 2)
SELECT p.class3, p.group_id, round((count(*) FILTER (r.v < p.v) + count(*) FILTER (r.v <= p.v)) * 50.0::DOUBLE / count(*), 6) AS percentile,
 round(any_value((p.v - m0) / nullif(m1 - m0, 0)), 6) AS relative_location
FROM probe p JOIN ref r USING (class3) JOIN mid USING (class3) GROUP BY 1, 2"""))
def m19(spark, sf):
    units = cut(O.medians(records(spark, sf), ["class3", "group_id"], {"v": "f_total"}, also=[F.max("label").alias("label")]))
    probe, stable = units.where("group_id % 25 = 0"), units.where("group_id % 25 <> 0")
    got = T.relative_location(T.percentile_of_score(probe, stable, ["class3"], "v"), stable, ["class3"], "v", "label")
    return rounded(got.select("class3", "group_id", "percentile", "relative_location"), ["percentile", "relative_location"])


@query("m21_fdr", with_views("records", """
WITH p AS (SELECT record_id, class3, CASE WHEN record_id % 50 = 0 THEN NULL ELSE CAST(f_total AS BIGINT) / 10000 / 200.0::DOUBLE END AS p FROM records),
 n AS (SELECT class3, p, count(*) AS c FROM p WHERE p IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT class3, p, p * sum(c) OVER (PARTITION BY class3) / sum(c) OVER (PARTITION BY class3 ORDER BY p) AS raw FROM n),
 q AS (SELECT class3, p, least(min(raw) OVER (PARTITION BY class3 ORDER BY p DESC), 1) AS q FROM r)
SELECT record_id, p.class3, round(q, 6) AS fdr_q FROM p LEFT JOIN q USING (class3, p)"""))
def m21(spark, sf):
    p = records(spark, sf).select("record_id", "class3", F.when(
        F.col("record_id") % 50 != 0, F.round("f_total").cast("bigint") / 10000 / 200.0).alias("p"))
    return M.benjamini_hochberg(p, ["class3"], "p").select("record_id", "class3", r6("fdr_q").alias("fdr_q"))


@query("m22_density", with_views("records", """
WITH s AS (SELECT class3, min(f_total) AS lo, max(f_total) AS hi, stddev_samp(f_total) * power(count(*), -0.2) AS h, count(*) AS n FROM records GROUP BY 1),
 g AS (SELECT class3, i, lo + (hi - lo) * i / 31.0::DOUBLE AS x, h, n FROM s, (SELECT range AS i FROM range(32)))
SELECT g.class3, CAST(i AS INTEGER) AS point, round(sum(exp(-0.5 * power((x - f_total) / h, 2))) / (n * h * sqrt(2 * pi())) * 1e6, 6) AS density_e6 FROM g JOIN records r USING (class3) GROUP BY g.class3, i, n, h"""))
def m22(spark, sf):
    got = T.density(records(spark, sf), ["class3"], "f_total", 32)
    return got.select("class3", "point", r6(F.col("density") * 1e6).alias("density_e6"))


@query("m23_curve_points", with_views("group_oof", """
WITH lev AS (SELECT model, repeat, score, sum(target) AS pos, count(*) - sum(target) AS neg FROM group_oof WHERE repeat = 1 GROUP BY 1, 2, 3)
SELECT model, repeat, score AS threshold, round(sum(neg) OVER w * 1.0::DOUBLE / sum(neg) OVER a, 6) AS fpr, round(sum(pos) OVER w * 1.0::DOUBLE / sum(pos) OVER a, 6) AS tpr,
 round(sum(pos) OVER w * 1.0::DOUBLE / (sum(pos) OVER w + sum(neg) OVER w), 6) AS precision FROM lev
WINDOW w AS (PARTITION BY model, repeat ORDER BY score DESC), a AS (PARTITION BY model, repeat)"""))
def m23(spark, sf):
    levels = M.score_levels(group_scores(spark, sf).where("repeat = 1"), ["model", "repeat"], "target", "score")
    return rounded(M.curve_points(levels, ["model", "repeat"], "score").drop("tp", "fp"), ["fpr", "tpr", "precision"])


@query("m24_class_feature_importance", with_views("attr", """
WITH r AS (SELECT class, feature, rank() OVER (PARTITION BY class, feature ORDER BY completed) + (count(*) OVER (PARTITION BY class, feature, completed) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY class, feature ORDER BY shap) + (count(*) OVER (PARTITION BY class, feature, shap) - 1) / 2.0::DOUBLE AS ry FROM attr WHERE completed IS NOT NULL AND shap IS NOT NULL),
 d AS (SELECT class, feature, corr(rx, ry) AS direction, count(*) AS n FROM r GROUP BY 1, 2)
SELECT class, feature, round(avg(abs(shap)), 6) AS mean_abs, round(median(shap), 6) AS median_signed, round(any_value(direction), 6) AS direction, any_value(d.n) AS n FROM attr JOIN d USING (class, feature) GROUP BY 1, 2"""))
def m24(spark, sf):
    rows = cut(attr(spark, sf).select("class", "feature", "completed", "shap"))  # read by the medians and the ranks
    got = O.medians(rows, ["class", "feature"], {"median_signed": "shap"},
                    also=[F.avg(F.abs("shap")).alias("mean_abs")])
    got = got.join(M.spearman(rows, ["class", "feature"], "completed", "shap", out="direction"), ["class", "feature"])
    return rounded(got, ["mean_abs", "median_signed", "direction"])


# --- choices -----------------------------------------------------------------------------------

CONSENSUS = AUC.replace("model, repeat", "model").replace("{0}", "consensus").replace("USING (model)", "USING (model)")
CONSENSUS = CONSENSUS.replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2").replace("GROUP BY 1, 2)", "GROUP BY 1)").replace(
    "lev AS (SELECT model, score, sum(target) AS pos, count(*) AS n FROM consensus GROUP BY 1)", "lev AS (SELECT model, score, sum(target) AS pos, count(*) AS n FROM consensus GROUP BY 1, 2)")


def consensus_metrics(spark, sf):
    scores = cut(group_scores(spark, sf))
    agreed = R.consensus(scores, ["model"], "group_id", 3)
    spread = M.auc_ap(scores, ["model", "repeat"]).groupBy("model").agg(F.stddev_samp("roc_auc").alias("roc_auc_sd"))
    return M.binary_metrics(agreed, ["model"]).join(spread, "model")


@query("k1_model_selection", with_views("consensus", "WITH " + CONSENSUS + """,
rr AS (SELECT model, repeat, target, rank() OVER (PARTITION BY model, repeat ORDER BY score) + (count(*) OVER (PARTITION BY model, repeat, score) - 1) / 2.0::DOUBLE AS rk FROM group_oof),
ra AS (SELECT model, repeat, (sum(rk) FILTER (target = 1) - sum(target)::DOUBLE * (sum(target) + 1) / 2) / (sum(target)::DOUBLE * (count(*) - sum(target))) AS roc_auc FROM rr GROUP BY 1, 2),
sd AS (SELECT model, stddev_samp(roc_auc) AS roc_auc_sd FROM ra GROUP BY 1),
x AS (SELECT model, roc_auc, average_precision, f1, roc_auc_sd FROM auc JOIN ap USING (model) JOIN rat USING (model) JOIN sd USING (model))
SELECT model, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(f1, 6) AS f1, round(roc_auc_sd, 6) AS roc_auc_sd FROM x
WHERE roc_auc >= (SELECT max(roc_auc) FROM x) - 0.005 ORDER BY average_precision DESC, roc_auc_sd, f1 DESC, model LIMIT 1"""))
def k1(spark, sf):
    got = K.select_binary(consensus_metrics(spark, sf)).select("model", "roc_auc", "average_precision", "f1", "roc_auc_sd")
    return rounded(got, ["roc_auc", "average_precision", "f1", "roc_auc_sd"])


def multiclass_candidates(spark, sf):
    st = cut(strata(spark, sf))
    conf = M.class_metrics(M.confusion(st, ["model"], "true_code", "predicted", 3), 3, "seen", CLASSES)
    by_rep = M.class_metrics(M.confusion(st, ["model", "repeat"], "true_code", "predicted", 3), 3, "seen", CLASSES)
    fold_sd = by_rep.groupBy("model").agg(F.stddev_pop("macro_f1").alias("fold_sd"))
    return conf.select("model", "macro_f1", "balanced_accuracy", F.least(*[f"recall_{c}" for c in CLASSES]).alias("min_recall")).join(
        M.ovr_auc(st, ["model"], "true_code", S3), "model").join(fold_sd, "model")


CANDIDATES = MULTI.format(key="model") + "," + OVR.format(key="model", src="strata") + """,
 x2 AS (SELECT model, repeat, true_code, predicted FROM strata_pred),
 per2 AS (SELECT model, repeat, c, count(*) FILTER (true_code = c AND predicted = c) AS tp, count(*) FILTER (true_code = c) AS s, count(*) FILTER (predicted = c) AS d
  FROM x2, (SELECT range AS c FROM range(3)) GROUP BY 1, 2, 3),
 fsd AS (SELECT model, stddev_pop(mf) AS fold_sd FROM (SELECT model, repeat, avg(2.0::DOUBLE * tp / (s + d)) AS mf FROM per2 WHERE s + d > 0 GROUP BY 1, 2) GROUP BY 1),
 cand AS (SELECT model, macro_f1, balanced_accuracy, min_recall, ovr_auc, fold_sd FROM mm JOIN om USING (model) JOIN fsd USING (model))
"""


@query("k2_multiclass_ranking", with_views("strata_pred", "WITH " + CANDIDATES + """
SELECT model, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(min_recall, 6) AS min_recall, round(ovr_auc, 6) AS ovr_auc, round(fold_sd, 6) AS fold_sd,
 macro_f1 >= (SELECT max(macro_f1) FROM cand) - 0.01 AS near_best,
 CAST(row_number() OVER (ORDER BY macro_f1 >= (SELECT max(macro_f1) FROM cand) - 0.01 DESC, balanced_accuracy DESC, min_recall DESC, ovr_auc DESC, fold_sd, macro_f1 DESC, model) AS INTEGER) AS selection_rank FROM cand"""))
def k2(spark, sf):
    return rounded(K.rank_multiclass(multiclass_candidates(spark, sf)), ["macro_f1", "balanced_accuracy", "min_recall", "ovr_auc", "fold_sd"])


def trials(spark, sf):
    """Trial rows derived from the parts table: 4 models x 5 folds, metrics from hashes."""
    from kinfold.functions.draws import draw_uniform
    p = F.col("p_partkey")
    model = F.element_at(F.array(*[F.lit(m) for m in ("gbt", "mlp", "rf", "svm")]), (p % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(
        model.alias("model"), (p % 5 + 1).cast("int").alias("fold"), p.alias("trial_number"),
        F.when(p % 11 == 0, "FAIL").when(p % 13 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
        (p % 3 != 0).alias("converged"), (F.lit(0.7) + draw_uniform("auc", p) * 0.2).alias("roc_auc"),
        draw_uniform("ap", p).alias("average_precision"), draw_uniform("sd", p).alias("fold_sd"),
        F.col("p_size").cast("double").alias("complexity"), F.col("p_retailprice").alias("seconds"))


TRIALS = """
trials AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'gbt' WHEN 1 THEN 'mlp' WHEN 2 THEN 'rf' ELSE 'svm' END AS model, CAST(p_partkey % 5 + 1 AS INTEGER) AS fold, p_partkey AS trial_number,
 CASE WHEN p_partkey % 11 = 0 THEN 'FAIL' WHEN p_partkey % 13 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state, p_partkey % 3 <> 0 AS converged,
 0.7::DOUBLE + CAST('0x' || substr(md5('auc:' || p_partkey), 1, 8) AS BIGINT) / 4294967296::DOUBLE * 0.2::DOUBLE AS roc_auc,
 CAST('0x' || substr(md5('ap:' || p_partkey), 1, 8) AS BIGINT) / 4294967296::DOUBLE AS average_precision,
 CAST('0x' || substr(md5('sd:' || p_partkey), 1, 8) AS BIGINT) / 4294967296::DOUBLE AS fold_sd, p_size::DOUBLE AS complexity, p_retailprice AS seconds FROM part)
"""


@query("k3_best_trial", "WITH " + TRIALS + """,
 d AS (SELECT *, bool_or(converged) OVER (PARTITION BY model, fold) AS anyc FROM trials WHERE state = 'COMPLETE'),
 c AS (SELECT *, max(roc_auc) OVER (PARTITION BY model, fold) AS best FROM d WHERE model <> 'mlp' OR converged OR NOT anyc),
 r AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY average_precision DESC, fold_sd, complexity, trial_number) AS rn FROM c WHERE roc_auc >= best - 0.005::DOUBLE)
SELECT model, fold, trial_number, round(roc_auc, 6) AS roc_auc FROM r WHERE rn = 1""")
def k3(spark, sf):
    return K.choose_trial(trials(spark, sf), ["model", "fold"]).select("model", "fold", "trial_number", r6("roc_auc").alias("roc_auc"))


GRID = [round(0.10 + i * 0.005, 3) for i in range(161)]


@query("k4_threshold_choice", with_views("group_oof", f"""
WITH g AS (SELECT unnest([{", ".join(f"{g!r}::DOUBLE" for g in GRID)}]) AS threshold),
 c AS (SELECT model, repeat, threshold, count(*) FILTER (target = 1 AND score >= threshold) AS tp, count(*) FILTER (target = 0 AND score >= threshold) AS fp,
  count(*) FILTER (target = 0 AND score < threshold) AS tn, count(*) FILTER (target = 1 AND score < threshold) AS fn FROM group_oof, g GROUP BY 1, 2, 3),
 m AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp * 1.0::DOUBLE / (tp + fn) AS recall, tn * 1.0::DOUBLE / (tn + fp) AS specificity FROM c),
 o AS (SELECT *, recall >= 0.55 AND specificity >= 0.55 AS ok, bool_or(recall >= 0.55 AND specificity >= 0.55) OVER (PARTITION BY model, repeat) AS anyok FROM m),
 r AS (SELECT *, row_number() OVER (PARTITION BY model, repeat ORDER BY f1 DESC, (recall + specificity) / 2 DESC, round(abs(threshold - 0.5), 9), threshold) AS rn FROM o WHERE ok OR NOT anyok)
SELECT model, repeat, threshold, round(f1, 6) AS f1, CASE WHEN anyok THEN 'constraints_met' ELSE 'constraint_not_met' END AS threshold_status FROM r WHERE rn = 1"""))
def k4(spark, sf):
    grid = M.grid_metrics(group_scores(spark, sf), ["model", "repeat"], "target", "score", GRID)
    return K.choose_threshold(grid, ["model", "repeat"]).select("model", "repeat", "threshold", r6("f1").alias("f1"), "threshold_status")


@query("k5_top_n_per_class", with_views("attr", """
WITH i AS (SELECT class, feature, avg(abs(shap)) AS imp FROM attr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY imp DESC, feature) AS rank FROM i)
SELECT class, feature, CAST(rank AS INTEGER) AS rank, round(imp, 6) AS importance FROM r WHERE rank <= 3"""))
def k5(spark, sf):
    imp = attr(spark, sf).groupBy("class", "feature").agg(F.avg(F.abs("shap")).alias("importance"))
    return rounded(K.top_n(imp, ["class"], 3, F.col("importance").desc(), F.col("feature")), ["importance"]).select("class", "feature", "rank", "importance")
