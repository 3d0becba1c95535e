"""Cross-task coupling (C)."""

from pyspark.sql import functions as F

from kinfold.operators import coupling as C, metrics as M, ordered as O, resample as B
from kinfold.plans.fixtures import FEATURES, attr, class_oof, oof, records, with_views
from kinfold.plans.metric_queries import rounded
from kinfold.plans.registry import query
from kinfold.plans.resample_queries import draws, shuffled, wrho
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)
REPS = 30

GT = """gt AS (SELECT feature, class AS task, group_id, min(block) AS block, median(completed) AS value, median(shap) AS shap FROM attr WHERE repeat = 1 AND class IN ('F', 'P') GROUP BY 1, 2, 3)"""


def group_tasks(spark, sf):
    rows = attr(spark, sf, by="group_id").where("repeat = 1 and class in ('F', 'P')").withColumnRenamed("class", "task")
    return O.medians(rows, ["feature", "task", "group_id"], {"value": "completed", "shap": "shap"}, also=[F.min("block").alias("block")], bound=["group_id"])


CONC = f"""{GT}, s0 AS (SELECT task, feature, value AS completed, shap, 1 AS w FROM gt), {wrho('s0', 'task, feature', name='rh')}, im AS (SELECT task, feature, avg(abs(shap)) AS imp FROM gt GROUP BY 1, 2),
 sd AS (SELECT task, feature, rho, imp / sum(imp) OVER (PARTITION BY task) AS share, rank() OVER (PARTITION BY task ORDER BY imp DESC) AS rk FROM im JOIN rh USING (task, feature)),
 cc AS (SELECT a.feature, a.rho AS a_rho, a.share AS a_share, sign(a.rho) * a.share AS a_signed, b.rho AS b_rho, b.share AS b_share, sign(b.rho) * b.share AS b_signed, CAST(a.rk AS INTEGER) AS a_rank, CAST(b.rk AS INTEGER) AS b_rank, CAST(sign(a.rho) = sign(b.rho) AS INTEGER) AS direction_agreement
  FROM sd a JOIN sd b USING (feature) WHERE a.task = 'F' AND b.task = 'P')"""
CN = ["a_rho", "a_share", "a_signed", "b_rho", "b_share", "b_signed"]


def concordance(spark, sf):
    gt = cut(group_tasks(spark, sf))
    rho = M.spearman(gt, ["task", "feature"], "value", "shap").select("task", "feature", "rho")
    both = cut(gt.groupBy("task", "feature").agg(F.avg(F.abs("shap")).alias("importance")).join(rho, ["task", "feature"]))
    side = lambda t: both.where(F.col("task") == t).drop("task")
    return C.feature_concordance(side("F"), side("P"))


@query("c1_feature_concordance", with_views("attr", f"WITH {CONC} SELECT feature, " + ", ".join(f"round({c}, 6) AS {c}" for c in CN) + ", a_rank, b_rank, direction_agreement FROM cc"))
def c1(spark, sf):
    return rounded(concordance(spark, sf), CN)


@query("c1_concordance_test", with_views("attr", f"""WITH {CONC}, f AS (SELECT feature, row_number() OVER (ORDER BY feature) AS k, a_signed AS l, b_signed AS r FROM cc),
 perm(o) AS (SELECT [k] FROM f UNION ALL SELECT list_append(o, k) FROM perm, f WHERE NOT list_contains(o, k)), fu AS (SELECT row_number() OVER () AS id, o FROM perm WHERE len(o) = 6),
 nl AS (SELECT id, sum(a.l * b.r) / (SELECT sqrt(sum(l * l)) * sqrt(sum(r * r)) FROM f) AS c FROM fu, f a JOIN f b ON b.k = o[a.k] GROUP BY 1), ob AS (SELECT sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r))) AS c0 FROM f)
SELECT 'a|b' AS pair, (SELECT round(c0, 6) FROM ob) AS cosine, round((1 + count(*) FILTER (abs(c) >= abs((SELECT c0 FROM ob)) - 1e-12)) * 1.0::DOUBLE / (1 + count(*)), 6) AS exact_p, count(*) AS orders, (SELECT count(*) FROM cc) AS shared_features, (SELECT CAST(sum(direction_agreement) AS BIGINT) FROM cc) AS agreements FROM nl""", recursive=True))
def c1b(spark, sf):
    return rounded(C.concordance_summary(cut(concordance(spark, sf)), 6), ["cosine", "exact_p"])


@query("c2_binned_dependence", with_views("attr", f"""WITH {GT}, e AS (SELECT feature, unnest(list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))) AS edge FROM (SELECT DISTINCT feature, group_id, value FROM gt) GROUP BY 1),
 bn AS (SELECT feature, task, group_id, any_value(block) AS block, any_value(value) AS value, any_value(shap) AS shap, CAST(greatest(count(*) FILTER (value > edge), 1) AS INTEGER) AS bin FROM gt JOIN e USING (feature) GROUP BY 1, 2, 3),
 md AS (SELECT feature, task, median(shap) AS m FROM bn GROUP BY 1, 2), ad AS (SELECT feature, task, median(abs(shap - m)) AS mad, any_value(m) AS m FROM bn JOIN md USING (feature, task) GROUP BY 1, 2),
 z AS (SELECT bn.*, (shap - m) / (1.4826 * mad) AS z FROM bn JOIN ad USING (feature, task)), sh AS (SELECT feature, task, bin, median(value) AS x_median, median(z) AS y_median, count(DISTINCT group_id) AS n_groups, count(DISTINCT block) AS n_blocks FROM z GROUP BY 1, 2, 3),
 {draws('block', 'z', REPS)}, bm AS (SELECT feature, task, bin, rep, median(z) AS m FROM (SELECT feature, task, bin, rep, z, unnest(generate_series(1, w)) FROM z JOIN draws USING (block)) GROUP BY 1, 2, 3, 4),
 ci AS (SELECT feature, task, bin, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY 1, 2, 3)
SELECT feature, task, bin, round(x_median, 5) AS x_median, round(y_median, 5) AS y_median, n_groups, n_blocks, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high FROM sh LEFT JOIN ci USING (feature, task, bin)"""))
def c2(spark, sf):
    got = C.binned_dependence(group_tasks(spark, sf), 5, "block", REPS, 7)
    return got.withColumns({c: F.round(c, 5) for c in ("x_median", "y_median", "ci_low", "ci_high")})


CG = """pu AS (SELECT group_id, min(block) AS block, median(score) AS p_u FROM oof WHERE model = 'gbt' AND repeat = 1 GROUP BY 1), ps AS (SELECT group_id, median(s2) FILTER (model = 'gbt') AS p_s, median(s2) FILTER (model = 'rf') AS p_c FROM class_oof WHERE repeat = 1 GROUP BY 1),
 cg AS (SELECT group_id, block, p_u, p_s, p_c FROM pu JOIN ps USING (group_id))"""


def groups(spark, sf):
    pu = O.medians(oof(spark, sf, by="group_id").where("model = 'gbt' and repeat = 1"), ["group_id"], {"p_u": "score"}, also=[F.min("block").alias("block")])
    one = class_oof(spark, sf, by="group_id").where("repeat = 1 and model in ('gbt', 'rf')").select(
        "group_id", F.when(F.col("model") == "gbt", F.col("s2")).alias("a"), F.when(F.col("model") == "rf", F.col("s2")).alias("b"))
    return pu.join(O.medians(one, ["group_id"], {"p_s": "a", "p_c": "b"}), "group_id")


def inference_sql(i, x, y, seed):
    return f"""c{i} AS (SELECT block, median({x}) AS x, median({y}) AS y FROM cg GROUP BY 1), {draws('block', f'c{i}', REPS, seed, f'd{i}')}, b{i} AS (SELECT rep, x AS completed, y AS shap, w FROM c{i} JOIN d{i} USING (block)), {wrho(f'b{i}', 'rep', name=f'br{i}')},
 o{i} AS (SELECT 1 AS k, x AS completed, y AS shap, 1 AS w FROM c{i}), {wrho(f'o{i}', 'k', name=f'es{i}')}, rk{i} AS (SELECT row_number() OVER (ORDER BY block) - 1 AS pos, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM c{i}),
 {shuffled(f'rk{i}', f'sh{i}', seed, 999)}, pm{i} AS (SELECT rep, rx, target FROM rk{i} JOIN sh{i} USING (pos)), nl{i} AS (SELECT rep, corr(pm{i}.rx, rk{i}.ry) AS rho FROM pm{i} JOIN rk{i} ON rk{i}.pos = pm{i}.target GROUP BY 1),
 f{i} AS (SELECT (SELECT rho FROM es{i}) AS estimate, (SELECT quantile_cont(rho, 0.025) FROM br{i}) AS ci_low, (SELECT quantile_cont(rho, 0.975) FROM br{i}) AS ci_high, (SELECT n FROM es{i}) AS components, (1 + count(*) FILTER (abs(rho) >= abs((SELECT rho FROM es{i})) - 1e-12)) * 1.0::DOUBLE / (1 + count(*)) AS p FROM nl{i})"""


@query("c3_associations", with_views("oof class_oof", f"""WITH {CG}, {inference_sql(0, 'p_s', 'p_u', 7)}, {inference_sql(1, 'p_c', 'p_u', 1007)}, {inference_sql(2, 'p_s', 'p_c', 2007)},
 a AS (SELECT 'raw' AS analysis, * FROM f0 UNION ALL SELECT 'calibrated', * FROM f1 UNION ALL SELECT 'agreement', * FROM f2), n AS (SELECT p, count(*) AS c FROM a GROUP BY 1), r AS (SELECT p, p * sum(c) OVER () / sum(c) OVER (ORDER BY p) AS raw FROM n), q AS (SELECT p, least(min(raw) OVER (ORDER BY p DESC), 1) AS q FROM r)
SELECT analysis, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, components, round(p, 6) AS permutation_p, round(q, 6) AS fdr_q FROM a JOIN q USING (p)""", recursive=True))
def c3(spark, sf):
    got = C.associations(groups(spark, sf), {"raw": ("p_s", "p_u"), "calibrated": ("p_c", "p_u"), "agreement": ("p_s", "p_c")}, "block", REPS, 999, 7)
    return rounded(got.select("analysis", "estimate", "ci_low", "ci_high", "components", "permutation_p", "fdr_q"), ["estimate", "ci_low", "ci_high", "permutation_p", "fdr_q"])


@query("c3_support_quantiles", with_views("oof class_oof", f"""WITH {CG}, e AS (SELECT unnest(list_sort(list_distinct(quantile_cont(p_s, [0.0, 0.25, 0.5, 0.75, 1.0])))) AS edge FROM cg), bn AS (SELECT group_id, any_value(block) AS block, any_value(p_u) AS p_u, any_value(p_s) AS p_s, CAST(greatest(count(*) FILTER (p_s > edge), 1) AS INTEGER) AS bin FROM cg, e GROUP BY 1),
 {draws('block', 'bn', REPS)}, bm AS (SELECT bin, rep, median(p_u) AS m FROM (SELECT bin, rep, p_u, unnest(generate_series(1, w)) FROM bn JOIN draws USING (block)) GROUP BY 1, 2), ci AS (SELECT bin, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1)
SELECT bin, round(median(p_u), 6) AS outcome_median, round(min(p_s), 6) AS score_min, round(max(p_s), 6) AS score_max, count(*) AS n_groups, count(DISTINCT block) AS n_blocks, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high FROM bn JOIN ci USING (bin) GROUP BY 1"""))
def c3b(spark, sf):
    got = C.support_quantiles(groups(spark, sf), "p_s", "p_u", 4, "block", REPS, 7)
    return rounded(got, ["outcome_median", "score_min", "score_max", "ci_low", "ci_high"])


@query("c4_joint_state", with_views("oof class_oof", f"""WITH {CG}, st AS (SELECT group_id, block, CASE WHEN p_s >= (SELECT median(p_s) FROM cg) THEN 'high S' ELSE 'low S' END || ' / ' || CASE WHEN p_u >= (SELECT median(p_u) FROM cg) THEN 'high U' ELSE 'low U' END AS joint_state FROM cg),
 v AS (SELECT group_id, 'f_total' AS feature, median(f_total) AS value FROM records WHERE group_id IN (SELECT group_id FROM cg) GROUP BY 1 UNION ALL SELECT group_id, 'f_qty', median(f_qty) FROM records WHERE group_id IN (SELECT group_id FROM cg) GROUP BY 1),
 m AS (SELECT feature, median(value) AS md FROM v GROUP BY 1), d AS (SELECT feature, any_value(md) AS md, median(abs(value - md)) AS mad FROM v JOIN m USING (feature) GROUP BY 1)
SELECT g.joint_state, g.feature, median_z, coalesce(n_groups, 0) AS n_groups, coalesce(n_blocks, 0) AS n_blocks, (SELECT round(median(p_u), 6) FROM cg) AS u_cut, (SELECT round(median(p_s), 6) FROM cg) AS s_cut
FROM (SELECT unnest(['low S / low U', 'high S / low U', 'low S / high U', 'high S / high U']) AS joint_state, feature FROM (SELECT DISTINCT feature FROM v)) g
LEFT JOIN (SELECT joint_state, feature, round(median((value - md) / (1.4826 * mad)), 5) AS median_z FROM v JOIN d USING (feature) JOIN st USING (group_id) GROUP BY 1, 2) USING (joint_state, feature)
LEFT JOIN (SELECT joint_state, count(DISTINCT group_id) AS n_groups, count(DISTINCT block) AS n_blocks FROM st GROUP BY 1) USING (joint_state)"""))
def c4(spark, sf):
    mids = O.medians(records(spark, sf), ["group_id"], {"f_total": "f_total", "f_qty": "f_qty"})
    values = mids.unpivot(["group_id"], ["f_total", "f_qty"], "feature", "value")
    got = C.joint_state(groups(spark, sf), "p_u", "p_s", values)
    return rounded(got.withColumn("median_z", F.round("median_z", 5)), ["u_cut", "s_cut"])


@query("c5_coupling_cosine", with_views("attr", f"""WITH {GT}, p AS (SELECT group_id, feature, max(shap) FILTER (task = 'F') AS a, max(shap) FILTER (task = 'P') AS b FROM gt GROUP BY 1, 2)
SELECT group_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS cosine FROM p GROUP BY 1"""))
def c5(spark, sf):
    side = lambda t: F.max(F.when(F.col("task") == t, F.col("shap")))
    wide = group_tasks(spark, sf).groupBy("group_id", "feature").agg(side("F").alias("a"), side("P").alias("b"))
    return rounded(C.coupling_cosine(wide, "group_id", "a", "b"), ["cosine"])
