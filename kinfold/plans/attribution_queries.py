"""Attribution summaries."""

from pyspark.sql import functions as F

from kinfold.operators import attribution as A, cohort as C
from kinfold.plans.fixtures import FEATURES, attr, records, with_views
from kinfold.plans.metric_queries import rounded
from kinfold.plans.registry import query
from kinfold.plans.resample_queries import draws, wrho
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)
REPS = 30

PR = "pr0 AS (SELECT feature, repeat, group_id, min(block) AS block, median(shap) AS shap, median(completed) AS completed, avg(imputed) AS imputed FROM attr WHERE class = 'P' GROUP BY 1, 2, 3)"
GLOBAL = f"""{PR}, ov AS (SELECT feature, group_id, min(block) AS block, median(shap) AS shap, median(completed) AS completed, avg(imputed) AS imputed FROM pr0 GROUP BY 1, 2),
 im AS (SELECT feature, repeat, row_number() OVER (PARTITION BY repeat ORDER BY avg(abs(shap)) DESC, feature) AS rank FROM pr0 GROUP BY 1, 2),
 rs AS (SELECT feature, avg(rank) AS mean_rank, stddev_samp(rank) AS rank_sd, count(*) FILTER (rank <= 3) AS top_repeat_count FROM im GROUP BY 1),
 dr0 AS (SELECT feature, repeat, completed, shap, 1 AS w FROM pr0), {wrho('dr0', 'feature, repeat', name='dr')},
 ag AS (SELECT feature, greatest(count(*) FILTER (rho > 0), count(*) FILTER (rho < 0), count(*) FILTER (rho = 0)) * 1.0::DOUBLE / count(*) AS direction_agreement FROM dr GROUP BY 1),
 {draws('group_id', 'ov', REPS)}, ma AS (SELECT rep, feature, sum(w * abs(shap)) / sum(w) AS m FROM ov JOIN draws USING (group_id) GROUP BY 1, 2),
 mi AS (SELECT feature, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ma GROUP BY 1),
 bx AS (SELECT feature, rep, completed, shap, w FROM ov JOIN draws USING (group_id)), {wrho('bx', 'feature, rep', name='br')}, bi AS (SELECT feature, quantile_cont(rho, 0.025) AS dlo, quantile_cont(rho, 0.975) AS dhi FROM br GROUP BY 1),
 e0 AS (SELECT feature, completed, shap, 1 AS w FROM ov), {wrho('e0', 'feature', name='er')}, mm AS (SELECT feature, avg(abs(shap)) AS mean_abs, avg(imputed) AS imputed_fraction FROM ov GROUP BY 1),
 gi AS (SELECT feature, mean_abs, lo AS mean_abs_low, hi AS mean_abs_high, mean_rank, rank_sd, top_repeat_count, direction_agreement, er.rho AS direction, dlo AS direction_low, dhi AS direction_high, imputed_fraction,
  mean_abs / sum(mean_abs) OVER () AS normalized_importance, dlo > 0 OR dhi < 0 AS ci_excludes_zero, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS new_rank
  FROM mm JOIN mi USING (feature) JOIN rs USING (feature) JOIN ag USING (feature) JOIN er USING (feature) JOIN bi USING (feature))"""
NUM = ["mean_abs", "mean_abs_low", "mean_abs_high", "mean_rank", "rank_sd", "direction_agreement", "direction", "direction_low", "direction_high", "imputed_fraction", "normalized_importance"]


def importance(spark, sf):
    return A.global_importance(attr(spark, sf, by="group_id").where("class = 'P'"), REPS, 7, top=3)


@query("x4_global_importance", with_views("attr", f"WITH {GLOBAL} SELECT feature, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUM) + ", top_repeat_count, ci_excludes_zero, new_rank FROM gi"))
def x4(spark, sf):
    return rounded(importance(spark, sf), NUM)


@query("x5_rank_stability", with_views("attr", """
WITH i AS (SELECT class, repeat || ':' || fold AS p, feature, avg(abs(shap)) AS imp FROM attr GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY class, p ORDER BY imp DESC, feature) AS rk, rank() OVER (PARTITION BY class, p ORDER BY imp) AS av FROM i),
 q AS (SELECT a.class, a.p AS l, b.p AS r, corr(a.av, b.av) AS rho, count(*) FILTER (a.rk <= 3 AND b.rk <= 3) * 1.0::DOUBLE / count(*) FILTER (a.rk <= 3 OR b.rk <= 3) AS j, count(*) FILTER (a.rk <= 3 AND b.rk <= 3) / 3.0::DOUBLE AS o FROM r a JOIN r b ON a.class = b.class AND a.feature = b.feature AND a.p < b.p GROUP BY 1, 2, 3)
SELECT class, count(*) AS comparisons, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.025), 6) AS rho_q025, round(quantile_cont(rho, 0.975), 6) AS rho_q975, round(avg(j), 6) AS mean_jaccard, round(min(j), 6) AS min_jaccard, round(min(o), 6) AS min_overlap FROM q GROUP BY 1"""))
def x5(spark, sf):
    return rounded(A.rank_stability(attr(spark, sf), 3), ["median_rho", "rho_q025", "rho_q975", "mean_jaccard", "min_jaccard", "min_overlap"])


@query("x6_block_influence", with_views("attr", f"""
WITH g AS (SELECT class, feature, group_id, block, median(completed) AS completed, avg(abs(shap)) AS mean_abs, avg(shap) AS shap FROM attr GROUP BY 1, 2, 3, 4),
 o AS (SELECT class, feature, block, sum(mean_abs) AS s, count(*) AS n FROM g GROUP BY 1, 2, 3), t AS (SELECT class, feature, sum(s) AS ts, sum(n) AS tn FROM o GROUP BY 1, 2),
 b AS (SELECT class, block AS omitted, feature, ts / tn AS base, (ts - s) / (tn - n) AS less, CAST(tn - n AS BIGINT) AS remaining FROM o JOIN t USING (class, feature)),
 r AS (SELECT *, row_number() OVER (PARTITION BY class, omitted ORDER BY base DESC, feature) AS r0, row_number() OVER (PARTITION BY class, omitted ORDER BY less DESC, feature) AS r1, rank() OVER (PARTITION BY class, omitted ORDER BY base) AS a0, rank() OVER (PARTITION BY class, omitted ORDER BY less) AS a1 FROM b),
 k AS (SELECT class, omitted, corr(a0, a1) AS rank_rho, count(*) FILTER (r0 <= 3 AND r1 <= 3) * 1.0::DOUBLE / count(*) FILTER (r0 <= 3 OR r1 <= 3) AS jaccard, max(remaining) AS remaining_groups FROM r GROUP BY 1, 2),
 f0 AS (SELECT class, feature, completed, shap, 1 AS w FROM g WHERE feature IN ('f_bal')), {wrho('f0', 'class, feature', name='full_')},
 l0 AS (SELECT g.class, feature, omitted, completed, shap, 1 AS w FROM g JOIN (SELECT DISTINCT class, block AS omitted FROM g) z ON z.class = g.class AND block <> omitted WHERE feature IN ('f_bal')), {wrho('l0', 'class, feature, omitted', name='less_')},
 c AS (SELECT l.class, omitted, max(abs(l.rho - f.rho)) AS mx, count(*) FILTER (sign(l.rho) * sign(f.rho) < 0) AS sign_flips FROM less_ l JOIN full_ f USING (class, feature) GROUP BY 1, 2)
SELECT class, omitted, round(rank_rho, 6) AS rank_rho, round(jaccard, 6) AS jaccard, remaining_groups, round(mx, 6) AS max_direction_change, sign_flips FROM k LEFT JOIN c USING (class, omitted)"""))
def x6(spark, sf):
    return rounded(A.block_influence(attr(spark, sf, by="group_id"), ["f_bal"], 3), ["rank_rho", "jaccard", "max_direction_change"])


RULE = {"max_rank": 4, "max_rank_sd": 5.0, "min_agreement": 0.67, "max_missing": 0.05, "max_gap": 0.1}


@query("x9_locked_reproducibility", with_views("attr", f"""WITH {GLOBAL}, lab AS (SELECT feature, abs(avg(imputed) FILTER (label = 1) - avg(imputed) FILTER (label = 0)) AS label_gap FROM attr WHERE class = 'P' AND repeat = 1 GROUP BY 1),
 k AS (SELECT * FROM gi JOIN lab USING (feature)), lk AS (SELECT unnest(['f_total', 'f_bal', 'f_qty', 'f_none']) AS feature),
 c AS (SELECT feature, new_rank, concat_ws(';', CASE WHEN NOT new_rank <= 4 THEN 'rank_range' END, CASE WHEN NOT coalesce(rank_sd <= 5, false) THEN 'rank_sd' END, CASE WHEN NOT direction_agreement >= 0.67 THEN 'direction_agreement' END,
  CASE WHEN NOT ci_excludes_zero THEN 'direction_ci' END, CASE WHEN NOT imputed_fraction <= 0.05 THEN 'missing_fraction' END, CASE WHEN NOT label_gap <= 0.1 THEN 'label_gap' END, CASE WHEN NOT feature <> 'f_qty' THEN 'quality_panel' END) AS failed FROM lk LEFT JOIN k USING (feature))
SELECT feature, coalesce(new_rank, 0) AS new_rank, CASE WHEN new_rank IS NOT NULL AND failed = '' THEN 'reproduced' ELSE 'not_reproduced' END AS status, CASE WHEN new_rank IS NULL THEN 'feature_not_in_retained_panel' WHEN failed = '' THEN 'all_checks_passed' ELSE failed END AS reason FROM c"""))
def x9(spark, sf):
    rows = attr(spark, sf).where("class = 'P'")
    gap = cut(rows.where("repeat = 1").groupBy("feature").agg(F.abs(F.avg(F.when(F.col("label") == 1, F.col("imputed"))) - F.avg(F.when(F.col("label") == 0, F.col("imputed")))).alias("label_gap")))
    table = importance(spark, sf).join(gap, "feature").withColumn("in_quality_panel", F.col("feature") != "f_qty")
    # the gaps have rows where the attributions have
    locked = gap.select(F.explode(F.array(*[F.lit(f) for f in ("f_total", "f_bal", "f_qty", "f_none")])).alias("feature")).distinct()
    return A.reproducibility(table, locked, RULE).withColumn("new_rank", F.coalesce("new_rank", F.lit(0)))


@query("x11_locked_availability", with_views("attr", """
SELECT class3, feature, count(*) AS n_valid, count(observed) AS n_available, round(count(observed) * 1.0::DOUBLE / count(*), 6) AS availability FROM attr WHERE class = 'F' AND feature IN ('f_bal', 'f_qty') GROUP BY 1, 2"""))
def x11(spark, sf):
    rows = attr(spark, sf).where(F.col("feature").isin("f_bal", "f_qty") & (F.col("class") == "F"))
    return rounded(A.availability(rows, ["class3", "feature"], "observed", "shap"), ["availability"])
