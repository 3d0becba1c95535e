"""Contracts and gates (Q) and the selection summary."""

from pyspark.sql import functions as F

from kinfold.functions.scalars import split_ids
from kinfold.operators import attribution as A, contracts as K, gates as G, metrics as M, resample as B, selection as S, weights as W
from kinfold.plans.attribution_queries import GLOBAL, importance
from kinfold.plans.fixtures import CLASSES, MODELS, attr, records, table, with_views
from kinfold.plans.metric_queries import BY_REPEAT, CANDIDATES, MULTI, by_repeat, consensus_metrics, multi, multiclass_candidates, rounded
from kinfold.plans.registry import query
from kinfold.plans.scan_queries import _expected_files
from kinfold.session import cut, scratch_path

r6 = lambda c: F.round(c, 6)


@query("q1_integrity_ledger", """
SELECT 'orders_have_rows' AS "check", count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS evidence, true AS fatal, 'run-2' AS run_id FROM orders
UNION ALL SELECT 'price_non_negative', count(*) FILTER (o_totalprice < 0) = 0, CAST(count(*) FILTER (o_totalprice < 0) AS VARCHAR), false, 'run-2' FROM orders""")
def q1(spark, sf):
    orders = table(spark, sf, "orders")
    checks = [K.check(orders, "orders_have_rows", F.count("*") > 0, F.count("*")),
              K.check(orders, "price_non_negative", F.count_if(F.col("o_totalprice") < 0) == 0, F.count_if(F.col("o_totalprice") < 0), fatal=False)]
    path = scratch_path(spark, "ledger")
    for run in (1, 2):
        K.ledger(checks, f"run-{run}").withColumn("sequence", F.lit(run)).write.mode("append").parquet(path)
    latest = K.latest_run(spark.read.parquet(path), "sequence").drop("sequence")
    K.raise_on_failure(latest)
    return latest


@query("q2_source_checks", with_views("records", """
SELECT 'unique_record_id' AS "check", true AS passed, '0' AS evidence, true AS fatal, 'r' AS run_id WHERE (SELECT count(*) = count(DISTINCT record_id) FROM records)
UNION ALL SELECT 'binary_label', count(*) FILTER (label NOT IN (0, 1)) = 0, CAST(count(*) FILTER (label NOT IN (0, 1)) AS VARCHAR), true, 'r' FROM records
UNION ALL SELECT 'traceable_group', count(*) = 0, CAST(count(*) AS VARCHAR), true, 'r' FROM (SELECT DISTINCT group_id FROM records WHERE group_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 100 <> 3))
UNION ALL SELECT 'source_present', count(*) FILTER (trim(source_ids) = '') = 0, CAST(count(*) FILTER (trim(source_ids) = '') AS VARCHAR), true, 'r' FROM records
UNION ALL SELECT 'unique_group_registry', true, '0', true, 'r'"""))
def q2(spark, sf):
    groups = table(spark, sf, "customer").where("c_custkey % 100 <> 3").select(F.col("c_custkey").alias("group_id"))
    return K.source_checks(records(spark, sf), groups, "record_id", "group_id", "label", "source_ids", "r")


@query("q3_protocol_contract", """
WITH a AS (SELECT o_orderstatus AS field, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 1 UNION ALL SELECT 'groups', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders),
 b AS (SELECT o_orderstatus AS field, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 UNION ALL SELECT 'groups', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders WHERE o_custkey % 2 = 0)
SELECT coalesce(a.field, b.field) AS field, a.value AS old_value, coalesce(b.value, '') AS new_value FROM a FULL JOIN b ON a.field = b.field WHERE a.value IS DISTINCT FROM b.value""")
def q3(spark, sf):
    def fields(rows, group_rows):
        return rows.groupBy(F.col("o_orderstatus").alias("field")).agg(F.count("*").cast("string").alias("value")).unionByName(
            group_rows.agg(F.countDistinct("o_custkey").cast("string").alias("value")).select(F.lit("groups").alias("field"), "value"))
    orders = table(spark, sf, "orders")
    diff = K.contract_diff(fields(orders, orders), fields(orders.where("o_orderstatus <> 'F'"), orders.where("o_custkey % 2 = 0")))
    return diff.withColumn("new_value", F.coalesce("new_value", F.lit("")))


@query("q4_output_completeness", """
SELECT 'missing_outputs' AS item, count(*) AS n, count(*) = 0 AS passed FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0
UNION ALL SELECT 'distinct_hashes', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) = 1 FROM orders""")
def q4(spark, sf):
    expected, actual = _expected_files(spark, sf)
    missing = K.missing_outputs(expected, actual).agg(F.count("*").alias("n"))
    hashes = K.hash_agreement(table(spark, sf, "orders").select(F.sha2("o_orderpriority", 256).alias("protocol_hash")))
    return missing.select(F.lit("missing_outputs").alias("item"), "n", (F.col("n") == 0).alias("passed")).unionByName(
        hashes.select(F.lit("distinct_hashes").alias("item"), F.col("distinct_hashes").alias("n"), F.col("agree").alias("passed")))


GATE = [("min_rank_rho", ">=", 0.8), ("min_overlap", ">=", 0.8), ("min_agreement", ">=", 0.67), ("mean_share_top", ">=", 0.5), ("max_missing", "<=", 0.2)]
GATE_SQL = f"""{GLOBAL}, ra AS (SELECT class, repeat || ':' || fold AS p, feature, avg(abs(shap)) AS imp FROM attr GROUP BY 1, 2, 3), rr AS (SELECT *, row_number() OVER (PARTITION BY class, p ORDER BY imp DESC, feature) AS rk, rank() OVER (PARTITION BY class, p ORDER BY imp) AS av FROM ra),
 rq AS (SELECT a.class, corr(a.av, b.av) AS rho, count(*) FILTER (a.rk <= 3 AND b.rk <= 3) / 3.0::DOUBLE AS o FROM rr a JOIN rr b ON a.class = b.class AND a.feature = b.feature AND a.p < b.p WHERE a.class = 'P' GROUP BY a.class, a.p, b.p),
 gm AS (SELECT (SELECT quantile_cont(rho, 0.025) FROM rq) AS min_rank_rho, (SELECT min(o) FROM rq) AS min_overlap, min(direction_agreement) FILTER (new_rank <= 3) AS min_agreement, sum(normalized_importance) FILTER (new_rank <= 3) AS mean_share_top, max(imputed_fraction) AS max_missing FROM gi),
 gc AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{op}' AS comparison, {t}::DOUBLE AS threshold, {m} AS value, {m} {op} {t} AS passed FROM gm" for m, op, t in GATE) + ")"


def gate_metrics(spark, sf):
    imp = cut(importance(spark, sf))
    top = F.col("new_rank") <= 3
    from_table = imp.agg(F.min(F.when(top, F.col("direction_agreement"))).alias("min_agreement"), F.sum(F.when(top, F.col("normalized_importance"))).alias("mean_share_top"),
                         F.max("imputed_fraction").alias("max_missing"))
    stab = cut(A.rank_stability(attr(spark, sf).where("class = 'P'"), 3))
    return from_table.withColumns({"min_rank_rho": stab.select("rho_q025").scalar(), "min_overlap": stab.select("min_overlap").scalar()})


@query("q5_reliability_gate", with_views("attr", f"WITH {GATE_SQL} SELECT metric, comparison, threshold, round(value, 6) AS value, passed, (SELECT bool_and(passed) FROM gc) AS gate_passed FROM gc"))
def q5(spark, sf):
    checks = cut(G.evaluate(gate_metrics(spark, sf), GATE))
    return rounded(checks.withColumn("gate_passed", G.verdict(checks).select("passed").scalar()), ["value"])


EXPLORE = [("macro_f1", ">=", 0.45), ("balanced_accuracy", ">=", 0.45), ("min_recall", ">=", 0.35)]
ROBUST = [("macro_f1", ">=", 0.55), ("balanced_accuracy", ">=", 0.55), ("min_recall", ">=", 0.5), ("ovr_auc", ">=", 0.9)]


@query("q6_readiness_levels", with_views("strata_pred", f"""WITH {CANDIDATES} SELECT model, macro_f1 >= 0.45 AND balanced_accuracy >= 0.45 AND min_recall >= 0.35 AS exploratory_ready, macro_f1 >= 0.55 AND balanced_accuracy >= 0.55 AND min_recall >= 0.5 AND ovr_auc >= 0.9 AS statistically_robust,
 CASE WHEN macro_f1 >= 0.55 AND balanced_accuracy >= 0.55 AND min_recall >= 0.5 AND ovr_auc >= 0.9 THEN 'robust' WHEN macro_f1 >= 0.45 AND balanced_accuracy >= 0.45 AND min_recall >= 0.35 THEN 'exploratory' ELSE 'not_ready' END AS level FROM cand"""))
def q6(spark, sf):
    return G.readiness(multiclass_candidates(spark, sf), EXPLORE, ROBUST, ["model"])


@query("q7_decision_gate", with_views("strata_pred", f"""WITH {CANDIDATES}, c AS (SELECT model, macro_f1 >= 0.6 AS f1_ok, balanced_accuracy >= 0.6 AS ba_ok, ovr_auc >= 0.8 AS auc_ok FROM cand)
SELECT model, f1_ok AND ba_ok AND auc_ok AS passed, concat_ws('; ', CASE WHEN NOT ba_ok THEN 'balanced_accuracy' END, CASE WHEN NOT f1_ok THEN 'macro_f1' END, CASE WHEN NOT auc_ok THEN 'ovr_auc' END) AS failed, auc_ok AS rank_passed,
 CASE WHEN f1_ok AND ba_ok AND auc_ok THEN 'main_text' WHEN auc_ok THEN 'supplement' ELSE 'diagnostic_only' END AS placement FROM c"""))
def q7(spark, sf):
    checks = cut(G.evaluate(multiclass_candidates(spark, sf), [("macro_f1", ">=", 0.6), ("balanced_accuracy", ">=", 0.6), ("ovr_auc", ">=", 0.8)], ["model"]))
    rank_ok = checks.where("metric = 'ovr_auc'").select("model", F.col("passed").alias("rank_passed"))
    return G.placement(G.verdict(checks, ["model"]).join(rank_ok, "model"), "passed", "rank_passed")


@query("q8_bridge_contract", with_views("attr", """
SELECT count(DISTINCT record_id) AS records, count(*) = count(DISTINCT (record_id, feature)) AS unique_rows, count(DISTINCT feature) AS features, string_agg(DISTINCT feature, ';' ORDER BY feature) AS feature_list, count(DISTINCT group_id) AS n_groups FROM attr WHERE class = 'P' AND repeat = 1"""))
def q8(spark, sf):
    rows = attr(spark, sf).where("class = 'P' and repeat = 1").select("record_id", "group_id", "feature")
    twice = rows.groupBy("record_id", "feature").count().where("count > 1").agg((F.count("*") == 0).alias("u")).scalar()
    return rows.agg(F.countDistinct("record_id").alias("records"), twice.alias("unique_rows"), F.countDistinct("feature").alias("features"),
                    F.array_join(F.array_sort(F.collect_set("feature")), ";").alias("feature_list"), F.countDistinct("group_id").alias("n_groups"))


@query("q9_revision_comparison", with_views("group_oof", BY_REPEAT + """ SELECT model, round(avg(roc_auc), 6) AS roc_auc, 'current' AS revision FROM by_repeat GROUP BY 1 UNION ALL SELECT model, round(roc_auc, 6), 'previous' FROM by_repeat WHERE repeat = 1"""))
def q9(spark, sf):
    scores = cut(by_repeat(spark, sf))
    now = scores.groupBy("model").agg(r6(F.avg("roc_auc")).alias("roc_auc"))
    return G.revision_table(now, scores.where("repeat = 1").select("model", r6("roc_auc").alias("roc_auc")))


@query("q10_figure_data", with_views("attr", """
WITH i AS (SELECT class, feature, avg(abs(shap)) AS imp FROM attr GROUP BY 1, 2) SELECT feature, round(max(imp) FILTER (class = 'F') / (SELECT sum(imp) FROM i WHERE class = 'F'), 6) AS "F", round(max(imp) FILTER (class = 'O') / (SELECT sum(imp) FROM i WHERE class = 'O'), 6) AS "O", round(max(imp) FILTER (class = 'P') / (SELECT sum(imp) FROM i WHERE class = 'P'), 6) AS "P" FROM i GROUP BY 1"""))
def q10(spark, sf):
    from kinfold.operators.vectors import share
    imp = attr(spark, sf).groupBy("class", "feature").agg(F.avg(F.abs("shap")).alias("imp"))
    shares = share(imp, ["class"], "imp", "share")
    return rounded(shares.groupBy("feature").pivot("class", CLASSES).agg(F.first("share")), CLASSES)


@query("l9_selection_summary", with_views("consensus", "" + BY_REPEAT + """,
 mi AS (SELECT model, avg(roc_auc) AS mean, stddev_samp(roc_auc) AS sd FROM by_repeat GROUP BY 1), r AS (SELECT model, row_number() OVER (PARTITION BY repeat ORDER BY average_precision DESC, roc_auc DESC, f1 DESC, model) AS rn FROM by_repeat), w AS (SELECT model, count(*) AS wins FROM r WHERE rn = 1 GROUP BY 1)
SELECT model, round(mean, 6) AS mean, round(mean - 4.302652729911275 * sd / sqrt(3), 6) AS ci_low, round(mean + 4.302652729911275 * sd / sqrt(3), 6) AS ci_high, coalesce(wins, 0) AS wins FROM mi LEFT JOIN w USING (model)"""))
def l9(spark, sf):
    scores = cut(by_repeat(spark, sf))
    spread = M.mean_interval(scores, ["model"], "roc_auc").select("model", "mean", "ci_low", "ci_high")
    won = W.winners(scores, ["repeat"], "model", F.col("average_precision").desc(), F.col("roc_auc").desc(), F.col("f1").desc(), F.col("model"))
    return rounded(spread.join(won, "model", "left").withColumn("wins", F.coalesce("wins", F.lit(0))), ["mean", "ci_low", "ci_high"])
