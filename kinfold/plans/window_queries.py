"""Windows and ranking (W)."""

from pyspark.sql import functions as F

from kinfold.functions.scalars import category
from kinfold.operators import metrics as M, ordered as O, rollup as R, vectors as V, weights as W
from kinfold.plans.fixtures import FEATURES, attr, records, stable, table, with_views
from kinfold.plans.metric_queries import BY_REPEAT, by_repeat, group_scores, rounded
from kinfold.plans.registry import query

r6 = lambda c: F.round(c, 6)
IMP = "i AS (SELECT {0}, feature, avg(abs(shap)) AS imp FROM attr GROUP BY {0}, feature)"


def importance(spark, sf, *keys):
    return attr(spark, sf).groupBy(*keys, "feature").agg(F.avg(F.abs("shap")).alias("imp"))


@query("w1_importance_rank", with_views("attr", "WITH " + IMP.format("block, repeat") + """
SELECT block, repeat, feature, CAST(row_number() OVER (PARTITION BY block, repeat ORDER BY imp DESC, feature) AS INTEGER) AS rank, round(imp, 6) AS imp FROM i"""))
def w1(spark, sf):
    return rounded(W.importance_ranks(importance(spark, sf, "block", "repeat"), ["block", "repeat"], "feature", "imp"), ["imp"])


@query("w2_min_rank", with_views("attr", """
WITH i AS (SELECT block, feature, round(avg(imputed), 6) AS imp FROM attr GROUP BY 1, 2) SELECT block, feature, CAST(rank() OVER (PARTITION BY block ORDER BY imp DESC) AS INTEGER) AS rank FROM i"""))
def w2(spark, sf):
    share = attr(spark, sf).groupBy("block", "feature").agg(F.round(F.avg("imputed"), 6).alias("imp"))
    return W.min_ranks(share, ["block"], "imp").select("block", "feature", "rank")


@query("w3_category_rank", with_views("attr", """
WITH i AS (SELECT block, feature, round(avg(imputed), 6) AS imp, CASE WHEN contains(feature, 'total') OR contains(feature, 'price') THEN 'money' WHEN contains(feature, 'bal') THEN 'account' ELSE 'other' END AS cat FROM attr GROUP BY 1, 2)
SELECT block, feature, cat, CAST(floor(rank() OVER (PARTITION BY block ORDER BY imp DESC) + (count(*) OVER (PARTITION BY block, imp) - 1) / 2.0) AS INTEGER) AS rank, count(*) OVER (PARTITION BY block, cat) AS category_size FROM i"""))
def w3(spark, sf):
    share = attr(spark, sf).groupBy("block", "feature").agg(F.round(F.avg("imputed"), 6).alias("imp")).withColumn(
        "cat", category("feature", {"money": ["total", "price"], "account": ["bal"]}, "other"))
    return W.category_ranks(share, ["block"], "cat", "imp").select("block", "feature", "cat", "rank", "category_size")


@query("w4_share_of_total", with_views("attr", "WITH " + IMP.format("class, block") + """
SELECT class, block, feature, round(imp / sum(imp) OVER (PARTITION BY class, block), 6) AS share FROM i"""))
def w4(spark, sf):
    got = V.share(importance(spark, sf, "class", "block"), ["class", "block"], "imp", "share")
    return got.select("class", "block", "feature", r6("share").alias("share"))


@query("w5_inverse_group_weight", with_views("stable", """
WITH n AS (SELECT record_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY group_id) AS w FROM stable) SELECT record_id, round(w / avg(w) OVER (), 6) AS weight FROM n"""))
def w5(spark, sf):
    got = W.inverse_group_weights(stable(spark, sf).select("record_id", "group_id"), "group_id")
    return got.select("record_id", r6("weight").alias("weight"))


@query("w6_balanced_weight", with_views("records", """
WITH n AS (SELECT record_id, count(*) OVER () * 1.0::DOUBLE / (3 * count(*) OVER (PARTITION BY class3)) / count(*) OVER (PARTITION BY group_id) AS w FROM records) SELECT record_id, round(w / avg(w) OVER (), 6) AS weight FROM n"""))
def w6(spark, sf):
    got = W.balanced_group_weights(records(spark, sf).select("record_id", "group_id", "class3"), "group_id", "class3", 3)
    return got.select("record_id", r6("weight").alias("weight"))


@query("w7_winner_counts", with_views("group_oof", BY_REPEAT + """,
 r AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY average_precision DESC, roc_auc DESC, f1 DESC, model) AS rn FROM by_repeat) SELECT model, count(*) AS wins FROM r WHERE rn = 1 GROUP BY 1"""))
def w7(spark, sf):
    return W.winners(by_repeat(spark, sf), ["repeat"], "model", F.col("average_precision").desc(), F.col("roc_auc").desc(), F.col("f1").desc(), F.col("model"))


@query("w8_suffix_minimum", with_views("records", """
WITH p AS (SELECT record_id, CASE WHEN f_qty IS NOT NULL THEN f_qty / 5000.0::DOUBLE END AS p FROM records), n AS (SELECT p, count(*) AS c FROM p WHERE p IS NOT NULL GROUP BY 1),
 r AS (SELECT p, p * sum(c) OVER () / sum(c) OVER (ORDER BY p) AS raw FROM n), q AS (SELECT p, least(min(raw) OVER (ORDER BY p DESC), 1) AS q FROM r)
SELECT record_id, round(q, 6) AS fdr_q FROM p LEFT JOIN q USING (p)"""))
def w8(spark, sf):
    p = records(spark, sf).select("record_id", (F.col("f_qty") / 5000.0).alias("p"))
    return M.benjamini_hochberg(p, [], "p").select("record_id", r6("fdr_q").alias("fdr_q"))


@query("w9_cumulative_counts", with_views("records", """
WITH l AS (SELECT class3, f_qty, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM records WHERE f_qty IS NOT NULL GROUP BY 1, 2)
SELECT class3, f_qty AS threshold, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS fp FROM l WINDOW w AS (PARTITION BY class3 ORDER BY f_qty DESC)"""))
def w9(spark, sf):
    levels = M.score_levels(records(spark, sf), ["class3"], "label", "f_qty")
    return M.curve_points(levels, ["class3"], "f_qty").select("class3", "threshold", "tp", "fp")


@query("w10_keep_one", """
SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS l_partkey, 'first' AS kept FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey)), 'last' FROM lineitem GROUP BY 1, 2""")
def w10(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey")
    side = lambda last, name: W.keep_one(rows, ["l_orderkey", "l_linenumber"], order, last).select("l_orderkey", "l_linenumber", "l_partkey", F.lit(name).alias("kept"))
    return side(False, "first").unionByName(side(True, "last"))


@query("w11_sequential_ids", with_views("records", """
SELECT block, 'CVB' || lpad(CAST(dense_rank() OVER (ORDER BY block) AS VARCHAR), CAST(greatest(4, length(CAST(dense_rank() OVER (ORDER BY block) AS VARCHAR))) AS INTEGER), '0') AS block_id FROM (SELECT DISTINCT block FROM records)"""))
def w11(spark, sf):
    pos = O.positions(records(spark, sf).select("block"), [], "block").withColumn("n", (F.col("position") + 1).cast("string"))
    return pos.select("block", F.concat(F.lit("CVB"), F.lpad("n", F.greatest(F.lit(4), F.length("n")), F.lit("0"))).alias("block_id"))
