"""Join patterns (J)."""

from pyspark.sql import functions as F

from kinfold.functions.draws import draw_int
from kinfold.functions.scalars import feature_name
from kinfold.operators import joins as J, metrics as M, ordered as O, rollup as R, statistics as T
from kinfold.plans.fixtures import CLASSES, FEATURES, attr, class_oof, oof, records, stable, table, with_views
from kinfold.plans.registry import query
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)
rounded = lambda df, names: df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


@query("j1_matched_records", with_views("records", """
SELECT a.record_id, a.group_id, a.f_total, b.f_qty, c.label FROM records a JOIN (SELECT * FROM records WHERE f_qty IS NOT NULL) b USING (record_id) JOIN (SELECT * FROM records WHERE record_id % 3 <> 0) c USING (record_id)"""))
def j1(spark, sf):
    base = records(spark, sf)
    joined, problems = J.checked_inner([
        ("a", base.select("record_id", "group_id", "f_total")),
        ("b", base.where("f_qty is not null").select("record_id", "group_id", "f_qty")),
        ("c", base.where("record_id % 3 <> 0").select("record_id", "group_id", "label"))], "record_id", "group_id")
    if not problems.isEmpty():
        raise ValueError("record join is not one-to-one or groups disagree")
    return joined


@query("j2_left_enrich", """
SELECT o_orderkey, o_custkey AS c_custkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'given' END, c_mktsegment) AS c_mktsegment, c_mktsegment AS c_mktsegment_registry FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def j2(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "given").alias("c_mktsegment"))
    return J.enrich(left, table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"])


@query("j3_availability_flag", with_views("records", """
WITH a AS (SELECT group_id, max(f_total) AS m FROM records GROUP BY 1), b AS (SELECT group_id, max(f_total) AS m2, count(*) AS n FROM records WHERE record_id % 5 = 0 GROUP BY 1)
SELECT group_id, m2 IS NOT NULL AS available, coalesce(n, 0) AS n_other, round(abs(m - m2), 4) AS abs_difference FROM a LEFT JOIN b USING (group_id)"""))
def j3(spark, sf):
    base = records(spark, sf)
    a = base.groupBy("group_id").agg(F.max("f_total").alias("m"))
    b = base.where("record_id % 5 = 0").groupBy("group_id").agg(F.max("f_total").alias("m2"), F.count("*").alias("n"))
    return a.join(b, "group_id", "left").select("group_id", F.col("m2").isNotNull().alias("available"), F.coalesce("n", F.lit(0)).alias("n_other"), F.round(F.abs(F.col("m") - F.col("m2")), 4).alias("abs_difference"))


@query("j4_semi_join_training", with_views("records", """
SELECT record_id, group_id FROM records WHERE group_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"""))
def j4(spark, sf):
    training = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("group_id"))
    return records(spark, sf).select("record_id", "group_id").join(training, "group_id", "left_semi")


@query("j5_orphan_groups", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)""")
def j5(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("j6_lookup_join", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j6(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("o_orderkey", "c_name", "n_name", "r_name"))


@query("j7_outer_alignment", with_views("attr", """
WITH a AS (SELECT group_id, feature, avg(abs(shap)) AS a FROM attr WHERE repeat = 1 AND class = 'F' AND group_id % 3 <> 0 GROUP BY 1, 2), b AS (SELECT group_id, feature, avg(abs(shap)) AS b FROM attr WHERE repeat = 2 AND class = 'F' AND group_id % 3 <> 1 GROUP BY 1, 2)
SELECT group_id, feature, round(coalesce(a, 0), 6) AS a, round(coalesce(b, 0), 6) AS b FROM a FULL JOIN b USING (group_id, feature)"""))
def j7(spark, sf):
    base = attr(spark, sf).where("class = 'F'")
    side = lambda cond, n: base.where(cond).groupBy("group_id", "feature").agg(F.avg(F.abs("shap")).alias(n))
    return rounded(J.align(side("repeat = 1 and group_id % 3 <> 0", "a"), side("repeat = 2 and group_id % 3 <> 1", "b"), ["group_id", "feature"], "a", "b"), ["a", "b"])


@query("j8_unordered_pairs", with_views("group_oof", """
SELECT a.group_id, a.repeat, a.model AS "left", b.model AS "right", round(a.score - b.score, 6) AS difference FROM group_oof a JOIN group_oof b ON a.group_id = b.group_id AND a.repeat = b.repeat AND a.model < b.model"""))
def j8(spark, sf):
    scores = R.group_scores(oof(spark, sf, by="group_id"), ["model", "repeat"], "group_id", "target", "block", "score")
    pairs = J.unordered_pairs(scores, ["group_id", "repeat"], "model", "score")
    return pairs.select("group_id", "repeat", "left", "right", r6(F.col("left_value") - F.col("right_value")).alias("difference"))


@query("j9_parameter_grid", with_views("group_oof", """
SELECT model, repeat, CAST(g AS INTEGER) AS slot, count(*) FILTER (target = 1 AND score >= g / 10.0::DOUBLE) AS tp, count(*) FILTER (target = 0 AND score >= g / 10.0::DOUBLE) AS fp FROM group_oof, (SELECT range AS g FROM range(1, 10)) GROUP BY 1, 2, 3"""))
def j9(spark, sf):
    scores = R.group_scores(oof(spark, sf, by="group_id"), ["model", "repeat"], "group_id", "target", "block", "score")
    grid = M.grid_metrics(scores, ["model", "repeat"], "target", "score", [i / 10 for i in range(1, 10)])
    return grid.select("model", "repeat", F.round(F.col("threshold") * 10).cast("int").alias("slot"), "tp", "fp")


@query("j10_bin_range_join", with_views("records", """
SELECT record_id, CAST(floor((f_total - lo) / ((hi - lo) / 8)) AS INTEGER) + CASE WHEN f_total = hi THEN 0 ELSE 1 END AS bin FROM records, (SELECT min(f_total) AS lo, max(f_total) AS hi FROM records)"""))
def j10(spark, sf):
    base = records(spark, sf).select("record_id", "f_total")
    span = base.agg(F.min("f_total").alias("lo"), F.max("f_total").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    width = (hi - lo) / 8
    return base.select("record_id", (F.floor((F.col("f_total") - lo) / width).cast("int") + F.when(F.col("f_total") == hi, 0).otherwise(1)).alias("bin"))


@query("j11_leave_one_out", with_views("attr", """
WITH o AS (SELECT class, feature, block, sum(abs(shap)) AS s, count(*) AS n FROM attr GROUP BY 1, 2, 3), t AS (SELECT class, feature, sum(s) AS ts, sum(n) AS tn FROM o GROUP BY 1, 2)
SELECT class, feature, block AS omitted, CAST(tn - n AS BIGINT) AS remaining, round((ts - s) / (tn - n), 6) AS remaining_mean FROM o JOIN t USING (class, feature)"""))
def j11(spark, sf):
    rows = attr(spark, sf).select("class", "feature", "block", F.abs("shap").alias("a"))
    return rounded(J.leave_one_out_mean(rows, ["class", "feature"], "block", "a"), ["remaining_mean"])


@query("j12_split_disjointness", with_views("records", """
WITH f AS (SELECT DISTINCT record_id, group_id, block, block % 5 AS own FROM records), r AS (SELECT fold, CASE WHEN own = fold THEN 'validation' ELSE 'train' END AS p, f.* FROM f, (SELECT range AS fold FROM range(5))),
 l AS (SELECT fold, 'record_id' AS level, record_id AS u, p FROM r UNION ALL SELECT fold, 'group_id', group_id, p FROM r UNION ALL SELECT fold, 'block', block, p FROM r)
SELECT level, count(*) FILTER (np > 1) AS leaks, count(*) AS checked FROM (SELECT fold, level, u, count(DISTINCT p) AS np FROM l GROUP BY 1, 2, 3) GROUP BY 1"""))
def j12(spark, sf):
    reg = records(spark, sf).select("record_id", "group_id", "block", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")).withColumn(
        "partition", F.when(F.col("block") % 5 == F.col("fold"), "validation").otherwise("train"))
    return J.split_leaks(reg, ["record_id", "group_id", "block"], ["fold"])


@query("j13_feature_agreement", """
SELECT p_brand || '2O' || p_size AS feature, p_partkey AS position FROM part WHERE p_partkey % 3 = 0
 AND p_brand || '2O' || p_size IN (SELECT p_brand || '2O' || p_size FROM part WHERE p_partkey % 5 = 0) AND p_brand || '2O' || p_size IN (SELECT p_brand || '2O' || p_size FROM part WHERE p_partkey % 7 = 0)""")
def j13(spark, sf):
    part = table(spark, sf, "part")
    raw = lambda unit, cond: part.where(cond).select(F.concat("p_brand", F.lit("₂O"), "p_size", F.lit(unit)).alias("raw"), F.col("p_partkey").alias("position"))
    return J.agreed_features(raw(" (wt.%)", "p_partkey % 3 = 0"), raw("", "p_partkey % 5 = 0"), raw(" (ppm)", "p_partkey % 7 = 0"), feature_name("raw"))


@query("j14_primary_domain_rescore", with_views("strata_pred", """
WITH x AS (SELECT model, group_id, true_code, predicted FROM strata_pred JOIN customer ON c_custkey = group_id WHERE c_nationkey >= 5),
 per AS (SELECT model, c, count(*) FILTER (true_code = c AND predicted = c) AS tp, count(*) FILTER (true_code = c) AS s, count(*) FILTER (predicted = c) AS d FROM x, (SELECT range AS c FROM range(3)) GROUP BY 1, 2),
 n AS (SELECT model, count(*) AS n_strata, count(DISTINCT group_id) AS n_groups FROM x GROUP BY 1)
SELECT model, round(avg(coalesce(2.0::DOUBLE * tp / nullif(s + d, 0), 0)), 6) AS macro_f1, any_value(n_strata) AS n_strata, any_value(n_groups) AS n_groups FROM per JOIN n USING (model) GROUP BY 1"""))
def j14(spark, sf):
    strata = R.class_strata(class_oof(spark, sf, by="group_id"), ["model", "repeat"], "group_id", "true_code", "block", ["s0", "s1", "s2"])
    domain = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), F.when(F.col("c_nationkey") >= 5, "primary").otherwise("out_of_domain").alias("domain"))
    kept = cut(strata.join(domain, "group_id").where("domain = 'primary'"))
    f1 = M.class_metrics(M.confusion(kept, ["model"], "true_code", "predicted", 3), 3, "fixed").select("model", r6("macro_f1").alias("macro_f1"))
    return f1.join(kept.groupBy("model").agg(F.count("*").alias("n_strata"), F.countDistinct("group_id").alias("n_groups")), "model")
