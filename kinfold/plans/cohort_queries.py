"""Cohort building (P2-P8) and audit aggregations."""

from pyspark.sql import functions as F

from kinfold.functions.scalars import split_ids
from kinfold.operators import cohort as C, contracts, rollup as R
from kinfold.plans.fixtures import CLASSES, FEATURES, class_oof, records, stable, table, with_views
from kinfold.plans.registry import query
from kinfold.sources.tables import column_contract

r6 = lambda c: F.round(c, 6)
rounded = lambda df, names: df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])

MATRIX = """
m AS (SELECT group_id, count(*) AS n, count(*) FILTER (class3 = 'F') AS nf, count(*) FILTER (class3 = 'O') AS no_, count(*) FILTER (class3 = 'P') AS np FROM records GROUP BY 1),
g AS (SELECT group_id, n, (n - greatest(nf, no_, np)) * 1.0::DOUBLE / n AS minority, CASE WHEN nf >= no_ AND nf >= np THEN 'F' WHEN no_ >= np THEN 'O' ELSE 'P' END AS majority,
 CAST(nf > 0 AS INTEGER) + CAST(no_ > 0 AS INTEGER) + CAST(np > 0 AS INTEGER) AS kinds FROM m),
gone AS (SELECT c_custkey AS group_id FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT group_id FROM g WHERE (kinds > 1 AND minority >= 0.6) OR n < 5 UNION SELECT c_custkey FROM customer WHERE c_custkey IN (7, 11)),
maj AS (SELECT group_id, majority FROM g WHERE minority > 0 AND minority < 0.6)
"""


def exclusion(spark, sf):
    base = records(spark, sf)
    matrix = C.class_matrix(base, "group_id", "class3", CLASSES)
    registry = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), "c_mktsegment")
    excluded = C.excluded_groups(matrix, registry, "group_id", CLASSES, "c_mktsegment", ["MACHINERY"], 0.6, 5, [7, 11])
    return base, excluded, C.majority_class(matrix, "group_id", CLASSES, 0.6)


@query("p2_drop_groups_and_minority", with_views("records", "WITH " + MATRIX + """
SELECT record_id, group_id, class3 FROM records LEFT JOIN maj USING (group_id)
WHERE group_id NOT IN (SELECT group_id FROM gone) AND (majority IS NULL OR class3 = majority)"""))
def p2(spark, sf):
    base, excluded, majority = exclusion(spark, sf)
    audit = C.attrition(base, "group_id", "class3", CLASSES, excluded, majority)
    return audit.where("filter_status = 'retained'").select("record_id", "group_id", "class3")


@query("p3_coercion_audit", """
WITH t AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'n.d.' WHEN o_orderkey % 10 = 1 THEN NULL WHEN o_orderkey % 10 = 2 THEN 'inf' ELSE 'ok' END AS k FROM orders)
SELECT 'price' AS feature, count(*) FILTER (k IS NOT NULL) AS observed, count(*) FILTER (k IN ('n.d.', 'inf')) AS not_numeric,
 count(*) FILTER (k = 'ok' AND o_totalprice < 50000) AS negative, count(*) FILTER (k IS DISTINCT FROM 'ok' OR o_totalprice < 50000) AS missing_after FROM t
UNION ALL SELECT 'cust', count(*), 0, 0, 0 FROM t""")
def p3(spark, sf):
    k = F.col("o_orderkey") % 10
    text = F.when(k == 0, "n.d.").when(k == 1, None).when(k == 2, "inf").otherwise((F.col("o_totalprice") - 50000).cast("string"))
    raw = table(spark, sf, "orders").select(text.alias("price"), F.col("o_custkey").cast("string").alias("cust"))
    return C.coercion_audit(raw, ["price", "cust"])


@query("p4_numeric_columns", """
SELECT 'c_name' AS "column", count(*) AS n_values, CAST(0 AS BIGINT) AS n_numeric, false AS is_feature FROM customer
UNION ALL SELECT 'bal', count(*), count(*) FILTER (c_custkey % 8 <> 0), count(*) FILTER (c_custkey % 8 <> 0) >= 0.8 * count(*) FROM customer
UNION ALL SELECT 'half', count(*), count(*) FILTER (c_custkey % 2 = 0), count(*) FILTER (c_custkey % 2 = 0) >= 0.8 * count(*) FROM customer""")
def p4(spark, sf):
    raw = table(spark, sf, "customer").select(
        "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 8 == 0, "?").otherwise(F.col("c_acctbal").cast("string")).alias("bal"),
        F.when(F.col("c_custkey") % 2 == 0, "1").otherwise("x").alias("half"))
    return C.numeric_columns(raw, raw.columns, ["c_mktsegment"])


STATUS = """
st AS (SELECT group_id, count(*) AS n_records, CASE WHEN min(label) = 0 AND max(label) = 0 THEN 'stable_negative' WHEN min(label) = 1 AND max(label) = 1 THEN 'stable_positive' ELSE 'mixed_uncertain' END AS status FROM records GROUP BY 1)
"""


@query("p5_group_label_status", with_views("records", "WITH " + STATUS + "SELECT group_id, n_records, status FROM st"))
def p5(spark, sf):
    return C.group_status(records(spark, sf), "group_id", "label")


MISSING = "(" + " + ".join(f"CAST({f} IS NULL AS INTEGER)" for f in FEATURES) + f") / {float(len(FEATURES))}::DOUBLE"


@query("p6_missing_fraction_filter", with_views("records", f"""
SELECT record_id, round({MISSING}, 6) AS missing_fraction FROM records WHERE {MISSING} <= 0.6"""))
def p6(spark, sf):
    return records(spark, sf).select("record_id", C.missing_fraction(FEATURES).alias("missing_fraction")).where(
        "missing_fraction <= 0.6").select("record_id", r6("missing_fraction").alias("missing_fraction"))


@query("p7_column_contract", """
SELECT 'l_orderkey' AS "column", TRUE AS present, count(l_orderkey) AS filled FROM lineitem
UNION ALL SELECT 'l_quantity', TRUE, count(l_quantity) FROM lineitem UNION ALL SELECT 'l_missing', FALSE, 0""")
def p7(spark, sf):
    return column_contract(table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_missing"])


@query("p8_key_contract", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def p8(spark, sf):
    return contracts.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a1_group_registry", with_views("stable", """
SELECT group_id, min(label) AS label, min(block) AS block, count(*) AS n_records, count(DISTINCT label) = 1 AS label_constant, count(DISTINCT block) = 1 AS block_constant FROM stable GROUP BY 1"""))
def a1(spark, sf):
    return R.group_registry(stable(spark, sf), "group_id", "label", "block")


@query("a2_cohort_flow", with_views("records", "WITH " + STATUS + f""",
 s AS (SELECT group_id, CASE WHEN {MISSING} > 0.6 THEN 'excluded_high_missingness' WHEN status = 'mixed_uncertain' THEN 'mixed_group_challenge' ELSE 'primary_stable_groups' END AS stage FROM records JOIN st USING (group_id))
SELECT stage, count(*) AS records, count(DISTINCT group_id) AS n_groups FROM s GROUP BY 1 UNION ALL SELECT 'source_records', count(*), count(DISTINCT group_id) FROM s"""))
def a2(spark, sf):
    base = records(spark, sf)
    staged = base.join(C.group_status(base, "group_id", "label").select("group_id", "status"), "group_id").select(
        "group_id", F.when(C.missing_fraction(FEATURES) > 0.6, "excluded_high_missingness")
        .when(F.col("status") == "mixed_uncertain", "mixed_group_challenge").otherwise("primary_stable_groups").alias("stage"))
    return C.cohort_flow(staged, "stage", "group_id")


@query("a3_attrition_audit", with_views("records", "WITH " + MATRIX + """
SELECT CASE WHEN class3 NOT IN ('F', 'O') THEN 'excluded_label' WHEN gone.group_id IS NOT NULL THEN 'excluded_group'
 WHEN majority IS NOT NULL AND class3 <> majority THEN 'excluded_minority' ELSE 'retained' END AS filter_status, count(*) AS records, count(DISTINCT r.group_id) AS n_groups
FROM records r LEFT JOIN gone USING (group_id) LEFT JOIN maj USING (group_id) GROUP BY 1"""))
def a3(spark, sf):
    base, excluded, majority = exclusion(spark, sf)
    audit = C.attrition(base, "group_id", "class3", ["F", "O"], excluded, majority)
    return audit.groupBy("filter_status").agg(F.count("*").alias("records"), F.countDistinct("group_id").alias("n_groups"))


@query("a4_excluded_groups", with_views("records", "WITH " + MATRIX + "SELECT group_id FROM gone"))
def a4(spark, sf):
    return exclusion(spark, sf)[1]


@query("a5_majority_class", with_views("records", "WITH " + MATRIX + "SELECT group_id, majority AS majority_label FROM maj"))
def a5(spark, sf):
    return exclusion(spark, sf)[2]


@query("a6_class_matrix", with_views("records", "WITH " + MATRIX + 'SELECT group_id, nf AS "n_F", no_ AS "n_O", np AS "n_P" FROM m'))
def a6(spark, sf):
    return C.class_matrix(records(spark, sf), "group_id", "class3", CLASSES)


@query("a7_group_flags", with_views("records strata_pred", """
WITH d AS (SELECT group_id, CASE WHEN record_id % 200 = 0 THEN NULL ELSE class3 END AS class3 FROM records),
 g AS (SELECT group_id, count(*) AS n, count(*) FILTER (class3 IS NULL) AS nm, count(DISTINCT class3) AS nt, string_agg(DISTINCT class3, ',' ORDER BY class3) AS kinds FROM d GROUP BY 1),
 dom AS (SELECT c_custkey AS group_id, CASE WHEN c_nationkey < 3 THEN 'out_of_domain' ELSE 'primary' END AS domain FROM customer),
 f AS (SELECT group_id, n, concat_ws('; ', CASE WHEN nt > 1 THEN 'mixed_type_group' END, CASE WHEN domain = 'out_of_domain' THEN 'out_of_domain_group' END, CASE WHEN n < 5 THEN 'low_sample_group' END, CASE WHEN nm > 0 THEN 'missing_label' END) AS flag,
  concat_ws('; ', CASE WHEN nt > 1 THEN 'types=' || kinds END, CASE WHEN domain = 'out_of_domain' THEN 'domain=out_of_domain' END, CASE WHEN n < 5 THEN 'n=' || n END, CASE WHEN nm > 0 THEN 'n_missing=' || nm END) AS detail FROM g LEFT JOIN dom USING (group_id)),
 ab AS (SELECT group_id, count(*) AS k FROM records WHERE f_qty IS NULL GROUP BY 1),
 rec AS (SELECT group_id, count(DISTINCT model) AS n_models, median(recall) AS mr FROM (SELECT group_id, model, avg(CAST(true_code = predicted AS INTEGER)) AS recall FROM strata_pred WHERE repeat = 1 GROUP BY 1, 2) GROUP BY 1)
SELECT group_id, flag, detail, n AS n_records FROM f WHERE flag <> ''
UNION ALL SELECT group_id, 'high_missingness_abstain', 'n_abstained=' || k, n FROM ab JOIN g USING (group_id)
UNION ALL SELECT group_id, 'consistent_cross_model_error', 'n_models=' || n_models, n FROM rec JOIN g USING (group_id) WHERE n_models >= 4 AND mr < 0.5"""))
def a7(spark, sf):
    base = records(spark, sf)
    raw = base.select("group_id", F.when(F.col("record_id") % 200 != 0, F.col("class3")).alias("class3"))
    domain = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), F.when(F.col("c_nationkey") < 3, "out_of_domain").otherwise("primary").alias("domain"))
    strata = R.class_strata(class_oof(spark, sf, by="group_id").where("repeat = 1"), ["model"], "group_id", "true_code", "block", ["s0", "s1", "s2"])
    recall = R.error_audit(strata, ["group_id", "model"], "true_code", "predicted", 3).groupBy("group_id").agg(
        F.countDistinct("model").alias("n_models"), F.percentile("recall", F.lit(0.5)).alias("median_recall"))
    return C.group_flags(raw, "group_id", "class3", domain, 5, base.where("f_qty is null"), recall, 4, 0.5)


MISS_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} IS NULL AS INTEGER)) AS m, avg(CAST({f} IS NULL AS INTEGER)) FILTER (label = 0) AS m0, avg(CAST({f} IS NULL AS INTEGER)) FILTER (label = 1) AS m1, count(DISTINCT {f}) AS nd FROM records" for f in FEATURES)


@query("a8_missingness_by_label", with_views("records", f"""
SELECT feature, round(m, 6) AS missing_fraction, round(m0, 6) AS missing_label_0, round(m1, 6) AS missing_label_1, round(abs(m1 - m0), 6) AS label_gap FROM ({MISS_ROWS})"""))
def a8(spark, sf):
    return rounded(C.missingness(records(spark, sf), FEATURES, "label"), ["missing_fraction", "missing_label_0", "missing_label_1", "label_gap"])


@query("a9_predictor_screen", with_views("records", f"""
SELECT feature, round(m, 6) AS missing_fraction, CASE WHEN feature = 'f_total' THEN 'excluded_direct' WHEN feature = 'f_tax' THEN 'excluded_named' WHEN m > 0.05 THEN 'excluded_missingness' WHEN nd < 2 THEN 'excluded_constant' ELSE 'retained' END AS decision FROM ({MISS_ROWS})"""))
def a9(spark, sf):
    return rounded(C.screen(records(spark, sf), FEATURES, ["f_total"], ["f_tax"], 0.05), ["missing_fraction"])


@query("a23_label_source_audit", with_views("records", """
WITH mx AS (SELECT group_id FROM records GROUP BY 1 HAVING count(DISTINCT class3) > 1)
SELECT 'class' AS level, coalesce(class3, 'ALL') AS unit, count(*) AS records, count(DISTINCT group_id) AS n_groups, count(DISTINCT block) AS n_blocks, NULL AS classes, CAST(0 AS BIGINT) AS mixed_groups FROM records GROUP BY GROUPING SETS ((), (class3))
UNION ALL SELECT 'block', CAST(block AS VARCHAR), count(*), count(DISTINCT group_id), 1, string_agg(DISTINCT class3, ';' ORDER BY class3), count(DISTINCT mx.group_id) FROM records LEFT JOIN mx USING (group_id) GROUP BY block"""))
def a23(spark, sf):
    base = records(spark, sf)
    top = R.class_source_summary(base, "class3", "group_id", "block").select(
        F.lit("class").alias("level"), F.col("class3").alias("unit"), "records", "n_groups", "n_blocks",
        F.lit(None).cast("string").alias("classes"), F.lit(0).cast("bigint").alias("mixed_groups"))
    blocks = R.block_label_audit(base, "class3", "group_id", "block").select(
        F.lit("block").alias("level"), F.col("block").cast("string").alias("unit"), "records", "n_groups",
        F.lit(1).cast("bigint").alias("n_blocks"), "classes", "mixed_groups")
    return top.unionByName(blocks)


@query("a24_class_support", with_views("records", """
SELECT class3, count(*) AS records, count(DISTINCT group_id) AS n_groups, count(DISTINCT block) AS n_blocks FROM records GROUP BY 1"""))
def a24(spark, sf):
    return R.class_support(records(spark, sf), "class3", "group_id", "block")


TOKENS = lambda: split_ids("source_ids")
REFS = "refs AS (SELECT DISTINCT group_id, block, unnest(string_split(source_ids, ';')) AS source FROM records)"


@query("a25_block_registry", with_views("records", f"""
WITH {REFS}, j AS (SELECT group_id, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM refs GROUP BY 1)
SELECT group_id, min(block) AS block, count(*) AS n_records, count(*) FILTER (class3 = 'F') AS "n_F", count(*) FILTER (class3 = 'O') AS "n_O", count(*) FILTER (class3 = 'P') AS "n_P", any_value(sources) AS sources
FROM records JOIN j USING (group_id) GROUP BY 1"""))
def a25(spark, sf):
    return R.block_registry(records(spark, sf), "group_id", "block", TOKENS(), "class3", CLASSES)


@query("a26_source_graph_audit", with_views("records", f"""
WITH {REFS} SELECT source, min(block) AS block, count(*) AS n_groups, count(*) > 1 AS shared, min(block) = max(block) AS inside_one_block FROM refs GROUP BY 1"""))
def a26(spark, sf):
    return R.source_graph_audit(records(spark, sf), "group_id", "block", TOKENS())


@query("a28_input_validation", with_views("records", f"""
WITH {REFS} SELECT class3, count(DISTINCT block) AS blocks, count(*) AS records, count(DISTINCT group_id) AS n_groups, count(DISTINCT block) >= 5 AS enough_blocks, (SELECT count(DISTINCT source) FROM refs) AS sources_total FROM records GROUP BY 1"""))
def a28(spark, sf):
    return R.validation_summary(records(spark, sf), "group_id", "block", "class3", TOKENS(), 5)


@query("a29_missingness_manifest", with_views("records", f"""
SELECT feature, round(m, 6) AS missing_fraction, feature IN ('f_tax') AS excluded, m <= 0.5 AND feature NOT IN ('f_tax') AS used FROM ({MISS_ROWS})"""))
def a29(spark, sf):
    kept = C.screen(records(spark, sf), FEATURES, [], ["f_tax"], 0.5)
    return kept.select("feature", r6("missing_fraction").alias("missing_fraction"), F.col("feature").isin("f_tax").alias("excluded"), (F.col("decision") == "retained").alias("used"))
