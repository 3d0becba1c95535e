"""Sources and sinks (S)."""

from pyspark.sql import functions as F

from kinfold.operators import cohort
from kinfold.plans.fixtures import CLASSES, records, table, with_views
from kinfold.plans.registry import query
from kinfold.session import scratch_path
from kinfold.sources import inventory as inv, tables


@query("s1_record_scan", """
SELECT o_orderkey AS record_id, o_custkey AS group_id, o_orderstatus AS class3, o_totalprice AS f_total,
 c_name AS group_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def s1(spark, sf):
    rows = tables.read_table(spark, f"{sf}/orders.parquet",
                             ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    groups = tables.read_table(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name"])
    return rows.join(groups, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"),
        F.col("o_orderstatus").alias("class3"), F.col("o_totalprice").alias("f_total"),
        F.col("c_name").alias("group_name"))


@query("s2_typed_record_load", with_views("records", """
WITH m AS (SELECT group_id, count(*) AS n, count(*) FILTER (class3 = 'F') AS nf, count(*) FILTER (class3 = 'O') AS no_,
  count(*) FILTER (class3 = 'P') AS np FROM records GROUP BY 1),
 g AS (SELECT group_id, n, greatest(nf, no_, np) AS top, CASE WHEN nf >= no_ AND nf >= np THEN 'F' WHEN no_ >= np THEN 'O' ELSE 'P' END AS maj FROM m),
 gone AS (SELECT group_id FROM g WHERE (n - top) * 1.0 / n >= 0.6 OR n < 5)
SELECT r.record_id, r.group_id, r.class3, CASE WHEN f_total >= 0 THEN f_total END AS f_total, f_qty,
  CASE WHEN f_qty <> 0 THEN greatest(least(f_price / f_qty, 1e6), 1e-6) END AS unit_price, c.c_name AS group_name
FROM records r JOIN g USING (group_id) JOIN customer c ON c.c_custkey = r.group_id
WHERE r.class3 IN ('F', 'O') AND r.group_id NOT IN (SELECT group_id FROM gone)
 AND ((n - top) = 0 OR (n - top) * 1.0 / n >= 0.6 OR r.class3 = maj)"""))
def s2(spark, sf):
    base = records(spark, sf)
    matrix = cohort.class_matrix(base, "group_id", "class3", CLASSES)
    excluded = cohort.mixed_or_small_groups(matrix, "group_id", CLASSES, 0.6, 5)
    majority = cohort.majority_class(matrix, "group_id", CLASSES, 0.6)
    groups = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("group_id"), F.col("c_name").alias("group_name"))
    from kinfold.functions.scalars import ratio
    loaded = tables.typed_records(
        base, groups, "group_id", "class3", ["F", "O"], ["f_total", "f_qty", "f_price"], excluded,
        majority, {"unit_price": ratio({"f_price": 1.0}, {"f_qty": 1.0})})
    return loaded.select("record_id", "group_id", "class3", "f_total", "f_qty",
                         "unit_price", "group_name")


@query("s3_frozen_cohort", with_views("records", """
SELECT record_id, f_total, f_qty FROM records WHERE group_id % 25 <> 0"""))
def s3(spark, sf):
    path = scratch_path(spark, "cohort")
    base = records(spark, sf)
    base.where(F.col("group_id") % 25 != 0).select("record_id", "f_total", "f_qty", "f_tax").write.parquet(path)
    names = scratch_path(spark, "features")
    table(spark, sf, "region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "f_total").otherwise("f_qty").alias("value")).write.text(names)
    # the feature list is configuration: a handful of names
    wanted = sorted(r.feature for r in tables.read_feature_list(spark, names).collect())
    cohort_rows = spark.read.parquet(path)
    tables.require_columns(cohort_rows, wanted, "frozen cohort")
    return cohort_rows.select("record_id", *wanted)


@query("s4_csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s4(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_table(table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path, "csv")
    back = tables.read_table(spark, path, fmt="csv",
                             schema="c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")
    return tables.require_columns(back, ["c_custkey", "c_name", "c_acctbal"], "canonical table")


@query("s5_json_contract", """
SELECT o_orderstatus AS name, count(*) AS records, min(o_totalprice) AS low FROM orders GROUP BY 1""")
def s5(spark, sf):
    path = scratch_path(spark, "json")
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(
        F.count("*").alias("records"), F.min("o_totalprice").alias("low"))
    tables.write_payload(rows.select("name", F.struct("records", "low").alias("body")), path)
    back = spark.read.schema("name string, body struct<records: bigint, low: double>").json(path)
    return back.select("name", "body.records", "body.low")


@query("s6_table_sink", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def s6(spark, sf):
    path = scratch_path(spark, "table")
    tables.write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"),
                       path, partition_by=["o_orderstatus"])
    return spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)


@query("s7_payload_sink", """
SELECT 'orders' AS name, count(*) AS records, count(DISTINCT o_custkey) AS groups_ FROM orders""")
def s7(spark, sf):
    path = scratch_path(spark, "payload")
    one = table(spark, sf, "orders").agg(
        F.count("*").alias("records"), F.countDistinct("o_custkey").alias("groups_"))
    tables.write_payload(one.select(F.lit("orders").alias("name"), F.struct("*").alias("counts")), path)
    back = spark.read.schema("name string, counts struct<records: bigint, groups_: bigint>").json(path)
    return back.select("name", "counts.*")


@query("s8_append_last_wins", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state,
 CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS objective FROM orders""")
def s8(spark, sf):
    old = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("old").alias("state"), F.col("o_totalprice").alias("objective"))
    new = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(
        "o_orderkey", F.lit("new").alias("state"), (F.col("o_totalprice") * 2).alias("objective"))
    return tables.last_write_wins(old, new, ["o_orderkey"])


@query("s9_file_inventory")
def s9(spark, sf):
    return inv.inventory(spark, sf)


def _expected_files(spark, sf):
    listed = table(spark, sf, "orders").select(
        F.concat(F.lit("part-"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 50 == 0, ".tmp").otherwise(".csv")).alias("path"),
        F.round(F.col("o_totalprice")).cast("bigint").alias("bytes"), F.sha2(F.col("o_orderpriority"), 256).alias("sha256"),
        "o_orderkey")
    expected = listed.where("o_orderkey % 7 <> 0").drop("o_orderkey")
    actual = listed.where("o_orderkey % 11 <> 0").withColumn(
        "sha256", F.when(F.col("o_orderkey") % 13 == 0, F.lit("changed")).otherwise(F.col("sha256"))).drop("o_orderkey")
    return expected, actual


@query("s10_verify_inventory", """
SELECT 'part-' || o_orderkey || CASE WHEN o_orderkey % 50 = 0 THEN '.tmp' ELSE '.csv' END AS path,
 CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 50 = 0 THEN 'forbidden_suffix'
  WHEN CAST(round(o_totalprice) AS BIGINT) > 300000 THEN 'too_large' WHEN o_orderkey % 7 = 0 THEN 'unlisted'
  WHEN o_orderkey % 13 = 0 THEN 'mismatch' ELSE 'ok' END AS status
FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 11 <> 0""")
def s10(spark, sf):
    expected, actual = _expected_files(spark, sf)
    return inv.verify_inventory(expected, actual, [".tmp", ".pkl"], 300_000)


@query("s11_stage_marker", """
SELECT 'stage-' || (o_custkey % 40) AS stage, count(*) AS outputs,
 count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS valid_outputs,
 count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) = count(*) AS complete
FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1""")
def s11(spark, sf):
    expected, actual = _expected_files(spark, sf)
    stages = table(spark, sf, "orders").select(
        F.concat(F.lit("part-"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 50 == 0, ".tmp").otherwise(".csv")).alias("path"),
        F.concat(F.lit("stage-"), F.col("o_custkey") % 40).alias("stage"))
    return inv.stage_status(expected.join(stages, "path"), actual)
