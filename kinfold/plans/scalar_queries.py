"""Scalar functions (F) and projections / predicates on columns (part of P)."""

from pyspark.sql import functions as F

from kinfold.functions import scalars as S
from kinfold.operators import contracts, vectors
from kinfold.plans.fixtures import FEATURES, attr, class_oof, oof, records, table, with_views
from kinfold.plans.registry import query

r6 = lambda c: F.round(c, 6)


@query("f1_split_ids", with_views("records", """
SELECT record_id, array_to_string(list_sort(list_distinct(list_filter(
 string_split_regex(replace(source_ids, ';', ' | ') || ';nan;' , '[;,|/\\s]+'), lambda x: lower(x) NOT IN ('', 'nan', 'none')))), ',') AS ids,
 len(list_distinct(list_filter(string_split_regex(replace(source_ids, ';', ' | ') || ';nan;', '[;,|/\\s]+'), lambda x: lower(x) NOT IN ('', 'nan', 'none')))) AS n_ids
FROM records"""))
def f1(spark, sf):
    raw = F.concat(F.replace("source_ids", F.lit(";"), F.lit(" | ")), F.lit(";nan;"))
    ids = S.split_ids(raw)
    return records(spark, sf).select(
        "record_id", F.array_join(ids, ",").alias("ids"), F.size(ids).cast("bigint").alias("n_ids"))


@query("f2_token_ids", with_views("records", """
SELECT record_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper('see ' || lower(source_ids) || '+x'), 'REF\\d{4,}'))), ',') AS ids
FROM records"""))
def f2(spark, sf):
    text = F.concat(F.lit("see "), F.lower("source_ids"), F.lit("+x"))
    return records(spark, sf).select("record_id", F.array_join(S.token_ids(text), ",").alias("ids"))


@query("f3_clean_text", """
SELECT doc_id, sha256(trim(regexp_replace(replace(replace('– ' || text || '  —', '–', '-'), '—', '-'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')) AS cleaned_hash
FROM documents""")
def f3(spark, sf):
    text = F.concat(F.lit("– "), F.col("text"), F.lit("  —"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.clean_text(text), 256).alias("cleaned_hash"))


@query("f4_feature_name", """
SELECT p_partkey, translate(p_brand, '0123456789', '0123456789') || '2O' || p_size AS feature FROM part""")
def f4(spark, sf):
    header = F.concat(F.col("p_brand"), F.lit("₂O"), F.col("p_size"),
                      F.when(F.col("p_size") % 2 == 0, " (wt.%)").otherwise(" (ppm)"))
    return table(spark, sf, "part").select("p_partkey", S.feature_name(header).alias("feature"))


@query("f5_ratio_features", with_views("records", """
SELECT record_id,
 CASE WHEN f_qty * 0.5::DOUBLE + f_disc * 2.0::DOUBLE <> 0 THEN round(greatest(least((f_price * 0.01::DOUBLE) / (f_qty * 0.5::DOUBLE + f_disc * 2.0::DOUBLE), 1e6), 1e-6), 6) END AS weighted_ratio,
 CASE WHEN (f_price / 0.153::DOUBLE) * (f_total / 0.2055::DOUBLE) > 0 THEN round(greatest(least((f_qty / 0.058::DOUBLE) / sqrt((f_price / 0.153::DOUBLE) * (f_total / 0.2055::DOUBLE)), 1e6), 1e-6), 6) END AS geometric_ratio,
 CASE WHEN f_bal <> 0 THEN round(greatest(least(f_total / f_bal, 1e6), 1e-6), 6) END AS plain_ratio
FROM records"""))
def f5(spark, sf):
    return records(spark, sf).select(
        "record_id",
        r6(S.ratio({"f_price": 0.01}, {"f_qty": 0.5, "f_disc": 2.0})).alias("weighted_ratio"),
        r6(S.ratio_to_geometric_mean(("f_qty", 0.058), ("f_price", 0.153), ("f_total", 0.2055))).alias("geometric_ratio"),
        r6(S.ratio({"f_total": 1.0}, {"f_bal": 1.0})).alias("plain_ratio"))


@query("f6_unit_transform", with_views("records", """
SELECT record_id, f_disc AS as_fraction, round(log10(f_price + 1), 6) AS as_trace FROM records"""))
def f6(spark, sf):
    return records(spark, sf).select(
        "record_id", S.unit_transform("f_disc", F.lit(True)).alias("as_fraction"),
        r6(S.unit_transform("f_price", F.lit(False))).alias("as_trace"))


@query("f7_scale_roundtrip", with_views("records", """
SELECT record_id, round((ln(1 + f_price) - 9.5::DOUBLE) / 1.25::DOUBLE, 6) AS z,
 round(greatest(exp((ln(1 + f_qty) - 3.0::DOUBLE) / 1.5::DOUBLE * 1.5::DOUBLE + 3.0::DOUBLE) - 1, 0), 4) AS back,
 round(greatest(exp(-ln(1 + f_qty)) - 1, 0), 4) AS clipped FROM records"""))
def f7(spark, sf):
    z = S.to_scale("f_qty", F.lit(3.0), F.lit(1.5))
    return records(spark, sf).select(
        "record_id", r6(S.to_scale("f_price", F.lit(9.5), F.lit(1.25))).alias("z"),
        F.round(S.from_scale(z, F.lit(3.0), F.lit(1.5)), 4).alias("back"),
        F.round(S.from_scale(-F.log1p("f_qty"), F.lit(0.0), F.lit(1.0)), 4).alias("clipped"))


@query("f8_squash", with_views("oof", """
SELECT model, repeat, record_id, round(1 / (1 + exp(-(score * 8 - 4))), 6) AS p FROM oof WHERE model = 'svm'"""))
def f8(spark, sf):
    return oof(spark, sf).where("model = 'svm'").select(
        "model", "repeat", "record_id", r6(S.squash(F.col("score") * 8 - 4)).alias("p"))


@query("f9_softmax", with_views("class_oof", """
WITH e AS (SELECT repeat, record_id, exp(s0 * 5 - greatest(s0, s1, s2) * 5) AS e0, exp(s1 * 5 - greatest(s0, s1, s2) * 5) AS e1,
  exp(s2 * 5 - greatest(s0, s1, s2) * 5) AS e2 FROM class_oof WHERE model = 'svm')
SELECT repeat, record_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2 FROM e"""))
def f9(spark, sf):
    soft = class_oof(spark, sf).where("model = 'svm'").select(
        "repeat", "record_id", S.softmax(F.array(*[F.col(f"s{i}") * 5 for i in range(3)])).alias("p"))
    return soft.select("repeat", "record_id", *[r6(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


@query("f10_temperature", with_views("class_oof", """
WITH e AS (SELECT repeat, record_id, power(greatest(s0, 1e-12), 1 / 1.7::DOUBLE) AS e0, power(greatest(s1, 1e-12), 1 / 1.7::DOUBLE) AS e1,
 power(greatest(s2, 1e-12), 1 / 1.7::DOUBLE) AS e2 FROM class_oof WHERE model = 'rf')
SELECT repeat, record_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2 FROM e"""))
def f10(spark, sf):
    soft = class_oof(spark, sf).where("model = 'rf'").select(
        "repeat", "record_id", S.temper(F.array("s0", "s1", "s2"), F.lit(1.7)).alias("p"))
    return soft.select("repeat", "record_id", *[r6(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


@query("f11_argmax", with_views("class_oof", """
SELECT model, repeat, record_id, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS predicted
FROM class_oof"""))
def f11(spark, sf):
    return class_oof(spark, sf).select(
        "model", "repeat", "record_id", S.first_max(["s0", "s1", "s2"]).alias("predicted"))


@query("f12_signed_share", with_views("attr", """
SELECT record_id, feature, round(shap / nullif(sum(abs(shap)) OVER (PARTITION BY record_id), 0), 6) AS signed_share
FROM attr WHERE repeat = 1 AND class = 'P'"""))
def f12(spark, sf):
    one = attr(spark, sf).where("repeat = 1 and class = 'P'").select("record_id", "feature", "shap")
    return vectors.signed_share(one, ["record_id"], "shap", "signed_share").select(
        "record_id", "feature", r6("signed_share").alias("signed_share"))


@query("f13_row_cosine", with_views("attr", """
SELECT record_id, round(sum(a.shap * b.shap) / (sqrt(sum(a.shap * a.shap)) * sqrt(sum(b.shap * b.shap))), 6) AS cosine
FROM attr a JOIN attr b USING (record_id, feature, repeat) WHERE repeat = 1 AND a.class = 'F' AND b.class = 'P' GROUP BY 1"""))
def f13(spark, sf):
    one = attr(spark, sf).where("repeat = 1")
    pair = one.groupBy("record_id", "feature").agg(
        F.max(F.when(F.col("class") == "F", F.col("shap"))).alias("a"),
        F.max(F.when(F.col("class") == "P", F.col("shap"))).alias("b"))
    return vectors.cosine(pair, ["record_id"], "a", "b").select("record_id", r6("cosine").alias("cosine"))


def trial_params(spark, sf):
    """Parameter maps derived from the parts table."""
    part = table(spark, sf, "part")
    model = F.element_at(F.array(*[F.lit(m) for m in ("gbt", "mlp", "rf", "svm")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(
        "p_partkey", model.alias("model"),
        F.to_json(F.create_map(
            F.lit("n_estimators"), (F.col("p_size") * 10).cast("double"), F.lit("max_depth"), (F.col("p_size") % 7 + 2).cast("double"),
            F.lit("min_leaf"), (F.col("p_size") % 4).cast("double"), F.lit("gamma"), (F.col("p_size") / 1000).cast("double"), F.lit("C"), (F.col("p_retailprice") / 100).cast("double"),
            F.lit("hidden_1"), (F.col("p_size") + 8).cast("double"))).alias("params_json"))


@query("f14_complexity", """
SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 10 * power(2.0::DOUBLE, p_size % 7 + 2) WHEN 1 THEN (p_size + 8)::DOUBLE
 WHEN 2 THEN p_size * 10 * (p_size % 7 + 2) / greatest(p_size % 4, 1)::DOUBLE
 ELSE log10(p_retailprice / 100) + log10(p_size / 1000::DOUBLE * 1e5 + 1) END, 6) AS complexity FROM part""")
def f14(spark, sf):
    rows = trial_params(spark, sf).withColumn("params", F.from_json("params_json", "map<string,double>"))
    return rows.select("p_partkey", r6(S.complexity("model", F.col("params"))).alias("complexity"))


@query("f15_payload_hash", """
WITH h AS (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS d FROM orders)
SELECT 'orders' AS part, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), """ + ", ".join(
    f"CAST(sum(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + """)) AS payload_hash, count(*) AS rows FROM h""")
def f15(spark, sf):
    return contracts.payload_hash(table(spark, sf, "orders"), "orders", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"))


@query("f16_params_json", """
SELECT event_id, CAST(props ->> '$.k' AS DOUBLE) AS k, '{"k":' || CAST(CAST(props ->> '$.k' AS BIGINT) AS VARCHAR) || ',"v":' || CAST(event_id AS VARCHAR) || '}' AS out_json FROM events""")
def f16(spark, sf):
    parsed = table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,double>"))
    return parsed.select(
        "event_id", F.col("m")["k"].alias("k"),
        F.to_json(F.struct(F.col("m")["k"].cast("bigint").alias("k"), F.col("event_id").alias("v"))).alias("out_json"))


@query("f17_join_flags", with_views("records", """
SELECT record_id, concat_ws('; ', CASE WHEN f_qty IS NULL THEN 'no_items' END, CASE WHEN f_bal IS NULL THEN 'no_balance' END,
 CASE WHEN f_total < 50000 THEN 'small' END) AS flags,
 concat_ws('; ', CASE WHEN NOT coalesce(f_total >= 50000, false) THEN 'size' END, CASE WHEN NOT coalesce(f_bal >= 1000, false) THEN 'balance' END) AS failed FROM records"""))
def f17(spark, sf):
    return records(spark, sf).select(
        "record_id",
        S.passed_names({"no_items": F.col("f_qty").isNull(), "no_balance": F.col("f_bal").isNull(),
                        "small": F.col("f_total") < 50000}, passed=True).alias("flags"),
        S.passed_names({"size": F.col("f_total") >= 50000, "balance": F.col("f_bal") >= 1000}).alias("failed"))


@query("f18_feature_category", """
SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 'first' WHEN contains(p_type, 'STANDARD') THEN 'second' ELSE 'other' END AS category FROM part""")
def f18(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.category("p_type", {"first": ["ECONOMY"], "second": ["STANDARD"]}, "other").alias("category"))


@query("f19_sign_agreement", with_views("attr", """
SELECT record_id, feature, sign(a) = sign(b) AND sign(a) <> 0 AS agree
FROM (SELECT record_id, feature, max(shap) FILTER (repeat = 1) AS a, max(shap) FILTER (repeat = 2) AS b FROM attr WHERE class = 'F' GROUP BY 1, 2)"""))
def f19(spark, sf):
    one = attr(spark, sf).where("class = 'F'").groupBy("record_id", "feature").agg(
        F.max(F.when(F.col("repeat") == 1, F.col("shap"))).alias("a"),
        F.max(F.when(F.col("repeat") == 2, F.col("shap"))).alias("b"))
    return one.select("record_id", "feature", S.same_sign("a", "b").alias("agree"))


# --- projections and predicates ---------------------------------------------------------------

@query("p1_known_classes", """
SELECT o_orderkey, o_orderstatus AS class3 FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def p1(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")).alias("c"))
    return raw.select("o_orderkey", F.upper(F.trim("c")).alias("class3")).where(F.col("class3").isin("F", "O"))


@query("p9_boolean_text", """
SELECT o_orderkey, o_orderkey % 5 < 3 AS flag FROM orders""")
def p9(spark, sf):
    texts = F.array(*[F.lit(t) for t in (" TRUE", "1", "Yes ", "no", "0.5")])
    return table(spark, sf, "orders").select(
        "o_orderkey", S.is_yes(F.element_at(texts, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("flag"))


@query("p10_numeric_frame", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders""")
def p10(spark, sf):
    bad = F.element_at(F.array(F.lit("n/a"), F.lit("inf"), F.lit("NaN")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, bad).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_custkey").cast("string").alias("cust"))
    return text.withColumns({c: S.number(c) for c in ("price", "cust", "absent") if c in text.columns})


@query("p11_first_value", with_views("records", """
SELECT record_id, coalesce(f_bal, f_price, f_total) AS common, abs(f_bal - f_price) AS abs_diff FROM records"""))
def p11(spark, sf):
    return records(spark, sf).select(
        "record_id", F.coalesce("f_bal", "f_price", "f_total").alias("common"),
        F.abs(F.col("f_bal") - F.col("f_price")).alias("abs_diff"))


@query("p12_prefix_state_filter", """
SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand LIKE 'Brand#1%' AND p_type IN ('ECONOMY', 'STANDARD')""")
def p12(spark, sf):
    return table(spark, sf, "part").where(
        F.col("p_brand").startswith("Brand#1") & F.col("p_type").isin("ECONOMY", "STANDARD")
    ).select("p_partkey", "p_brand", "p_type")


@query("p13_prune_rename_mask", with_views("records", """
SELECT record_id, f_total AS task_a_total, f_qty AS task_a_qty FROM records"""))
def p13(spark, sf):
    return records(spark, sf).select("record_id", "label", "f_total", "f_qty").withColumnsRenamed(
        {"f_total": "task_a_total", "f_qty": "task_a_qty"}).drop("label")


@query("p14_domain_tag", """
SELECT c_custkey, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'primary' WHEN r_name = 'AFRICA' THEN 'out_of_domain' ELSE 'unclassified' END AS domain
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def p14(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.when(F.col("r_name").isin("ASIA", "EUROPE"), "primary").when(F.col("r_name") == "AFRICA", "out_of_domain")
        .otherwise("unclassified").alias("domain"))
