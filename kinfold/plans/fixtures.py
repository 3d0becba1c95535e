"""Views over the given tables in the shapes the operators work on, in Spark and in SQL.

``records``     one row per order: group = customer, features from its line items
``oof``         model x repeat x record scores of the stable groups
``class_oof``   the same with one score per class
``attr``        repeat x class x feature x record attributions
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.functions.draws import draw_int

FEATURES = ["f_total", "f_bal", "f_qty", "f_price", "f_disc", "f_tax"]
CLASSES = ["F", "O", "P"]
TASK_RECORDS = 150_000
MODELS = ["gbt", "mlp", "rf", "svm"]
SHIFT = {"gbt": 0.30, "mlp": 0.21, "rf": 0.24, "svm": 0.18}
FEATURE_SCALE = {"f_total": 100000.0, "f_bal": 5000.0, "f_qty": 100.0, "f_price": 100000.0,
                 "f_disc": 0.2, "f_tax": 0.2}
CLASS_WEIGHT = {
    "F": [0.9, -0.5, 0.3, 0.7, -0.2, 0.1],
    "O": [-0.4, 0.8, 0.6, -0.3, 0.2, -0.1],
    "P": [-0.5, -0.3, -0.9, 0.4, 0.1, 0.2],
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_quantity"), 2).alias("f_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("f_price"),
        F.round(F.sum("l_discount"), 2).alias("f_disc"),
        F.round(F.sum("l_tax"), 2).alias("f_tax"),
    )
    joined = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    token = lambda key: F.concat(F.lit("REF"), F.lpad(key.cast("string"), 9, "0"))
    return joined.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("group_id"),
        (F.col("o_custkey") - F.col("o_custkey") % 4).alias("block"),
        F.concat(
            token(F.col("o_custkey")),
            F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit(";"), token(F.col("o_custkey") + 1)))
            .otherwise(F.lit("")),
        ).alias("source_ids"),
        F.col("o_orderstatus").alias("class3"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        .otherwise(2).alias("class_code"),
        F.when(F.col("o_custkey") % 25 == 0, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .otherwise(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).cast("int").alias("label"),
        F.col("c_nationkey").alias("domain"),
        F.col("o_totalprice").alias("f_total"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("f_bal"),
        "f_qty", "f_price", "f_disc", "f_tax",
    )


def stable(spark: SparkSession, sf: str) -> DataFrame:
    """Records of groups whose label is constant."""
    return records(spark, sf).where(F.col("group_id") % 25 != 0)


def _dealt(df: DataFrame, spark: SparkSession, sf: str, by: str) -> DataFrame:
    """Records dealt by one column before they are copied per model, class or feature: aggregates that have ``by``
    among their keys need no further exchange, and a task's rows do not grow with the table."""
    tasks = -(-table(spark, sf, "orders").count() // TASK_RECORDS)  # answered by the file's footers
    return df.repartition(max(spark.sparkContext.defaultParallelism, tasks), by)


def _per_model_repeat(df: DataFrame) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(SHIFT[m]).alias("shift"))
                       for m in MODELS])
    return (
        df.withColumn("m", F.explode(models))
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .select("*", "m.model", "m.shift").drop("m")
    )


def oof(spark: SparkSession, sf: str, by: str = "record_id") -> DataFrame:
    base = _dealt(stable(spark, sf).select("record_id", "group_id", "block", F.col("label").alias("target")), spark, sf, by)
    u = draw_int(F.col("model"), F.col("repeat"), F.col("record_id")) / F.lit(4294967296.0)
    return _per_model_repeat(base).select(
        "model", "repeat", "record_id", "group_id", "block", "target",
        (F.lit(0.7) * u + F.col("target") * F.col("shift")).alias("score"))


def class_oof(spark: SparkSession, sf: str, by: str = "record_id") -> DataFrame:
    base = _dealt(records(spark, sf).select("record_id", "group_id", "block", F.col("class_code").alias("true_code")), spark, sf, by)
    digest = F.md5(F.concat_ws(":", "model", "repeat", "record_id"))
    hexed = lambda i: F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint")
    raw = _per_model_repeat(base).withColumn("digest", digest)
    for i in range(3):
        raw = raw.withColumn(
            f"e{i}", hexed(i) / F.lit(4294967296.0)
            + F.when(F.col("true_code") == i, F.col("shift") * 2).otherwise(F.lit(0.0)) + F.lit(0.05))
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return raw.select(
        "model", "repeat", "record_id", "group_id", "block", "true_code",
        *[(F.col(f"e{i}") / total).alias(f"s{i}") for i in range(3)])


def attr(spark: SparkSession, sf: str, by: str = "record_id") -> DataFrame:
    base = _dealt(records(spark, sf), spark, sf, by)
    cells = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit(i).alias("f_pos"), F.col(f).alias("observed"),
            F.lit(FEATURE_SCALE[f]).alias("scale"),
            *[F.lit(CLASS_WEIGHT[c][i]).alias(f"w_{c}") for c in CLASSES],
        ) for i, f in enumerate(FEATURES)])
    long = base.select("record_id", "group_id", "block", "label", "class3",
                       F.explode(cells).alias("c"))
    long = long.select("record_id", "group_id", "block", "label", "class3", "c.*")
    classes = F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"w_{c}").alias("w")) for c in CLASSES]))
    long = long.select("*", classes.alias("k")).select(
        "record_id", "group_id", "block", "label", "class3", "feature", "f_pos", "observed", "scale",
        "k.class", "k.w",
        F.explode(F.sequence(F.lit(1), F.lit(2))).alias("repeat"))
    u = draw_int(F.col("repeat"), F.col("class"), F.col("feature"), F.col("record_id")) / F.lit(4294967296.0)
    completed = F.coalesce(F.col("observed"), F.col("scale") / 2)
    return long.select(
        "repeat", (F.pmod(F.col("group_id") + F.col("repeat"), F.lit(3)) + 1).cast("int").alias("fold"),
        "class", "feature", "record_id", "group_id", "block", "label", "class3",
        "observed", completed.alias("completed"), F.col("observed").isNull().cast("int").alias("imputed"),
        (F.col("w") * (completed / F.col("scale") - F.lit(0.8)) + F.lit(0.4) * (u - F.lit(0.5))).alias("shap"))


# --- the same views in SQL -------------------------------------------------------------------

def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else f"{v!r}::DOUBLE" for v in r) + ")"
                     for r in rows)


U = "CAST('0x' || substr(md5({0}), {1}, 8) AS BIGINT) / 4294967296::DOUBLE"

CTES = {
    "records": """
 SELECT o.o_orderkey AS record_id, o.o_custkey AS group_id, o.o_custkey - o.o_custkey % 4 AS block,
  'REF' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0') ||
   CASE WHEN o.o_orderkey % 97 = 0 THEN ';REF' || lpad(CAST(o.o_custkey + 1 AS VARCHAR), 9, '0') ELSE '' END AS source_ids,
  o.o_orderstatus AS class3,
  CAST(CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS class_code,
  CAST(CASE WHEN o.o_custkey % 25 = 0 THEN o.o_orderpriority IN ('1-URGENT', '2-HIGH')
       ELSE c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') END AS INTEGER) AS label,
  c.c_nationkey AS domain, o.o_totalprice AS f_total,
  CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS f_bal,
  l.f_qty, l.f_price, l.f_disc, l.f_tax
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
 LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS f_qty, round(sum(l_extendedprice), 2) AS f_price,
   round(sum(l_discount), 2) AS f_disc, round(sum(l_tax), 2) AS f_tax FROM lineitem GROUP BY 1) l
  ON o.o_orderkey = l.l_orderkey""",
    "stable": "SELECT * FROM records WHERE group_id % 25 <> 0",
    "models": f"SELECT * FROM (VALUES {_values(SHIFT.items())}) t(model, shift)",
    "repeats": "SELECT CAST(range AS INTEGER) AS repeat FROM range(1, 4)",
    "oof": f"""
 SELECT model, repeat, record_id, group_id, block, label AS target,
  0.7::DOUBLE * ({U.format("concat_ws(':', model, repeat, record_id)", 1)}) + label * shift AS score
 FROM stable, models, repeats""",
    "class_oof": f"""
 SELECT model, repeat, record_id, group_id, block, true_code, e0 / (e0 + e1 + e2) AS s0,
  e1 / (e0 + e1 + e2) AS s1, e2 / (e0 + e1 + e2) AS s2 FROM (
  SELECT model, repeat, record_id, group_id, block, class_code AS true_code,
   {", ".join(f"{U.format('k', 1 + 8 * i)} + CASE WHEN class_code = {i} THEN shift * 2 ELSE 0 END + 0.05::DOUBLE AS e{i}" for i in range(3))}
  FROM (SELECT *, concat_ws(':', model, repeat, record_id) AS k FROM records, models, repeats))""",
    "weights": "SELECT * FROM (VALUES " + _values(
        (c, f, FEATURE_SCALE[f], CLASS_WEIGHT[c][i]) for c in CLASSES for i, f in enumerate(FEATURES)
    ) + ") t(class, feature, scale, w)",
    "cells": " UNION ALL ".join(
        f"SELECT record_id, group_id, block, label, class3, '{f}' AS feature, {f} AS observed FROM records"
        for f in FEATURES),
    "attr": f"""
 SELECT repeat, CAST((group_id + repeat) % 3 + 1 AS INTEGER) AS fold, class, feature, record_id, group_id,
  block, label, class3, observed, completed, CAST(observed IS NULL AS INTEGER) AS imputed,
  w * (completed / scale - 0.8::DOUBLE) + 0.4::DOUBLE *
   ({U.format("concat_ws(':', repeat, class, feature, record_id)", 1)} - 0.5::DOUBLE) AS shap
 FROM (SELECT c.*, w.class, w.scale, w.w, repeat, coalesce(observed, scale / 2) AS completed
   FROM cells c JOIN weights w USING (feature), (SELECT * FROM repeats WHERE repeat <= 2))""",
    "group_oof": """
 SELECT model, repeat, group_id, min(block) AS block, min(target) AS target, median(score) AS score
 FROM oof GROUP BY 1, 2, 3""",
    "consensus": """
 SELECT model, group_id, min(block) AS block, min(target) AS target, median(score) AS score
 FROM group_oof GROUP BY 1, 2""",
    "strata": """
 SELECT model, repeat, group_id, min(block) AS block, true_code, median(s0) AS s0, median(s1) AS s1,
  median(s2) AS s2, count(*) AS n_records FROM class_oof GROUP BY model, repeat, group_id, true_code""",
    "strata_pred": """
 SELECT *, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INTEGER) AS predicted
 FROM strata""",
}

NEEDS = {
    "stable": ["records"], "oof": ["stable", "models", "repeats"],
    "class_oof": ["records", "models", "repeats"], "cells": ["records"],
    "attr": ["cells", "weights", "repeats"], "group_oof": ["oof"], "consensus": ["group_oof"],
    "strata": ["class_oof"], "strata_pred": ["strata"],
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named views (and what they need) in front; ``body`` may add its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return f"{head}{views},\n{body[5:]}"
    return f"{head}{views}\n{body}"
