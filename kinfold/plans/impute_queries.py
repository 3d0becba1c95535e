"""Fold-local preparation (I1-I3), masked recovery (M20) and the quality panel.

Rows are the given embedding vectors: all components plus 1 are the features, a tenth of the cells is
hidden by hash.
"""

from pyspark.sql import functions as F

from kinfold.functions.draws import draw_uniform
from kinfold.operators import cohort as C, gates as G, impute as I
from kinfold.plans.fixtures import table
from kinfold.plans.metric_queries import rounded
from kinfold.plans.registry import query
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)
P = 64  # components of the given vectors
DIMS = [f"x{i}" for i in range(P)]
FOLDS = 3


def vectors(spark, sf, p=P):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id"), (F.col("label") % 2).alias("label"), (F.col("vec_id") % FOLDS).cast("int").alias("own_fold"),
        *[(F.col("embedding")[i].cast("double") + 1.0).alias(f"x{i}") for i in range(p)])


def masked(spark, sf, p=P):
    base = vectors(spark, sf, p)
    return base.select("vec_id", "label", "own_fold", *[
        F.when(draw_uniform(f"hide{i}", F.col("vec_id")) >= 0.1, F.col(f"x{i}")).alias(f"x{i}") for i in range(p)])


V = "v AS (SELECT vec_id, label % 2 AS label, CAST(vec_id % 3 AS INTEGER) AS own_fold, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) + 1.0::DOUBLE AS x{i}" for i in range(P)) + " FROM embeddings)"
MASK = V + ", m AS (SELECT vec_id, label, own_fold, " + ", ".join(
    f"CASE WHEN CAST('0x' || substr(md5('hide{i}:' || vec_id), 1, 8) AS BIGINT) / 4294967296::DOUBLE >= 0.1 THEN x{i} END AS x{i}" for i in range(P)) + " FROM v)"
LONG = "c AS (" + " UNION ALL ".join(f"SELECT vec_id, label, own_fold, 'x{i}' AS feature, x{i} AS value FROM m" for i in range(P)) + ")"
TRAIN = "tr AS (SELECT f.fold, c.* FROM c, (SELECT CAST(range AS INTEGER) AS fold FROM range(3)) f WHERE own_fold <> fold AND value IS NOT NULL)"
STATS = "st AS (SELECT fold, feature, median(ln(1 + value)) AS center, CASE WHEN quantile_cont(ln(1 + value), 0.75) - quantile_cont(ln(1 + value), 0.25) > 0 THEN quantile_cont(ln(1 + value), 0.75) - quantile_cont(ln(1 + value), 0.25) ELSE 1 END AS scale FROM tr GROUP BY 1, 2)"


@query("i1_fold_scaler_robust", f"WITH {MASK}, {LONG}, {TRAIN}, {STATS} SELECT fold, feature, round(center, 6) AS center, round(scale, 6) AS scale FROM st")
def i1(spark, sf):
    cells = I.training_cells(masked(spark, sf), "vec_id", "own_fold", FOLDS, DIMS)
    return rounded(I.robust_stats(cells, ["fold", "feature"]), ["center", "scale"])


@query("i1_fold_scaler_standard", f"WITH {MASK}, {LONG}, {TRAIN} SELECT fold, feature, round(avg(ln(1 + value)), 6) AS center, round(stddev_pop(ln(1 + value)), 6) AS scale FROM tr GROUP BY 1, 2")
def i1b(spark, sf):
    cells = I.training_cells(masked(spark, sf), "vec_id", "own_fold", FOLDS, DIMS)
    return rounded(I.standard_stats(cells, ["fold", "feature"]), ["center", "scale"])


def knn_sql(k):
    """SQL of the completion from z(fold, vec_id, tr, z0, z1, ...): one distance per pair, then its missing cells."""
    gap = " + ".join(f"coalesce((r.z{i} - d.z{i}) * (r.z{i} - d.z{i}), 0)" for i in range(P))
    common = " + ".join(f"CAST(r.z{i} IS NOT NULL AND d.z{i} IS NOT NULL AS INTEGER)" for i in range(P))
    return f"""
 zc AS (SELECT fold, vec_id, CAST(substr(feature, 2) AS BIGINT) AS j, (ln(1 + value) - center) / scale AS value FROM c JOIN st USING (feature)),
 gaps AS (SELECT fold, vec_id, j, 'x' || j AS feature FROM zc WHERE value IS NULL),
 ds AS (SELECT r.fold, r.vec_id, d.vec_id AS donor, sqrt({P}.0::DOUBLE / nullif({common}, 0) * ({gap})) AS dist FROM z r JOIN z d ON r.fold = d.fold AND d.tr),
 tp AS (SELECT ds.fold, ds.vec_id, g.j, v.value AS dv, dist, row_number() OVER (PARTITION BY ds.fold, ds.vec_id, g.j ORDER BY dist, donor) AS rn
  FROM ds JOIN gaps g ON g.fold = ds.fold AND g.vec_id = ds.vec_id JOIN zc v ON v.fold = ds.fold AND v.vec_id = donor AND v.j = g.j WHERE v.value IS NOT NULL AND dist IS NOT NULL),
 kn AS (SELECT fold, vec_id, j, CASE WHEN count(*) FILTER (dist = 0) > 0 THEN avg(dv) FILTER (dist = 0) ELSE sum(dv / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS zz FROM tp WHERE rn <= {k} GROUP BY 1, 2, 3),
 mean AS (SELECT fold, feature, avg((ln(1 + value) - center) / scale) AS mz FROM tr JOIN st USING (fold, feature) GROUP BY 1, 2),
 done AS (SELECT g.fold, g.vec_id, g.feature, coalesce(zz, mz) AS zz, greatest(exp(coalesce(zz, mz) * scale + center) - 1, 0) AS value FROM gaps g LEFT JOIN kn USING (fold, vec_id, j) JOIN mean USING (fold, feature) JOIN st USING (fold, feature))"""


ZROWS = "z AS (SELECT fold, vec_id, own_fold <> fold AS tr, " + ", ".join(
    f"max((ln(1 + value) - center) / scale) FILTER (feature = 'x{i}') AS z{i}" for i in range(P)) + " FROM c, (SELECT CAST(range AS INTEGER) AS fold FROM range(3)) JOIN st USING (fold, feature) GROUP BY 1, 2, 3)"


@query("i2_knn_completion", f"WITH {MASK}, {LONG}, {TRAIN}, {STATS}, {ZROWS.replace('FROM c, (SELECT CAST(range AS INTEGER) AS fold FROM range(3)) JOIN st USING (fold, feature)', 'FROM c JOIN st USING (feature)')}, {knn_sql(7)} SELECT fold, vec_id, feature, round(value, 6) AS value FROM done")
def i2(spark, sf):
    return rounded(I.complete(masked(spark, sf), "vec_id", "own_fold", FOLDS, DIMS, 7), ["value"])


@query("i3_fold_screens", f"""WITH {MASK}, {LONG}, a AS (SELECT fold, feature, avg(CAST(value IS NULL AS INTEGER)) AS ms FROM c, (SELECT CAST(range AS INTEGER) AS fold FROM range(3)) f WHERE own_fold <> fold GROUP BY 1, 2)
SELECT fold, feature, round(ms, 6) AS missing_share FROM a WHERE ms <= 0.11 AND feature <> 'x5'""")
def i3(spark, sf):
    shares = I.fold_missingness(masked(spark, sf), "own_fold", FOLDS, DIMS)
    return rounded(I.fold_feature_screen(shares, 0.11, ["x5"]), ["missing_share"])


HIDE = """h AS (SELECT feature, vec_id FROM (SELECT feature, vec_id, row_number() OVER (PARTITION BY feature ORDER BY md5(concat_ws(':', '11:1', feature, vec_id)), vec_id) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM c0 WHERE value IS NOT NULL) WHERE r < least(n, greatest(5, round(n * 0.1))))"""
RECOVER = f"""{MASK}, {LONG.replace('c AS', 'c0 AS')}, {HIDE}, c AS (SELECT c0.vec_id, c0.label, -1 AS own_fold, feature, CASE WHEN h.vec_id IS NULL THEN value END AS value FROM c0 LEFT JOIN h USING (vec_id, feature)),
 {TRAIN.replace('range(3)', 'range(1)')}, {STATS}, {ZROWS.replace('FROM c, (SELECT CAST(range AS INTEGER) AS fold FROM range(3)) JOIN st USING (fold, feature)', 'FROM c JOIN st USING (feature)')}, {knn_sql(7)},
 rec AS (SELECT feature, count(*) AS masked, corr(c0.value, done.value) AS pearson_r, avg(abs(c0.value - done.value)) / greatest(quantile_cont(c0.value, 0.75) - quantile_cont(c0.value, 0.25), 1e-12) AS normalized_mae FROM h JOIN c0 USING (vec_id, feature) JOIN done USING (vec_id, feature) GROUP BY 1)"""


def recovery(spark, sf):
    return I.masked_recovery(masked(spark, sf), "vec_id", DIMS, 7, 0.1, 5, 1, 11)


@query("m20_masked_recovery", f"WITH {RECOVER} SELECT CAST(1 AS INTEGER) AS repeat, feature, masked, round(pearson_r, 6) AS pearson_r, round(normalized_mae, 6) AS normalized_mae FROM rec")
def m20(spark, sf):
    return rounded(recovery(spark, sf), ["pearson_r", "normalized_mae"])


@query("x10_quality_panel", f"""WITH {RECOVER}, ms AS (SELECT feature, avg(CAST(value IS NULL AS INTEGER)) AS missing_fraction, abs(avg(CAST(value IS NULL AS INTEGER)) FILTER (label = 1) - avg(CAST(value IS NULL AS INTEGER)) FILTER (label = 0)) AS label_gap FROM c0 GROUP BY 1)
SELECT feature, round(missing_fraction, 6) AS missing_fraction, round(label_gap, 6) AS label_gap, round(pearson_r, 6) AS pearson_r, missing_fraction <= 0.15 AS passes_missingness, label_gap <= 0.15 AS passes_label_gap, pearson_r >= 0.1 AS passes_recovery,
 missing_fraction <= 0.15 AND label_gap <= 0.15 AND pearson_r >= 0.1 AS retained FROM ms JOIN rec USING (feature)""")
def x10(spark, sf):
    missing = C.missingness(masked(spark, sf), DIMS, "label")
    got = G.quality_panel(missing, recovery(spark, sf), 0.15, 0.15, 0.1)
    return rounded(got, ["missing_fraction", "label_gap", "pearson_r"])
