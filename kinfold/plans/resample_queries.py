"""Resampling inference (B)."""

from pyspark.sql import functions as F

from kinfold.operators import joins as J, metrics as M, ordered as O, resample as B, rollup as R, statistics as T, vectors as V
from kinfold.plans.fixtures import CLASSES, FEATURES, MODELS, attr, records, with_views
from kinfold.plans.metric_queries import group_scores, rounded, strata
from kinfold.plans.registry import query
from kinfold.session import cut

r6 = lambda c: F.round(c, 6)
REPS = 50
CI = ["ci_low", "ci_high", "replicate_median", "replicate_mean"]
CI_SQL = """round(quantile_cont({0}, 0.025), 6) AS ci_low, round(quantile_cont({0}, 0.975), 6) AS ci_high, round(median({0}), 6) AS replicate_median, round(avg({0}), 6) AS replicate_mean, count({0}) AS replicates_valid"""


def draws(unit, source, reps=REPS, seed=7, name="draws"):
    return f"""{name}_u AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {unit} FROM {source} WHERE {unit} IS NOT NULL)),
{name} AS (SELECT rep, u.{unit}, w FROM (SELECT rep, CAST('0x' || substr(md5(concat_ws(':', '{seed}', rep, pos)), 1, 8) AS BIGINT) % n AS hit, count(*) AS w FROM {name}_u, (SELECT range AS rep FROM range(1, {reps + 1})) GROUP BY 1, 2) d JOIN {name}_u u ON u.pos = d.hit)"""


def shuffled(source, name, seed, reps):
    """Targets ``(rep, pos, target)`` of the rows of ``source`` (with ``pos``): the network of ``draws.shuffled_position``, a round a step."""
    h = lambda half: f"(((({half} + key) % 2147483647) * (({half} + key) % 2147483647)) % 2147483647 * 48271 + key) % 2147483647"
    return f"""{name}_d AS (SELECT n, CASE WHEN n <= 2 THEN 1 ELSE a END AS a, CASE WHEN n <= 2 THEN greatest(n, 1) ELSE m // a END AS b FROM (
  SELECT n, m, unnest(range(greatest(2, root // 4), root + 1)) AS a FROM (SELECT n, root, unnest(range(n, n + root + 1)) AS m FROM (
   SELECT count(*) AS n, greatest(2, CAST(floor(sqrt(count(*))) AS BIGINT)) AS root FROM {source}))) WHERE m % a = 0 ORDER BY m, a DESC LIMIT 1),
 {name}_k AS (SELECT rep, t, CAST('0x' || substr(md5(concat_ws(':', '{seed}', rep, t)), 1, 8) AS BIGINT) % 2147483647 AS key FROM (SELECT range AS rep FROM range(1, {reps + 1})), (SELECT range AS t FROM range(8))),
 {name}_w AS (SELECT rep, pos, pos // b AS l, pos % b AS r, 0 AS i FROM {source}, {name}_d, (SELECT range AS rep FROM range(1, {reps + 1}))
  UNION ALL SELECT w.rep, pos, CASE WHEN i % 2 = 0 THEN (l + {h('r')}) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + {h('l')}) % b ELSE r END, i + 1
  FROM {name}_w w JOIN {name}_k k ON k.rep = w.rep AND k.t = w.i % 8, {name}_d WHERE i % 8 <> 0 OR i = 0 OR l * b + r >= n),
 {name} AS (SELECT rep, pos, l * b + r AS target FROM {name}_w, {name}_d WHERE i > 0 AND i % 8 = 0 AND l * b + r < n)"""


def pair_auc(unit):
    return with_views("consensus", f"""WITH {draws(unit, 'consensus')},
 drawn AS (SELECT rep, {unit}, w FROM draws UNION ALL SELECT DISTINCT 0, {unit}, 1 FROM consensus WHERE {unit} IS NOT NULL),
 lev AS (SELECT rep, model, score, sum(w) FILTER (target = 1) AS p, sum(w) FILTER (target = 0) AS q FROM consensus JOIN drawn USING ({unit}) GROUP BY 1, 2, 3),
 cum AS (SELECT rep, model, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(sum(coalesce(q, 0)) OVER (PARTITION BY rep, model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM lev),
 auc AS (SELECT rep, model, sum(p * (qb + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0) AS auc FROM cum GROUP BY 1, 2),
 d AS (SELECT a.model AS left_model, b.model AS right_model, CASE WHEN a.rep > 0 THEN a.auc - b.auc END AS diff, CASE WHEN a.rep = 0 THEN a.auc - b.auc END AS seen FROM auc a JOIN auc b ON a.rep = b.rep AND a.model < b.model)
SELECT left_model, right_model, round(max(seen), 6) AS observed, {CI_SQL.format('diff')} FROM d GROUP BY 1, 2""")


def consensus(spark, sf):
    return R.consensus(group_scores(spark, sf), ["model"], "group_id", 3).select("model", "group_id", "block", "target", "score")


@query("b1_pairwise_auc_groups", pair_auc("group_id"))
def b1(spark, sf):
    return rounded(B.pairwise_auc(consensus(spark, sf), "group_id", MODELS, REPS, 7), ["observed", *CI])


@query("b1_pairwise_auc_blocks", pair_auc("block"))
def b1b(spark, sf):
    return rounded(B.pairwise_auc(consensus(spark, sf), "block", MODELS, REPS, 7), ["observed", *CI])


PER = """
per AS (SELECT {key}, c, sum(w) FILTER (true_code = c AND predicted = c) AS tp, sum(w) FILTER (true_code = c) AS s, sum(w) FILTER (predicted = c) AS d FROM x, (SELECT range AS c FROM range(3)) GROUP BY {key}, c),
pr AS (SELECT {key}, c, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s, coalesce(d, 0) AS d, coalesce(coalesce(tp, 0) * 1.0::DOUBLE / nullif(d, 0), 0) AS p, coalesce(coalesce(tp, 0) * 1.0::DOUBLE / nullif(s, 0), 0) AS r, coalesce(2.0::DOUBLE * coalesce(tp, 0) / nullif(coalesce(s, 0) + coalesce(d, 0), 0), 0) AS f FROM per),
mf AS (SELECT {key}, avg(f) FILTER (s + d > 0) AS macro_f1, avg(r) FILTER (s > 0) AS balanced_accuracy FROM pr GROUP BY {key})
"""


@query("b2_macro_f1_difference", with_views("strata_pred", f"""WITH src AS (SELECT * FROM strata_pred WHERE model IN ('gbt', 'svm')), {draws('block', 'src')}, x AS (SELECT rep, model, true_code, predicted, w FROM src JOIN draws USING (block)), {PER.format(key='rep, model')},
 d AS (SELECT a.macro_f1 - b.macro_f1 AS diff FROM mf a JOIN mf b USING (rep) WHERE a.model = 'gbt' AND b.model = 'svm') SELECT {CI_SQL.format('diff')} FROM d"""))
def b2(spark, sf):
    return rounded(B.macro_f1_difference(strata(spark, sf), "block", "gbt", "svm", 3, REPS, 7), CI)


LONG = """SELECT {0}'macro_f1' AS metric, macro_f1 AS v FROM {1}mf UNION ALL SELECT {0}'balanced_accuracy', balanced_accuracy FROM {1}mf UNION ALL
 SELECT {0}m || '_' || CASE c WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END, CASE m WHEN 'precision' THEN p WHEN 'recall' THEN r ELSE f END FROM {1}pr, (SELECT unnest(['precision', 'recall', 'f1']) AS m)"""


@query("b3_class_metric_intervals", with_views("strata_pred", f"""WITH src AS (SELECT * FROM strata_pred WHERE model = 'rf'), {draws('block', 'src')}, x AS (SELECT rep, true_code, predicted, w FROM src JOIN draws USING (block)), {PER.format(key='rep')},
 l AS ({LONG.format('rep, ', '')}), w0 AS (SELECT 1 AS one, true_code, predicted, 1 AS w FROM src),
 {PER.format(key='one').replace('per AS', 'eper AS').replace('FROM per', 'FROM eper').replace('FROM x,', 'FROM w0,').replace('pr AS (', 'epr AS (').replace('FROM pr', 'FROM epr').replace('mf AS', 'emf AS')},
 e AS ({LONG.format('', 'e')})
SELECT metric, round(any_value(e.v), 6) AS estimate, {CI_SQL.format('l.v')} FROM l JOIN e USING (metric) GROUP BY 1"""))
def b3(spark, sf):
    return rounded(B.class_metric_intervals(strata(spark, sf).where("model = 'rf'"), "block", CLASSES, REPS, 7), ["estimate", *CI])


def group_attr(spark, sf):
    """Group-level attribution of class P, first repeat."""
    rows = attr(spark, sf, by="group_id").where("repeat = 1 and class = 'P'")
    return O.medians(rows, ["feature", "group_id"], {"shap": "shap", "completed": "completed"}, also=[F.min("block").alias("block")], bound=["group_id"])


GA = "ga AS (SELECT feature, group_id, min(block) AS block, median(shap) AS shap, median(completed) AS completed FROM attr WHERE repeat = 1 AND class = 'P' GROUP BY 1, 2)"


@query("b4_mean_abs_interval", with_views("attr", f"""WITH {GA}, {draws('group_id', 'ga')}, v AS (SELECT rep, feature, sum(w * abs(shap)) / sum(w) AS m FROM ga JOIN draws USING (group_id) GROUP BY 1, 2), e AS (SELECT feature, avg(abs(shap)) AS est FROM ga GROUP BY 1)
SELECT feature, round(any_value(est), 6) AS estimate, {CI_SQL.format('m')} FROM v JOIN e USING (feature) GROUP BY 1"""))
def b4(spark, sf):
    return rounded(B.mean_abs_interval(group_attr(spark, sf), ["feature"], "group_id", "shap", REPS, 7), ["estimate", *CI])


def wrho(src, key, x="completed", y="shap", name="rho"):
    """SQL of a weighted tie-averaged Spearman over src(key..., x, y, w)."""
    return f"""{name}_g AS (SELECT {key}, {x} AS x, {y} AS y, sum(w) AS w FROM {src} GROUP BY {key}, {x}, {y}),
{name}_r AS (SELECT *, sum(w) OVER (PARTITION BY {key} ORDER BY x) - sum(w) OVER (PARTITION BY {key}, x) / 2.0::DOUBLE + 0.5 AS rx, sum(w) OVER (PARTITION BY {key} ORDER BY y) - sum(w) OVER (PARTITION BY {key}, y) / 2.0::DOUBLE + 0.5 AS ry, (sum(w) OVER (PARTITION BY {key}) + 1) / 2.0::DOUBLE AS m FROM {name}_g),
{name} AS (SELECT {key}, sum(w * (rx - m) * (ry - m)) / nullif(sqrt(sum(w * (rx - m) * (rx - m)) * sum(w * (ry - m) * (ry - m))), 0) AS rho, CAST(sum(w) AS BIGINT) AS n FROM {name}_r GROUP BY {key})"""


def direction_sql(unit):
    return with_views("attr", f"""WITH {GA}, {draws(unit, 'ga')}, x AS (SELECT feature, rep, completed, shap, w FROM ga JOIN draws USING ({unit})), {wrho('x', 'feature, rep')}, one AS (SELECT feature, completed, shap, 1 AS w FROM ga), {wrho('one', 'feature', name='est')}
SELECT feature, round(any_value(est.rho), 6) AS estimate, any_value(est.n) AS n, {CI_SQL.format('rho.rho')} FROM rho JOIN est USING (feature) GROUP BY 1""")


@query("b5_direction_interval", direction_sql("group_id"))
def b5(spark, sf):
    return rounded(B.spearman_interval(group_attr(spark, sf), ["feature"], "group_id", "completed", "shap", REPS, 7), ["estimate", *CI])


@query("b5_direction_interval_clusters", direction_sql("block"))
def b5b(spark, sf):
    return rounded(B.spearman_interval(group_attr(spark, sf), ["feature"], "block", "completed", "shap", REPS, 7), ["estimate", *CI])


GP = """gp AS (SELECT repeat, fold, class, feature, group_id, min(block) AS block, median(completed) AS completed, median(shap) AS shap FROM attr GROUP BY 1, 2, 3, 4, 5),
 gg AS (SELECT class, feature, group_id, min(block) AS block, median(completed) AS completed, avg(shap) AS shap FROM gp GROUP BY 1, 2, 3)"""


def partition_groups(spark, sf):
    return cut(O.medians(attr(spark, sf, by="group_id"), ["repeat", "fold", "class", "feature", "group_id"], {"completed": "completed", "shap": "shap"},
                         also=[F.min("block").alias("block")], bound=["group_id"]))


@query("b6_direction_stability", with_views("attr", f"""WITH {GP}, p1 AS (SELECT repeat, fold, class, feature, completed, shap, 1 AS w FROM gp), {wrho('p1', 'repeat, fold, class, feature', name='pr')},
 sc AS (SELECT class, feature, greatest(count(*) FILTER (rho > 0), count(*) FILTER (rho < 0)) * 1.0::DOUBLE / count(*) FILTER (rho <> 0) AS sign_consistency, count(*) FILTER (rho <> 0) AS partitions FROM pr GROUP BY 1, 2),
 {draws('block', 'gg', 20)}, x AS (SELECT class, feature, rep, completed, shap, w FROM gg JOIN draws USING (block)), {wrho('x', 'class, feature, rep')}, one AS (SELECT class, feature, completed, shap, 1 AS w FROM gg), {wrho('one', 'class, feature', name='est')}
SELECT class, feature, round(any_value(est.rho), 6) AS estimate, round(quantile_cont(rho.rho, 0.025), 6) AS ci_low, round(quantile_cont(rho.rho, 0.975), 6) AS ci_high, round(any_value(sign_consistency), 6) AS sign_consistency, any_value(partitions) AS partitions, round(any_value(partitions) / 6.0::DOUBLE, 6) AS availability
FROM rho JOIN est USING (class, feature) JOIN sc USING (class, feature) GROUP BY 1, 2"""))
def b6(spark, sf):
    return rounded(direction_stability(spark, sf, 20), ["estimate", "ci_low", "ci_high", "sign_consistency", "availability"])


def direction_stability(spark, sf, reps):
    parts = partition_groups(spark, sf)
    each = M.spearman(parts, ["repeat", "fold", "class", "feature"], "completed", "shap")
    steady = B.sign_consistency(each, ["class", "feature"], "rho", 6)
    # rows per key are partitions, a configured few
    whole = O.medians(parts, ["class", "feature", "group_id"], {"completed": "completed"}, hot=O.FEW, also=[F.min("block").alias("block"), F.avg("shap").alias("shap")])
    boot = B.spearman_interval(whole, ["class", "feature"], "block", "completed", "shap", reps, 7, min_rows=3, min_distinct=2)
    return boot.select("class", "feature", "estimate", "ci_low", "ci_high").join(steady, ["class", "feature"])


COMP = "comp AS (SELECT block, median(f_total) AS x, median(f_price) AS y FROM records WHERE f_total IS NOT NULL AND f_price IS NOT NULL GROUP BY 1)"


@query("b7_component_inference", with_views("records", f"""WITH {COMP}, {draws('block', 'comp')}, b AS (SELECT rep, x AS completed, y AS shap, w FROM comp JOIN draws USING (block)), {wrho('b', 'rep')}, one AS (SELECT 1 AS k, x AS completed, y AS shap, 1 AS w FROM comp), {wrho('one', 'k', name='est')},
 rk AS (SELECT row_number() OVER (ORDER BY block) - 1 AS pos, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM comp),
 {shuffled('rk', 'sh', 7, 999)}, pm AS (SELECT rep, rx, target FROM rk JOIN sh USING (pos)),
 nl AS (SELECT rep, corr(pm.rx, rk.ry) AS rho FROM pm JOIN rk ON rk.pos = pm.target GROUP BY 1)
SELECT (SELECT round(rho, 6) FROM est) AS estimate, (SELECT round(quantile_cont(rho, 0.025), 6) FROM rho) AS ci_low, (SELECT round(quantile_cont(rho, 0.975), 6) FROM rho) AS ci_high, (SELECT n FROM est) AS components, (SELECT count(rho) FROM rho) AS bootstraps_valid,
 round((1 + count(*) FILTER (abs(rho) >= abs((SELECT rho FROM est)) - 1e-12)) * 1.0::DOUBLE / (1 + count(*)), 6) AS permutation_p, count(*) AS permutations_valid FROM nl""", recursive=True))
def b7(spark, sf):
    rows = records(spark, sf).select("block", F.col("f_total").alias("x"), F.col("f_price").alias("y"))
    return rounded(B.component_inference(rows, "block", "x", "y", REPS, 999, 7), ["estimate", "ci_low", "ci_high", "permutation_p"])


@query("b8_bin_median_interval", with_views("records", f"""WITH g AS (SELECT group_id, min(block) AS block, median(f_total) AS v, CAST(min(domain) % 4 AS INTEGER) AS bin FROM records GROUP BY 1), {draws('block', 'g')},
 m AS (SELECT rep, bin, median(v) AS md FROM (SELECT rep, bin, v, unnest(generate_series(1, w)) FROM g JOIN draws USING (block)) GROUP BY 1, 2) SELECT bin, {CI_SQL.format('md')} FROM m GROUP BY 1"""))
def b8(spark, sf):
    groups = O.medians(records(spark, sf), ["group_id"], {"v": "f_total"}, also=[F.min("block").alias("block"), (F.min("domain") % 4).alias("bin")])
    return rounded(B.bin_median_interval(groups, [], "bin", "block", "v", REPS, 7), CI)


@query("b9_exact_permutation", with_views("attr", """
WITH RECURSIVE i AS (SELECT class, feature, avg(shap) AS v FROM attr GROUP BY 1, 2), s AS (SELECT class, feature, v / sum(abs(v)) OVER (PARTITION BY class) AS v FROM i),
 f AS (SELECT feature, row_number() OVER (ORDER BY feature) AS k FROM (SELECT DISTINCT feature FROM s)),
 perm(o) AS (SELECT [k] FROM f UNION ALL SELECT list_append(o, k) FROM perm, f WHERE NOT list_contains(o, k)), full_ AS (SELECT row_number() OVER () AS id, o FROM perm WHERE len(o) = 6),
 pairs AS (SELECT * FROM (VALUES ('F', 'O'), ('F', 'P'), ('O', 'P')) t(a, b)), slots AS (SELECT range AS k FROM range(1, 7)),
 v AS (SELECT class, k, v FROM s JOIN f USING (feature)),
 nl AS (SELECT a, b, id, sum(l.v * r.v) / (sqrt(sum(l.v * l.v)) * sqrt(sum(r.v * r.v))) AS c FROM pairs, full_, slots JOIN v l ON l.class = a AND l.k = slots.k JOIN v r ON r.class = b AND r.k = o[slots.k] GROUP BY 1, 2, 3),
 ob AS (SELECT a, b, sum(l.v * r.v) / (sqrt(sum(l.v * l.v)) * sqrt(sum(r.v * r.v))) AS c0 FROM pairs JOIN v l ON l.class = a JOIN v r ON r.class = b AND r.k = l.k GROUP BY 1, 2)
SELECT a AS left_class, b AS right_class, round(any_value(c0), 6) AS cosine, round((1 + count(*) FILTER (abs(c) >= abs(c0) - 1e-12)) * 1.0::DOUBLE / (1 + count(*)), 6) AS exact_p, count(*) AS orders FROM nl JOIN ob USING (a, b) GROUP BY 1, 2""", recursive=True).replace("RECURSIVE i AS", "i AS"))
def b9(spark, sf):
    return rounded(B.exact_cosine_permutation(signed_share_pairs(spark, sf), ["left_class", "right_class"], "feature", "left_value", "right_value", 6), ["cosine", "exact_p"])


@query("b9_leave_one_feature", with_views("attr", """
WITH i AS (SELECT class, feature, avg(shap) AS v FROM attr GROUP BY 1, 2), s AS (SELECT class, feature, v / sum(abs(v)) OVER (PARTITION BY class) AS v FROM i),
 om AS (SELECT DISTINCT feature AS omitted FROM s UNION ALL SELECT NULL), pairs AS (SELECT * FROM (VALUES ('F', 'O'), ('F', 'P'), ('O', 'P')) t(a, b)),
 v AS (SELECT omitted, class, v, row_number() OVER (PARTITION BY omitted, class ORDER BY feature) AS k, count(*) OVER (PARTITION BY omitted, class) AS n FROM s, om WHERE omitted IS NULL OR feature <> omitted),
 perm(n, o) AS (SELECT n, CAST([] AS BIGINT[]) FROM (VALUES (5), (6)) t(n) UNION ALL SELECT n, list_append(o, k) FROM perm, (SELECT range AS k FROM range(1, 7)) WHERE k <= n AND NOT list_contains(o, k)),
 full_ AS (SELECT n, o, row_number() OVER () AS id FROM perm WHERE len(o) = n),
 nl AS (SELECT a, b, l.omitted, id, sum(l.v * r.v) / (sqrt(sum(l.v * l.v)) * sqrt(sum(r.v * r.v))) AS c FROM pairs JOIN v l ON l.class = a JOIN full_ ON full_.n = l.n JOIN v r ON r.class = b AND r.omitted IS NOT DISTINCT FROM l.omitted AND r.k = o[l.k] GROUP BY 1, 2, 3, 4),
 ob AS (SELECT a, b, l.omitted, count(*) AS retained, sum(l.v * r.v) / (sqrt(sum(l.v * l.v)) * sqrt(sum(r.v * r.v))) AS c0 FROM pairs JOIN v l ON l.class = a JOIN v r ON r.class = b AND r.omitted IS NOT DISTINCT FROM l.omitted AND r.k = l.k GROUP BY 1, 2, 3)
SELECT nl.a AS left_class, nl.b AS right_class, coalesce(nl.omitted, 'none') AS omitted, any_value(retained) AS retained, round(any_value(c0), 6) AS cosine,
 round((1 + count(*) FILTER (abs(c) >= abs(c0) - 1e-12)) * 1.0::DOUBLE / (1 + count(*)), 6) AS exact_p, count(*) AS orders FROM nl JOIN ob ON nl.a = ob.a AND nl.b = ob.b AND nl.omitted IS NOT DISTINCT FROM ob.omitted GROUP BY 1, 2, 3""", recursive=True))
def b9_leave_one(spark, sf):
    got = B.leave_one_label_permutation(signed_share_pairs(spark, sf), ["left_class", "right_class"], "feature", "left_value", "right_value", 6)
    return rounded(got.withColumn("omitted", F.coalesce("omitted", F.lit("none"))), ["cosine", "exact_p"])


def signed_share_pairs(spark, sf):
    mean = attr(spark, sf).groupBy("class", "feature").agg(F.avg("shap").alias("v"))
    shares = V.signed_share(mean, ["class"], "v", "share")
    return J.unordered_pairs(shares, ["feature"], "class", "share").withColumnsRenamed({"left": "left_class", "right": "right_class"})


@query("b10_weighted_resample", with_views("records", """
WITH c AS (SELECT record_id, coalesce(f_qty, 0) AS w, sum(coalesce(f_qty, 0)) OVER (ORDER BY record_id) AS hi, row_number() OVER (ORDER BY record_id) - 1 AS draw FROM records),
 d AS (SELECT draw, CAST('0x' || substr(md5(concat_ws(':', '7', draw)), 1, 8) AS BIGINT) / 4294967296::DOUBLE * (SELECT max(hi) FROM c) AS t FROM c)
SELECT d.draw, c.record_id FROM d ASOF JOIN (SELECT record_id, hi - w AS lo FROM c WHERE w > 0) c ON d.t >= c.lo"""))
def b10(spark, sf):
    return B.weighted_resample(records(spark, sf), "record_id", F.coalesce("f_qty", F.lit(0.0)), 7)


@query("b11_random_mask", with_views("cells", """
WITH o AS (SELECT feature, record_id, row_number() OVER (PARTITION BY feature ORDER BY md5(concat_ws(':', '9', feature, record_id)), record_id) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM cells WHERE observed IS NOT NULL)
SELECT feature, record_id FROM o WHERE r < least(n, greatest(5, round(n * 0.1)))"""))
def b11(spark, sf):
    from kinfold.operators.cohort import cells
    observed = cells(records(spark, sf), ["record_id"], FEATURES).where("value is not null")
    return B.random_mask(observed, ["feature"], "record_id", 0.1, 5, 9)
