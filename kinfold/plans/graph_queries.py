"""Connected blocks and grouped splits (G) and the holdout choice (K6)."""

from pyspark.sql import functions as F

from kinfold.functions.scalars import split_ids
from kinfold.operators import cohort as C, contracts, graph as G, joins as J, splits as S
from kinfold.plans.fixtures import FEATURES, attr, records, table, with_views
from kinfold.plans.registry import query
from kinfold.session import cut, scratch_path

r6 = lambda c: F.round(c, 6)

EDGES = "e AS (SELECT DISTINCT group_id AS g, unnest(string_split(source_ids, ';')) AS s FROM records)"
REACH = """
gg AS (SELECT DISTINCT a.g AS a, b.g AS b FROM e a JOIN e b USING (s)), reach(a, b) AS (SELECT a, b FROM gg UNION SELECT reach.a, gg.b FROM reach JOIN gg ON reach.b = gg.a),
root AS (SELECT a AS group_id, min(b) AS root FROM reach GROUP BY 1), num AS (SELECT root, dense_rank() OVER (ORDER BY root) AS n FROM (SELECT DISTINCT root FROM root))
"""
NAME = "'{0}' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0')"


@query("g1_connected_blocks", with_views("records", f"WITH {EDGES}, {REACH} SELECT group_id, root, {NAME.format('CVB')} AS block FROM root JOIN num USING (root)", recursive=True))
def g1(spark, sf):
    return G.connected_blocks(G.group_source_edges(records(spark, sf), "group_id", split_ids("source_ids")), "group_id")


@query("g2_blocks_two_edge_lists", with_views("records", f"""WITH {EDGES.replace("FROM records", "FROM records UNION SELECT c_custkey, 'N' || (c_custkey // 2) FROM customer WHERE c_custkey % 10 < 2")}, {REACH} SELECT group_id, root, {NAME.format('RCB')} AS block FROM root JOIN num USING (root)""", recursive=True))
def g2(spark, sf):
    edges = G.group_source_edges(records(spark, sf), "group_id", split_ids("source_ids"))
    registry = table(spark, sf, "customer").where("c_custkey % 10 < 2").select(
        F.col("c_custkey").alias("group_id"), F.concat(F.lit("N"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("refs"))
    return G.connected_blocks(G.union_edges(edges, registry, "group_id", "refs"), "group_id", "RCB")


@query("g3_dependency_blocks", with_views("records", f"""
WITH e AS (SELECT DISTINCT block AS g, block + CASE WHEN group_id % 40 = 0 THEN 4 ELSE 0 END AS s FROM records), {REACH} SELECT group_id AS a_block, root, {NAME.format('CCB')} AS block FROM root JOIN num USING (root)""", recursive=True))
def g3(spark, sf):
    pairs = records(spark, sf).select(F.col("block").alias("a_block"), (F.col("block") + F.when(F.col("group_id") % 40 == 0, 4).otherwise(0)).alias("b_block"))
    return G.dependency_blocks(pairs, "a_block", "b_block")


def deal(folds, seeds, cls="class_code", k=3, src="records", name="deal"):
    """SQL of the snake deal for a list of seeds."""
    return f"""
{name}_b AS (SELECT block, {", ".join(f"count(*) FILTER ({cls} = {c}) AS n_{c}" for c in range(k))}, count(*) AS n FROM {src} GROUP BY 1),
{name}_s AS (SELECT *, CASE {" ".join(f"WHEN n_{c} = greatest({', '.join(f'n_{i}' for i in range(k))}) THEN {c}" for c in range(k))} END AS stratum FROM {name}_b),
{name}_r AS (SELECT seed, s.*, row_number() OVER (PARTITION BY seed, stratum ORDER BY n DESC, md5(seed || ':' || block), block) - 1 AS r FROM {name}_s s, (SELECT unnest([{", ".join(map(str, seeds))}]) AS seed)),
{name} AS (SELECT seed, stratum, block, {", ".join(f"n_{c}" for c in range(k))}, CAST(CASE WHEN (r // {folds}) % 2 = 0 THEN r % {folds} ELSE {folds} - 1 - r % {folds} END AS INTEGER) AS fold FROM {name}_r),
{name}_v AS (SELECT seed, bool_and({" AND ".join(f"v{c} > 0 AND t{c} > v{c}" for c in range(k))}) AND count(*) = {folds} AS valid FROM (SELECT seed, fold, {", ".join(f"sum(n_{c}) AS v{c}" for c in range(k))} FROM {name} GROUP BY 1, 2),
 (SELECT {", ".join(f"sum(n_{c}) AS t{c}" for c in range(k))} FROM {name}_b) GROUP BY 1)"""


SEEDS = [42, 43, 44, 45]


@query("g4_grouped_folds", with_views("records", f"WITH {deal(5, SEEDS)} SELECT CAST(seed AS INTEGER) AS seed, block, fold FROM deal WHERE seed = (SELECT min(seed) FROM deal_v WHERE valid)"))
def g4(spark, sf):
    return S.grouped_split(cut(records(spark, sf).select("block", "class_code")), "block", "class_code", 3, 5, SEEDS).select("seed", "block", "fold")


@query("g5_class_complete_folds", with_views("records", f"WITH {deal(4, SEEDS)} SELECT CAST(seed AS INTEGER) AS seed, block, fold FROM deal WHERE seed = (SELECT min(seed) FROM deal_v WHERE valid AND seed NOT IN (SELECT 42 + r_regionkey FROM region WHERE r_regionkey < 2))"))
def g5(spark, sf):
    used = table(spark, sf, "region").where("r_regionkey < 2").select((F.col("r_regionkey") + 42).alias("seed"))
    return S.grouped_split(cut(records(spark, sf).select("block", "class_code")), "block", "class_code", 3, 4, SEEDS, used).select("seed", "block", "fold")


@query("g6_inner_folds", with_views("records", f"""
WITH few AS (SELECT * FROM records WHERE block % 1000 IN (0, 4, 8)), many AS (SELECT * FROM records), {deal(4, [7], src="few", name="four")}, {deal(3, [7], src="few", name="three")}
SELECT CAST(4 AS INTEGER) AS folds, CAST(seed AS INTEGER) AS seed, block, fold FROM four WHERE (SELECT valid FROM four_v)
UNION ALL SELECT 3, CAST(seed AS INTEGER), block, fold FROM three WHERE NOT coalesce((SELECT valid FROM four_v), false) AND (SELECT valid FROM three_v)"""))
def g6(spark, sf):
    few = cut(records(spark, sf).where("block % 1000 in (0, 4, 8)").select("block", "class_code"))
    return S.inner_split(few, "block", "class_code", 3, [4, 3], 7).select("folds", "seed", "block", "fold")


HOLD_SEEDS = list(range(100, 120))
CAND = deal(5, HOLD_SEEDS) + """,
pb AS (SELECT block, count(*) AS n, """ + ", ".join(f"count(*) FILTER (class_code = {c}) AS n_{c}, count(DISTINCT group_id) FILTER (class_code = {c}) AS g_{c}" for c in range(3)) + """ FROM records GROUP BY 1),
tt AS (SELECT sum(n) AS n, """ + ", ".join(f"sum(n_{c}) AS n_{c}, sum(g_{c}) AS g_{c}" for c in range(3)) + """ FROM pb),
hh AS (SELECT seed, fold, sum(pb.n) AS n, """ + ", ".join(f"sum(pb.n_{c}) AS n_{c}, sum(pb.g_{c}) AS g_{c}" for c in range(3)) + """ FROM deal JOIN pb USING (block) GROUP BY 1, 2),
cand AS (SELECT CAST(seed AS INTEGER) AS seed, fold, CAST(hh.n AS BIGINT) AS held_records, """ + " AND ".join(f"hh.g_{c} >= 2 AND tt.g_{c} - hh.g_{c} >= 2" for c in range(3)) + """ AS eligible,
 abs(hh.n * 1.0::DOUBLE / tt.n - 0.2) + """ + " + ".join(f"abs(hh.n_{c} * 1.0::DOUBLE / hh.n - tt.n_{c} * 1.0::DOUBLE / tt.n)" for c in range(3)) + """ AS objective FROM hh, tt)
"""


def holdouts(spark, sf):
    rows = cut(records(spark, sf).select("group_id", "block", "class_code"))
    dealt = S.deal_folds(S.block_classes(rows, "block", "class_code", 3), "block", 5, HOLD_SEEDS)
    return S.holdout_candidates(rows, dealt, "group_id", "block", "class_code", 3)


@query("g7_holdout_candidates", with_views("records", f"WITH {CAND} SELECT seed, fold, held_records, eligible, round(objective, 6) AS objective FROM cand"))
def g7(spark, sf):
    return holdouts(spark, sf).withColumn("objective", r6("objective"))


@query("k6_holdout_choice", with_views("records", f"WITH {CAND} SELECT seed, fold, held_records, eligible, round(objective, 6) AS objective FROM cand WHERE eligible ORDER BY round(objective, 12), seed, fold LIMIT 1"))
def k6(spark, sf):
    return S.choose_holdout(holdouts(spark, sf)).withColumn("objective", r6("objective"))


@query("g8_holdout_contract")
def g8(spark, sf):
    """Freeze the chosen holdout, then count accesses in an append-only ledger (read, check, append)."""
    path = scratch_path(spark, "holdout_ledger")
    chosen = S.choose_holdout(holdouts(spark, sf)).select("seed", "fold", F.lit("frozen").alias("event"), F.lit(0).alias("access"))
    chosen.write.mode("append").parquet(path)
    contracts.record_access(spark, path, "final_evaluation", limit=1)
    return spark.read.parquet(path)


@query("g9_fold_registry", with_views("records", f"""
WITH {deal(5, [42])}, kept AS (SELECT * FROM (VALUES (0, 'f_bal'), (0, 'f_qty'), (1, 'f_bal'), (1, 'f_qty'), (2, 'f_bal'), (2, 'f_price'), (3, 'f_total'), (3, 'f_qty'), (4, 'f_bal'), (4, 'f_tax')) t(fold, feature)),
 l AS (SELECT record_id, block, fold, count(*) AS k, count(*) FILTER (CASE feature {" ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES)} END IS NULL) AS m FROM records JOIN deal USING (block) JOIN kept USING (fold) GROUP BY 1, 2, 3)
SELECT record_id, block, fold, k AS retained_features, round(m * 1.0::DOUBLE / k, 6) AS missing_share, CASE WHEN m * 1.0 / k >= 0.5 THEN 'missing_share' ELSE '' END AS abstain_reason FROM l"""))
def g9(spark, sf):
    base = cut(records(spark, sf))
    dealt = S.deal_folds(S.block_classes(base, "block", "class_code", 3), "block", 5, [42])
    picks = {0: ("f_bal", "f_qty"), 1: ("f_bal", "f_qty"), 2: ("f_bal", "f_price"), 3: ("f_total", "f_qty"), 4: ("f_bal", "f_tax")}
    kept = dealt.select("fold").distinct().withColumn("feature", F.explode(F.element_at(F.array(*[F.array(*[F.lit(f) for f in picks[i]]) for i in range(5)]), F.col("fold") + 1)))
    got = S.fold_registry(base, dealt, "block", "record_id", kept, FEATURES, 0.5)
    return got.withColumns({"missing_share": r6("missing_share"), "abstain_reason": F.coalesce("abstain_reason", F.lit(""))})


@query("g10_leave_one_group", with_views("records", """
WITH o AS (SELECT class3, group_id, sum(f_qty) AS s, count(f_qty) AS n FROM records GROUP BY 1, 2), t AS (SELECT class3, sum(s) AS ts, sum(n) AS tn FROM o GROUP BY 1)
SELECT class3, group_id AS omitted, CAST(tn - n AS BIGINT) AS remaining, round((ts - coalesce(s, 0)) / (tn - n), 6) AS remaining_mean FROM o JOIN t USING (class3)"""))
def g10(spark, sf):
    rows = records(spark, sf).select("class3", "group_id", "f_qty")
    got = J.leave_one_out_mean(rows, ["class3"], "group_id", "f_qty")
    return got.withColumn("remaining_mean", r6("remaining_mean"))
