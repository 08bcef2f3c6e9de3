"""Split, sampling, balancing and set-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.operators import balance as B
from netweir.operators import evaluate as E
from netweir.operators import splits as S
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.registry import query
from netweir.sources import adapters as src

DRAWN = ctes.RARE + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id)) AS rk, count(*) OVER (PARTITION BY label) AS n,
  count(*) OVER () AS total FROM rare)"""
I1 = DRAWN + ", split AS (SELECT *, CASE WHEN rk <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM ranked)"


@query("stratified_split", f"WITH {I1} SELECT row_id, split FROM split")
def stratified_split(spark, sf):
    return S.stratified_split(src.rare_features(spark, sf), "label", "row_id", 0.2, 42).select("row_id", "split")


@query("temporal_split", f"""WITH {ctes.RARE}, o AS (SELECT *, row_number() OVER (ORDER BY ts) AS rk, count(*) OVER () AS n FROM rare),
b AS (SELECT max(ts) AS boundary FROM o WHERE rk = round_even(n * 0.8, 0))
SELECT row_id, CASE WHEN ts <= boundary THEN 'train' ELSE 'test' END AS split FROM rare, b""")
def temporal_split(spark, sf):
    return S.temporal_split(src.rare_features(spark, sf), "ts", 0.2).select("row_id", "split")


@query("temporal_split_per_class", f"""WITH {ctes.RARE},
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ts, md5('order|' || row_id)) AS rk, count(*) OVER (PARTITION BY label) AS n FROM rare)
SELECT row_id, CASE WHEN rk <= n - round_even(n * 0.2, 0) THEN 'train' ELSE 'test' END AS split FROM o""")
def temporal_split_per_class(spark, sf):
    return S.temporal_split_per_class(src.rare_features(spark, sf), "label", "ts", "row_id", 0.2).select("row_id", "split")


@query("temporal_split_matched_counts", f"""WITH {I1}, c AS (SELECT label, count(*) AS wanted FROM split WHERE split = 'test' AND label <> 'Bot' GROUP BY label),
o AS (SELECT s.label, ts, s.row_id, row_number() OVER (PARTITION BY s.label ORDER BY ts, md5('order|' || row_id)) AS rk2, n, coalesce(wanted, 0) AS wanted FROM split s LEFT JOIN c USING (label))
SELECT row_id, CASE WHEN rk2 <= n - wanted THEN 'train' ELSE 'test' END AS split FROM o""")
def temporal_split_matched_counts(spark, sf):
    rare = src.rare_features(spark, sf)
    counts = S.stratified_split(rare, "label", "row_id", 0.2, 42).where(
        (F.col("split") == "test") & (F.col("label") != "Bot")).groupBy("label").agg(F.count(F.lit(1)).alias("wanted"))
    return S.temporal_split_per_class(rare, "label", "ts", "row_id", counts=counts).select("row_id", "split")


SUBSET = DRAWN + """, sub AS (SELECT *, least(n, greatest(10, round_even(n * (500 / CAST(total AS DOUBLE)), 0))) AS k FROM ranked)"""


@query("stratified_subset", f"WITH {SUBSET} SELECT row_id, label FROM sub WHERE rk <= k")
def stratified_subset(spark, sf):
    return S.stratified_subset(src.rare_features(spark, sf), "label", "row_id", 500, 42).select("row_id", "label")


@query("subset_targets", f"""WITH {SUBSET} SELECT label, n, CAST(any_value(k) AS BIGINT) AS k, any_value(k) > round_even(n * (500 / CAST(any_value(total) AS DOUBLE)), 0) AS floored FROM sub GROUP BY label, n""")
def subset_targets(spark, sf):
    return S.subset_targets(src.rare_features(spark, sf), "label", 500)


@query("nested_calibration_split", f"""WITH {I1},
b AS (SELECT row_id, row_number() OVER (ORDER BY md5('42-calibration|' || row_id)) AS r, count(*) OVER () AS m FROM split WHERE split = 'train' AND label = 'BENIGN')
SELECT s.row_id, CASE WHEN split = 'test' THEN 'test' WHEN label <> 'BENIGN' THEN 'train_attack' WHEN r <= round_even(m * 0.2, 0) THEN 'calibrate' ELSE 'fit' END AS part
FROM split s LEFT JOIN b USING (row_id)""")
def nested_calibration_split(spark, sf):
    return S.nested_calibration_split(src.rare_features(spark, sf), "label", "row_id", 0.2, 42).select("row_id", "part")


@query("attack_ratio_sample", f"""WITH {ctes.RARE},
k AS (SELECT row_id, label, row_number() OVER (PARTITION BY label = 'BENIGN' ORDER BY md5('7|' || row_id)) AS r FROM rare)
SELECT row_id, label FROM k WHERE CASE WHEN label = 'BENIGN' THEN r <= 700 ELSE r <= 300 END""")
def attack_ratio_sample(spark, sf):
    return S.attack_ratio_sample(src.rare_features(spark, sf), F.col("label") != "BENIGN", "row_id", 1000, 0.3, 7).select("row_id", "label")


@query("evidence_strata", f"""WITH {ctes.LIVE}, s AS (SELECT *, CASE WHEN expected_binary_label = 'BENIGN' AND predicted_label <> 'BENIGN' THEN 'false_positive'
  WHEN expected_binary_label = 'ATTACK' AND predicted_label <> 'BENIGN' THEN 'true_positive' END AS stratum FROM live),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY row_id) AS o FROM s WHERE stratum IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('9|' || row_id)) AS r FROM p WHERE stratum = 'false_positive' OR o <= 2000)
SELECT row_id, stratum FROM d WHERE r <= 40""")
def evidence_strata(spark, sf):
    flagged = F.col("predicted_label") != "BENIGN"
    live = src.live_flows(spark, sf).withColumn(
        "stratum", F.when(flagged & (F.col("expected_binary_label") == "BENIGN"), "false_positive")
        .when(flagged & (F.col("expected_binary_label") == "ATTACK"), "true_positive"))
    return S.evidence_strata(live, "row_id", "row_id", 40, 9).select("row_id", "stratum")


@query("remove_family", f"""WITH {ctes.PREDICTIONS} SELECT row_id, y_true FROM predictions WHERE y_true <> 'DoS Hulk'""")
def remove_family(spark, sf):
    return S.remove_family(E.with_family(src.predictions(spark, sf), "y_true"), "family", "DoS").select("row_id", "y_true")


@query("family_leaks", f"""WITH {ctes.PREDICTIONS} SELECT count(*) FILTER (y_true = 'DoS Hulk') AS leaked_rows FROM predictions""")
def family_leaks(spark, sf):
    return S.family_leaks(E.with_family(src.predictions(spark, sf), "y_true"), "family", "DoS")


@query("overlap_rows", f"""WITH {ctes.FEATURES} SELECT quantity, discount, tax, label FROM features WHERE status = 'F' INTERSECT SELECT quantity, discount, tax, label FROM features WHERE status = 'O'""")
def overlap_rows(spark, sf):
    f = src.features(spark, sf)
    return S.overlap_rows(f.where("status = 'F'"), f.where("status = 'O'"), ["quantity", "discount", "tax", "label"])


@query("split_leakage", """WITH r AS (SELECT DISTINCT 'run-' || (o_orderkey % 40) AS run_id, o_orderkey % 40 AS k,
    CASE WHEN o_orderkey % 40 < 20 THEN 'adaptation' WHEN o_orderkey % 40 < 28 THEN 'validation' WHEN o_orderkey % 40 < 39 THEN 'final_test' ELSE 'spare' END AS role FROM orders
  UNION SELECT DISTINCT 'run-' || (o_orderkey % 40), o_orderkey % 40, 'final_test' FROM orders WHERE o_orderkey % 40 IN (3, 22)),
g AS (SELECT run_id, k, list_sort(list_distinct(list(role))) AS roles FROM r GROUP BY 1, 2)
SELECT run_id, 'adaptation and final_test' AS violation FROM g WHERE list_contains(roles, 'adaptation') AND list_contains(roles, 'final_test')
UNION ALL SELECT run_id, 'validation and final_test' FROM g WHERE list_contains(roles, 'validation') AND list_contains(roles, 'final_test')
UNION ALL SELECT run_id, 'several roles' FROM g WHERE len(roles) > 1
UNION ALL SELECT run_id, 'historical run in final_test' FROM g WHERE list_contains(roles, 'final_test') AND k IN (30, 5)
UNION ALL SELECT run_id, 'unknown role' FROM g WHERE list_contains(roles, 'spare')""")
def split_leakage(spark, sf):
    k = F.col("o_orderkey") % 40
    role = F.when(k < 20, "adaptation").when(k < 28, "validation").when(k < 39, "final_test").otherwise("spare")
    rows = src.table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), k.cast("string")).alias("run_id"), role.alias("role"), k.alias("k"))
    rows = rows.unionByName(rows.where(F.col("k").isin(3, 22)).withColumn("role", F.lit("final_test")))
    return S.split_leakage(rows, rows.where(F.col("k").isin(30, 5)).select("run_id"))


@query("duplicate_straddle", f"""WITH {I1}, g AS (SELECT quantity, discount, tax, count(*) AS n, bool_or(split = 'train') AND bool_or(split = 'test') AS s FROM split GROUP BY 1, 2, 3)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, round(1 - count(*) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_rate, count(*) FILTER (n > 1) AS duplicate_groups,
  count(*) FILTER (s) AS straddling_groups, CAST(coalesce(sum(n) FILTER (s), 0) AS BIGINT) AS rows_in_straddling_groups, round(coalesce(sum(n) FILTER (s), 0) / CAST(sum(n) AS DOUBLE), 6) AS straddling_fraction FROM g""")
def duplicate_straddle(spark, sf):
    split = S.stratified_split(src.rare_features(spark, sf), "label", "row_id", 0.2, 42)
    return rounded(S.duplicate_straddle(split, ["quantity", "discount", "tax"], "split"))


@query("dedupe_explanations", """SELECT min(doc_id) AS explanation_id, doc_id // 10 * 3 AS alarm_id, CASE doc_id % 3 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'Claude-y' ELSE 'other-1' END AS text_model,
  CASE WHEN doc_id % 9 <> 8 THEN 'prompt-' || lang END AS prompt_version FROM documents GROUP BY 2, 3, 4""")
def dedupe_explanations(spark, sf):
    e = src.explanations(spark, sf).withColumn("alarm_id", F.expr("explanation_id div 10 * 3"))
    return S.dedupe_explanations(e.select("explanation_id", "alarm_id", "text_model", "prompt_version"))


@query("key_set_overlap", f"""WITH {ctes.FLOWS}, a AS (SELECT DISTINCT destination_ip AS k FROM flows WHERE source_ip < '10.0.0.12'), b AS (SELECT DISTINCT destination_ip AS k FROM flows WHERE attack_type = 'PortScan' AND value > 60),
u AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ia, b.k IS NOT NULL AS ib FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (ia) AS n_a, count(*) FILTER (ib) AS n_b, count(*) FILTER (ia AND ib) AS shared, count(*) AS union_size, round(count(*) FILTER (ia AND ib) / CAST(count(*) AS DOUBLE), 6) AS jaccard,
  count(*) FILTER (NOT ib) AS only_in_a, count(*) FILTER (NOT ia) AS only_in_b FROM u""")
def key_set_overlap(spark, sf):
    f = src.flows(spark, sf)
    return rounded(S.key_set_overlap(f.where("source_ip < '10.0.0.12'"), f.where("attack_type = 'PortScan' AND value > 60"), "destination_ip"))


PLAN = """counts AS (SELECT label, count(*) AS available FROM rare GROUP BY label),
plan AS (SELECT *, CAST(CASE WHEN label = 'BENIGN' AND available > 2000 THEN 2000 WHEN label <> 'BENIGN' AND available < 1500 THEN 1500 ELSE available END AS BIGINT) AS target,
  CASE WHEN label = 'BENIGN' AND available > 2000 THEN 'undersampled' WHEN label <> 'BENIGN' AND available < 1500 THEN CASE WHEN available < 2 THEN 'replicated' ELSE 'smote' END ELSE 'unchanged' END AS method FROM counts)"""


@query("balance_plan", f"WITH {ctes.RARE}, {PLAN} SELECT * FROM plan")
def balance_plan(spark, sf):
    return B.balance_plan(src.rare_features(spark, sf), "label", 2000, 1500)


@query("undersample", f"WITH {DRAWN}, {PLAN} SELECT row_id, r.label FROM ranked r JOIN plan p USING (label) WHERE rk <= target")
def undersample(spark, sf):
    rare = src.rare_features(spark, sf)
    return B.undersample(rare, B.balance_plan(rare, "label", 2000, 1500), "label", "row_id", 42).select("row_id", "label")


LONE = """lone AS (SELECT 'v' || c_custkey AS row_id, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'Heartbleed' ELSE c_mktsegment END AS label FROM customer)"""


@query("replicate", f"""WITH {LONE} SELECT row_id, label, CAST(unnest(range(1, 25)) AS BIGINT) AS copy_no FROM lone WHERE label = 'Heartbleed'""")
def replicate(spark, sf):
    customer = src.table(spark, sf, "customer")
    last = customer.agg(F.max("c_custkey").alias("last"))
    rows = customer.join(F.broadcast(last)).select(
        F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("row_id"),
        F.when(F.col("c_custkey") == F.col("last"), "Heartbleed").otherwise(F.col("c_mktsegment")).alias("label"))
    return B.replicate(rows, B.balance_plan(rows, "label", None, 25), "label")


@query("class_weights", f"""WITH {ctes.RARE}, c AS (SELECT label, count(*) AS n FROM rare GROUP BY label) SELECT label, n, round(sum(n) OVER () / CAST((count(*) OVER ()) * n AS DOUBLE), 6) AS weight FROM c""")
def class_weights(spark, sf):
    return rounded(B.class_weights(src.rare_features(spark, sf), "label"))


def vector_plan(spark, sf):
    """Class 0 is capped, classes under the largest class size are oversampled to it."""
    v = src.vectors(spark, sf).withColumn("label", F.when(F.col("label") == "class-0", "BENIGN").otherwise(F.col("label")))
    return v, B.balance_plan(v, "label", 20, 20000)


@query("smote_neighbours", """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS row_id, CASE label WHEN 0 THEN 'BENIGN' ELSE 'class-' || label END AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.label, a.row_id, b.row_id AS neighbour_id, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.label = b.label AND a.row_id <> b.row_id WHERE a.label <> 'BENIGN'),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, neighbour_id) AS rank FROM p)
SELECT label, row_id, neighbour_id, CAST(rank AS INT) AS rank, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def smote_neighbours(spark, sf):
    v, plan = vector_plan(spark, sf)
    return rounded(B.nearest_in_class(v, plan, "label", "row_id", "vector", 5, 20000))


@query("smote_rows")
def smote_rows(spark, sf):
    v, plan = vector_plan(spark, sf)
    return B.smote(v, plan, "label", "row_id", "vector", 42, 5, 20000).groupBy("label").agg(
        F.count(F.lit(1)).alias("synthetic_rows"), F.countDistinct("base_id").alias("bases"))


@query("balance_report", """WITH v AS (SELECT CASE label WHEN 0 THEN 'BENIGN' ELSE 'class-' || label END AS label FROM embeddings), c AS (SELECT label, count(*) AS n FROM v GROUP BY label)
SELECT label, n AS rows_before, CAST(CASE label WHEN 'BENIGN' THEN least(n, 20) ELSE 20000 END AS BIGINT) AS target, CASE label WHEN 'BENIGN' THEN CASE WHEN n > 20 THEN 'undersampled' ELSE 'unchanged' END ELSE 'smote' END AS method,
  CAST(CASE label WHEN 'BENIGN' THEN least(n, 20) ELSE 20000 END AS BIGINT) AS rows_after, CAST(CASE label WHEN 'BENIGN' THEN 0 ELSE 20000 - n END AS BIGINT) AS synthetic_rows FROM c""")
def balance_report(spark, sf):
    v, plan = vector_plan(spark, sf)
    return B.balance_report(B.balance(v, "label", "row_id", "vector", 42, 20, 20000), plan, "label")
