"""Model, anomaly and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.operators import anomaly as A
from netweir.operators import evaluate as E
from netweir.operators import models as M
from netweir.operators import profile as P
from netweir.operators import validate as V
from netweir.plans import training as T
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.drift import GRID
from netweir.plans.catalog.evaluation import RATES, SCORED, scored
from netweir.plans.catalog.profiling import VALIDATED
from netweir.plans.catalog.registry import query
from netweir.sources import adapters as src


@query("index_labels", f"""WITH {ctes.RARE}, l AS (SELECT label, count(*) AS n FROM rare GROUP BY label) SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index, n FROM l""")
def index_labels(spark, sf):
    rare = src.rare_features(spark, sf)
    return M.index_labels(rare).transform(rare).groupBy("label", "label_index").agg(F.count(F.lit(1)).alias("n"))


def _scored_classes(spark, sf, train):
    v = src.vectors(spark, sf)
    return M.score(v, train(v)).groupBy("label", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("min_confidence"))


@query("train_forest")
def train_forest(spark, sf):
    return _scored_classes(spark, sf, lambda v: M.train_forest(v))


@query("train_mlp")
def train_mlp(spark, sf):
    return _scored_classes(spark, sf, lambda v: M.train_mlp(v, 64))


@query("train_boosted_binary")
def train_boosted_binary(spark, sf):
    f = M.assemble(src.features(spark, sf), src.FEATURE_COLUMNS).withColumn(
        "label", F.when(F.col("label") == "BENIGN", "BENIGN").otherwise("ATTACK"))
    model = M.train_boosted(f, rounds=2, depth=3)
    return M.score(f, model, 0.5).groupBy("label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


@query("train_boosted_multiclass")
def train_boosted_multiclass(spark, sf):
    """Held-out rows scored by boosted trees, one class against the rest."""
    rows = T.split_rows(M.assemble(src.rare_features(spark, sf), src.FEATURE_COLUMNS), T.TrainingConfig(src.FEATURE_COLUMNS))
    model = M.train_boosted(rows.where("split = 'train'"), rounds=3, depth=3)
    return M.score(rows.where("split = 'test'"), model).groupBy("label", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def benign(spark, sf):
    return src.features(spark, sf).where("label = 'BENIGN'")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return A.fit_isolation_forest(benign(spark, sf), src.FEATURE_COLUMNS, "row_id", 42).select(
        "tree", F.size("feature").alias("nodes"))


def forest(spark, sf):
    return A.fit_isolation_forest(benign(spark, sf), src.FEATURE_COLUMNS, "row_id", 42)


@query("isolation_score")
def isolation_score(spark, sf):
    return A.isolation_score(src.features(spark, sf), forest(spark, sf), src.FEATURE_COLUMNS, ["row_id", "label"])


@query("attribute_by_median")
def attribute_by_median(spark, sf):
    medians = {r["feature"]: r["p50"] for r in P.feature_reference(benign(spark, sf), src.FEATURE_COLUMNS).select("feature", "p50").collect()}
    return A.attribute_by_median(src.features(spark, sf), forest(spark, sf), src.FEATURE_COLUMNS, medians, "row_id", top=2)


@query("calibrate_anomaly", f"""WITH {SCORED}, b AS (SELECT s FROM scored WHERE NOT attack), q AS (SELECT quantile_cont(s, {RATES}) AS t, quantile_cont(s, {GRID}) AS g FROM b)
SELECT list_transform(t, lambda x: round(x, 6)) AS thresholds, list_transform(g, lambda x: round(x, 6)) AS calibration_quantiles FROM q""")
def calibrate_anomaly(spark, sf):
    c = A.calibrate_anomaly(scored(spark, sf).where(~F.col("attack")), "s")
    return c.select(F.transform("thresholds", lambda t: F.round(t["threshold"], 6)).alias("thresholds"),
                    F.transform("calibration_quantiles", lambda x: F.round(x, 6)).alias("calibration_quantiles"))


@query("anomaly_percentile", f"""WITH {SCORED}, q AS (SELECT quantile_cont(s, {GRID}) AS q FROM scored WHERE NOT attack),
g AS (SELECT row_id, s, q, len(list_filter(q, lambda k: k <= s)) AS b FROM scored, q)
SELECT row_id, round_even(1 - CASE WHEN b = 0 THEN 0.0 WHEN b >= 101 THEN 1.0 ELSE (b - 1) / 100.0 + (s - q[b]) * (0.01 / (q[b + 1] - q[b])) END, 6) AS p FROM g""")
def anomaly_percentile(spark, sf):
    s = scored(spark, sf)
    c = A.calibrate_anomaly(s.where(~F.col("attack")), "s").select("calibration_quantiles")
    return s.join(F.broadcast(c)).select("row_id", A.anomaly_percentile(
        F.col("s"), F.col("calibration_quantiles")).alias("p"))


@query("anomaly_available", f"""WITH {VALIDATED} SELECT row_id, len(missing) = 0 AND len(invalid) = 0 AS anomaly_available,
  array_to_string(missing || list_transform(invalid, lambda x: split_part(x, ':', 1)), ',') AS blocking FROM judged""")
def anomaly_available(spark, sf):
    v = V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES, policy=V.PERMISSIVE)
    return A.anomaly_available(v).select("row_id", "anomaly_available", F.array_join("blocking_features", ",").alias("blocking"))


@query("fuse", f"""WITH {ctes.LIVE}, f AS (SELECT row_id, predicted_label AS l, prediction_confidence AS c, validation_status = 'VALID' AND model_b_score < 0.3 AS odd FROM live)
SELECT row_id, CASE WHEN l <> 'BENIGN' THEN l WHEN odd THEN 'UNKNOWN' ELSE 'BENIGN' END AS prediction, CASE WHEN l <> 'BENIGN' THEN 'KNOWN_ATTACK' WHEN odd THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS detection_class,
  CASE WHEN l <> 'BENIGN' OR NOT odd THEN c END AS detection_confidence, CASE WHEN l = 'BENIGN' AND odd THEN 'ANOMALY_DETECTION' ELSE 'SUPERVISED_ML' END AS detection_method FROM f""")
def fuse(spark, sf):
    live = src.live_flows(spark, sf).select(
        "row_id", F.col("predicted_label").alias("supervised_label"), F.col("prediction_confidence").alias("supervised_confidence"),
        (F.col("validation_status") == "VALID").alias("anomaly_available"), (F.col("model_b_score") < 0.3).alias("is_anomalous"))
    return A.fuse(live).select("row_id", "prediction", "detection_class", "detection_confidence", "detection_method")


@query("global_importance", """WITH e AS (SELECT unnest(['Flow Duration', 'Total Fwd Packets', 'SYN Flag Count']) AS feature, (doc_id % 10 + 1) / 16.0 AS c FROM documents)
SELECT feature, round(avg(c), 6) AS importance FROM e GROUP BY feature""")
def global_importance(spark, sf):
    c = src.explanations(spark, sf).select(F.explode("evidence").alias("e")).select("e.feature", "e.contribution")
    return rounded(A.global_importance(c))


SMALL = dict(features=src.FEATURE_COLUMNS, learner_options={"trees": 3, "depth": 4})


@query("train_evaluate")
def train_evaluate(spark, sf):
    _, conf = T.train_evaluate(src.rare_features(spark, sf), T.TrainingConfig(**SMALL, benign_cap=20000))
    return E.per_class(conf)


@query("feature_count_sweep")
def feature_count_sweep(spark, sf):
    return T.feature_count_sweep(src.features(spark, sf), src.FEATURE_COLUMNS, [1, 2], T.TrainingConfig(
        **SMALL, split="temporal_global"))


@query("leave_one_family_out")
def leave_one_family_out(spark, sf):
    rows = src.rare_features(spark, sf)
    families = [r.family for r in E.with_family(rows, "label").where("family <> 'BENIGN'").select("family").distinct().orderBy("family").collect()]
    options = {"forest": {"trees": 10, "depth": 5}, "mlp": {"rounds": 20}}
    return T.leave_one_family_out(rows, families, [T.TrainingConfig(
        src.FEATURE_COLUMNS, learner, benign_cap=20000, learner_options=o) for learner, o in options.items()])
