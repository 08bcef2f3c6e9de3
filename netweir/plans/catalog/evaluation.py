"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.operators import evaluate as E
from netweir.operators import ranking_metrics as R
from netweir.operators import runs as L
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.registry import query
from netweir.sources import adapters as src

CLASSES = ["BENIGN", "Bot", "DoS Hulk", "PortScan"]
TRAINED = ["BENIGN", "Bot", "DoS Hulk"]

CONF = ctes.PREDICTIONS + """,
names AS (SELECT unnest(['BENIGN', 'Bot', 'DoS Hulk', 'PortScan']) AS label),
found AS (SELECT y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2),
conf AS (SELECT t.label AS y_true, p.label AS y_pred, coalesce(f.n, 0) AS n
  FROM names t CROSS JOIN names p LEFT JOIN found f ON f.y_true = t.label AND f.y_pred = p.label)"""


def metrics_sql(conf: str) -> str:
    return f"""sums AS (SELECT label, CAST(sum(support) AS BIGINT) AS support,
    CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM (
      SELECT y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM {conf}
      UNION ALL SELECT y_pred, 0, n, 0 FROM {conf}) GROUP BY label),
cells AS (SELECT *, support - tp AS fn, predicted - tp AS fp,
    CAST(sum(support) OVER () AS BIGINT) - support - predicted + tp AS tn FROM sums),
rates AS (SELECT *, tp / nullif(CAST(predicted AS DOUBLE), 0) AS precision, tp / nullif(CAST(support AS DOUBLE), 0) AS recall,
    fp / nullif(CAST(fp + tn AS DOUBLE), 0) AS fpr, fn / nullif(CAST(support AS DOUBLE), 0) AS fnr FROM cells),
per_class AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
    support >= 100 AS sufficient FROM rates)"""


PER_CLASS = CONF + ", " + metrics_sql("conf")


def confusion(spark, sf):
    return E.confusion(src.predictions(spark, sf), CLASSES)


def classes(spark, sf):
    return E.per_class(confusion(spark, sf))


def labels(spark, names):
    return spark.createDataFrame([(n,) for n in names], "label string")


def trained(spark, sf):
    """Labels with training rows: all predicted labels but PortScan."""
    return src.predictions(spark, sf).where(F.col("y_pred") != "PortScan").select(
        F.col("y_pred").alias("label"))


@query("confusion", f"WITH {CONF} SELECT * FROM conf")
def confusion_query(spark, sf):
    return confusion(spark, sf)


@query("confusion_seen_classes", f"WITH {CONF} SELECT * FROM conf")
def confusion_seen_classes(spark, sf):
    return E.confusion(src.predictions(spark, sf))


@query("confusion_wide", f"""WITH {CONF} SELECT y_true AS "true\\predicted",
  CAST(sum(n) FILTER (y_pred = 'BENIGN') AS BIGINT) AS "BENIGN", CAST(sum(n) FILTER (y_pred = 'Bot') AS BIGINT) AS "Bot",
  CAST(sum(n) FILTER (y_pred = 'DoS Hulk') AS BIGINT) AS "DoS Hulk",
  CAST(sum(n) FILTER (y_pred = 'PortScan') AS BIGINT) AS "PortScan" FROM conf GROUP BY y_true""")
def confusion_wide(spark, sf):
    return E.confusion_wide(confusion(spark, sf), CLASSES)


@query("per_class_metrics", f"WITH {PER_CLASS} SELECT * FROM per_class")
def per_class_metrics(spark, sf):
    return classes(spark, sf)


OVERALL_SQL = """overall AS (SELECT CAST(sum(support) AS BIGINT) AS n_rows, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy,
  avg(coalesce(precision, 0)) AS macro_precision, avg(coalesce(recall, 0)) AS macro_recall, avg(f1) AS macro_f1,
  sum(coalesce(precision, 0) * support) / sum(support) AS weighted_precision,
  sum(coalesce(recall, 0) * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1
  FROM per_class)"""


@query("overall_metrics", f"""WITH {PER_CLASS}, {OVERALL_SQL}
SELECT n_rows, {', '.join(f'round({c}, 6) AS {c}' for c in ['accuracy', 'macro_precision', 'macro_recall', 'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1'])} FROM overall""")
def overall_metrics(spark, sf):
    return rounded(E.overall(classes(spark, sf))).withColumnRenamed("rows", "n_rows")


@query("macro_f1_min_support", f"""WITH {PER_CLASS}
SELECT round(avg(f1) FILTER (support >= 20000), 6) AS macro_f1_min_support,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (support >= 20000), '') AS sufficient_classes,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (support > 0 AND support < 20000), '') AS insufficient_classes,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (support = 0), '') AS absent_classes FROM per_class""")
def macro_f1_min_support(spark, sf):
    return rounded(E.macro_f1_at_support(classes(spark, sf), 20000))


BINARY = """two AS (SELECT CAST(coalesce(sum(n) FILTER (y_true <> 'BENIGN' AND y_pred <> 'BENIGN'), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(n) FILTER (y_true = 'BENIGN' AND y_pred <> 'BENIGN'), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(n) FILTER (y_true <> 'BENIGN' AND y_pred = 'BENIGN'), 0) AS BIGINT) AS fn,
  CAST(coalesce(sum(n) FILTER (y_true = 'BENIGN' AND y_pred = 'BENIGN'), 0) AS BIGINT) AS tn FROM conf)"""


@query("binary_view", f"""WITH {CONF}, {BINARY}
SELECT tp + fn AS attack_rows, tn + fp AS benign_rows, tp / CAST(tp + fn AS DOUBLE) AS attack_recall,
  fp / CAST(fp + tn AS DOUBLE) AS benign_false_positive_rate FROM two""")
def binary_view(spark, sf):
    return E.binary_view(confusion(spark, sf))


@query("binary_diagnostic", f"""WITH {CONF}, {BINARY},
r AS (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall FROM two)
SELECT tp, fp, fn, tn, tp + fn AS attack_rows, tn + fp AS benign_rows, precision, recall,
  CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy, fp / nullif(CAST(fp + tn AS DOUBLE), 0) AS benign_false_positive_rate,
  fn / nullif(CAST(tp + fn AS DOUBLE), 0) AS attack_miss_rate FROM r""")
def binary_diagnostic(spark, sf):
    return E.binary_diagnostic(confusion(spark, sf))


CLASS_SET_FLAGS = """train_labels AS (SELECT DISTINCT y_pred AS label FROM predictions WHERE y_pred <> 'PortScan'),
flagged AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, precision, recall, coalesce(f1, 0) AS f1,
  t.label IS NOT NULL AS in_train FROM per_class FULL JOIN train_labels t USING (label)),
members AS (SELECT *, unnest([{'name': 'test', 'member': support > 0}, {'name': 'seen', 'member': support > 0 AND in_train},
  {'name': 'union', 'member': support > 0 OR in_train}, {'name': 'supported', 'member': support >= 100}]) AS s FROM flagged)"""


@query("temporal_variants", f"""WITH {PER_CLASS}, {CLASS_SET_FLAGS}
SELECT s.name AS class_set, count(*) FILTER (s.member) AS n_classes,
  round(avg(coalesce(precision, 0)) FILTER (s.member), 6) AS macro_precision,
  round(avg(coalesce(recall, 0)) FILTER (s.member), 6) AS macro_recall, round(avg(f1) FILTER (s.member), 6) AS macro_f1,
  round(sum(tp) FILTER (s.member) / nullif(CAST(sum(support) FILTER (s.member) AS DOUBLE), 0), 6) AS restricted_accuracy
FROM members GROUP BY s.name""")
def temporal_variants(spark, sf):
    return rounded(E.temporal_variants(classes(spark, sf), trained(spark, sf)))


@query("unseen_report", f"""WITH {PER_CLASS}, {CLASS_SET_FLAGS}
SELECT string_agg(label, ',' ORDER BY label) FILTER (support > 0 AND NOT in_train) AS unseen_classes,
  count(*) FILTER (support > 0 AND NOT in_train) AS n_unseen,
  CAST(coalesce(sum(support) FILTER (support > 0 AND NOT in_train), 0) AS BIGINT) AS unseen_rows,
  coalesce(sum(support) FILTER (support > 0 AND NOT in_train), 0) / CAST(sum(support) AS DOUBLE) AS unseen_fraction FROM flagged""")
def unseen_report(spark, sf):
    return E.unseen_report(classes(spark, sf), trained(spark, sf))


@query("class_sets", f"""WITH {ctes.PREDICTIONS},
a AS (SELECT DISTINCT y_pred AS label FROM predictions), b AS (SELECT DISTINCT y_true AS label FROM predictions)
SELECT label, a.label IS NOT NULL AS in_train, b.label IS NOT NULL AS in_test FROM a FULL JOIN b USING (label)""")
def class_sets(spark, sf):
    p = src.predictions(spark, sf)
    return E.class_sets(p.select(F.col("y_pred").alias("label")), p.select(F.col("y_true").alias("label")))


HELD = ctes.PREDICTIONS + f""",
held AS (SELECT {ctes.family_of('y_true')} AS family, status, y_pred, count(*) AS n FROM predictions
  WHERE y_true <> 'BENIGN' GROUP BY ALL)"""


def held(spark, sf):
    return E.with_family(src.predictions(spark, sf).where(F.col("y_true") != "BENIGN"), "y_true").groupBy(
        "family", "status", "y_pred").agg(F.count(F.lit(1)).alias("n"))


DETECTION = """detection AS (SELECT family, status, CAST(sum(n) AS BIGINT) AS support,
  CAST(coalesce(sum(n) FILTER (y_pred <> 'BENIGN'), 0) AS BIGINT) AS detected FROM held GROUP BY 1, 2)"""


@query("detection_report", f"""WITH {HELD}, {DETECTION}
SELECT *, detected / CAST(support AS DOUBLE) AS detection_rate, (support - detected) / CAST(support AS DOUBLE) AS miss_rate FROM detection""")
def detection_report(spark, sf):
    return E.detection_report(held(spark, sf), ["family", "status"])


ATTRIBUTION = f"""flagged AS (SELECT family AS g, status, y_pred, {ctes.family_of('y_pred')} AS fam, CAST(sum(n) AS BIGINT) AS n
  FROM held WHERE y_pred <> 'BENIGN' GROUP BY ALL),
by_fam AS (SELECT g, status, fam, sum(n) AS n, min(y_pred) AS first_label FROM flagged GROUP BY ALL),
lab AS (SELECT *, row_number() OVER (PARTITION BY g, status ORDER BY n DESC, y_pred) AS r, sum(n) OVER (PARTITION BY g, status) AS total FROM flagged),
fa AS (SELECT *, row_number() OVER (PARTITION BY g, status ORDER BY n DESC, first_label) AS r FROM by_fam),
right_label AS (SELECT g, status, coalesce(sum(n) FILTER (y_pred = 'DoS Hulk'), 0) AS rl, coalesce(sum(n) FILTER (fam = 'PortScan'), 0) AS rf FROM flagged GROUP BY ALL),
attributed AS (SELECT l.g AS family, l.status, CAST(l.total AS BIGINT) AS attack_predictions, l.y_pred AS dominant_label,
  l.n / CAST(l.total AS DOUBLE) AS dominant_label_share, f.fam AS dominant_family, f.n / CAST(l.total AS DOUBLE) AS dominant_family_share,
  rl / CAST(l.total AS DOUBLE) AS label_attribution_rate, rf / CAST(l.total AS DOUBLE) AS family_attribution_rate
  FROM lab l JOIN fa f ON l.g = f.g AND l.status = f.status AND f.r = 1
  JOIN right_label q ON q.g = l.g AND q.status = l.status WHERE l.r = 1)"""


@query("attribution", f"WITH {HELD}, {ATTRIBUTION} SELECT * FROM attributed")
def attribution(spark, sf):
    return E.attribution(held(spark, sf), ["family", "status"], "DoS Hulk", "PortScan")


@query("known_class_metrics", f"""WITH {PER_CLASS}
SELECT count(*) AS n_classes, CAST(sum(support) AS BIGINT) AS n_rows, round(avg(coalesce(precision, 0)), 6) AS macro_precision,
  round(avg(coalesce(recall, 0)), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy_over_known_rows FROM per_class WHERE label <> 'PortScan'""")
def known_class_metrics(spark, sf):
    return rounded(E.known_class_metrics(classes(spark, sf), trained(spark, sf)), skip=(
        "accuracy_over_known_rows",)).withColumnRenamed("rows", "n_rows")


@query("matched_baseline", f"""WITH {PER_CLASS}, {BINARY}
SELECT count(*) AS n_classes, CAST(sum(support) AS BIGINT) AS n_rows, round(avg(coalesce(precision, 0)), 6) AS macro_precision,
  round(avg(coalesce(recall, 0)), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy_over_known_rows,
  (SELECT round(fp / CAST(fp + tn AS DOUBLE), 6) FROM two) AS benign_false_positive_rate FROM per_class WHERE label <> 'PortScan'""")
def matched_baseline(spark, sf):
    return rounded(E.matched_baseline(confusion(spark, sf), trained(spark, sf))).withColumnRenamed("rows", "n_rows")


FOLD_SQL = f"""t AS (SELECT y_true, y_pred, quantity, {ctes.family_of('y_true')} AS fam, {ctes.family_of('y_pred')} AS pf FROM predictions WHERE status = 'O'),
fams AS (SELECT DISTINCT fam AS held_out FROM t WHERE fam <> 'BENIGN'),
f AS (SELECT held_out, y_true, fam, CASE WHEN pf = held_out THEN 'BENIGN' ELSE y_pred END AS y_pred, count(*) AS n FROM t, fams GROUP BY ALL),
base AS (SELECT y_true, CASE WHEN quantity < 12 THEN 'BENIGN' ELSE y_pred END AS y_pred, count(*) AS n FROM t GROUP BY ALL),
det AS (SELECT held_out, sum(n) AS support, coalesce(sum(n) FILTER (y_pred <> 'BENIGN'), 0) AS detected FROM f WHERE fam = held_out GROUP BY held_out),
lab AS (SELECT held_out, y_pred, {ctes.family_of('y_pred')} AS pfam, sum(n) AS n FROM f WHERE fam = held_out AND y_pred <> 'BENIGN' GROUP BY ALL),
dom AS (SELECT held_out, arg_min(y_pred, (-n, y_pred)) AS dominant_label, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM lab GROUP BY held_out),
domf AS (SELECT held_out, arg_min(coalesce(pfam, 'unmapped'), (-n, first_label)) AS dominant_family
  FROM (SELECT held_out, pfam, sum(n) AS n, min(y_pred) AS first_label FROM lab GROUP BY ALL) GROUP BY held_out),
bin AS (SELECT held_out, coalesce(sum(n) FILTER (y_true = 'BENIGN'), 0) AS b, coalesce(sum(n) FILTER (y_true <> 'BENIGN'), 0) AS a,
  coalesce(sum(n) FILTER (y_true <> 'BENIGN' AND y_pred <> 'BENIGN'), 0) AS tp, coalesce(sum(n) FILTER (y_true = 'BENIGN' AND y_pred <> 'BENIGN'), 0) AS fp FROM f GROUP BY held_out),
known AS (SELECT held_out, label FROM fams, (SELECT DISTINCT y_true AS label, {ctes.family_of('y_true')} AS lf FROM predictions WHERE status = 'F') WHERE lf IS NULL OR lf <> held_out),
cls AS (SELECT held_out, label, sum(s) AS support, sum(p) AS predicted, sum(c) AS tp FROM (
  SELECT held_out, y_true AS label, n AS s, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS c FROM f UNION ALL SELECT held_out, y_pred, 0, n, 0 FROM f) GROUP BY ALL),
bcls AS (SELECT label, sum(s) AS support, sum(p) AS predicted, sum(c) AS tp FROM (
  SELECT y_true AS label, n AS s, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS c FROM base UNION ALL SELECT y_pred, 0, n, 0 FROM base) GROUP BY ALL),
k AS (SELECT held_out, count(*) AS known_classes, coalesce(sum(support), 0) AS known_rows, avg(coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0)) AS mp,
  avg(coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0)) AS mr, avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) AS mf, sum(tp) / CAST(sum(support) AS DOUBLE) AS acc
  FROM known LEFT JOIN cls USING (held_out, label) GROUP BY held_out),
bk AS (SELECT held_out, avg(coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0)) AS mp,
  avg(coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0)) AS mr, avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) AS mf, sum(tp) / CAST(sum(support) AS DOUBLE) AS acc
  FROM known LEFT JOIN bcls USING (label) GROUP BY held_out)"""


@query("fold_report", f"""WITH {ctes.PREDICTIONS}, {FOLD_SQL}
SELECT 'rule' AS learner, held_out, CAST(support AS BIGINT) AS support, CAST(detected AS BIGINT) AS detected, round(detected / CAST(support AS DOUBLE), 6) AS detection_rate,
  round((support - detected) / CAST(support AS DOUBLE), 6) AS miss_rate, dominant_label, round(share, 6) AS dominant_label_share, dominant_family,
  CAST(b AS BIGINT) AS benign_rows, CAST(a AS BIGINT) AS attack_rows, round(bin.tp / CAST(a AS DOUBLE), 6) AS attack_recall, round(bin.tp / CAST(bin.tp + bin.fp AS DOUBLE), 6) AS attack_precision,
  round(bin.fp / CAST(b AS DOUBLE), 6) AS benign_false_positive_rate, known_classes, CAST(known_rows AS BIGINT) AS known_rows,
  round(k.mp, 6) AS known_macro_precision, round(k.mr, 6) AS known_macro_recall, round(k.mf, 6) AS known_macro_f1, round(k.acc, 6) AS known_accuracy,
  round(bk.mp, 6) AS base_macro_precision, round(bk.mr, 6) AS base_macro_recall, round(bk.mf, 6) AS base_macro_f1, round(bk.acc, 6) AS base_accuracy,
  (SELECT round(sum(n) FILTER (y_true = 'BENIGN' AND y_pred <> 'BENIGN') / CAST(sum(n) FILTER (y_true = 'BENIGN') AS DOUBLE), 6) FROM base) AS base_benign_false_positive_rate,
  CASE WHEN support >= 1000 THEN 'high' WHEN support >= 100 THEN 'moderate' ELSE 'low_exploratory' END AS tier
FROM det LEFT JOIN dom USING (held_out) LEFT JOIN domf USING (held_out) JOIN bin USING (held_out) JOIN k USING (held_out) JOIN bk USING (held_out)""")
def fold_report(spark, sf):
    """The fold report with a fixed rule as the model, which never names the held-out family."""
    rows = src.predictions(spark, sf)
    test = E.with_family(rows.where("status = 'O'"), "y_true").withColumn("_pf", E.family_of(F.col("y_pred")))
    families = test.where("family <> 'BENIGN'").select(F.col("family").alias("held_out")).distinct()
    n = F.count(F.lit(1)).alias("n")
    folds = test.join(F.broadcast(families)).select("held_out", "y_true", F.when(F.col("_pf") == F.col("held_out"), "BENIGN").otherwise(
        F.col("y_pred")).alias("y_pred")).groupBy("held_out", "y_true", "y_pred").agg(n)
    base = test.select(F.lit("").alias("held_out"), "y_true", F.when(F.col("quantity") < 12, "BENIGN").otherwise(
        F.col("y_pred")).alias("y_pred")).groupBy("held_out", "y_true", "y_pred").agg(n)
    conf = folds.unionByName(base).withColumn("learner", F.lit("rule"))
    return rounded(E.fold_report(conf, rows.where("status = 'F'").select(F.col("y_true").alias("label"))))


@query("support_by_family", f"""WITH {ctes.PREDICTIONS},
f AS (SELECT {ctes.family_of('y_true')} AS family, status FROM predictions)
SELECT family, count(*) AS total_support, count(*) FILTER (status = 'F') AS train_support, count(*) FILTER (status = 'O') AS test_support,
  CASE WHEN count(*) FILTER (status = 'O') >= 1000 THEN 'high' WHEN count(*) FILTER (status = 'O') >= 100 THEN 'moderate' ELSE 'low_exploratory' END AS tier
FROM f WHERE family IS NOT NULL AND family <> 'BENIGN' GROUP BY family""")
def support_by_family(spark, sf):
    return E.support_by_family(src.predictions(spark, sf).withColumn(
        "split", F.when(F.col("status") == "F", "train").otherwise("test")), "y_true", "split")


@query("with_family", f"""WITH {ctes.LIVE}
SELECT predicted_label, {ctes.family_of('predicted_label')} AS family, count(*) AS n FROM live GROUP BY ALL""")
def with_family(spark, sf):
    return E.with_family(src.live_flows(spark, sf), "predicted_label").groupBy(
        "predicted_label", "family").agg(F.count(F.lit(1)).alias("n"))


@query("unmapped_labels", f"""WITH {ctes.RARE}
SELECT label, count(*) AS n FROM rare WHERE {ctes.family_of('label')} IS NULL GROUP BY label""")
def unmapped_labels(spark, sf):
    return E.unmapped_labels(src.rare_features(spark, sf), "label")


@query("family_summary", f"""WITH {HELD}, {DETECTION}, {ATTRIBUTION},
folds AS (SELECT d.family, d.status, CASE d.status WHEN 'F' THEN 0 ELSE 1 END AS o, detected / CAST(support AS DOUBLE) AS rate, dominant_label
  FROM detection d LEFT JOIN attributed a USING (family, status)),
tops AS (SELECT family, dominant_label, count(*) AS n, min(o) AS o FROM folds GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, o) AS r FROM tops)
SELECT f.family, count(*) AS models, round(avg(rate), 6) AS mean_detection, round(quantile_cont(rate, 0.5), 6) AS median_detection,
  round(min(rate), 6) AS min_detection, round(max(rate), 6) AS max_detection, any_value(t.dominant_label) AS dominant_label, any_value(t.n) AS dominant_models
FROM folds f JOIN top t ON t.family = f.family AND t.r = 1 GROUP BY f.family""")
def family_summary(spark, sf):
    h = held(spark, sf)
    folds = E.detection_report(h, ["family", "status"]).join(
        E.attribution(h, ["family", "status"]).select("family", "status", "dominant_label"),
        ["family", "status"], "left").withColumn(
        "model_order", F.when(F.col("status") == "F", 0).otherwise(1))
    return rounded(E.family_summary(folds))


@query("prediction_summary", f"""WITH {ctes.LIVE}
SELECT count(*) AS support, count(*) FILTER (predicted_label = 'BENIGN') AS predicted_benign,
  count(*) FILTER (predicted_label <> 'BENIGN') AS predicted_attack,
  count(*) FILTER (predicted_label <> 'BENIGN') / CAST(count(*) AS DOUBLE) AS detection_rate,
  min(prediction_confidence) AS confidence_min, max(prediction_confidence) AS confidence_max,
  round(quantile_cont(prediction_confidence, 0.5), 6) AS confidence_median FROM live""")
def prediction_summary(spark, sf):
    summary = E.prediction_summary(src.live_flows(spark, sf), "predicted_label", "prediction_confidence")
    return summary.withColumn("confidence_median", F.round("confidence_median", 6))


@query("prediction_distribution", f"""WITH {ctes.LIVE}
SELECT 'label' AS dimension, predicted_label AS value, count(*) AS n FROM live GROUP BY 2
UNION ALL SELECT 'family', coalesce({ctes.family_of('predicted_label')}, 'unmapped'), count(*) FROM live
WHERE predicted_label <> 'BENIGN' GROUP BY 2""")
def prediction_distribution(spark, sf):
    return E.prediction_distribution(src.live_flows(spark, sf), "predicted_label")


@query("report_violations", f"""WITH {PER_CLASS}, {OVERALL_SQL}
SELECT 'support does not add up to rows' AS violation FROM overall WHERE (SELECT sum(support) FROM per_class) <> n_rows + 1
UNION ALL SELECT 'macro_f1 differs from the matrix' FROM overall WHERE abs(macro_f1 + 0.01 - (SELECT avg(f1) FROM per_class)) > 0.000001""")
def report_violations(spark, sf):
    c = classes(spark, sf)
    tampered = E.overall(c).withColumns({"rows": F.col("rows") + 1, "macro_f1": F.col("macro_f1") + 0.01})
    return E.report_violations(c, tampered)


def by_status(status: str, prefix: str) -> str:
    inner = metrics_sql(f"{prefix}conf").replace("per_class AS", f"{prefix}classes AS")
    for name in ("sums", "cells", "rates"):
        inner = inner.replace(f"{name} AS", f"{prefix}{name} AS").replace(f"FROM {name}", f"FROM {prefix}{name}")
    return (f"{prefix}found AS (SELECT y_true, y_pred, count(*) AS n FROM predictions WHERE status = '{status}' GROUP BY 1, 2), "
            f"{prefix}conf AS (SELECT t.label AS y_true, p.label AS y_pred, coalesce(f.n, 0) AS n FROM names t CROSS JOIN names p "
            f"LEFT JOIN {prefix}found f ON f.y_true = t.label AND f.y_pred = p.label), {inner}")


TWO_RUNS = ctes.PREDICTIONS + ", names AS (SELECT unnest(['BENIGN', 'Bot', 'DoS Hulk', 'PortScan']) AS label), " \
    + by_status("F", "a_") + ", " + by_status("O", "b_")


def run_classes(spark, sf, status):
    return E.per_class(E.confusion(src.predictions(spark, sf).where(F.col("status") == status), CLASSES))


@query("compare_classes", f"""WITH {TWO_RUNS}
SELECT b.label, b.support, round(b.f1, 6) AS other_f1, round(a.f1, 6) AS base_f1, round(b.f1 - a.f1, 6) AS delta_f1,
  CASE WHEN b.label = 'PortScan' THEN 'unseen' WHEN b.support < 100 THEN 'low support' WHEN b.f1 - a.f1 < -0.3 THEN 'collapse'
    WHEN b.f1 - a.f1 < -0.05 THEN 'moderate degradation' ELSE 'stable' END AS status
FROM b_classes b LEFT JOIN a_classes a USING (label) WHERE b.support > 0""")
def compare_classes(spark, sf):
    return rounded(E.compare_classes(run_classes(spark, sf, "F"), run_classes(spark, sf, "O"),
                                     trained(spark, sf)))


@query("compare_models", f"""WITH {TWO_RUNS},
a AS (SELECT avg(f1) AS macro_f1, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy FROM a_classes),
b AS (SELECT avg(f1) AS macro_f1, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy FROM b_classes),
m AS (SELECT 'macro_f1' AS metric, a.macro_f1 AS base, b.macro_f1 AS other FROM a, b UNION ALL SELECT 'accuracy', a.accuracy, b.accuracy FROM a, b)
SELECT 'rule' AS model, metric, round(base, 6) AS base, round(other, 6) AS other, round(other - base, 6) AS difference,
  round((other - base) / base * 100, 6) AS relative_pct FROM m""")
def compare_models(spark, sf):
    def summary(status):
        return E.overall(run_classes(spark, sf, status)).withColumn("model", F.lit("rule"))
    return rounded(E.compare_models(summary("F"), summary("O"), ["macro_f1", "accuracy"]))


@query("stored_vs_recomputed", f"""WITH {TWO_RUNS},
a AS (SELECT avg(f1) AS macro_f1 FROM a_classes), b AS (SELECT avg(f1) AS macro_f1 FROM b_classes),
s AS (SELECT 'macro_f1' AS field, a.macro_f1 AS stored, b.macro_f1 AS recomputed FROM a, b
  UNION ALL SELECT 'avg_latency_ms', (SELECT avg(quantity) FROM predictions WHERE status = 'F'), (SELECT avg(quantity) FROM predictions WHERE status = 'O'))
SELECT 'rule' AS model, field, round(stored, 6) AS stored, round(recomputed, 6) AS recomputed, round(recomputed - stored, 6) AS difference,
  field <> 'avg_latency_ms' AS comparable FROM s""")
def stored_vs_recomputed(spark, sf):
    def record(status):
        p = src.predictions(spark, sf).where(F.col("status") == status)
        return E.overall(run_classes(spark, sf, status)).select(F.lit("rule").alias("model"), "macro_f1").join(
            p.agg(F.avg("quantity").alias("avg_latency_ms")))
    return rounded(E.stored_vs_recomputed(record("F"), record("O"), ["macro_f1", "avg_latency_ms"]))


# -- lab runs -------------------------------------------------------------------------

@query("run_flow_counts", f"""WITH {ctes.LIVE}
SELECT run_id, count(*) AS flow_count, count(*) FILTER (validation_status = 'VALID') AS valid_flow_count,
  count(*) FILTER (validation_status <> 'VALID') AS invalid_flow_count,
  count(*) FILTER (expected_binary_label = 'UNLABELLED') AS unlabelled_flow_count,
  count(*) FILTER (validation_status = 'VALID' AND expected_binary_label <> 'UNLABELLED') AS evaluable_flow_count
FROM live GROUP BY run_id""")
def run_flow_counts(spark, sf):
    return L.run_flow_counts(src.live_flows(spark, sf))


@query("run_status_counts", f"""WITH {ctes.LIVE} SELECT run_id, validation_status, count(*) AS n FROM live GROUP BY ALL""")
def run_status_counts(spark, sf):
    return L.run_status_counts(src.live_flows(spark, sf))


@query("evaluable_flows", f"""WITH {ctes.LIVE} SELECT row_id, run_id, expected_binary_label, predicted_label FROM evaluable""")
def evaluable_flows(spark, sf):
    return L.evaluable(src.live_flows(spark, sf)).select("row_id", "run_id", "expected_binary_label", "predicted_label")


@query("benign_baseline_run", f"""WITH {ctes.LIVE}
SELECT run_id, count(*) AS valid_benign_flows, count(*) FILTER (predicted_label = 'BENIGN') AS predicted_benign,
  count(*) FILTER (predicted_label <> 'BENIGN') AS predicted_attack,
  count(*) FILTER (predicted_label <> 'BENIGN') / CAST(count(*) AS DOUBLE) AS benign_false_positive_rate,
  CASE WHEN count(*) < 30 THEN 'benign denominator is ' || count(*) || ' (below 30); report raw counts rather than rates alone' END AS rate_support_warning
FROM evaluable WHERE expected_binary_label = 'BENIGN' GROUP BY run_id""")
def benign_baseline_run(spark, sf):
    return L.benign_baseline(src.live_flows(spark, sf))


@query("false_positive_labels", f"""WITH {ctes.LIVE} SELECT run_id, predicted_label AS label, count(*) AS n FROM evaluable
WHERE expected_binary_label = 'BENIGN' AND predicted_label <> 'BENIGN' GROUP BY ALL""")
def false_positive_labels(spark, sf):
    return L.false_positive_labels(src.live_flows(spark, sf))


INVENTORY = ctes.LIVE + """,
counted AS (SELECT run_id, scenario, count(*) AS total_flows, count(*) FILTER (validation_status = 'VALID') AS valid_flows,
  count(*) FILTER (validation_status = 'VALID' AND expected_binary_label <> 'UNLABELLED') AS evaluable_flows,
  count(*) FILTER (validation_status = 'VALID' AND expected_binary_label = 'ATTACK') AS attack_flows,
  count(*) FILTER (validation_status = 'VALID' AND expected_binary_label = 'BENIGN') AS benign_flows,
  count(*) FILTER (expected_binary_label = 'UNLABELLED') AS unlabelled_flows FROM live GROUP BY 1, 2),
inventory AS (SELECT *, CASE scenario WHEN 'benign' THEN benign_flows ELSE attack_flows END AS support,
  CASE WHEN CASE scenario WHEN 'benign' THEN benign_flows ELSE attack_flows END >= CASE scenario WHEN 'ssh' THEN 30 ELSE 300 END
    THEN 'ACCEPTED' ELSE 'INVALID_LOW_SUPPORT' END AS acceptance FROM counted)"""


@query("run_inventory", f"WITH {INVENTORY} SELECT * FROM inventory")
def run_inventory(spark, sf):
    return L.run_inventory(src.live_flows(spark, sf))


@query("scenario_support", f"""WITH {INVENTORY}
SELECT scenario, count(*) AS run_count, CAST(sum(total_flows) AS BIGINT) AS total_flows, CAST(sum(evaluable_flows) AS BIGINT) AS evaluable_flows,
  min(support) AS min_support, max(support) AS max_support, round_even(avg(support), 1) AS mean_support, quantile_cont(CAST(support AS DOUBLE), 0.5) AS median_support
FROM inventory WHERE acceptance = 'ACCEPTED' GROUP BY scenario""")
def scenario_support(spark, sf):
    return L.scenario_support(L.run_inventory(src.live_flows(spark, sf)))


@query("class_distribution", f"""WITH {INVENTORY}, ok AS (SELECT * FROM inventory WHERE acceptance = 'ACCEPTED')
SELECT 'binary' AS dimension, 'BENIGN' AS value, CAST(sum(benign_flows) AS BIGINT) AS n FROM ok
UNION ALL SELECT 'binary', 'ATTACK', CAST(sum(attack_flows) AS BIGINT) FROM ok
UNION ALL SELECT 'family', CASE scenario WHEN 'portscan' THEN 'PortScan' ELSE 'Brute Force' END, CAST(sum(attack_flows) AS BIGINT)
FROM ok WHERE scenario <> 'benign' GROUP BY 2""")
def class_distribution(spark, sf):
    return L.class_distribution(L.run_inventory(src.live_flows(spark, sf)))


@query("run_level_partition", f"""WITH {INVENTORY}
SELECT scenario, run_id, CASE row_number() OVER (PARTITION BY scenario ORDER BY run_id DESC) WHEN 1 THEN 'validation' ELSE 'train' END AS partition
FROM inventory WHERE acceptance = 'ACCEPTED'""")
def run_level_partition(spark, sf):
    return L.run_level_partition(L.run_inventory(src.live_flows(spark, sf)).where(F.col("acceptance") == "ACCEPTED"))


@query("aggregate_runs", f"""WITH {ctes.LIVE}, kept AS (SELECT e.* FROM evaluable e WHERE NOT excluded),
c AS (SELECT run_id, scenario, count(*) AS evaluable_flows,
  count(*) FILTER (expected_binary_label = 'ATTACK') AS a, count(*) FILTER (expected_binary_label = 'ATTACK' AND predicted_label <> 'BENIGN') AS tp,
  count(*) FILTER (expected_binary_label = 'BENIGN') AS b, count(*) FILTER (expected_binary_label = 'BENIGN' AND predicted_label <> 'BENIGN') AS fp
  FROM kept GROUP BY 1, 2),
l AS (SELECT run_id, predicted_label, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, predicted_label) AS r FROM kept
  WHERE expected_binary_label = 'ATTACK' AND predicted_label <> 'BENIGN' GROUP BY 1, 2)
SELECT c.run_id, scenario, evaluable_flows, tp / nullif(CAST(a AS DOUBLE), 0) AS attack_detection_rate, a AS attack_denominator,
  fp / nullif(CAST(b AS DOUBLE), 0) AS benign_false_positive_rate, b AS benign_denominator,
  nullif(concat_ws('; ', CASE WHEN a > 0 AND a < 30 THEN 'attack denominator is ' || a END, CASE WHEN b > 0 AND b < 30 THEN 'benign denominator is ' || b END), '')
    || ' (below 30); report raw counts rather than rates alone' AS rate_support_warning, l.predicted_label AS dominant_label
FROM c LEFT JOIN l ON l.run_id = c.run_id AND l.r = 1""")
def aggregate_runs(spark, sf):
    return L.aggregate_runs(src.live_flows(spark, sf))


def models():
    return {"model_a": F.col("predicted_label") != "BENIGN", "model_b": F.col("model_b_score") >= 0.5}


def outcomes_sql(keys: str) -> str:
    return f"""WITH {ctes.LIVE},
u AS (SELECT run_id, scenario, unnest([{{'m': 'model_a', 'p': predicted_label <> 'BENIGN'}}, {{'m': 'model_b', 'p': model_b_score >= 0.5}}]) AS x FROM evaluable),
c AS (SELECT {keys}, x.m AS model, count(*) FILTER (x.p) AS positives, count(*) AS n FROM u GROUP BY ALL),
w AS (SELECT *, positives / CAST(n AS DOUBLE) AS p, 1.959963984540054 AS z FROM c),
h AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS centre, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS half FROM w)
SELECT {keys}, model, positives, n, CASE scenario WHEN 'benign' THEN 'benign_false_positive_rate' ELSE 'attack_detection_rate' END AS quantity,
  round(p, 6) AS rate, round(least(p, greatest(0, centre - half)), 6) AS wilson_low, round(greatest(p, least(1, centre + half)), 6) AS wilson_high FROM h"""


@query("scenario_results", outcomes_sql("scenario"))
def scenario_results(spark, sf):
    return rounded(L.model_outcomes(src.live_flows(spark, sf), ["scenario"], models()))


@query("per_run_results", outcomes_sql("run_id, scenario"))
def per_run_results(spark, sf):
    return rounded(L.model_outcomes(src.live_flows(spark, sf), ["run_id", "scenario"], models()))


PAIRED = ctes.LIVE + """,
pairs AS (SELECT a.row_id, a.expected_binary_label = 'ATTACK' AS attack, a.predicted_label <> 'BENIGN' AS a, b.model_b_score >= 0.5 AS b
  FROM evaluable a JOIN evaluable b USING (row_id)),
paired AS (SELECT CASE WHEN attack THEN 'attack' ELSE 'benign' END AS truth, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS a_only,
  count(*) FILTER (NOT a AND b) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) AS n FROM pairs GROUP BY 1)"""


def pairs(spark, sf):
    live = L.evaluable(src.live_flows(spark, sf))
    return L.paired_predictions(live.select("row_id", "run_id", "expected_binary_label", "predicted_label"),
                                live.select("row_id", "model_b_score"), "row_id")


def paired_counts_of(spark, sf):
    return L.paired_counts(pairs(spark, sf), F.col("expected_binary_label") == "ATTACK",
                           F.col("predicted_label") != "BENIGN", F.col("model_b_score") >= 0.5)


@query("paired_predictions", f"WITH {PAIRED} SELECT * FROM pairs")
def paired_predictions(spark, sf):
    return pairs(spark, sf).select(
        "row_id", (F.col("expected_binary_label") == "ATTACK").alias("attack"),
        (F.col("predicted_label") != "BENIGN").alias("a"), (F.col("model_b_score") >= 0.5).alias("b"))


@query("paired_counts", f"WITH {PAIRED} SELECT * FROM paired")
def paired_counts(spark, sf):
    return paired_counts_of(spark, sf)


@query("mcnemar_by_run", f"""WITH {ctes.LIVE},
d AS (SELECT run_id, count(*) FILTER (predicted_label <> 'BENIGN' AND model_b_score < 0.5) AS b,
  count(*) FILTER (predicted_label = 'BENIGN' AND model_b_score >= 0.5) AS c FROM evaluable GROUP BY run_id)
SELECT run_id, b, c, round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
  lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) AS p_value FROM d WHERE b + c > 0""")
def mcnemar_by_run(spark, sf):
    a, b = F.col("predicted_label") != "BENIGN", F.col("model_b_score") >= 0.5
    counts = L.evaluable(src.live_flows(spark, sf)).groupBy("run_id").agg(
        F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    return counts.where(F.col("b") + F.col("c") > 0).select(
        "run_id", "b", "c", F.round(L.mcnemar_p(F.col("b"), F.col("c")), 6).alias("p_value"))


def wilson_sql(k, n, name):
    """Score interval of k of n at the 95 % level, as two columns."""
    z = repr(contract.WILSON_Z)
    p, n = f"({k}) / CAST({n} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    centre = f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} / (1 + {z} * {z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    return (f"round(least({p}, greatest(0, {centre} - {half})), 6) AS {name}_low, "
            f"round(greatest({p}, least(1, {centre} + {half})), 6) AS {name}_high")


@query("pooled_binary", f"""WITH {ctes.LIVE},
c AS (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn
  FROM (SELECT expected_binary_label = 'ATTACK' AS e, model_b_score >= 0.5 AS p FROM evaluable)),
by_score AS (SELECT model_b_score AS s, count(*) FILTER (expected_binary_label = 'ATTACK') AS pos, count(*) FILTER (expected_binary_label <> 'ATTACK') AS neg
  FROM evaluable WHERE model_b_score IS NOT NULL GROUP BY 1),
running AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM by_score),
rank_quality AS (SELECT sum(CAST(neg AS DOUBLE) * (cp - pos / 2.0)) / (max(p) * CAST(max(n) AS DOUBLE)) AS auc,
  sum(pos / CAST(p AS DOUBLE) * (cp / CAST(cp + cn AS DOUBLE))) AS ap FROM running)
SELECT c.*, round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1,
  round((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS balanced_accuracy, round(tp / CAST(tp + fn AS DOUBLE), 6) AS attack_recall,
  round(tp / CAST(tp + fp AS DOUBLE), 6) AS attack_precision, round(fp / CAST(fp + tn AS DOUBLE), 6) AS benign_fpr, round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc,
  {wilson_sql('tp', 'tp + fn', 'recall')}, {wilson_sql('fp', 'fp + tn', 'fpr')} FROM c, rank_quality""")
def pooled_binary(spark, sf):
    return rounded(L.pooled_binary(L.evaluable(src.live_flows(spark, sf)), F.col("expected_binary_label") == "ATTACK",
                                   F.col("model_b_score") >= 0.5, "model_b_score"))


MANIFEST_SQL = """manifests AS (SELECT 'run-' || (o_orderkey % 8) AS run_id, count(*) AS orders,
  CASE o_orderkey % 8 WHEN 0 THEN 'run_level_uniform' ELSE 'per_flow_selector' END AS mode,
  CASE WHEN o_orderkey % 8 = 0 THEN 'BENIGN' ELSE 'ATTACK' END AS manifest_label,
  CASE WHEN o_orderkey % 8 < 4 THEN 'BENIGN' ELSE 'UNLABELLED' END AS unmatched_policy,
  CASE o_orderkey % 8 WHEN 1 THEN '10.0.0.7' WHEN 2 THEN '' END AS sip, CASE WHEN o_orderkey % 8 = 2 THEN '192.168.1.5' END AS dip,
  CASE WHEN o_orderkey % 8 IN (3, 4) THEN [22, 80] END AS ports, CASE WHEN o_orderkey % 8 >= 4 AND o_orderkey % 8 < 7 THEN ['6', '17'] END AS protocols
  FROM orders GROUP BY o_orderkey % 8)"""


@query("label_by_manifest", f"""WITH {ctes.FLOWS}, {MANIFEST_SQL},
f AS (SELECT *, 'run-' || (flow_id % 8) AS run_id FROM flows)
SELECT f.run_id, CASE WHEN mode = 'run_level_uniform' THEN manifest_label
  WHEN NOT (coalesce(sip, '') = '' AND coalesce(dip, '') = '' AND ports IS NULL AND protocols IS NULL)
    AND (coalesce(sip, '') = '' OR source_ip = sip) AND (coalesce(dip, '') = '' OR destination_ip = dip)
    AND (ports IS NULL OR list_contains(ports, destination_port)) AND (protocols IS NULL OR list_contains(protocols, protocol)) THEN 'ATTACK'
  WHEN unmatched_policy = 'BENIGN' THEN 'BENIGN' ELSE 'UNLABELLED' END AS expected_binary_label, count(*) AS n
FROM f JOIN manifests m ON m.run_id = f.run_id GROUP BY ALL""")
def label_by_manifest(spark, sf):
    run = F.col("o_orderkey") % 8
    manifests = src.table(spark, sf, "orders").select(run.alias("run")).distinct().select(
        F.concat(F.lit("run-"), F.col("run").cast("string")).alias("run_id"),
        F.when(F.col("run") == 0, "run_level_uniform").otherwise("per_flow_selector").alias("mode"),
        F.when(F.col("run") == 0, "BENIGN").otherwise("ATTACK").alias("expected_binary_label"),
        F.when(F.col("run") < 4, "BENIGN").otherwise("UNLABELLED").alias("unmatched_policy"),
        F.struct(
            F.when(F.col("run") == 1, "10.0.0.7").when(F.col("run") == 2, "").alias("source_ip"),
            F.when(F.col("run") == 2, "192.168.1.5").alias("destination_ip"),
            F.when(F.col("run").isin(3, 4), F.array(F.lit(22), F.lit(80))).alias("destination_ports"),
            F.when(F.col("run").between(4, 6), F.array(F.lit("6"), F.lit("17"))).alias("protocols"))
        .alias("selector"))
    flows = src.flows(spark, sf).withColumn(
        "run_id", F.concat(F.lit("run-"), (F.col("flow_id") % 8).cast("string")))
    return L.label_by_manifest(flows, manifests).groupBy("run_id", "expected_binary_label").agg(
        F.count(F.lit(1)).alias("n"))


# -- scores -----------------------------------------------------------------------------

SCORED = ctes.PREDICTIONS + f""",
scored AS (SELECT *, quantity / (quantity + tax * 100 + 10) AS s, y_true <> 'BENIGN' AS attack, y_pred = 'BENIGN' AS missed,
  {ctes.family_of('y_true')} AS family FROM predictions)"""


def scored(spark, sf):
    return E.with_family(src.predictions(spark, sf), "y_true").withColumns({
        "s": F.col("quantity") / (F.col("quantity") + F.col("tax") * 100 + 10),
        "attack": F.col("y_true") != "BENIGN", "missed": F.col("y_pred") == "BENIGN"})


def ranking_sql(groups: str, score: str, positive: str) -> str:
    return f"""WITH {SCORED},
c AS (SELECT {groups} AS g, {score} AS score, count(*) FILTER ({positive}) AS pos, count(*) FILTER (NOT ({positive})) AS neg FROM scored GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY score DESC) AS up, sum(neg) OVER (PARTITION BY g ORDER BY score DESC) AS un,
  sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM c)
SELECT g, round(sum(neg * (up - pos + pos / 2.0)) / (CAST(any_value(p) AS DOUBLE) * any_value(n)), 6) AS roc_auc,
  round(sum(pos / CAST(p AS DOUBLE) * (up / CAST(up + un AS DOUBLE))), 6) AS average_precision, CAST(any_value(p) AS BIGINT) AS positives, CAST(any_value(n) AS BIGINT) AS negatives
FROM r GROUP BY g"""


@query("roc_auc_and_average_precision", ranking_sql("status", "s", "attack"))
def roc_auc_and_average_precision(spark, sf):
    df = scored(spark, sf).withColumnRenamed("status", "g")
    return rounded(R.ranking_quality(df, ["g"], "s", F.col("attack")))


@query("roc_auc_tied_scores", ranking_sql("status", "score", "y_pred = y_true"))
def roc_auc_tied_scores(spark, sf):
    df = scored(spark, sf).withColumnRenamed("status", "g")
    return rounded(R.ranking_quality(df, ["g"], "score", F.col("y_pred") == F.col("y_true")))


RATES = [0.001, 0.005, 0.01, 0.02, 0.05]
THRESHOLDS = SCORED + f""",
rates AS (SELECT unnest({RATES}) AS rate),
thresholds AS (SELECT rate, (SELECT quantile_cont(s, r.rate) FROM scored WHERE NOT attack) AS threshold FROM rates r)"""
THRESHOLDS = SCORED + f""",
q AS (SELECT quantile_cont(s, {RATES}) AS v FROM scored WHERE NOT attack),
thresholds AS (SELECT unnest({RATES}) AS rate, unnest(v) AS threshold FROM q),
flags AS (SELECT s.*, rate, threshold, s.s < threshold AS f FROM scored s CROSS JOIN thresholds)"""


def thresholds(spark, sf):
    return R.benign_thresholds(scored(spark, sf).where(~F.col("attack")), "s", RATES)


@query("anomaly_thresholds", f"WITH {THRESHOLDS} SELECT rate, round(threshold, 6) AS threshold FROM thresholds")
def anomaly_thresholds(spark, sf):
    return thresholds(spark, sf).select(F.explode("thresholds").alias("t")).select(
        "t.rate", F.round("t.threshold", 6).alias("threshold"))


@query("operating_points", f"""WITH {THRESHOLDS},
c AS (SELECT rate, threshold, count(*) FILTER (f AND attack) AS tp, count(*) FILTER (f AND NOT attack) AS fp,
  count(*) FILTER (attack) AS a, count(*) FILTER (NOT attack) AS b FROM flags GROUP BY 1, 2),
m AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, tp / CAST(a AS DOUBLE) AS recall FROM c)
SELECT rate, round(threshold, 6) AS threshold, round(fp / CAST(b AS DOUBLE), 6) AS observed_benign_rate, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m""")
def operating_points(spark, sf):
    return rounded(R.operating_points(scored(spark, sf), thresholds(spark, sf), "s", "attack"), skip=("rate",))


@query("flag_rate_by_family", f"""WITH {THRESHOLDS}
SELECT rate, family, count(*) AS support, count(*) FILTER (f) AS flagged, round(count(*) FILTER (f) / CAST(count(*) AS DOUBLE), 6) AS flag_rate
FROM flags GROUP BY 1, 2""")
def flag_rate_by_family(spark, sf):
    return rounded(R.flag_rate_by_family(scored(spark, sf), thresholds(spark, sf), "s", "family"), skip=("rate",))


@query("hybrid_recovery", f"""WITH {THRESHOLDS}
SELECT family, rate, count(*) AS support, count(*) FILTER (missed) AS supervised_missed, count(*) FILTER (missed AND f) AS recovered,
  round(count(*) FILTER (missed AND f) / nullif(CAST(count(*) FILTER (missed) AS DOUBLE), 0), 6) AS recovery_rate,
  round(count(*) FILTER (f) / CAST(count(*) AS DOUBLE), 6) AS anomaly_flag_rate,
  round(count(*) FILTER (NOT missed OR f) / CAST(count(*) AS DOUBLE), 6) AS combined_detection FROM flags WHERE attack GROUP BY 1, 2""")
def hybrid_recovery(spark, sf):
    return rounded(R.hybrid_recovery(scored(spark, sf).where(F.col("attack")), thresholds(spark, sf),
                                     "s", "family", "missed"), skip=("rate",))


@query("contamination_baseline", f"""WITH {SCORED},
cut AS (SELECT quantile_cont(s, 0.2) AS t FROM scored WHERE status = 'F' AND NOT attack),
c AS (SELECT count(*) FILTER (s < t AND attack) AS tp, count(*) FILTER (s < t AND NOT attack) AS fp, count(*) FILTER (attack) AS a, count(*) FILTER (NOT attack) AS b
  FROM scored CROSS JOIN cut WHERE status = 'O')
SELECT 0.2 AS contamination, round(tp / CAST(a AS DOUBLE), 6) AS attack_recall, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(fp / CAST(b AS DOUBLE), 6) AS benign_flag_rate FROM c""")
def contamination_baseline(spark, sf):
    s = scored(spark, sf)
    return rounded(R.contamination_baseline(
        s.where((F.col("status") == "F") & ~F.col("attack")), s.where(F.col("status") == "O"), "s", "attack", 0.2))
