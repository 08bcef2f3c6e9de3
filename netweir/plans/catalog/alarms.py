"""Alarm, incident and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.operators import alarms as A
from netweir.operators import incidents as I
from netweir.plans.catalog import ctes
from netweir.plans.catalog.registry import query
from netweir.plans.incident_report import top_incident_groups
from netweir.sources import adapters as src

DAY, THREE_DAYS = 86400, 259200


def micros(df, *columns):
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query("incident_top_groups", f"""WITH {ctes.incidents(DAY)}
SELECT source_ip, attack_type, count(*) AS incidents, CAST(sum(alarm_count) AS BIGINT) AS alarms,
  {ctes.severity_name(f"max({ctes.severity_rank('severity')})")} AS severity,
  min(first_us) AS first_seen, max(last_us) AS last_seen
FROM incidents WHERE source_ip IS NOT NULL GROUP BY source_ip, attack_type
ORDER BY alarms DESC, source_ip, attack_type NULLS LAST LIMIT 20""")
def incident_top_groups(spark, sf):
    return micros(top_incident_groups(src.flows(spark, sf), DAY, 20), "first_seen", "last_seen")


@query("severity_of_flows", f"""WITH {ctes.FLOWS}
SELECT flow_id, {ctes.SEVERITY} AS severity FROM flows""")
def severity_of_flows(spark, sf):
    limits = spark.createDataFrame([(0.95, 0.85, 0.70)],
                                   "critical_min double, high_min double, medium_min double")
    return A.severity_from(src.flows(spark, sf), limits).select("flow_id", "severity")


@query("alarms_raised", f"""WITH {ctes.ALARMS}
SELECT alarm_id, created_us AS created_at, severity, source_ip, destination_ip, attack_type FROM alarms""")
def alarms_raised(spark, sf):
    return micros(src.alarms(spark, sf), "created_at").select(
        "alarm_id", "created_at", "severity", "source_ip", "destination_ip", "attack_type")


@query("flow_label_of_detection", f"""WITH {ctes.FLOWS},
c AS (SELECT *, CASE predicted_label WHEN 'ATTACK' THEN 'KNOWN_ATTACK' WHEN 'UNKNOWN' THEN 'SUSPICIOUS'
  ELSE 'BENIGN' END AS detection_class FROM flows)
SELECT detection_class, CASE detection_class WHEN 'KNOWN_ATTACK' THEN 'ATTACK'
  WHEN 'SUSPICIOUS' THEN 'UNKNOWN' ELSE 'BENIGN' END AS flow_label, count(*) AS n FROM c GROUP BY 1, 2""")
def flow_label_of_detection(spark, sf):
    detection = (F.when(F.col("predicted_label") == "ATTACK", "KNOWN_ATTACK")
                 .when(F.col("predicted_label") == "UNKNOWN", "SUSPICIOUS").otherwise("BENIGN"))
    return src.flows(spark, sf).select(detection.alias("detection_class")).withColumn(
        "flow_label", A.flow_label(F.col("detection_class"))).groupBy(
        "detection_class", "flow_label").agg(F.count(F.lit(1)).alias("n"))


@query("alarm_lifecycle", f"""WITH {ctes.LIFECYCLE}
SELECT alarm_id, status, acknowledged_us AS acknowledged_at, resolved_us AS resolved_at FROM alarm_states""")
def alarm_lifecycle(spark, sf):
    states = A.alarm_lifecycle(src.alarms(spark, sf), src.status_events(spark, sf))
    return micros(states, "acknowledged_at", "resolved_at").select(
        "alarm_id", "status", "acknowledged_at", "resolved_at")


@query("alarm_stats", f"""WITH {ctes.LIFECYCLE},
names AS (SELECT 'severity' AS dimension, unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS value
  UNION ALL SELECT 'status', unnest(['NEW', 'ACKNOWLEDGED', 'CONFIRMED', 'FALSE_POSITIVE', 'RESOLVED'])
  UNION ALL SELECT 'total', 'all'),
found AS (SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM alarm_states GROUP BY 2
  UNION ALL SELECT 'status', status, count(*) FROM alarm_states GROUP BY 2
  UNION ALL SELECT 'total', 'all', count(*) FROM alarm_states)
SELECT dimension, value, coalesce(n, 0) AS n FROM names LEFT JOIN found USING (dimension, value)""")
def alarm_stats(spark, sf):
    return A.alarm_stats(A.alarm_lifecycle(src.alarms(spark, sf), src.status_events(spark, sf)))


@query("alarms_per_hour", f"""WITH {ctes.ALARMS}
SELECT epoch_us(date_trunc('hour', created_at)) AS bucket, count(*) AS alarm_count
FROM alarms GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def alarms_per_hour(spark, sf):
    return micros(A.alarms_per_hour(src.alarms(spark, sf)), "bucket")


@query("alarm_groups", f"""WITH {ctes.ALARMS}
SELECT source_ip, attack_type, count(*) AS alarm_count,
  {ctes.severity_name(f"max({ctes.severity_rank('severity')})")} AS severity,
  min(created_us) AS first_seen, max(created_us) AS last_seen
FROM alarms WHERE source_ip IS NOT NULL GROUP BY source_ip, attack_type
ORDER BY alarm_count DESC, source_ip, attack_type NULLS LAST LIMIT 20""")
def alarm_groups(spark, sf):
    return micros(A.alarm_groups(src.alarms(spark, sf), src.flows(spark, sf)),
                  "first_seen", "last_seen")


@query("attack_type_counts", f"""WITH {ctes.FLOWS}
SELECT attack_type, count(*) AS n, (SELECT count(*) FROM flows) AS total_flows FROM flows
WHERE attack_type IS NOT NULL GROUP BY attack_type ORDER BY n DESC, attack_type LIMIT 8""")
def attack_type_counts(spark, sf):
    return A.attack_type_counts(src.flows(spark, sf))


@query("alarms_with_flows", f"""WITH {ctes.ALARMS}
SELECT a.alarm_id, a.severity, f.source_ip, f.destination_ip, f.confidence, f.model_name
FROM alarms a JOIN flows f USING (flow_id)""")
def alarms_with_flows(spark, sf):
    return src.alarms(spark, sf).select("alarm_id", "flow_id", "severity").join(
        src.flows(spark, sf).select("flow_id", "source_ip", "destination_ip", "confidence",
                                    "model_name"), "flow_id").drop("flow_id")


FEEDBACK_SQL = ctes.STATUS_EVENTS + """,
first_verdict AS (SELECT alarm_id, status AS verdict, min(changed_us) AS recorded_at,
    arg_min(analyst, changed_us) AS analyst
  FROM status_events WHERE status IN ('CONFIRMED', 'FALSE_POSITIVE') GROUP BY alarm_id, status),
feedback AS (SELECT v.alarm_id, a.flow_id, v.verdict, v.recorded_at, v.analyst,
    f.predicted_label AS original_prediction, f.attack_type AS original_attack_type,
    f.confidence AS original_confidence, f.anomaly_score AS original_anomaly_score,
    f.detection_method, CASE WHEN v.verdict = 'CONFIRMED' THEN f.attack_type END AS analyst_attack_type,
    f.model_name, f.truth_attack_type AS ground_truth_label
  FROM first_verdict v JOIN alarms a USING (alarm_id) JOIN flows f ON f.flow_id = a.flow_id)"""


def feedback(spark, sf):
    return A.record_feedback(src.status_events(spark, sf), src.alarms(spark, sf),
                             src.flows(spark, sf))


@query("record_feedback", f"""WITH {FEEDBACK_SQL} SELECT * FROM feedback""")
def record_feedback(spark, sf):
    return micros(feedback(spark, sf).drop("incident_id"), "recorded_at")


@query("feedback_stats", f"""WITH {FEEDBACK_SQL},
g AS (SELECT coalesce(model_name, '(unrecorded)') AS model_name, verdict FROM feedback
  UNION ALL SELECT '(all)', verdict FROM feedback)
SELECT model_name, count(*) FILTER (verdict = 'CONFIRMED') AS confirmed,
  count(*) FILTER (verdict = 'FALSE_POSITIVE') AS false_positive, count(*) AS total,
  count(*) FILTER (verdict = 'FALSE_POSITIVE') / CAST(count(*) AS DOUBLE) AS false_positive_rate
FROM g GROUP BY model_name""")
def feedback_stats(spark, sf):
    return A.feedback_stats(feedback(spark, sf))


@query("known_models_only", f"""WITH {ctes.FLOWS}
SELECT CASE WHEN model_name IS NULL OR model_name IN ('model-0', 'model-1', 'model-2') THEN 'known'
  ELSE 'refused' END AS outcome, model_name, count(*) AS n FROM flows GROUP BY 1, 2""")
def known_models_only(spark, sf):
    registry = src.flows(spark, sf).where(F.col("model_name") != "model-3").select("model_name")
    known, refused = A.known_models_only(src.flows(spark, sf), registry)
    both = known.select(F.lit("known").alias("outcome"), "model_name").unionByName(
        refused.select(F.lit("refused").alias("outcome"), "model_name"))
    return both.groupBy("outcome", "model_name").agg(F.count(F.lit(1)).alias("n"))


@query("search_flows", f"""WITH {ctes.FLOWS},
hits AS (SELECT * FROM flows WHERE predicted_label = 'ATTACK' AND (
  contains(lower(source_ip), '0.0.1') OR contains(lower(destination_ip), '0.0.1')
  OR coalesce(contains(lower(attack_type), '0.0.1'), false)))
SELECT flow_id, source_ip, destination_ip, attack_type, (SELECT count(*) FROM hits) AS total_rows
FROM hits ORDER BY flow_ts DESC, flow_id LIMIT 25 OFFSET 25""")
def search_flows(spark, sf):
    return A.search(src.flows(spark, sf), {"predicted_label": "ATTACK"}, "0.0.1",
                    ["source_ip", "destination_ip", "attack_type"], "flow_ts", "flow_id",
                    page=1, size=25).select("flow_id", "source_ip", "destination_ip",
                                            "attack_type", "total_rows")


@query("search_alarms", f"""WITH {ctes.LIFECYCLE},
hits AS (SELECT * FROM alarm_states WHERE severity = 'MEDIUM' AND status = 'NEW'
  AND contains(CAST(alarm_id AS VARCHAR), '1'))
SELECT alarm_id, severity, status, created_us AS created_at, (SELECT count(*) FROM hits) AS total_rows
FROM hits ORDER BY created_us DESC, alarm_id LIMIT 200""")
def search_alarms(spark, sf):
    states = A.alarm_lifecycle(src.alarms(spark, sf), src.status_events(spark, sf))
    return micros(A.search(states, {"severity": "MEDIUM", "status": "NEW"}, "1", ["alarm_id"],
                           "created_at", "alarm_id", page=0, size=500), "created_at").select(
        "alarm_id", "severity", "status", "created_at", "total_rows")


@query("search_incidents", f"""WITH {ctes.incidents(THREE_DAYS)},
hits AS (SELECT * FROM incidents WHERE severity = 'HIGH' AND (contains(lower(source_ip), 'portscan')
  OR coalesce(contains(lower(attack_type), 'portscan'), false) OR contains(lower(correlation_key), 'portscan')))
SELECT incident_id, severity, last_us AS last_seen, (SELECT count(*) FROM hits) AS total_rows
FROM hits ORDER BY last_us DESC, incident_id LIMIT 50""")
def search_incidents(spark, sf):
    found = I.sessionise_incidents(src.alarms(spark, sf), THREE_DAYS)
    return micros(A.search(found, {"severity": "HIGH", "attack_type": None}, "PortScan",
                           ["source_ip", "attack_type", "correlation_key"], "last_seen",
                           "incident_id"), "last_seen").select(
        "incident_id", "severity", "last_seen", "total_rows")


@query("incident_count_120s", f"""WITH {ctes.incidents(120)} SELECT count(*) AS incidents FROM incidents""")
def incident_count_120s(spark, sf):
    keyed = src.alarms(spark, sf).withColumn("correlation_key", I.correlation_key(
        F.col("source_ip"), F.col("attack_type")))
    return I.incident_count(keyed, ["correlation_key"], "created_at", 120)


@query("incident_count_3d", f"""WITH {ctes.incidents(THREE_DAYS)} SELECT count(*) AS incidents FROM incidents""")
def incident_count_3d(spark, sf):
    keyed = src.alarms(spark, sf).withColumn("correlation_key", I.correlation_key(
        F.col("source_ip"), F.col("attack_type")))
    return I.incident_count(keyed, ["correlation_key"], "created_at", THREE_DAYS)


@query("sessionised_incidents", f"""WITH {ctes.incidents(THREE_DAYS)},
seen AS (SELECT incident_id, destination_ip, min(created_us) AS seen_us FROM links GROUP BY 1, 2),
lists AS (SELECT incident_id, string_agg(destination_ip, ',' ORDER BY seen_us, destination_ip) AS destinations
  FROM seen GROUP BY 1)
SELECT incident_id, correlation_key, source_ip, attack_type, detection_method, first_us AS first_seen,
  last_us AS last_seen, alarm_count, severity, destination_count, false AS destinations_truncated, destinations
FROM incidents JOIN lists USING (incident_id)""")
def sessionised_incidents(spark, sf):
    found = I.sessionise_incidents(src.alarms(spark, sf), THREE_DAYS)
    return micros(found, "first_seen", "last_seen").select(
        "incident_id", "correlation_key", "source_ip", "attack_type", "detection_method",
        "first_seen", "last_seen", "alarm_count", "severity", "destination_count",
        "destinations_truncated", F.concat_ws(",", "destination_ips").alias("destinations"))


@query("incidents_by_attack_type", f"""WITH {ctes.ALARMS},
g AS (SELECT *, created_us - lag(created_us) OVER (PARTITION BY detection_method ORDER BY created_us) AS gap
  FROM alarms),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (
  PARTITION BY detection_method ORDER BY created_us ROWS UNBOUNDED PRECEDING) AS no FROM g),
d AS (SELECT detection_method, no, destination_ip, min(created_us) AS seen FROM n GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY detection_method, no ORDER BY seen, destination_ip) AS rk FROM d)
SELECT detection_method || '|UNKNOWN#' || CAST(no AS BIGINT) AS incident_id, count(*) AS destination_count,
  count(*) > 10 AS destinations_truncated,
  string_agg(destination_ip, ',' ORDER BY rk) FILTER (rk <= 10) AS destinations
FROM r GROUP BY detection_method, no""")
def incidents_by_attack_type(spark, sf):
    hot = src.alarms(spark, sf).withColumn("source_ip", F.col("detection_method")).withColumn(
        "attack_type", F.lit(None).cast("string"))
    return I.sessionise_incidents(hot, 1800, max_destinations=10).select(
        "incident_id", "destination_count", "destinations_truncated",
        F.concat_ws(",", "destination_ips").alias("destinations"))


@query("incident_destinations", f"""WITH {ctes.incidents(THREE_DAYS)}
SELECT incident_id, destination_count FROM incidents""")
def incident_destinations(spark, sf):
    found = src.alarms(spark, sf)
    return I.distinct_destinations(found, I.incident_of_alarm(found, THREE_DAYS))


INCIDENT_STATUS = ctes.incidents(THREE_DAYS) + """,
incident_events AS (SELECT incident_id, alarm_id,
    CASE alarm_id % 3 WHEN 0 THEN 'ACKNOWLEDGED' WHEN 1 THEN 'RESOLVED' ELSE 'CONFIRMED' END AS status,
    created_us + 60000000 AS changed_us FROM links WHERE severity <> 'LOW'),
last_status AS (SELECT incident_id, arg_max(status, changed_us) AS status FROM incident_events GROUP BY 1),
states AS (SELECT i.incident_id, i.severity, coalesce(s.status, 'NEW') AS status
  FROM incidents i LEFT JOIN last_status s USING (incident_id))"""


def _incident_states(spark, sf):
    found = src.alarms(spark, sf)
    events = I.incident_of_alarm(found, THREE_DAYS).join(
        found.where(F.col("severity") != "LOW").select("alarm_id", "created_at"), "alarm_id").select(
        "incident_id", F.element_at(F.array(F.lit("ACKNOWLEDGED"), F.lit("RESOLVED"), F.lit("CONFIRMED")),
                                    (F.col("alarm_id") % 3 + 1).cast("int")).alias("status"),
        (F.col("created_at") + F.expr("INTERVAL 60 SECONDS")).alias("changed_at"))
    return I.incident_status(I.sessionise_incidents(found, THREE_DAYS), events)


@query("incident_status", f"""WITH {INCIDENT_STATUS} SELECT * FROM states""")
def incident_status(spark, sf):
    return _incident_states(spark, sf).select("incident_id", "severity", "status")


@query("incident_stats", f"""WITH {INCIDENT_STATUS}
SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM states GROUP BY severity
UNION ALL SELECT 'status', status, count(*) FROM states GROUP BY status""")
def incident_stats(spark, sf):
    return I.incident_stats(_incident_states(spark, sf))


SWEEP = [600, 3600, 21600, 86400, 259200]


@query("window_sweep", f"""WITH {ctes.ALARMS},
g AS (SELECT created_us - lag(created_us) OVER (PARTITION BY correlation_key ORDER BY created_us) AS gap FROM alarms),
w AS (SELECT unnest({SWEEP}) AS window_seconds)
SELECT window_seconds, CAST(count(*) FILTER (gap IS NULL OR gap > window_seconds * CAST(1000000 AS BIGINT)) AS BIGINT) AS incidents,
  count(*) AS n_rows, count(*) / CAST(count(*) FILTER (gap IS NULL OR gap > window_seconds * CAST(1000000 AS BIGINT)) AS DOUBLE) AS rows_per_incident
FROM g CROSS JOIN w GROUP BY window_seconds""")
def window_sweep(spark, sf):
    keyed = src.alarms(spark, sf).withColumn("correlation_key", I.correlation_key(
        F.col("source_ip"), F.col("attack_type")))
    return I.window_sweep(keyed, ["correlation_key"], "created_at", SWEEP).withColumnRenamed(
        "rows", "n_rows")


GAPS_SQL = ctes.FLOWS + """,
labelled AS (SELECT *, coalesce(attack_type, predicted_label) AS label FROM flows),
g AS (SELECT *, (flow_us - lag(flow_us) OVER (PARTITION BY label, source_ip ORDER BY flow_us)) / 1000000.0 AS gap
  FROM labelled),
stats AS (SELECT label, count(*) AS flows, count(DISTINCT source_ip) AS distinct_sources,
  count(DISTINCT destination_ip) AS distinct_targets, count(gap) AS gap_count,
  round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.9), 6) AS p90,
  round(quantile_cont(gap, 0.95), 6) AS p95, round(quantile_cont(gap, 0.99), 6) AS p99,
  max(gap) AS max_gap,
  avg(CASE WHEN gap <= 3600 THEN 1.0 ELSE 0.0 END) FILTER (gap IS NOT NULL) AS under_3600,
  avg(CASE WHEN gap <= 86400 THEN 1.0 ELSE 0.0 END) FILTER (gap IS NOT NULL) AS under_86400
FROM g GROUP BY label HAVING count(*) >= 100)"""


def _gap_stats(spark, sf):
    labelled = src.flows(spark, sf).withColumn(
        "label", F.coalesce("attack_type", "predicted_label"))
    return I.gap_statistics(labelled, "label", "source_ip", "destination_ip", "flow_ts",
                            windows=[3600, 86400])


def rounded(df, places=6, skip=()):
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


@query("gap_statistics", f"""WITH {GAPS_SQL}
SELECT label, flows, distinct_sources, distinct_targets, gap_count, p50, p90, p95, p99,
  round(max_gap, 6) AS max_gap, round(under_3600, 6) AS under_3600, round(under_86400, 6) AS under_86400
FROM stats""")
def gap_statistics(spark, sf):
    return rounded(_gap_stats(spark, sf))


@query("mean_gap_coverage", f"""WITH {GAPS_SQL}
SELECT 3600 AS window_seconds, round(avg(under_3600), 6) AS coverage FROM stats
UNION ALL SELECT 86400, round(avg(under_86400), 6) FROM stats""")
def mean_gap_coverage(spark, sf):
    return rounded(I.mean_gap_coverage(_gap_stats(spark, sf), [3600, 86400]))
