"""Streaming queries, run over the whole table until it is used up.

Each writes under the checkpoint folder of the session and is compared with the SQL of
its batch form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.operators import anomaly as A
from netweir.operators import models as M
from netweir.operators import profile as P
from netweir.operators import validate as V
from netweir.operators.alarms import name_of
from netweir.operators.incidents import correlation_key
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.drift import GRID
from netweir.plans.catalog.packets import PACKETS
from netweir.plans.catalog.profiling import VALIDATED
from netweir.plans.catalog.registry import query
from netweir.session import ensure_checkpoint_dir
from netweir.sources import adapters as src
from netweir.streaming import correlate as C
from netweir.streaming import detect as DT
from netweir.streaming import drift as D
from netweir.streaming import flows as S
from netweir.streaming import growing as G
from netweir.streaming.packets import packet_flow_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def place(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream, path, mode="append"):
    """Run a stream to its end and read back what it wrote, batch by batch."""
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").drop("batch")


@query("stream_alarms", f"WITH {ctes.ALARMS} SELECT alarm_id, created_us AS created_at, severity FROM alarms")
def stream_alarms(spark, sf):
    alarms = S.alarm_stream(src.as_flows(src.event_stream(spark, sf)))
    return drain(alarms, place(spark)).select("alarm_id", F.unix_micros("created_at").alias("created_at"), "severity")


@query("stream_alarms_per_hour", f"WITH {ctes.ALARMS} SELECT epoch_us(date_trunc('hour', created_at)) AS bucket, count(*) AS alarm_count FROM alarms GROUP BY 1")
def stream_alarms_per_hour(spark, sf):
    hours = S.alarms_per_hour_stream(S.alarm_stream(src.as_flows(src.event_stream(spark, sf))), "1 hour")
    counted = drain(hours, place(spark), "update")
    return counted.groupBy(F.unix_micros("bucket").alias("bucket")).agg(F.max("alarm_count").alias("alarm_count"))


@query("stream_incidents", f"""WITH {ctes.incidents(259200)} SELECT correlation_key, incident_no, first_us, last_us, alarm_count AS n, severity, CAST(destination_count AS INT) AS destinations FROM incidents""")
def stream_incidents(spark, sf):
    return incidents_of(spark, S.alarm_stream(src.as_flows(src.event_stream(spark, sf))), None).drop("status")


def incidents_of(spark, alarms, status_events):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        updates = C.correlate_stream(alarms, "30 days", 2 * 259200, 259200, status_events)
        found = C.latest_incidents(drain(updates, place(spark), "update"))
    finally:
        spark.conf.set(PROVIDER, before)
    return found.select("correlation_key", "incident_no", "first_us", "last_us", "n", name_of(F.col("worst"), contract.SEVERITIES).alias("severity"),
                        F.size("destinations").alias("destinations"), "status")


# a microsecond after every 31st alarm its incident is acknowledged, after every 97th it is closed
@query("stream_incidents_with_status", f"""WITH {ctes.ALARMS},
r AS (SELECT correlation_key, created_us AS us, 1 AS turn, alarm_id, NULL AS status FROM alarms
  UNION ALL SELECT correlation_key, created_us + 1, 0, NULL, CASE WHEN alarm_id % 97 = 0 THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END FROM alarms WHERE alarm_id % 97 = 0 OR alarm_id % 31 = 0),
c AS (SELECT *, count(*) FILTER (status = 'RESOLVED') OVER w AS closed, max(us) FILTER (turn = 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM r WINDOW w AS (PARTITION BY correlation_key ORDER BY us, turn, alarm_id)),
g AS (SELECT *, closed - lag(closed) OVER (PARTITION BY correlation_key ORDER BY us, alarm_id) AS closings FROM c WHERE turn = 1),
s AS (SELECT correlation_key, us, alarm_id, sum((before IS NULL OR us - before > 259200000000 OR closings > 0)::INT) OVER (
    PARTITION BY correlation_key ORDER BY us, alarm_id ROWS UNBOUNDED PRECEDING)::BIGINT AS incident_no FROM g),
e AS (SELECT r.correlation_key, r.us, r.status, s.incident_no FROM r ASOF JOIN s ON r.correlation_key = s.correlation_key AND r.us > s.us WHERE turn = 0),
last AS (SELECT correlation_key, incident_no, arg_max(status, us) AS status FROM e GROUP BY 1, 2)
SELECT correlation_key, incident_no, min(us) AS first_us, max(us) AS last_us, count(*) AS n, {ctes.severity_name(f"max({ctes.severity_rank('severity')})")} AS severity,
  count(DISTINCT destination_ip)::INT AS destinations, coalesce(any_value(last.status), 'NEW') AS status
FROM s JOIN alarms USING (correlation_key, alarm_id) LEFT JOIN last USING (correlation_key, incident_no) GROUP BY 1, 2""")
def stream_incidents_with_status(spark, sf):
    def alarms():
        return S.alarm_stream(src.as_flows(src.event_stream(spark, sf)))

    marked = alarms().where("alarm_id % 97 = 0 OR alarm_id % 31 = 0").select(
        correlation_key(F.col("source_ip"), F.col("attack_type")).alias("correlation_key"), F.lit(None).cast("long").alias("incident_no"),
        F.when(F.col("alarm_id") % 97 == 0, "RESOLVED").otherwise("ACKNOWLEDGED").alias("status"),
        F.timestamp_micros(F.unix_micros("created_at") + 1).alias("changed_at"))
    return incidents_of(spark, alarms(), marked)


@query("stream_feedback", f"""WITH {ctes.STATUS_EVENTS} SELECT alarm_id, status, min(changed_us) AS changed_at FROM status_events WHERE status IN ('CONFIRMED', 'FALSE_POSITIVE') GROUP BY 1, 2""")
def stream_feedback(spark, sf):
    path = place(spark)
    src.status_events(spark, sf).repartition(8, "alarm_id").sortWithinPartitions("changed_at").write.parquet(f"{path}/events")
    events = S.flow_stream(spark, f"{path}/events", spark.read.parquet(f"{path}/events").schema)
    return drain(S.feedback_stream(events, "30 days"), path).select("alarm_id", "status", F.unix_micros("changed_at").alias("changed_at"))


# a flow is written when the watermark, a minute behind the newest packet, is 240 s past its last one
@query("stream_packet_flows", f"""WITH {PACKETS} SELECT flow_key, any_value(src) FILTER (forward) AS source, min(time_us) AS start_us, max(time_us) AS end_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes,
  count(*) FILTER (forward) AS fwd_packets, count(*) FILTER (NOT forward) AS bwd_packets, coalesce(sum(length) FILTER (forward), 0)::BIGINT AS fwd_bytes, coalesce(sum(length) FILTER (NOT forward), 0)::BIGINT AS bwd_bytes
FROM pk GROUP BY flow_id, flow_key HAVING max(time_us) + 240000000 <= (SELECT max(time_us) FROM pk) - 60000000""")
def stream_packet_flows(spark, sf):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return drain(packet_flow_stream(src.as_packets(src.event_stream(spark, sf)), "60 seconds"), place(spark))
    finally:
        spark.conf.set(PROVIDER, before)


@query("stream_validated", f"WITH {VALIDATED} SELECT row_id, len(missing) = 0 AND len(invalid) = 0 AS valid FROM judged")
def stream_validated(spark, sf):
    path = place(spark)
    table = src.raw_features(spark, sf)
    table.write.parquet(f"{path}/raw")
    # two batches, as many files as the table has parts: a fixed number of files would make one task of an eighth of the rows
    files = len(spark.read.parquet(f"{path}/raw").inputFiles())
    raw = S.flow_stream(spark, f"{path}/raw", table.schema, files_per_batch=-(-files // 2))
    S.validate_stream(raw, src.VALIDATED_FEATURES, f"{path}/accepted", f"{path}/dead", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/accepted").unionByName(spark.read.parquet(f"{path}/dead")).select("row_id", "valid")


# -- drift: a report at every 500th flow of a model version, here of each line status --------------------

VALUES = """[dur, fwd, bwd, fb, bb, fmax, fmin, fmean, bmax, bmin, bmean, CASE WHEN text_sd THEN 1000 ELSE sd END, (fb + bb) / nullif(dur / 1000000, 0),
  (fwd + bwd) / nullif(dur / 1000000, 0), floor(bwd / fwd), greatest(fmax, bmax), CASE WHEN text_sd THEN 1000000 ELSE sd * sd END, 0, 0, CASE status WHEN 'F' THEN 12.5 ELSE 1000 END]"""
LIMITS = [(200, 0.2, 0.1), (500, 0.06, 0.15), (1000, 0.05, 0.12)]


def names_sql(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


MARKS = f"""{VALIDATED},
ref AS (SELECT feature, quantile_cont(v, {GRID}) AS q FROM (SELECT unnest({names_sql(src.RAW_FEATURES)}) AS feature,
    unnest([dur, fwd, bwd, fb, bb, fmax, fmin, fmean, bmax, bmin, bmean, sd]) AS v FROM vec WHERE flag = 'N') GROUP BY feature),
o AS (SELECT *, len(missing) = 0 AND len(invalid) = 0 AS valid, row_number() OVER (PARTITION BY status ORDER BY row_id) AS no FROM judged),
a AS (SELECT *, sum(valid::INT) OVER (PARTITION BY status ORDER BY no ROWS UNBOUNDED PRECEDING) AS acc FROM o),
f AS (SELECT status, no, acc, valid, missing, derived, list_transform(invalid, lambda x: split_part(x, ': ', 1)) AS bad,
    unnest({names_sql(src.VALIDATED_FEATURES)}) AS feature, unnest({VALUES}) AS v FROM a),
seen AS (SELECT status, no, feature, sum(list_contains(missing, feature)::INT) OVER w / no AS missing_rate, sum(list_contains(bad, feature)::INT) OVER w / no AS invalid_rate,
    sum(list_contains(derived, feature)::INT) OVER w / no AS derived_rate, sum((feature IN ('Bwd PSH Flags', 'Fwd Avg Bulk Rate'))::INT) OVER w / no AS zero_filled_rate,
    sum((valid AND q IS NOT NULL AND q[2] <> q[100] AND (v < q[2] OR v > q[100]))::INT) OVER w / no AS out_of_range_rate
  FROM f LEFT JOIN ref USING (feature) WINDOW w AS (PARTITION BY status, feature ORDER BY no ROWS UNBOUNDED PRECEDING)),
marks AS (SELECT status, no, acc FROM a WHERE no % 500 = 0),
win AS (SELECT m.status, m.no, f.feature, f.v, row_number() OVER w AS i, count(*) OVER (PARTITION BY m.status, m.no, f.feature) AS n
  FROM marks m JOIN f ON f.status = m.status AND f.valid AND f.acc <= m.acc AND f.acc > m.acc - 1000 WINDOW w AS (PARTITION BY m.status, m.no, f.feature ORDER BY f.v)),
k AS (SELECT w.*, q, len(list_filter(q, lambda x: x <= v)) AS b FROM win w LEFT JOIN ref USING (feature)),
kv AS (SELECT *, CASE WHEN b = 0 THEN 0.0 WHEN b >= 101 THEN 1.0 ELSE (b - 1) / 100.0 + (v - q[b]) * (0.01 / (q[b + 1] - q[b])) END AS cdf FROM k),
st AS (SELECT status, no, feature, any_value(n) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
    CASE WHEN any_value(q) IS NULL THEN NULL WHEN any_value(q)[101] <= any_value(q)[1] THEN max((v <> q[1])::INT)
      ELSE max(greatest(i / n::DOUBLE - cdf, cdf - (i - 1) / n::DOUBLE)) END AS ks FROM kv GROUP BY ALL),
lim(size, p95, share) AS (VALUES {", ".join(f"({w}, {p}::DOUBLE, {f}::DOUBLE)" for w, p, f in LIMITS)}),
near AS (SELECT status, no, least(acc, 1000) AS sample_size, arg_min(size, abs(size - least(acc, 1000)) * 10000 + size) AS size FROM marks, lim GROUP BY ALL),
rep AS (SELECT s.*, mean, std, p25, p50, p75, ks, CASE WHEN ks IS NOT NULL THEN p95 END AS ks_threshold, ks > p95 AS drifted
  FROM seen s JOIN near USING (status, no) JOIN lim USING (size) LEFT JOIN st USING (status, no, feature))"""
STATISTICS = ["missing_rate", "invalid_rate", "derived_rate", "zero_filled_rate", "out_of_range_rate", "mean", "std", "p25", "p50", "p75"]


def drift_tables(spark, sf):
    """The stream over the whole line table, two versions; the folder that holds its reports."""
    path = place(spark)
    reference = P.feature_reference(src.flow_vectors(spark, sf).where("flag = 'N'"), src.RAW_FEATURES)
    limits = spark.createDataFrame(LIMITS, "window_size int, p95 double, fraction_p99 double").withColumn(
        "feature", F.explode(F.array(*[F.lit(f) for f in src.VALIDATED_FEATURES])))
    raw = src.as_raw_features(src.as_vectors(src.line_stream(spark, sf))).withColumnRenamed("status", "model_version")
    validated = V.validate(raw, src.VALIDATED_FEATURES, reference=reference)
    D.drift_stream(validated, src.VALIDATED_FEATURES, reference, limits, ["row_id"], path, f"{path}/checkpoint").awaitTermination()
    return path


@query("stream_drift_windows", f"""WITH {MARKS}
SELECT status AS model_version, no AS observed_flows, feature, {', '.join(f'round({c}, 6) AS {c}' for c in STATISTICS)}, round(ks, 6) AS ks_statistic, ks_threshold, drifted FROM rep""")
def stream_drift_windows(spark, sf):
    return rounded(spark.read.parquet(f"{drift_tables(spark, sf)}/features").drop("batch"))


REASON_COUNTS = ", ".join(f"sum(len(list_filter(invalid, lambda x: x LIKE '%: {r}')))::BIGINT AS reason_{r}" for r in D.REASONS)


@query("stream_drift_reports", f"""WITH {MARKS},
why AS (SELECT m.status, m.no, m.acc, {REASON_COUNTS}, sum(CASE WHEN a.valid THEN 0 ELSE len(missing) END)::BIGINT AS reason_missing
  FROM marks m JOIN a ON a.status = m.status AND a.no <= m.no GROUP BY ALL),
facts AS (SELECT status, no, count(*) FILTER (missing_rate > 0.01) AS badly_missing, count(*) FILTER (drifted) AS drifted_feature_count,
    coalesce(array_to_string(list_sort(list(feature) FILTER (drifted)), ','), '') AS drifted_features, count(*) FILTER (drifted) / 20.0::DOUBLE AS drifted_fraction FROM rep GROUP BY ALL),
j AS (SELECT *, (no - acc) / no AS bad FROM why JOIN facts USING (status, no) JOIN near USING (status, no) JOIN lim USING (size))
SELECT status AS model_version, no AS observed_flows, acc::BIGINT AS accepted_flows, (no - acc)::BIGINT AS rejected_flows, sample_size::BIGINT AS sample_size, round(bad, 6) AS invalid_rate,
  {', '.join(f'reason_{r}' for r in (*D.REASONS, 'missing'))}, badly_missing, drifted_feature_count, drifted_features, drifted_fraction, size AS calibration_window,
  CASE WHEN bad > 0.05 OR badly_missing > 0 OR drifted_fraction > 0.2 THEN 'CRITICAL' WHEN bad > 0.01 OR drifted_fraction > share THEN 'WARNING' ELSE 'NORMAL' END AS status,
  coalesce(nullif(concat_ws('; ', CASE WHEN bad > 0.05 THEN 'invalid rate critical' WHEN bad > 0.01 THEN 'invalid rate raised' END, CASE WHEN badly_missing > 0 THEN 'features missing' END,
    CASE WHEN drifted_fraction > 0.2 THEN 'drifted share above policy' WHEN drifted_fraction > share THEN 'drifted share above calibration' END), ''), 'within calibrated no-drift bounds') AS reasons FROM j""")
def stream_drift_reports(spark, sf):
    reports = spark.read.parquet(f"{drift_tables(spark, sf)}/reports").drop("batch")
    return rounded(reports.withColumn("drifted_features", F.array_join("drifted_features", ",")))


# -- detection: one set of features for the supervised model, another for the anomaly score -----------------

DETECT_FEATURES = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Max Packet Length"]
ANOMALY_FEATURES = ["Flow Duration", "Fwd Packet Length Min", "Packet Length Std"]


def store_models(spark, sf, path):
    """Trains a version on the flow vectors and activates it; returns the table of activations."""
    vectors = src.flow_vectors(spark, sf).withColumns({
        "Max Packet Length": F.greatest("Fwd Packet Length Max", "Bwd Packet Length Max"),
        "label": F.when(F.col("flag") == "N", contract.BENIGN).otherwise("ATTACK")})
    fitted = M.train_forest(M.assemble(vectors, DETECT_FEATURES), trees=20, depth=6)
    benign = vectors.where("flag = 'N'")
    trees = A.fit_isolation_forest(benign, ANOMALY_FEATURES, "row_id", 42)
    trees.write.parquet(f"{path}/fitted-trees")
    trees = spark.read.parquet(f"{path}/fitted-trees")
    # a calibration reads the scores several times
    A.isolation_score(benign, trees, ANOMALY_FEATURES, ["row_id"]).write.parquet(f"{path}/fitted-scores")
    calibration = A.calibrate_anomaly(spark.read.parquet(f"{path}/fitted-scores"), "raw_score").first()
    DT.save_version(f"{path}/models", "v2", fitted, trees, DETECT_FEATURES, ANOMALY_FEATURES,
                    calibration["thresholds"][-1]["threshold"], calibration["calibration_quantiles"])
    spark.createDataFrame([("v1", 1), ("v2", 2)], "model string, activated_at long").write.parquet(f"{path}/registry")
    return f"{path}/registry"


@query("stream_detections", f"""WITH {VALIDATED}
SELECT row_id, 'v2' AS model_version, CASE WHEN null_bmax THEN 'dead_letter' ELSE 'detected' END AS outcome, CASE WHEN NOT null_bmax THEN NOT no_fmin AND NOT bad_sd END AS anomaly_available,
  CASE WHEN null_bmax THEN '1 missing: Max Packet Length' ELSE concat_ws(',', CASE WHEN no_fmin THEN 'Fwd Packet Length Min' END, CASE WHEN bad_sd THEN 'Packet Length Std' END) END AS reasons,
  true AS rules_hold FROM judged""")
def stream_detections(spark, sf):
    path = place(spark)
    registry = store_models(spark, sf, path)
    raw = src.as_raw_features(src.as_vectors(src.line_stream(spark, sf)))
    DT.detect_stream(raw, f"{path}/models", lambda s: DT.newest_version(s, registry), ["row_id"], path, f"{path}/checkpoint").awaitTermination()
    benign, odd = F.col("supervised_label") == contract.BENIGN, F.coalesce("is_anomalous", F.lit(False))
    rules = (F.col("anomaly_available") == F.col("anomaly_score").isNotNull()) & (F.coalesce("anomaly_score", F.lit(0.0)).between(0, 1)) & (
        (F.col("detection_class") == "SUSPICIOUS") == (benign & odd)) & ((F.col("prediction") == "ATTACK") == ~benign) & (
        F.col("supervised_confidence") >= 0.5)
    found = spark.read.parquet(f"{path}/detections").select("row_id", "model_version", F.lit("detected").alias("outcome"), "anomaly_available",
                                                            F.array_join("blocking_features", ",").alias("reasons"), rules.alias("rules_hold"))
    dead = spark.read.parquet(f"{path}/dead_letters").select("row_id", "model_version", F.lit("dead_letter").alias("outcome"), F.lit(None).cast("boolean").alias("anomaly_available"),
                                                             F.array_join("validation_errors", "; ").alias("reasons"), F.lit(True).alias("rules_hold"))
    return found.unionByName(dead)


# -- growing files: the events as CSV lines, followed by byte ---------------------------------------------

@query("stream_growing_files", """SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events""")
def stream_growing_files(spark, sf):
    path, columns = place(spark), ["event_id", "user_id", "event_type", "value"]
    src.table(spark, sf, "events").select(*columns).write.option("header", True).csv(f"{path}/capture")
    records, _ = G.follow_capture(G.growing_lines(spark, f"{path}/capture", suffix=".csv", pieceBytes=str(1 << 20)), columns)
    found = drain(records, path)
    return found.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type",
                        F.round(F.col("value").cast("double"), 6).alias("value"))
