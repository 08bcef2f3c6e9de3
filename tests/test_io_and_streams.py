"""Sources, sinks and streams over files written by the test."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.operators import anomaly, incidents, models
from netweir.sources import adapters, flows, sinks
from netweir.streaming import correlate
from netweir.streaming import flows as streams

SF = "/root/testdata/sf0.001"


def test_day_files(spark, tmp_path):
    header = [" Flow ID", "Fwd Header Length", " Flow Bytes/s", " Flow Packets/s", "Fwd Header Length.1", " Label"]
    for name in ("monday", "tuesday"):
        (tmp_path / f"{name}.csv").write_bytes(
            (",".join(header) + "\na,1,Infinity,2,1,Web Attack \x96 XSS\nb,1,3,NaN,1,BENIGN\nc,1,3,4,1,BENIGN\n").encode("latin1"))
    schema = flows.day_schema(header, ["Flow ID", "Label"])
    days = flows.read_flow_days(spark, [str(tmp_path / "monday.csv"), str(tmp_path / "tuesday.csv")], schema)
    assert contract.DUPLICATE_HEADER not in days.columns
    got = {(r["source_file"], r["Flow ID"], r["Flow Bytes/s"]) for r in days.collect()}
    assert ("monday.csv", "a", float("inf")) in got and len(got) == 6
    from netweir.functions.cleaning import clean_label
    from netweir.operators.clean import drop_nonfinite
    assert drop_nonfinite(days).count() == 2
    assert days.select(clean_label(F.col("Label")).alias("l")).where("l = 'Web Attack - XSS'").count() == 2
    sinks.write_cleaned(days, str(tmp_path / "cleaned"))
    assert spark.read.parquet(str(tmp_path / "cleaned")).count() == 6
    assert flows.union_days([days, days]).count() == 12


def test_tolerant_capture(spark, tmp_path):
    path = tmp_path / "capture.csv"
    path.write_text("src_ip,dst_ip,dst_port\na,b,1\nshort,x\nc,d,2,long\ne,f,3\n")
    good, bad = flows.read_capture(spark, str(path), ["src_ip", "dst_ip", "dst_port"])
    assert good.count() == 2 and bad.count() == 2
    report = flows.capture_column_report(good, bad, ["src_ip", "dst_ip", "dst_port", "dst_ip"]).first()
    assert tuple(report) == (2, 4, "dst_ip", 2)


def test_missing_feature_columns_are_refused(spark):
    with pytest.raises(ValueError, match="missing"):
        flows.read_features(spark, f"{SF}/lineitem.parquet", ["nope"], [])


def test_fingerprint_ignores_order(spark):
    df = adapters.features(spark, SF)
    first = sinks.table_fingerprint(df, ["row_id", "quantity"]).first()
    assert first == sinks.table_fingerprint(df.orderBy("quantity"), ["row_id", "quantity"]).first()


def test_exports(spark, tmp_path):
    live = adapters.live_flows(spark, SF)
    sinks.write_predictions(live, str(tmp_path / "predictions"))
    back = spark.read.option("header", True).csv(str(tmp_path / "predictions"))
    assert back.count() == live.count() and set(back.columns) == set(contract.PREDICTION_FIELDS)
    rows = adapters.explanations(spark, SF)
    sinks.export_explanations(rows, rows.groupBy("decision").count(), str(tmp_path / "explanations"))
    assert spark.read.json(str(tmp_path / "explanations/jsonl")).count() == rows.count()


def test_isolation_scores_single_out_the_far_rows(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("row_id"), *[
        F.when(F.col("id") == 599, 50.0).otherwise((F.hash("id", F.lit(j)) % 1000) / 1000.0).alias(f"f{j}") for j in range(3)])
    trees = anomaly.fit_isolation_forest(df, ["f0", "f1", "f2"], "row_id", 1, trees=25, sample=128)
    assert trees.count() == 25
    scores = anomaly.isolation_score(df, trees, ["f0", "f1", "f2"], ["row_id"], 128)
    assert scores.orderBy("raw_score").first()["row_id"] == "599"
    assert scores.where((F.col("raw_score") > 0) | (F.col("raw_score") < -1)).count() == 0


def test_models_learn_a_simple_rule(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("row_id"), F.when(F.col("id") % 3 == 0, "ATTACK").otherwise("BENIGN").alias("label"),
        F.array((F.col("id") % 3).cast("double"), (F.col("id") % 7).cast("double")).alias("vector"))
    for fitted in (models.train_forest(df, trees=5, depth=3), models.train_boosted(df, rounds=3, depth=2)):
        scored = models.score(df, fitted)
        assert scored.where("label != predicted_label").count() == 0
        assert scored.where("confidence < 0.5 OR confidence > 1").count() == 0


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_incidents(spark, tmp_path, batches, window, lateness="365 days", retain=None):
    """Incidents of alarm batches, each landed as one file and read as one micro-batch."""
    schema = ("alarm_id long, created_at timestamp, severity string, source_ip string, destination_ip string, "
              "attack_type string, incident_no long, status string")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(
        str(tmp_path / "in/*"))
    status = source.where("status IS NOT NULL").select(
        F.concat_ws("|", "source_ip", "attack_type").alias("correlation_key"), "incident_no", "status",
        F.col("created_at").alias("changed_at"))
    updates = correlate.correlate_stream(source.where("status IS NULL"), lateness, retain or 365 * 86400, window, status)
    updates.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(
        lambda d, n: d.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))).trigger(
        availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in correlate.latest_incidents(
        spark.read.parquet(str(tmp_path / "out")).drop("b")).select("incident_no", "n", "worst", "status").collect())


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def alarm(i, seconds, severity="LOW"):
    return (i, at(seconds), severity, "s", f"d{i}", "PortScan", None, None)


def test_late_alarm_joins_and_severity_never_falls(spark, tmp_path):
    got = run_incidents(spark, tmp_path, [
        [alarm(1, 1000, "HIGH"), alarm(2, 1100)], [alarm(3, 0)], [alarm(4, 1221)]], 120)
    assert got == [(1, 3, 2, "NEW"), (2, 1, 0, "NEW")]


def closing(no, seconds, status="RESOLVED"):
    return (None, at(seconds), None, "s", None, "PortScan", no, status)


def test_a_closed_incident_takes_no_alarm_of_the_same_cell(spark, tmp_path):
    got = run_incidents(spark, tmp_path, [[alarm(1, 0)], [alarm(2, 10), closing(1, 30), alarm(3, 60)]], 120)
    assert got == [(1, 2, 0, "RESOLVED"), (2, 1, 0, "NEW")]


def test_a_status_without_new_alarms_is_kept(spark, tmp_path):
    got = run_incidents(spark, tmp_path, [[alarm(1, 0)], [closing(1, 5)]], 120)
    assert got == [(1, 1, 0, "RESOLVED")]


def test_a_quiet_key_leaves_only_its_number(spark, tmp_path):
    far = [(9, at(90000), "LOW", "other", "d", "PortScan", None, None)]
    got = run_incidents(spark, tmp_path, [[alarm(1, 0), alarm(2, 50)], far, far, [closing(1, 90000)], [alarm(3, 89990)]], 120, "1 minute", 300)
    assert got == [(1, 2, 0, "NEW"), (1, 2, 0, "RESOLVED"), (2, 1, 0, "NEW")]
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "incidents").load()
    assert state.count() == 2


def test_in_order_stream_equals_the_batch_form(spark, tmp_path):
    table = adapters.alarms(spark, SF).orderBy("created_at").select(
        "alarm_id", "created_at", "severity", "source_ip", "destination_ip", "attack_type",
        F.lit(None).cast("long"), F.lit(None).cast("string")).collect()
    third = len(table) // 3
    got = run_incidents(spark, tmp_path, [[tuple(r) for r in part] for part in (
        table[:third], table[third:2 * third], table[2 * third:])], 86400)
    batch = incidents.sessionise_incidents(adapters.alarms(spark, SF), 86400)
    assert len(got) == batch.count()
    assert sum(n for _, n, _, _ in got) == len(table)


def test_validated_stream_keeps_every_row_once(spark, tmp_path):
    raw = adapters.raw_features(spark, SF).repartition(3)
    raw.write.parquet(str(tmp_path / "raw"))
    stream = streams.flow_stream(spark, str(tmp_path / "raw"), raw.schema, files_per_batch=1)
    streams.validate_stream(stream, adapters.VALIDATED_FEATURES, str(tmp_path / "ok"), str(tmp_path / "dead"),
                            str(tmp_path / "cp")).awaitTermination()
    ok, dead = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "dead"))
    assert ok.count() + dead.count() == raw.count() and dead.count() > 0
    assert ok.where("NOT valid").count() == 0


def test_a_validated_stream_computes_its_rows_once_and_keeps_none(spark, tmp_path):
    passed, kept = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    for i, values in enumerate(([("1", "2"), ("x", "3")], [("4", "5")])):
        rows = [(v[1], {"Flow Duration": v[0]}) for v in values]
        spark.createDataFrame(rows, "row_id string, features map<string,string>").coalesce(1).write.parquet(str(tmp_path / f"raw/b={i}"))
    raw = spark.read.parquet(str(tmp_path / "raw")).drop("b")
    stream = streams.flow_stream(spark, str(tmp_path / "raw/*"), raw.schema, files_per_batch=1).mapInPandas(counted, raw.schema)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    split = streams.split_valid

    def watched(checked):
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size() - before)
        return split(checked)

    streams.split_valid = watched
    try:
        streams.validate_stream(stream, ["Flow Duration"], str(tmp_path / "ok"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    finally:
        streams.split_valid = split
    ok, dead = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "dead"))
    assert sorted(r.row_id for r in ok.collect()) == ["2", "5"] and [(r.row_id, r.valid) for r in dead.collect()] == [("3", False)]
    assert sorted(p.name for p in (tmp_path / "dead").iterdir() if p.name.startswith("batch")) == ["batch=0", "batch=1"]
    assert passed.value == 3 and not any(kept) and not (tmp_path / "ok/_staging").exists()
