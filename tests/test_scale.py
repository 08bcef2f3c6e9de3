"""What a step may move or hold, on small tables."""

import tracemalloc
import types

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from netweir.functions import contract, ordered
from netweir.operators import balance, drift, profile, validate
from netweir.streaming import correlate


def test_validation_runs_as_compiled_columns(spark):
    cases = [(1, {"Total Fwd Packets": " 1_0 ", "Flow Duration": "0x1", "x": "1"}), (2, {"Total Fwd Packets": None}), (3, None)]
    df = spark.createDataFrame(cases, "id int, features map<string,string>")
    checked = validate.validate(df, ["Total Fwd Packets", "Flow Duration", "Subflow Fwd Packets", "Bwd PSH Flags"])
    assert "lambdafunction" not in checked._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: r for r in checked.collect()}
    assert [(c["value"], c["outcome"], c["reason"]) for c in found[1]["checks"]] == [
        (10.0, "raw", None), (None, "invalid", "non_numeric"), (10.0, "derived", "missing"), (0.0, "zero_filled", "missing")]
    assert found[1]["unexpected_features"] == ["x"] and found[1]["vector"] is None
    assert found[2]["invalid_features"] == [("Total Fwd Packets", "null")] and found[2]["derived_features"] == []
    assert found[3]["missing_features"] == ["Total Fwd Packets", "Flow Duration", "Subflow Fwd Packets"]
    loose = validate.validate(df, ["Total Fwd Packets", "Flow Duration"], policy=validate.PERMISSIVE).where("id = 1 AND valid")
    assert loose.select("vector", "zero_filled_features").first() == ([10.0, 0.0], ["Flow Duration"])


def test_quantiles_carry_no_ranks_with_the_rows(spark):
    df = spark.range(2000).select(F.lit("f").alias("feature"), (F.col("id") % 3).cast("double").alias("value"))
    found = ordered.exact_quantiles(df, ["feature"], "value", [i / 100 for i in range(101)])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    by_value = [line for line in plan.splitlines() if "Aggregate" in line and "_v" in line.split("functions=")[0]]
    assert by_value and not any("_ranks" in line or "SortAggregate" in line for line in by_value)
    assert found.first()["quantiles"] == [df.approxQuantile("value", [0.0], 0.0)[0]] * 34 + [1.0] * 33 + [2.0] * 34


def test_neighbours_need_the_same_memory_for_larger_classes():
    points = np.random.default_rng(1).normal(size=(3000, 64))
    tracemalloc.start()
    order, distance = balance.nearest_points(points, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    exact = np.sqrt(((points[7] - points) ** 2).sum(axis=1))
    assert order[7].tolist() == np.argsort(exact, kind="stable")[1:6].tolist()
    assert distance[7].tolist() == np.sort(exact)[1:6].tolist()


def test_a_drift_report_passes_its_rows_twice(spark):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    values = spark.range(400, numPartitions=1).select((F.col("id") * F.col("id") % 397 + 1).cast("double").alias("v")).mapInPandas(
        counted, "v double")
    checks = F.array(F.struct(F.lit("f").alias("feature"), F.col("v").alias("value"), F.lit("raw").alias("outcome")))
    validated = values.select(checks.alias("checks"), (F.col("v") > 0).alias("valid"), F.array(F.lit("f")).alias("out_of_range_features"))
    reference = spark.createDataFrame([("f", [float(4 * i) for i in range(101)])], "feature string, quantiles array<double>")
    limits = spark.createDataFrame([(200, "f", 0.2)], "window_size int, feature string, p95 double")
    report = drift.drift_report(validated, reference, limits).first()
    assert passed.value <= 2 * 400
    exact = np.array([i * i % 397 + 1 for i in range(400)], float)
    assert report["observed"] == report["accepted"] == 400 and report["out_of_range_rate"] == 1
    assert np.allclose([report["mean"], report["std"]], [exact.mean(), exact.std(ddof=1)])
    assert [report["p25"], report["p50"], report["p75"]] == np.quantile(exact, [0.25, 0.5, 0.75]).tolist()


def test_a_compatibility_profile_parses_its_texts_twice(spark):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    texts = spark.range(300, numPartitions=1).select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("raw"))
    column = {v: k for k, v in contract.CAPTURE_TO_CONTRACT.items()}["Flow Duration"]
    capture = texts.mapInPandas(counted, "raw string").select(F.when(F.col("raw") != " 7", F.col("raw")).otherwise("1e999").alias(column))
    reference = spark.createDataFrame([("Flow Duration", 0.0, 9.0, 0.5, 0.0)], "feature string, p01 double, p99 double, zero_fraction double, negative_fraction double")
    row = profile.compatibility_profile(capture, reference, ["Flow Duration"], ["Flow Duration"]).first()
    exact = np.array([i for i in range(300) if i != 7], float)
    assert passed.value <= 2 * 300 and (row["observed"], row["n_valid"], row["live_max"]) == (300, 299, 299.0)
    assert np.allclose([row[c] for c in ("live_mean", "live_zero_fraction", "live_p01", "live_p50", "live_p99")],
                       [exact.mean(), 1 / 299, *np.quantile(exact, [0.01, 0.5, 0.99])])
    assert (row["flags"], row["verdict"]) == ("RANGE_SHIFT,ZERO_SHIFT", "OK_WITH_INVALIDS")


class Entries(dict):
    """A map state that counts its calls."""
    calls = 0

    def exists(self):
        return bool(self)

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(self.items())


def test_incident_state_is_called_per_key_and_not_per_incident():
    state, timers = Entries(), []
    handle = types.SimpleNamespace(getMapState=lambda *schema: state, registerTimer=timers.append)
    processor = correlate.IncidentProcessor(10, 1600, None)
    processor.init(handle)
    rows = pd.DataFrame([(f"k{k}", s * 10**6, s * 10**6, 1, 0, [f"d{s}"], False, None, None) for k in range(50) for s in (0, 5, 150, 200, 300)],
                        columns=["correlation_key", "first_us", "last_us", "n", "worst", "destinations", "overflow", "incident_no", "status"])
    out = pd.concat(processor.handleInputRows((1,), iter([rows]), None))
    assert len(out) == 200 and out["n"].sum() == 250 and state.calls == 50 and len(timers) == 1
    assert timers[0] >= 1605 * 1000 and timers[0] <= 1705 * 1000
    list(processor.handleExpiredTimer((1,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: timers[0]), None))
    assert all([facts[0] for facts in entry[2]] == [2, 3, 4] for entry in state.values()) and timers[1] >= 1700 * 1000
    late = rows.iloc[:1].assign(first_us=301 * 10**6, incident_no=1.0, status="RESOLVED", n=0)
    [last] = processor.handleInputRows((1,), iter([late]), None)
    assert last.iloc[0]["status"] == "RESOLVED" and last["n"].isna().all() and state["k0",][0] == 4


def test_a_kept_drift_report_validates_its_rows_once(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    features = ["Flow Duration", "Bwd PSH Flags"]
    raw = spark.range(300, numPartitions=1).select(F.when(F.col("id") % 7 != 3, F.create_map(
        F.lit("Flow Duration"), F.col("id").cast("string"))).otherwise(F.create_map(F.lit("x"), F.lit("1"))).alias("features"))
    reference = spark.createDataFrame([(f, 9.0, 200.0, [2.5 * i for i in range(101)]) for f in features],
                                      "feature string, p01 double, p99 double, quantiles array<double>")
    limits = spark.createDataFrame([(200, f, 0.2) for f in features], "window_size int, feature string, p95 double")

    def keep(rows):
        rows.write.parquet(str(tmp_path / "kept"))
        return spark.read.parquet(str(tmp_path / "kept"))

    plain = drift.drift_report(validate.validate(raw, features, reference=reference), reference, limits).collect()
    rows = validate.validate(raw.mapInPandas(counted, raw.schema), features, reference=reference)
    once = drift.drift_report(rows, reference, limits, features, keep).collect()
    assert passed.value == 300

    def values(report):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in report)

    assert values(once) == values(plain)
    assert {r["feature"]: (r["missing_rate"], r["zero_filled_rate"]) for r in once} == {"Flow Duration": (43 / 300, 0.0), "Bwd PSH Flags": (0.0, 1.0)}
