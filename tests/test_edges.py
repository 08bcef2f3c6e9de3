"""Edge cases on small literal tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from netweir.functions import cleaning, draws, numbers, ordered
from netweir.functions.derive import RULES, derived
from netweir.operators import alarms, balance, drift, evaluate, incidents, runs, splits, validate


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_twelve_hour_clock(spark):
    texts = ["7/7/2017 8:55", "7/7/2017 12:30", "7/7/2017 1:00:05", "3/7/2017 5:02", "7/7/2017 6:10",
             "7/7/2017 7:10", "7/7/2017 13:10", "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.hour(cleaning.repair_12h_timestamp(F.col("t")))).collect()]
    assert got == [8, 12, 13, 17, None, None, None, None]


def test_strict_clock_refuses_ambiguous_hours(spark):
    df = spark.createDataFrame([("7/7/2017 6:10",)], "t string")
    with pytest.raises(Exception, match="hour of day"):
        df.select(cleaning.repair_12h_timestamp(F.col("t"), strict=True)).collect()


def test_number_reasons(spark):
    cases = {"1.5": (1.5, None), " 2 ": (2.0, None), "1d": (None, "non_numeric"), "1_000": (1000.0, None),
             "1e400": (None, "inf"), "-Infinity": (None, "inf"), "NaN": (None, "empty"), "+nan": (None, "nan"),
             "-": (None, "empty"), "": (None, "empty"), "0x1": (None, "non_numeric"), ".5": (0.5, None)}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(
        "t", numbers.parse_number(F.col("t")).alias("p"))
    assert {r["t"]: (r["p"]["value"], r["p"]["reason"]) for r in df.collect()} == cases


@pytest.mark.parametrize("k,n", [(0, 10), (10, 10), (3, 10), (85, 960)])
def test_wilson_contains_the_point(spark, k, n):
    w = spark.range(1).select(numbers.wilson(F.lit(k), F.lit(n)).alias("w")).first()["w"]
    assert 0 <= w["low"] <= k / n <= w["high"] <= 1


def test_wilson_without_trials(spark):
    assert spark.range(1).select(numbers.wilson(F.lit(0), F.lit(0))).first()[0] is None


def test_interpolation_takes_the_rightmost_repeated_knot(spark):
    knots, levels = F.array(*[F.lit(x) for x in (0.0, 1.0, 1.0, 1.0, 2.0)]), F.array(
        *[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 1.0, 1.5, 2.0, 9.0)], "x double")
    got = [r[0] for r in df.select(numbers.interpolate(F.col("x"), knots, levels)).collect()]
    assert got == pytest.approx([0.0, 0.125, 0.75, 0.875, 1.0, 1.0])


def test_minimum_ignores_backward_without_backward_packets(spark):
    names = RULES["Min Packet Length"].inputs
    df = spark.createDataFrame([(40.0, 0.0, 0.0), (40.0, 20.0, 3.0), (40.0, None, 3.0)], [f"c{i}" for i in range(3)])
    read = dict(zip(names, ("c0", "c1", "c2")))
    got = [r[0] for r in df.select(derived("Min Packet Length", lambda n: F.col(read[n]))).collect()]
    assert got == [40.0, 20.0, None]


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "B")], "y_true string, y_pred string")
    got = {r["label"]: r for r in evaluate.per_class(evaluate.confusion(df, ["A", "B"])).collect()}
    assert got["A"]["precision"] is None and got["A"]["f1"] == 0.0
    assert got["B"]["recall"] == 1.0


def test_label_outside_the_class_list_is_refused(spark):
    df = spark.createDataFrame([("A", "C")], "y_true string, y_pred string")
    with pytest.raises(Exception, match="outside the class list"):
        evaluate.confusion(df, ["A", "B"]).collect()


def alarm_table(spark, seconds, **extra):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(seconds=s), "HIGH", "10.0.0.1", f"192.168.0.{i % 250}-{i}", "PortScan", "M")
            for i, s in enumerate(seconds)]
    return spark.createDataFrame(data, "alarm_id long, created_at timestamp, severity string, source_ip string, "
                                       "destination_ip string, attack_type string, detection_method string")


def test_gap_equal_to_the_window_stays(spark):
    assert incidents.sessionise_incidents(alarm_table(spark, [0, 120, 240]), 120).count() == 1
    assert incidents.sessionise_incidents(alarm_table(spark, [0, 120, 241]), 120).count() == 2


def test_destination_list_is_cut_at_one_hundred(spark):
    for n, truncated in ((100, False), (101, True)):
        r = incidents.sessionise_incidents(alarm_table(spark, range(n)), 120).first()
        assert len(r["destination_ips"]) == 100 and r["destinations_truncated"] is truncated
        assert r["destination_count"] == n


def test_severity_thresholds_must_fall():
    with pytest.raises(ValueError):
        alarms.severity(None, {"critical": 0.8, "high": 0.9, "medium": 0.7})


def test_draw_is_exact_whatever_the_target(spark):
    df = spark.range(500).select(F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 3).alias("g"))
    targets = spark.createDataFrame([(0, 10), (1, 0), (2, 10_000)], "g long, k long")
    got = dict(rows(draws.draw(df, ["g"], "row_id", 1, targets, "k").where("drawn").groupBy("g").count(), "g", "count"))
    assert got == {0: 10, 2: 166}


def test_quantiles_equal_percentile(spark):
    df = spark.range(997).select((F.col("id") % 2).alias("g"), (F.sin("id") * F.pow(F.lit(10.0), F.col("id") % 7)).alias("v"))
    grid = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in ordered.exact_quantiles(df, ["g"], "v", grid).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in grid])).alias("q")).collect()}
    for g in want:
        assert got[g] == pytest.approx(want[g])


def test_value_cells_are_monotone(spark):
    values = [-1e12, -3.7, -1.0001, -1.0, -0.5, -1e-9, 0.0, 1e-9, 0.3, 1.0, 1.0001, 5.0, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(ordered.value_cell(F.col("v"))).collect()]
    assert got == sorted(got)


def test_constant_reference(spark):
    reference = spark.createDataFrame([("f", [5.0] * 101)], "feature string, quantiles array<double>")
    for values, want in (([5.0, 5.0], 0.0), ([5.0, 6.0], 1.0), ([], 0.0)):
        long = spark.createDataFrame([("f", v) for v in values], "feature string, value double")
        assert drift.ks_vs_reference(long, reference).first()["ks_statistic"] == want


def test_temporal_split_keeps_an_instant_whole(spark):
    stamps = [0] * 3 + [1] * 5 + [2] * 2
    df = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate(stamps)],
                               "row_id string, ts timestamp")
    got = splits.temporal_split(df, "ts", 0.5).groupBy("split").count()
    assert dict(rows(got, "split", "count")) == {"train": 8, "test": 2}


def test_smote_rows_lie_between_neighbours(spark):
    data = [("R", f"r{i}", [float(i), float(i * i)]) for i in range(6)] + [("BENIGN", f"b{i}", [0.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(data, "label string, row_id string, vector array<double>")
    plan = balance.balance_plan(df, "label", 4, 20)
    made = balance.smote(df, plan, "label", "row_id", "vector", 1, 5, 20).collect()
    points = {r: v for _, r, v in data}
    assert len(made) == 14 and len({r["row_id"] for r in made}) == 14
    for r in made:
        a, b = points[r["base_id"]], points[r["neighbour_id"]]
        assert 0 <= r["u"] < 1 and a != b
        assert r["vector"] == pytest.approx([x + r["u"] * (y - x) for x, y in zip(a, b)])
    counts = balance.balance(df, "label", "row_id", "vector", 1, 4, 20).groupBy("label").count()
    assert dict(rows(counts, "label", "count")) == {"BENIGN": 4, "R": 20}


@pytest.mark.parametrize("b,c", [(0, 5), (3, 9), (40, 60), (1500, 1400)])
def test_mcnemar_equals_the_binomial_tail(spark, b, c):
    n, k = b + c, min(b, c)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)
    got = spark.range(1).select(runs.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long"))).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_derived_values_are_no_inputs(spark):
    df = spark.createDataFrame([({"Total Fwd Packets": "4", "Flow Duration": "2000000"},)], "features map<string,string>")
    r = validate.validate(df, ["Fwd Packets/s", "Flow Packets/s", "Bwd Avg Bulk Rate"]).first()
    assert not r["valid"] and r["missing_features"] == ["Flow Packets/s"]
    assert [d["feature"] for d in r["derived_features"]] == ["Fwd Packets/s"]
    assert r["zero_filled_features"] == ["Bwd Avg Bulk Rate"]


def test_key_with_a_third_of_all_rows_is_not_one_task(spark):
    """The hot key's rows are combined into cells before they are exchanged."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("correlation_key"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000).alias("created_at"))
    got = incidents.incident_count(df, ["correlation_key"], "created_at", 120).first()["incidents"]
    assert got == 20001


def test_thresholds_table_must_have_one_descending_row(spark):
    flows = spark.createDataFrame([("ATTACK", 0.9)], "predicted_label string, confidence double")
    shape = "critical_min double, high_min double, medium_min double"
    good = spark.createDataFrame([(0.95, 0.85, 0.7)], shape)
    assert alarms.severity_from(flows, good).first()["severity"] == "HIGH"
    for bad in ([(0.95, 0.85, 0.7), (0.9, 0.8, 0.6)], [(0.7, 0.85, 0.95)], []):
        with pytest.raises(Exception, match="strictly descending"):
            alarms.severity_from(flows, spark.createDataFrame(bad, shape)).collect()


def test_a_flow_without_a_time_takes_the_alarms(spark):
    flows = spark.createDataFrame([(1, None, "ATTACK", 0.9, "s", "d", "PortScan", "m")], (
        "flow_id long, flow_ts timestamp, predicted_label string, confidence double, source_ip string, destination_ip string, "
        "attack_type string, detection_method string"))
    raised = dt.datetime(2024, 1, 1)
    assert alarms.raise_alarms(flows, raised_at=F.lit(raised)).first()["created_at"] == raised


def test_cells_tell_tiny_values_apart(spark):
    values = [-2.5, -1e-9, -3e-300, 0.0, 5e-324, 3e-12, 3.1e-12, 1e-6, 0.5, 0.501, 1.0, 7e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = [r[0] for r in df.orderBy("v").select(ordered.value_cell(F.col("v"))).collect()]
    assert cells == sorted(cells) and len(set(cells)) == len(values)
    tiny = spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") * 1e-9).alias("v"))
    q = ordered.exact_quantiles(tiny, ["g"], "v", [0.25, 0.5]).first()["quantiles"]
    assert q == pytest.approx([249.75e-9, 499.5e-9], rel=1e-12)


def test_score_intervals_and_ranking_of_a_pool(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.6), (False, 0.1)], "attack boolean, s double")
    r = runs.pooled_binary(df, F.col("attack"), F.col("s") >= 0.5, "s").first()
    assert (r.roc_auc, r.tp, r.fp) == (0.75, 1, 1) and r.recall_low < 0.5 < r.recall_high
    one = runs.pooled_binary(df.where("attack"), F.col("attack"), F.col("s") >= 0.5, "s").first()
    assert one.roc_auc is None and one.pr_auc is None
