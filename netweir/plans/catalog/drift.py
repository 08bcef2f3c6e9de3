"""Drift, shift and feature-ranking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netweir.operators import drift as D
from netweir.operators import profile as P
from netweir.operators import validate as V
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.profiling import VECTORS
from netweir.plans.catalog.registry import query
from netweir.session import ensure_checkpoint_dir
from netweir.sources import adapters as src

GRID = "[" + ", ".join(str(i / 100) for i in range(101)) + "]"
COLUMNS = {"quantity": "quantity", "extendedprice": "extendedprice", "discount": "discount", "tax": "tax"}
LONG = ctes.FEATURES + """,
long AS (UNPIVOT (SELECT row_id, status, label, quantity, extendedprice, discount, tax FROM features) ON quantity, extendedprice, discount, tax INTO NAME feature VALUE v),
base AS (SELECT feature, v FROM long WHERE status = 'F' AND label = 'BENIGN'),
live AS (SELECT feature, CASE WHEN feature = 'extendedprice' THEN v * 1.25::DOUBLE WHEN feature = 'tax' THEN v / 2 ELSE v END AS v FROM long WHERE status = 'O')"""
KS_REF = LONG + f""",
ref AS (SELECT feature, quantile_cont(v, {GRID}) AS q FROM base GROUP BY feature),
ranked AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS i, count(*) OVER (PARTITION BY feature) AS n FROM live),
g AS (SELECT r.*, len(list_filter(q, lambda k: k <= v)) AS b, q FROM ranked r JOIN ref USING (feature)),
gv AS (SELECT *, CASE WHEN b = 0 THEN 0.0 WHEN b >= 101 THEN 1.0 ELSE (b - 1) / 100.0 + (v - q[b]) * (0.01 / (q[b + 1] - q[b])) END AS cdf FROM g),
ks AS (SELECT feature, max(greatest(i / CAST(n AS DOUBLE) - cdf, cdf - (i - 1) / CAST(n AS DOUBLE))) AS ks_statistic, count(*) AS sample_size FROM gv GROUP BY feature)"""


def sides(spark, sf):
    long = P.long_features(src.features(spark, sf), src.FEATURE_COLUMNS, ["status", "label"])
    base = long.where("status = 'F' AND label = 'BENIGN'").select("feature", "value")
    changed = F.when(F.col("feature") == "extendedprice", F.col("value") * 1.25).when(
        F.col("feature") == "tax", F.col("value") / 2).otherwise(F.col("value"))
    return base, long.where("status = 'O'").select("feature", changed.alias("value"))


def reference(base):
    from netweir.functions.ordered import exact_quantiles
    return exact_quantiles(base, ["feature"], "value", P.PERCENT_GRID).select("feature", "quantiles")


@query("ks_vs_reference", f"WITH {KS_REF} SELECT feature, round(ks_statistic, 6) AS ks_statistic, sample_size FROM ks")
def ks_vs_reference(spark, sf):
    base, live = sides(spark, sf)
    return rounded(D.ks_vs_reference(live, reference(base)))


TWO = LONG + """,
u AS (SELECT feature, v, 1 AS a FROM base UNION ALL SELECT feature, v, 0 FROM live),
d AS (SELECT feature, v, sum(a) AS na, sum(1 - a) AS nb FROM u GROUP BY 1, 2),
c AS (SELECT feature, sum(na) OVER w / CAST(sum(na) OVER t AS DOUBLE) AS fa, sum(nb) OVER w / CAST(sum(nb) OVER t AS DOUBLE) AS fb FROM d
  WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature)),
two AS (SELECT feature, max(abs(fa - fb)) AS ks_statistic FROM c GROUP BY feature)"""


@query("ks_two_sample", f"WITH {TWO} SELECT feature, round(ks_statistic, 6) AS ks_statistic FROM two")
def ks_two_sample(spark, sf):
    return rounded(D.ks_two_sample(*sides(spark, sf)))


def describe_sql(name: str, table: str) -> str:
    return f"""{name}_s AS (SELECT feature, count(*) AS {name}_n, avg(v) AS {name}_mean, stddev_pop(v) AS {name}_std, min(v) AS {name}_min, max(v) AS {name}_max,
  avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) AS {name}_zero_fraction, quantile_cont(v, 0.01) AS {name}_p01, quantile_cont(v, 0.25) AS {name}_p25, quantile_cont(v, 0.5) AS {name}_median,
  quantile_cont(v, 0.75) AS {name}_p75, quantile_cont(v, 0.99) AS {name}_p99 FROM {table} GROUP BY feature)"""


SHIFT_TAIL = f"""{describe_sql('base', 'base')}, {describe_sql('live', 'live')},
o AS (SELECT feature, avg(CASE WHEN v < base_p25 OR v > base_p75 THEN 1.0 ELSE 0 END) * 100 AS pct_outside_iqr, avg(CASE WHEN v < base_p01 OR v > base_p99 THEN 1.0 ELSE 0 END) * 100 AS pct_outside_p01_p99
  FROM live JOIN base_s USING (feature) GROUP BY feature),
shift AS (SELECT *, abs(live_mean - base_mean) / nullif(sqrt((base_std * base_std + live_std * live_std) / 2), 0) AS abs_standardized_diff, live_median - base_median AS median_diff,
  live_median / nullif(base_median, 0) AS median_ratio, base_std <= 1e-9 AS base_constant, live_std <= 1e-9 AS live_constant
  FROM base_s JOIN live_s USING (feature) JOIN o USING (feature) JOIN two USING (feature))"""
SHIFT = TWO + ", " + SHIFT_TAIL
SHIFT_COLUMNS = [f"{s}_{c}" for s in ("base", "live") for c in ("mean", "std", "min", "max", "zero_fraction", "p01", "p25", "median", "p75", "p99")] + [
    "pct_outside_iqr", "pct_outside_p01_p99", "ks_statistic", "abs_standardized_diff", "median_diff", "median_ratio"]


@query("feature_shift", f"WITH {SHIFT} SELECT feature, base_n, live_n, base_constant, live_constant, {', '.join(f'round({c}, 6) AS {c}' for c in SHIFT_COLUMNS)} FROM shift")
def feature_shift(spark, sf):
    return rounded(D.feature_shift(*sides(spark, sf)))


@query("shift_rank", f"WITH {TWO} SELECT feature, round(ks_statistic, 6) AS ks_statistic, CAST(row_number() OVER (ORDER BY ks_statistic DESC, feature) AS INT) AS shift_rank FROM two QUALIFY shift_rank <= 3")
def shift_rank(spark, sf):
    return rounded(D.shift_rank(D.ks_two_sample(*sides(spark, sf)), 3))


@query("shift_overview", f"""WITH {SHIFT}
SELECT count(ks_statistic) AS comparable_features, count(*) FILTER (ks_statistic IS NULL) AS not_comparable, round(quantile_cont(ks_statistic, 0.5), 6) AS median_ks, round(quantile_cont(ks_statistic, 0.75), 6) AS p75_ks,
  round(max(ks_statistic), 6) AS max_ks, count(*) FILTER (ks_statistic >= 0.3) AS ks_ge_0_3, count(*) FILTER (ks_statistic >= 0.5) AS ks_ge_0_5, count(*) FILTER (ks_statistic >= 0.8) AS ks_ge_0_8,
  count(*) FILTER (pct_outside_p01_p99 >= 50) AS ge_50pct_outside, count(*) FILTER (pct_outside_p01_p99 >= 100) AS all_outside FROM shift""")
def shift_overview(spark, sf):
    return rounded(D.shift_overview(D.feature_shift(*sides(spark, sf))))


# time features in other units: base in microseconds, live in seconds
UNITS = VECTORS + """,
base AS (SELECT unnest(['Flow Duration', 'Flow IAT Min', 'Flow Bytes/s', 'SYN Flag Count', 'Total Fwd Packets']) AS feature, unnest([dur, 0.0, fb, bwd, fwd]) AS v FROM vec WHERE status = 'F'),
live AS (SELECT unnest(['Flow Duration', 'Flow IAT Min', 'Flow Bytes/s', 'SYN Flag Count', 'Total Fwd Packets']) AS feature, unnest([dur / 1000000, 0.0, fb, bwd + 1, fwd]) AS v FROM vec WHERE status = 'O'),
u AS (SELECT feature, v, 1 AS a FROM base UNION ALL SELECT feature, v, 0 FROM live),
d AS (SELECT feature, v, sum(a) AS na, sum(1 - a) AS nb FROM u GROUP BY 1, 2),
c AS (SELECT feature, sum(na) OVER w / CAST(sum(na) OVER t AS DOUBLE) AS fa, sum(nb) OVER w / CAST(sum(nb) OVER t AS DOUBLE) AS fb FROM d
  WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature)),
two AS (SELECT feature, CASE WHEN feature <> 'Flow IAT Min' THEN max(abs(fa - fb)) END AS ks_statistic FROM c GROUP BY feature), """ + SHIFT_TAIL
UNIT_FEATURES = ["Flow Duration", "Flow IAT Min", "Flow Bytes/s", "SYN Flag Count", "Total Fwd Packets"]


def unit_sides(spark, sf, factor=1.0):
    v = src.flow_vectors(spark, sf)

    def long(status, scale, extra):
        part = v.where(F.col("status") == status)
        return P.long_features(part.withColumns({
            "Flow Duration": F.col("Flow Duration") * factor / scale if scale != 1 else F.col("Flow Duration"),
            "Flow IAT Min": F.lit(0.0), "Flow Bytes/s": F.col("Total Length of Fwd Packets"),
            "SYN Flag Count": F.col("Total Backward Packets") + extra}), UNIT_FEATURES)

    return long("F", 1, 0), long("O", 1000000, 1)


@query("unit_mismatch_audit", f"""WITH {UNITS}
SELECT feature, CASE feature WHEN 'Flow Duration' THEN 'time' WHEN 'Flow IAT Min' THEN 'time' WHEN 'Flow Bytes/s' THEN 'rate' WHEN 'SYN Flag Count' THEN 'flag' ELSE 'other' END AS kind,
  CASE feature WHEN 'Flow Duration' THEN 'UNIT_MISMATCH_SUSPECTED' WHEN 'Flow IAT Min' THEN 'LIKELY_SAME' WHEN 'Total Fwd Packets' THEN 'LIKELY_SAME' ELSE 'POSSIBLE_IMPLEMENTATION_DIFFERENCE' END AS semantic_status,
  round(base_median, 6) AS base_median, round(live_median, 6) AS live_median, round(median_ratio, 9) AS median_ratio, feature = 'Flow Duration' AS unit_ratio_found FROM shift""")
def unit_mismatch_audit(spark, sf):
    return rounded(D.unit_mismatch_audit(D.feature_shift(*unit_sides(spark, sf))), skip=("median_ratio",)).withColumn(
        "median_ratio", F.round("median_ratio", 9))


@query("contract_audit", f"""WITH {UNITS}
SELECT feature, round(base_p99, 6) AS base_p99, round(base_max, 6) AS base_max, round(live_p99, 6) AS live_p99, round(1 - live_zero_fraction, 6) AS live_nonzero, base_p99 >= 100000 AS base_microsecond_scale,
  live_zero_fraction < 1 AND live_p99 < 10000 AS live_second_scale, CASE feature WHEN 'Flow Bytes/s' THEN 'SEMANTICS_DIFFER' WHEN 'Flow Duration' THEN 'CONFIRMED_UNIT_CONVERSION' ELSE 'LIKELY_UNIT_CONVERSION' END AS semantic_status,
  CASE feature WHEN 'Flow Duration' THEN 'seconds_to_microseconds' ELSE 'none' END AS required_transformation FROM shift WHERE feature IN ('Flow Duration', 'Flow IAT Min', 'Flow Bytes/s')""")
def contract_audit(spark, sf):
    return rounded(D.contract_audit(*unit_sides(spark, sf)))


@query("before_after_shift", f"""WITH {UNITS}
SELECT feature, round(base_median, 6) AS base_median, round(ks_statistic, 6) AS ks_before, round(pct_outside_p01_p99, 6) AS outside_before, feature IN ('Flow Duration', 'Flow IAT Min') AS is_time_feature FROM shift""")
def before_after_shift(spark, sf):
    before = D.feature_shift(*unit_sides(spark, sf))
    after = D.feature_shift(*unit_sides(spark, sf, 1000000.0))
    return rounded(D.before_after_shift(before, after).select(
        "feature", "base_median", "ks_before", "outside_before", "is_time_feature"))


IMPORTANCE = LONG + """,
importances AS (SELECT feature, CAST(CASE feature WHEN 'quantity' THEN 0 WHEN 'extendedprice' THEN 1 WHEN 'discount' THEN 2 ELSE 3 END AS INT) AS dataset_position,
  CASE WHEN feature = 'tax' THEN 0 ELSE round(avg(CASE WHEN v > 20 THEN 1.0 ELSE 0 END), 2) END AS importance FROM long GROUP BY feature),
ranks AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, dataset_position) AS INT) AS rank FROM importances)"""


def importances(spark, sf):
    """A stand-in importance from the data: how often a feature is over 20."""
    long = P.long_features(src.features(spark, sf), src.FEATURE_COLUMNS)
    order = F.array_position(F.array(*[F.lit(c) for c in src.FEATURE_COLUMNS]), F.col("feature")) - 1
    share = F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 2)
    return long.groupBy("feature").agg(share.alias("share")).select(
        "feature", order.cast("int").alias("dataset_position"),
        F.when(F.col("feature") == "tax", 0.0).otherwise(F.col("share")).alias("importance"))


@query("rank_features", f"WITH {IMPORTANCE} SELECT feature, dataset_position, CAST(importance AS DOUBLE) AS importance, rank FROM ranks")
def rank_features(spark, sf):
    return D.rank_features(importances(spark, sf))


@query("feature_sets_from_importance", f"""WITH {IMPORTANCE}, n AS (SELECT unnest([2, 3]) AS n)
SELECT 'top' || n AS feature_set, rank AS position, feature FROM ranks, n WHERE rank <= n UNION ALL SELECT 'zero_importance', rank, feature FROM ranks WHERE importance <= 0""")
def feature_sets_from_importance(spark, sf):
    return D.feature_sets_from_importance(importances(spark, sf), [2, 3])


@query("importance_vs_shift", f"""WITH {IMPORTANCE}, {TWO[len(LONG) + 2:]}, s AS (SELECT *, CAST(row_number() OVER (ORDER BY ks_statistic DESC, feature) AS INT) AS shift_rank FROM two)
SELECT feature, rank AS importance_rank, CAST(importance AS DOUBLE) AS importance, round(ks_statistic, 6) AS ks_statistic, shift_rank, ks_statistic >= 0.5 AS substantially_shifted FROM ranks JOIN s USING (feature) WHERE rank <= 3""")
def importance_vs_shift(spark, sf):
    return rounded(D.importance_vs_shift(importances(spark, sf), D.ks_two_sample(*sides(spark, sf)), 3))


CALIBRATED = """limits AS (SELECT unnest([200, 500, 1000, 40000]) AS window_size, unnest([0.2, 0.1, 0.05, 0.012]) AS p95)"""


def limits(spark, features):
    """Thresholds as calibration would write them, one row per window and feature."""
    return spark.createDataFrame([(w, p) for w, p in ((200, 0.2), (500, 0.1), (1000, 0.05), (40000, 0.012))],
                                 "window_size int, p95 double").withColumn(
        "feature", F.explode(F.array(*[F.lit(f) for f in features])))


@query("nearest_calibration", f"""WITH {CALIBRATED}, n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(arg_min(window_size, abs(window_size - n) * 100000 + window_size) AS INT) AS window_size FROM limits, (SELECT min(n) AS n FROM n)""")
def nearest_calibration(spark, sf):
    n = src.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    return D.nearest_calibration(limits(spark, ["x"]).join(F.broadcast(n)), F.col("n"))


def drift_inputs(spark, sf):
    ref = P.feature_reference(src.flow_vectors(spark, sf).where("flag = 'N'"), ["Flow Duration", "Total Fwd Packets"]).persist()
    return V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES, reference=ref), ref


def kept(rows):
    """The rows written below the checkpoint folder and read again."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/report-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query("drift_report")
def drift_report(spark, sf):
    validated, ref = drift_inputs(spark, sf)
    return rounded(D.drift_report(validated, ref, limits(spark, src.VALIDATED_FEATURES), src.VALIDATED_FEATURES, kept))


@query("drift_rates", """WITH b AS (SELECT l_quantity AS q, CASE WHEN l_tax = 0 AND l_quantity > 40 THEN 0 ELSE floor(l_extendedprice * 10) END AS dur FROM lineitem)
SELECT 'Fwd Packet Length Min' AS feature, count(*) AS observed, round(avg(CASE WHEN q = 9 THEN 1.0 ELSE 0 END), 6) AS missing_rate, 0.0::DOUBLE AS invalid_rate, 0.0::DOUBLE AS derived_rate FROM b
UNION ALL SELECT 'Packet Length Std', count(*), 0, round(avg(CASE WHEN q IN (3, 4, 5, 6) THEN 1.0 ELSE 0 END), 6), 0 FROM b
UNION ALL SELECT 'Flow Bytes/s', count(*), round(avg(CASE WHEN dur = 0 THEN 1.0 ELSE 0 END), 6), 0, round(avg(CASE WHEN dur <> 0 THEN 1.0 ELSE 0 END), 6) FROM b""")
def drift_rates(spark, sf):
    validated, ref = drift_inputs(spark, sf)
    report = D.drift_report(validated, ref, limits(spark, src.VALIDATED_FEATURES), src.VALIDATED_FEATURES, kept)
    return rounded(report.where(F.col("feature").isin("Fwd Packet Length Min", "Packet Length Std", "Flow Bytes/s")).select(
        "feature", "observed", "missing_rate", "invalid_rate", "derived_rate"))


@query("drift_status", f"""WITH {KS_REF}, t AS (SELECT count(*) AS observed, count(*) FILTER (quantity < 2) AS rejected FROM features),
d AS (SELECT count(*) FILTER (ks_statistic > 0.05) AS drifted_features, avg(CASE WHEN ks_statistic > 0.05 THEN 1.0 ELSE 0 END) AS drifted_fraction FROM ks),
x AS (SELECT *, rejected / CAST(observed AS DOUBLE) AS bad FROM t, d)
SELECT CASE WHEN bad > 0.05 OR drifted_fraction > 0.2 THEN 'CRITICAL' WHEN bad > 0.01 OR drifted_fraction > 0.05 THEN 'WARNING' ELSE 'NORMAL' END AS status,
  coalesce(nullif(concat_ws('; ', CASE WHEN bad > 0.05 THEN 'invalid rate critical' WHEN bad > 0.01 THEN 'invalid rate raised' END,
    CASE WHEN drifted_fraction > 0.2 THEN 'drifted share above policy' WHEN drifted_fraction > 0.05 THEN 'drifted share above calibration' END), ''), 'within calibrated no-drift bounds') AS reasons,
  observed, rejected, round(bad, 6) AS invalid_rate, CAST(0 AS BIGINT) AS badly_missing, drifted_features, drifted_fraction FROM x""")
def drift_status(spark, sf):
    base, live = sides(spark, sf)
    report = D.ks_vs_reference(live, reference(base)).withColumns({
        "missing_rate": F.lit(0.0), "drifted": F.col("ks_statistic") > 0.05})
    totals = src.features(spark, sf).agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.col("quantity") < 2).alias("rejected"))
    return rounded(D.drift_status(report, totals, 0.05))


@query("calibrate_thresholds")
def calibrate_thresholds(spark, sf):
    f = src.features(spark, sf)
    ref = P.feature_reference(f, src.FEATURE_COLUMNS)
    return rounded(D.calibrate_thresholds(f, ref, src.FEATURE_COLUMNS, "row_id", 42))
