"""Cleaning, derivation, validation and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions import cleaning
from netweir.functions.derive import RULES, derived
from netweir.functions.numbers import parse_number
from netweir.operators import clean as C
from netweir.operators import profile as P
from netweir.operators import validate as V
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.registry import query
from netweir.sources import adapters as src

INF = "CAST('Infinity' AS DOUBLE)"
DIRTY = ctes.FEATURES + f""",
dirty AS (SELECT row_id, ' ' || replace(label, 'DoS Hulk', 'Web Attack ' || chr(150) || ' XSS') AS "Label",
  CASE WHEN discount = 0 AND quantity > 25 THEN {INF} WHEN tax = 0 AND quantity < 3 THEN CAST('NaN' AS DOUBLE)
    ELSE extendedprice / (quantity * 100) END AS "Flow Bytes/s",
  CASE WHEN tax = 0 AND quantity > 48 THEN -{INF} WHEN quantity <> 7 THEN quantity - 10 END AS "Flow Packets/s",
  extendedprice / 64 AS "Flow Duration", CAST(0.0 AS DOUBLE) AS "Bwd PSH Flags",
  CASE WHEN quantity = 50 AND discount < 0.03 THEN CAST(1 AS DOUBLE) ELSE 0 END AS "ECE Flag Count" FROM features)"""
DIRTY_FEATURES = ["Flow Bytes/s", "Flow Packets/s", "Flow Duration", "Bwd PSH Flags", "ECE Flag Count"]


@query("drop_nonfinite", f"""WITH {DIRTY}
SELECT row_id, "Flow Bytes/s" AS bytes_s, "Flow Packets/s" AS packets_s FROM dirty
WHERE isfinite("Flow Bytes/s") AND isfinite("Flow Packets/s")""")
def drop_nonfinite(spark, sf):
    return C.drop_nonfinite(src.dirty_features(spark, sf)).select(
        "row_id", F.col("`Flow Bytes/s`").alias("bytes_s"), F.col("`Flow Packets/s`").alias("packets_s"))


@query("nonfinite_by_column", f"""WITH {DIRTY}, l AS (UNPIVOT (SELECT * EXCLUDE (row_id, "Label") REPLACE (
    coalesce("Flow Packets/s", CAST('NaN' AS DOUBLE)) AS "Flow Packets/s") FROM dirty)
  ON COLUMNS(*) INTO NAME "column" VALUE v)
SELECT "column", count(*) FILTER (isnan(v)) AS nan_count, count(*) FILTER (isinf(v)) AS inf_count FROM l GROUP BY 1""")
def nonfinite_by_column(spark, sf):
    return C.nonfinite_by_column(src.dirty_features(spark, sf))


@query("clean_label", f"""WITH {DIRTY}
SELECT trim(replace("Label", chr(150), '-')) AS label, count(*) AS n FROM dirty GROUP BY 1""")
def clean_label(spark, sf):
    return src.dirty_features(spark, sf).groupBy(cleaning.clean_label(F.col("Label")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


CLOCK = """clock AS (SELECT event_id, ts, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END AS h FROM events)"""


@query("repair_12h_timestamp", f"""WITH {CLOCK}
SELECT event_id, epoch_us(CASE WHEN h NOT IN (6, 7) THEN date_trunc('day', ts) + to_hours(CASE WHEN h <= 5 THEN h + 12 ELSE h END)
  + to_minutes(minute(ts)) + to_seconds(CASE WHEN event_id % 2 = 0 THEN second(ts) ELSE 0 END) END) AS repaired FROM clock""")
def repair_12h_timestamp(spark, sf):
    return src.clock_texts(spark, sf).select("event_id", F.unix_micros(
        cleaning.repair_12h_timestamp(F.col("text"))).alias("repaired"))


@query("clock_hour_guard", f"""WITH {CLOCK} SELECT CAST(h AS INT) AS hour, count(*) AS n FROM clock WHERE h IN (6, 7) GROUP BY h""")
def clock_hour_guard(spark, sf):
    hour = cleaning.clock_hour(F.col("text"))
    return src.clock_texts(spark, sf).where(~(hour.between(1, 5) | hour.between(8, 12))).groupBy(
        hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def times_sql(shift: str) -> str:
    return f"""t AS (SELECT event_id, event_id % 10 AS kind, ts, epoch_us(date_trunc('second', ts)) AS s FROM events),
parsed AS (SELECT event_id, ts, CASE kind WHEN 0 THEN s WHEN 1 THEN s - 7200000000 WHEN 6 THEN s
  WHEN 2 THEN epoch_us(ts) - {shift} WHEN 3 THEN s - {shift} WHEN 4 THEN epoch_us(date_trunc('minute', ts)) - {shift}
  WHEN 5 THEN s - {shift} WHEN 7 THEN epoch_us(date_trunc('day', ts)) - {shift} END AS us FROM t)"""


@query("parse_timestamp_multi", f"WITH {times_sql('0')} SELECT event_id, us FROM parsed")
def parse_timestamp_multi(spark, sf):
    return src.time_texts(spark, sf).select("event_id", F.unix_micros(
        cleaning.parse_timestamp(F.col("text"))).alias("us"))


@query("parse_timestamp_in_zone", f"WITH {times_sql('3600000000')} SELECT event_id, us FROM parsed")
def parse_timestamp_in_zone(spark, sf):
    return src.time_texts(spark, sf).select("event_id", F.unix_micros(
        cleaning.parse_timestamp(F.col("text"), "Europe/Tirane")).alias("us"))


@query("resolve_capture_time", f"""WITH {times_sql('0')}
SELECT event_id, coalesce(us, epoch_us(ts)) AS us, CASE WHEN us IS NULL THEN 'APPROXIMATE_INGEST' ELSE 'EXACT_CAPTURE' END AS capture_timestamp_source,
  CASE WHEN us IS NOT NULL THEN 'flow_start' END AS capture_timestamp_column, us IS NULL AS capture_timestamp_is_approximate FROM parsed""")
def resolve_capture_time(spark, sf):
    df = src.time_texts(spark, sf).withColumnRenamed("text", "flow_start").withColumn("timestamp", F.lit("-"))
    return C.resolve_capture_time(df, "ingested_at").select(
        "event_id", F.unix_micros("capture_timestamp").alias("us"), "capture_timestamp_source",
        "capture_timestamp_column", "capture_timestamp_is_approximate")


@query("protocol_name", f"""WITH {ctes.FLOWS}
SELECT protocol, CASE protocol WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '1.0' THEN 'ICMP' ELSE 'UNKNOWN' END AS name, count(*) AS n
FROM flows GROUP BY ALL""")
def protocol_name(spark, sf):
    return src.flows(spark, sf).groupBy("protocol", cleaning.protocol_name(F.col("protocol")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"))


NUMBER_CASES = """cases AS (SELECT c_custkey, c_acctbal, CASE c_custkey % 12 WHEN 0 THEN CAST(c_acctbal AS VARCHAR) WHEN 1 THEN ' 1e3 ' WHEN 2 THEN '1d'
  WHEN 3 THEN '1_000' WHEN 4 THEN 'nan' WHEN 5 THEN 'Infinity' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN 'N/A' WHEN 9 THEN '.5'
  WHEN 10 THEN '-INF' ELSE c_mktsegment END AS raw FROM customer)"""


@query("parse_numeric", f"""WITH {NUMBER_CASES}
SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN c_acctbal WHEN 1 THEN 1000.0 WHEN 3 THEN 1000.0 WHEN 9 THEN 0.5 END AS value,
  CASE c_custkey % 12 WHEN 2 THEN 'non_numeric' WHEN 4 THEN 'empty' WHEN 5 THEN 'inf' WHEN 6 THEN 'empty' WHEN 7 THEN 'null' WHEN 8 THEN 'empty'
    WHEN 10 THEN 'inf' WHEN 11 THEN 'non_numeric' END AS reason FROM cases""")
def parse_numeric(spark, sf):
    return numbers(spark, sf).select("c_custkey", parse_number(F.col("raw")).alias("p")).select(
        "c_custkey", "p.value", "p.reason")


def numbers(spark, sf):
    texts = F.array(F.col("c_acctbal").cast("string"), F.lit(" 1e3 "), F.lit("1d"), F.lit("1_000"), F.lit("nan"),
                    F.lit("Infinity"), F.lit(""), F.lit(None).cast("string"), F.lit("N/A"), F.lit(".5"), F.lit("-INF"),
                    F.col("c_mktsegment"))
    return src.table(spark, sf, "customer").select(
        "c_custkey", F.element_at(texts, (F.col("c_custkey") % 12 + 1).cast("int")).alias("raw"))


@query("coerce_fill_zero", f"""WITH {NUMBER_CASES}
SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN c_acctbal WHEN 1 THEN 1000.0 WHEN 9 THEN 0.5 ELSE 0.0 END AS raw FROM cases""")
def coerce_fill_zero(spark, sf):
    return C.coerce_fill_zero(numbers(spark, sf), ["raw"])


VECTORS = f"""vec AS (SELECT {ctes.ROW_ID} AS row_id, l_returnflag AS flag, l_linestatus AS status, l_quantity AS q,
  CASE WHEN l_tax = 0 AND l_quantity > 40 THEN 0.0 ELSE floor(l_extendedprice * 10) END AS dur, l_quantity AS fwd, l_linenumber - 1.0::DOUBLE AS bwd,
  floor(l_extendedprice / 4) AS fb, (l_linenumber - 1.0::DOUBLE) * 64 AS bb, l_quantity * 20 AS fmax, l_quantity + 4 AS fmin, l_quantity * 10 AS fmean,
  (l_linenumber - 1.0::DOUBLE) * 32 AS bmax, (l_linenumber - 1.0::DOUBLE) * 8 AS bmin, (l_linenumber - 1.0::DOUBLE) * 16 AS bmean,
  l_quantity * 0.5::DOUBLE + l_linenumber AS sd FROM lineitem)"""

DERIVED_SQL = {
    "Avg Fwd Segment Size": "fmean", "Avg Bwd Segment Size": "bmean", "Subflow Fwd Packets": "fwd",
    "Subflow Bwd Packets": "bwd", "Subflow Fwd Bytes": "fb", "Subflow Bwd Bytes": "bb",
    "Down/Up Ratio": "CASE WHEN fwd <> 0 THEN floor(bwd / fwd) END", "Max Packet Length": "greatest(fmax, bmax)",
    "Min Packet Length": "CASE WHEN bwd = 0 THEN fmin ELSE least(fmin, bmin) END",
    "Flow Packets/s": "CASE WHEN dur <> 0 THEN (fwd + bwd) / (dur / 1000000) END",
    "Fwd Packets/s": "CASE WHEN dur <> 0 THEN fwd / (dur / 1000000) END",
    "Bwd Packets/s": "CASE WHEN dur <> 0 THEN bwd / (dur / 1000000) END", "Packet Length Variance": "sd * sd",
    "Flow Bytes/s": "CASE WHEN dur <> 0 THEN (fb + bb) / (dur / 1000000) END",
    "Flow IAT Mean": "CASE WHEN fwd + bwd > 1 THEN dur / (fwd + bwd - 1) END",
}


@query("derived_features", f"WITH {VECTORS} SELECT row_id, " + ", ".join(
    f'round({e}, 6) AS "{n}"' for n, e in DERIVED_SQL.items()) + " FROM vec")
def derived_features(spark, sf):
    return src.flow_vectors(spark, sf).select("row_id", *[
        F.round(derived(n, lambda c: F.col(f"`{c}`")), 6).alias(n) for n in RULES])


@query("verify_derivations", f"""WITH {VECTORS}, x AS (
  SELECT 'Max Packet Length' AS feature, 1.0 AS claimed, greatest(fmax, bmax) AS guess, CASE WHEN q = 5 THEN 1 ELSE greatest(fmax, bmax) END AS actual FROM vec
  UNION ALL SELECT 'Packet Length Variance', 0.9932, sd * sd, CASE WHEN q = 50 AND status = 'F' THEN NULL ELSE sd * sd * 1.0000001 END FROM vec
  UNION ALL SELECT 'Flow Packets/s', 1.0, CASE WHEN dur <> 0 THEN (fwd + bwd) / (dur / 1000000) END, (fwd + bwd) / nullif(dur / 1000000, 0) + CASE WHEN flag = 'N' AND q > 49 THEN 0.1 ELSE 0 END FROM vec)
SELECT feature, count(*) FILTER (guess IS NOT NULL AND actual IS NOT NULL) AS comparable,
  count(*) FILTER (abs(guess - actual) <= 0.000001 * greatest(abs(actual), 1)) AS exact,
  round(count(*) FILTER (abs(guess - actual) <= 0.000001 * greatest(abs(actual), 1)) / CAST(count(*) FILTER (guess IS NOT NULL AND actual IS NOT NULL) AS DOUBLE), 6) AS exact_rate,
  CAST(any_value(claimed) AS DOUBLE) AS claimed_rate,
  count(*) FILTER (abs(guess - actual) <= 0.000001 * greatest(abs(actual), 1)) / CAST(count(*) FILTER (guess IS NOT NULL AND actual IS NOT NULL) AS DOUBLE) < any_value(claimed) - 0.01 AS regression
FROM x GROUP BY feature""")
def verify_derivations(spark, sf):
    v, q = src.flow_vectors(spark, sf), F.col("Total Fwd Packets")

    def rule(name):
        return RULES[name].expression(*[F.col(f"`{c}`") for c in RULES[name].inputs])

    table = v.withColumns({
        "Max Packet Length": F.when(q == 5, 1.0).otherwise(rule("Max Packet Length")),
        "Packet Length Variance": F.when(~((q == 50) & (F.col("status") == "F")), rule("Packet Length Variance") * 1.0000001),
        "Flow Packets/s": rule("Flow Packets/s") + F.when((F.col("flag") == "N") & (q > 49), 0.1).otherwise(0.0)})
    return rounded(P.verify_derivations(table), skip=("claimed_rate",))


@query("redundant_columns", f"""WITH {VECTORS}
SELECT 'Total Fwd Packets' AS left_column, 'Fwd Packet Length Min' AS right_column, count(*) FILTER (fwd <> fmin) AS differing, count(*) FILTER (fwd <> fmin) = 0 AS identical FROM vec
UNION ALL SELECT 'Total Fwd Packets', 'Total Fwd Packets', 0, true""")
def redundant_columns(spark, sf):
    return C.redundant_columns(src.flow_vectors(spark, sf), [
        ("Total Fwd Packets", "Fwd Packet Length Min"), ("Total Fwd Packets", "Total Fwd Packets")])


@query("rename_to_contract", f"""WITH {VECTORS}
SELECT row_id, CAST(fwd AS DOUBLE) AS "Total Fwd Packets", bwd AS "Total Backward Packets", dur AS "Flow Duration", '7' AS "Bwd PSH Flags" FROM vec""")
def rename_to_contract(spark, sf):
    renamed = C.rename_to_contract(src.capture(spark, sf), keep=["row_id"])
    return renamed.select("row_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in
                                      ("Total Fwd Packets", "Total Backward Packets", "Flow Duration")], "Bwd PSH Flags")


@query("seconds_to_micros", f"""WITH {VECTORS} SELECT row_id, fmean * 1000000 AS "Flow IAT Mean", dur * 1000000 AS "Flow Duration", fb AS "Flow Bytes/s", true AS applied FROM vec""")
def seconds_to_micros(spark, sf):
    v = src.flow_vectors(spark, sf).withColumns({
        "Flow IAT Mean": F.col("Fwd Packet Length Mean"), "Flow Bytes/s": F.col("Total Length of Fwd Packets")})
    done = C.seconds_to_micros(v, ["Flow Duration", "Flow IAT Mean"])
    return done.select("row_id", "Flow IAT Mean", "Flow Duration", F.col("`Flow Bytes/s`"),
                       F.col(C.APPLIED).alias("applied"))


@query("replay_payload", f"""WITH {VECTORS}
SELECT row_id, CASE flag WHEN 'N' THEN 'BENIGN' ELSE 'ATTACK' END AS ground_truth_label, CASE WHEN flag <> 'N' THEN 'Attack - ' || flag END AS ground_truth_attack_type,
  CAST(fwd AS INT) AS source_port, 0 AS destination_port, 'TCP' AS protocol, dur AS duration, fwd AS packets FROM vec""")
def replay_payload(spark, sf):
    v = src.flow_vectors(spark, sf).withColumns({
        "Label": F.when(F.col("flag") == "N", " BENIGN").otherwise(F.concat(F.lit("Attack \x96 "), "flag")),
        "Source IP": F.col("row_id"), "Destination IP": F.lit("d"), "Source Port": F.col("Total Fwd Packets"),
        "Destination Port": F.lit("none"), "Protocol": F.lit("6.0")})
    p = C.replay_payload(v, ["Flow Duration", "Total Fwd Packets"])
    return p.select(F.col("source_ip").alias("row_id"), "ground_truth_label", "ground_truth_attack_type", "source_port",
                    "destination_port", "protocol", F.col("feature_vector")["Flow Duration"].alias("duration"),
                    F.col("feature_vector")["Total Fwd Packets"].alias("packets"))


# -- validation -----------------------------------------------------------------------

# Per row of the raw feature maps: how each disturbed feature fares under the rules.
VALIDATED = VECTORS + """,
state AS (SELECT *, q = 9 AS no_fmin, q = 8 AS null_bmax, q IN (3, 4, 5, 6) AS bad_sd, q = 7 AS text_sd,
  CASE q WHEN 3 THEN 'empty' WHEN 4 THEN 'non_numeric' WHEN 5 THEN 'empty' WHEN 6 THEN 'inf' END AS sd_reason FROM vec),
judged AS (SELECT *,
  CASE WHEN no_fmin THEN ['Fwd Packet Length Min'] ELSE [] END || CASE WHEN dur = 0 THEN ['Flow Bytes/s', 'Flow Packets/s'] ELSE [] END
    || CASE WHEN null_bmax THEN ['Max Packet Length'] ELSE [] END || CASE WHEN bad_sd THEN ['Packet Length Variance'] ELSE [] END AS missing,
  CASE WHEN null_bmax THEN ['Bwd Packet Length Max: null'] ELSE [] END || CASE WHEN bad_sd THEN ['Packet Length Std: ' || sd_reason] ELSE [] END AS invalid,
  CASE WHEN dur <> 0 THEN ['Flow Bytes/s', 'Flow Packets/s'] ELSE [] END || ['Down/Up Ratio'] || CASE WHEN NOT null_bmax THEN ['Max Packet Length'] ELSE [] END
    || CASE WHEN NOT bad_sd THEN ['Packet Length Variance'] ELSE [] END AS derived FROM state)"""


def joined(column):
    return F.array_join(column, ",")


def pairs(column):
    return F.array_join(F.transform(column, lambda e: F.concat(e["feature"], F.lit(": "), e["reason"])), ",")


@query("validate_strict", f"""WITH {VALIDATED}
SELECT row_id, len(missing) = 0 AND len(invalid) = 0 AS valid, array_to_string(missing, ',') AS missing, array_to_string(invalid, ',') AS invalid,
  array_to_string(derived, ',') AS derived, 'Bwd PSH Flags,Fwd Avg Bulk Rate' AS zero_filled, CASE WHEN q = 10 THEN '' ELSE 'unused_column' END AS unexpected,
  CASE WHEN len(missing) = 0 AND len(invalid) = 0 THEN round(dur + fwd + bwd + fb + bb + fmax + fmin + fmean + bmax + bmin + bmean
    + CASE WHEN text_sd THEN 1000 ELSE sd END + (fb + bb) / (dur / 1000000) + (fwd + bwd) / (dur / 1000000) + floor(bwd / fwd) + greatest(fmax, bmax)
    + CASE WHEN text_sd THEN 1000000 ELSE sd * sd END + CASE status WHEN 'F' THEN 12.5 ELSE 1000 END, 3) END AS vector_sum FROM judged""")
def validate_strict(spark, sf):
    v = V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES)
    return v.select("row_id", "valid", joined("missing_features").alias("missing"), pairs(F.col("invalid_features")).alias("invalid"),
                    joined(F.transform("derived_features", lambda e: e["feature"])).alias("derived"),
                    joined("zero_filled_features").alias("zero_filled"), joined("unexpected_features").alias("unexpected"),
                    F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 3).alias("vector_sum"))


@query("validate_permissive", f"""WITH {VALIDATED},
open AS (SELECT *, CASE WHEN no_fmin THEN ['Fwd Packet Length Min'] ELSE [] END || CASE WHEN null_bmax THEN ['Bwd Packet Length Max'] ELSE [] END
  || CASE WHEN bad_sd THEN ['Packet Length Std'] ELSE [] END || CASE WHEN dur = 0 THEN ['Flow Bytes/s', 'Flow Packets/s'] ELSE [] END
  || CASE WHEN null_bmax THEN ['Max Packet Length'] ELSE [] END || CASE WHEN bad_sd THEN ['Packet Length Variance'] ELSE [] END AS opened FROM judged)
SELECT row_id, true AS valid, array_to_string(['Bwd PSH Flags', 'Fwd Avg Bulk Rate'] || opened, ',') AS zero_filled, 20 AS width FROM open""")
def validate_permissive(spark, sf):
    v = V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES, policy=V.PERMISSIVE)
    return v.select("row_id", "valid", joined("zero_filled_features").alias("zero_filled"), F.size("vector").alias("width"))


def reference_of(spark, sf):
    v = src.flow_vectors(spark, sf).where(F.col("flag") == "N")
    return P.feature_reference(v, src.RAW_FEATURES)


LIMITS = """limits AS (SELECT quantile_cont(fwd, 0.01) AS fwd1, quantile_cont(fwd, 0.99) AS fwd99, quantile_cont(dur, 0.01) AS dur1, quantile_cont(dur, 0.99) AS dur99,
  quantile_cont(sd, 0.01) AS sd1, quantile_cont(sd, 0.99) AS sd99 FROM vec WHERE flag = 'N')"""


@query("range_check", f"""WITH {VALIDATED}, {LIMITS}
SELECT row_id, array_to_string(CASE WHEN len(missing) + len(invalid) > 0 THEN [] ELSE
  CASE WHEN dur < dur1 OR dur > dur99 THEN ['Flow Duration'] ELSE [] END || CASE WHEN fwd < fwd1 OR fwd > fwd99 THEN ['Total Fwd Packets'] ELSE [] END
  || CASE WHEN CASE WHEN text_sd THEN 1000 ELSE sd END NOT BETWEEN sd1 AND sd99 THEN ['Packet Length Std'] ELSE [] END END, ',') AS out_of_range FROM judged, limits""")
def range_check(spark, sf):
    kept = reference_of(spark, sf).where(F.col("feature").isin("Flow Duration", "Total Fwd Packets", "Packet Length Std"))
    v = V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES, reference=kept)
    return v.select("row_id", joined("out_of_range_features").alias("out_of_range"))


@query("validation_status", f"""WITH {VALIDATED}
SELECT row_id, CASE WHEN len(missing) > 0 THEN 'MISSING_FEATURE' WHEN bad_sd AND sd_reason = 'inf' THEN 'NONFINITE_VALUE' WHEN len(invalid) > 0 THEN 'INVALID_SCHEMA'
    WHEN q <> 10 THEN 'EXTRA_FEATURE' ELSE 'VALID' END AS validation_status,
  concat_ws(' | ', CASE WHEN len(missing) > 0 THEN len(missing) || ' missing: ' || array_to_string(missing, ', ') END, nullif(array_to_string(invalid, ' | '), ''),
    CASE WHEN len(missing) + len(invalid) = 0 AND q <> 10 THEN '1 unexpected feature(s): unused_column' END) AS errors FROM judged""")
def validation_status(spark, sf):
    v = V.validation_status(V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES), "reject")
    return v.select("row_id", "validation_status", F.array_join("validation_errors", " | ").alias("errors"))


@query("split_valid", f"""WITH {VALIDATED}
SELECT CASE WHEN len(missing) + len(invalid) = 0 THEN 'accepted' ELSE 'dead_letter' END AS outcome, count(*) AS n FROM judged GROUP BY 1""")
def split_valid(spark, sf):
    accepted, rejected = V.split_valid(V.validate(src.raw_features(spark, sf), src.VALIDATED_FEATURES))
    both = accepted.select(F.lit("accepted").alias("outcome")).unionAll(rejected.select(F.lit("dead_letter").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


PROFILE_STATUS = """status AS (SELECT feature, CASE WHEN feature IN ('Flow Bytes/s', 'Flow Packets/s', 'Down/Up Ratio', 'Max Packet Length', 'Packet Length Variance') THEN 'derivable'
    WHEN feature = 'Fwd Avg Bulk Rate' THEN 'constant_zero' WHEN feature = 'Average Packet Size' THEN 'unobtainable' ELSE 'present' END AS status
  FROM (SELECT unnest([{names}]) AS feature))""".format(names=", ".join(f"'{n}'" for n in src.VALIDATED_FEATURES))


@query("capture_profile", f"""WITH {VECTORS}, {PROFILE_STATUS},
bad AS (SELECT 'Packet Length Std' AS feature, count(*) FILTER (q IN (3, 5)) AS e, count(*) FILTER (q = 4) AS x, count(*) FILTER (q = 6) AS i, 0 AS z FROM vec
  UNION ALL SELECT 'Bwd Packet Length Min', 0, 0, 0, count(*) FILTER (q = 8) FROM vec)
SELECT feature, status, coalesce(z, 0) AS null_values, coalesce(e, 0) AS empty_values, coalesce(x, 0) AS non_numeric_values, CAST(0 AS BIGINT) AS nan_values, coalesce(i, 0) AS inf_values
FROM status LEFT JOIN bad USING (feature)""")
def capture_profile(spark, sf):
    return V.capture_profile(src.capture(spark, sf), src.VALIDATED_FEATURES)


@query("capture_verdict", f"""WITH {times_sql('0')}, {PROFILE_STATUS},
n AS (SELECT count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'derivable') AS derivable,
  count(*) FILTER (status = 'constant_zero') AS constant_zero, count(*) FILTER (status = 'unobtainable') AS unobtainable FROM status)
SELECT *, CASE WHEN unobtainable > 0 THEN 'BLOCKED' WHEN derivable + constant_zero > 0 THEN 'PASS_WITH_DERIVATION' ELSE 'PASS' END AS verdict,
  (SELECT count(us) FROM parsed) AS exact_times, (SELECT count(*) - count(us) FROM parsed) AS fallback_times FROM n""")
def capture_verdict(spark, sf):
    timed = C.resolve_capture_time(src.time_texts(spark, sf).withColumnRenamed("text", "timestamp"), "ingested_at")
    return V.capture_verdict(V.capture_profile(src.capture(spark, sf), src.VALIDATED_FEATURES), timed)


COMPAT_COLUMNS = {"Flow Duration": "dur", "Total Fwd Packets": "fwd", "Total Backward Packets": "bwd", "Total Length of Fwd Packets": "fb",
                  "Total Length of Bwd Packets": "bb", "Fwd Packet Length Max": "fmax", "Fwd Packet Length Min": "fmin", "Fwd Packet Length Mean": "fmean",
                  "Bwd Packet Length Max": "bmax", "Bwd Packet Length Min": "CASE WHEN q = 8 THEN NULL WHEN q > 30 THEN -bmin ELSE bmin END",
                  "Bwd Packet Length Mean": "bmean", "Packet Length Std": "CASE WHEN q NOT IN (3, 4, 5, 6) THEN sd END", "Bwd PSH Flags": "7.0"}
PLAIN = {**COMPAT_COLUMNS, "Bwd Packet Length Min": "bmin", "Packet Length Std": "sd"}


@query("compatibility_profile", f"""WITH {VECTORS},
live AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST({e} AS DOUBLE) AS v FROM vec" for f, e in COMPAT_COLUMNS.items())}),
ref AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, quantile_cont({e}, 0.01) AS p01, quantile_cont({e}, 0.99) AS p99, avg(CASE WHEN {e} = 0 THEN 1.0 ELSE 0 END) AS zf, avg(CASE WHEN {e} < 0 THEN 1.0 ELSE 0 END) AS nf FROM vec WHERE flag = 'N'" for f, e in PLAIN.items() if f != "Bwd PSH Flags")}),
s AS (SELECT feature, count(*) AS observed, count(v) AS n_valid, min(v) AS mn, max(v) AS mx, avg(v) AS mean, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p9,
  avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) FILTER (v IS NOT NULL) AS z, avg(CASE WHEN v < 0 THEN 1.0 ELSE 0 END) FILTER (v IS NOT NULL) AS n FROM live GROUP BY feature),
{PROFILE_STATUS}
SELECT feature, feature <> 'Average Packet Size' AS active, observed, n_valid, round(1 - n_valid / CAST(observed AS DOUBLE), 6) AS invalid_fraction, round(mn, 6) AS live_min, round(mx, 6) AS live_max, round(mean, 6) AS live_mean,
  round(p1, 6) AS live_p01, round(p50, 6) AS live_p50, round(p9, 6) AS live_p99, round(z, 6) AS live_zero_fraction, round(n, 6) AS live_negative_fraction,
  CASE WHEN n_valid > 0 THEN concat_ws(',', CASE WHEN p50 < p01 OR p50 > p99 THEN 'RANGE_SHIFT' END, CASE WHEN nf = 0 AND n > 0 THEN 'SIGN_SHIFT' END, CASE WHEN abs(z - zf) > 0.25 THEN 'ZERO_SHIFT' END) ELSE '' END AS flags,
  CASE status WHEN 'derivable' THEN 'MISSING_BUT_DERIVABLE' WHEN 'constant_zero' THEN 'CONST_ZERO_OK' WHEN 'unobtainable' THEN 'MISSING' ELSE CASE WHEN observed > n_valid THEN 'OK_WITH_INVALIDS' ELSE 'OK' END END AS verdict,
  false AS blocking FROM status LEFT JOIN s USING (feature) LEFT JOIN ref USING (feature)""")
def compatibility_profile(spark, sf):
    return rounded(P.compatibility_profile(src.capture(spark, sf), reference_of(spark, sf), src.VALIDATED_FEATURES,
                                           [f for f in src.VALIDATED_FEATURES if f != "Average Packet Size"]))


# -- profiles -------------------------------------------------------------------------

def dirty_stats(f: str) -> str:
    return f"""SELECT '{f}' AS feature, count(*) FILTER (isfinite("{f}")) AS count, count(*) FILTER ("{f}" IS NULL OR isnan("{f}")) AS nan_count, count(*) FILTER (isinf("{f}")) AS inf_count,
  count(DISTINCT "{f}") FILTER (NOT isnan("{f}")) AS nunique, count(DISTINCT "{f}") FILTER (NOT isnan("{f}")) <= 1 AS constant,
  round(avg("{f}") FILTER (isfinite("{f}")), 6) AS mean, round(stddev_samp("{f}") FILTER (isfinite("{f}")), 6) AS std, round(min("{f}") FILTER (isfinite("{f}")), 9) AS min, round(max("{f}") FILTER (isfinite("{f}")), 9) AS max,
  round(avg(CASE WHEN "{f}" = 0 THEN 1.0 ELSE 0 END), 6) AS zero_fraction, round(avg(CASE WHEN "{f}" < 0 AND NOT isnan("{f}") THEN 1.0 ELSE 0 END), 6) AS negative_fraction,
  list_transform(quantile_cont("{f}", [{', '.join(str(i / 100) for i in range(101))}]) FILTER (isfinite("{f}")), lambda v: round(v, 9)) AS quantiles FROM dirty"""


REFERENCE = DIRTY + ", reference AS (" + " UNION ALL ".join(dirty_stats(f) for f in DIRTY_FEATURES) + ")"


@query("feature_reference", f"""WITH {REFERENCE}
SELECT * EXCLUDE (quantiles), CASE WHEN constant THEN min END AS constant_value, quantiles[2] AS p01, quantiles[26] AS p25, quantiles[51] AS p50, quantiles[76] AS p75, quantiles[100] AS p99 FROM reference""")
def feature_reference(spark, sf):
    exact = ("min", "max", "p01", "p25", "p50", "p75", "p99")
    reference = P.feature_reference(src.dirty_features(spark, sf), DIRTY_FEATURES).drop("quantiles").withColumns(
        {c: F.round(c, 9) for c in exact})
    return rounded(reference, skip=exact)


@query("feature_reference_quantiles", f"""WITH {REFERENCE},
q AS (SELECT feature, unnest(quantiles) AS value, unnest(range(101)) AS percent FROM reference)
SELECT feature, CAST(percent AS INT) AS percent, round(value, 9) AS value FROM q""")
def feature_reference_quantiles(spark, sf):
    reference = P.feature_reference(src.dirty_features(spark, sf), DIRTY_FEATURES)
    return reference.select("feature", F.posexplode("quantiles").alias("percent", "value")).withColumn("value", F.round("value", 9))


@query("constant_and_near_zero", f"""WITH {REFERENCE}
SELECT feature, CASE WHEN constant AND min = 0 THEN 'constant_zero' ELSE 'near_zero' END AS kind FROM reference WHERE (constant AND min = 0) OR zero_fraction >= 0.99""")
def constant_and_near_zero(spark, sf):
    return P.constant_and_near_zero(P.feature_reference(src.dirty_features(spark, sf), DIRTY_FEATURES))


@query("class_counts", f"WITH {ctes.RARE} SELECT label, count(*) AS n FROM rare GROUP BY label")
def class_counts(spark, sf):
    return P.class_counts(src.rare_features(spark, sf), "label")


@query("class_windows", f"""WITH {ctes.RARE} SELECT label, count(*) AS n_rows, min(ts_us) AS first_occurrence, max(ts_us) AS last_occurrence FROM rare GROUP BY label""")
def class_windows(spark, sf):
    return P.class_windows(src.rare_features(spark, sf).withColumn("ts", F.unix_micros("ts")), "label", "ts")


@query("source_summary", """WITH o AS (SELECT o_orderstatus AS source_file, epoch_us(o_orderdate) AS ts, o_orderkey FROM orders),
s AS (SELECT *, lag(ts) OVER (PARTITION BY source_file ORDER BY o_orderkey) AS prev FROM o)
SELECT source_file, count(*) AS n_rows, min(ts) AS first_timestamp, max(ts) AS last_timestamp,
  round(count(*) FILTER (ts >= prev) / CAST(count(prev) AS DOUBLE), 6) AS non_decreasing_share FROM s GROUP BY source_file""")
def source_summary(spark, sf):
    orders = src.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("source_file"), "o_orderkey",
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return rounded(P.source_summary(orders, "source_file", "ts", ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000)))


@query("source_class_counts", f"WITH {ctes.FEATURES} SELECT source_file, label, count(*) AS n FROM features GROUP BY ALL")
def source_class_counts(spark, sf):
    return P.source_class_counts(src.features(spark, sf), "source_file", "label")


@query("benign_baseline_quantiles", f"""WITH {ctes.FEATURES}, l AS (UNPIVOT (SELECT quantity, extendedprice, discount, tax FROM features WHERE label = 'BENIGN') ON COLUMNS(*) INTO NAME feature VALUE v)
SELECT feature, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.99), 6) AS p99 FROM l GROUP BY feature""")
def benign_baseline_quantiles(spark, sf):
    return rounded(P.benign_baseline_quantiles(src.features(spark, sf), src.FEATURE_COLUMNS, "label"))


SPLIT = ctes.RARE + ", split AS (SELECT *, CASE WHEN ts < TIMESTAMP '2000-06-01' THEN 'train' ELSE 'test' END AS split FROM rare WHERE NOT (label = 'Bot' AND ts < TIMESTAMP '2000-06-01'))"


def split_rows(spark, sf):
    train = F.col("ts") < F.lit("2000-06-01").cast("timestamp")
    return src.rare_features(spark, sf).where(~((F.col("label") == "Bot") & train)).withColumn(
        "split", F.when(train, "train").otherwise("test")).withColumn("ts", F.unix_micros("ts"))


@query("partition_report", f"""WITH {SPLIT},
l AS (SELECT label, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'test') AS te FROM split GROUP BY label),
a AS (SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'test') / CAST(count(*) AS DOUBLE) AS test_fraction,
  min(ts_us) FILTER (split = 'train') AS train_first, max(ts_us) FILTER (split = 'train') AS train_last, min(ts_us) FILTER (split = 'test') AS test_first, max(ts_us) FILTER (split = 'test') AS test_last,
  max(ts_us) FILTER (split = 'train') <= min(ts_us) FILTER (split = 'test') AS chronology_respected FROM split)
SELECT a.*, (SELECT coalesce(string_agg(label, ',' ORDER BY label), '') FROM l WHERE tr > 0 AND te > 0) AS classes_in_both,
  (SELECT coalesce(string_agg(label, ',' ORDER BY label), '') FROM l WHERE tr > 0 AND te = 0) AS classes_only_in_train,
  (SELECT coalesce(string_agg(label, ',' ORDER BY label), '') FROM l WHERE tr = 0 AND te > 0) AS classes_only_in_test,
  (SELECT CAST(coalesce(sum(te), 0) AS BIGINT) FROM l WHERE tr = 0) AS unseen_test_rows, (SELECT coalesce(sum(te), 0) FROM l WHERE tr = 0) / CAST(test_rows AS DOUBLE) AS unseen_test_fraction FROM a""")
def partition_report(spark, sf):
    return P.partition_report(split_rows(spark, sf), "label", "ts", "split")


@query("split_support", f"""WITH {SPLIT} SELECT label, count(*) FILTER (split = 'train') AS train_support, count(*) FILTER (split = 'test') AS test_support FROM split GROUP BY label""")
def split_support(spark, sf):
    return P.split_support(split_rows(spark, sf), "label", "split")


@query("latency_summary", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
  min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY event_type""")
def latency_summary(spark, sf):
    return rounded(P.latency_summary(src.table(spark, sf, "events"), ["event_type"], "value"))
