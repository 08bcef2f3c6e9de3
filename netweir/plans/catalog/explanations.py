"""Explanation, record-table and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.functions import text as T
from netweir.operators import explain as X
from netweir.operators import registry as G
from netweir.plans.catalog import ctes
from netweir.plans.catalog.alarms import FEEDBACK_SQL, feedback, rounded
from netweir.plans.catalog.registry import query
from netweir.sources import adapters as src
from netweir.sources import flows as R
from netweir.sources import sinks as K


def terms(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def any_of(column, words):
    return f"len(list_filter({terms(words)}, lambda t: contains({column}, t))) > 0"


EXPL = """expl AS (SELECT doc_id AS explanation_id, doc_id * 3 AS alarm_id, doc_id, lang, n_chars,
  CASE doc_id % 3 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'Claude-y' ELSE 'other-1' END AS text_model, CASE WHEN doc_id % 9 <> 8 THEN 'prompt-' || lang END AS prompt_version,
  CASE WHEN doc_id % 6 <> 0 THEN CAST(n_chars AS DOUBLE) / 4 END AS latency_ms, CASE doc_id % 4 WHEN 1 THEN 'USEFUL' WHEN 2 THEN 'WRONG' END AS rating,
  CASE WHEN doc_id % 2 = 0 THEN 'ATTACK' ELSE 'BENIGN' END AS decision, doc_id % 50 / 64.0::DOUBLE AS confidence, CASE WHEN doc_id % 8 < 6 THEN 'with_evidence' ELSE 'without_evidence' END AS condition,
  [CAST(n_chars AS DOUBLE), n_chars / 8.0::DOUBLE, CAST(doc_id % 100 AS DOUBLE)] AS vals, (doc_id % 10 + 1) / 16.0::DOUBLE AS c,
  CASE WHEN doc_id % 2 = 0 THEN 'The traffic looks like an attack' ELSE 'The traffic is normal' END
  || CASE doc_id % 3 WHEN 0 THEN '. Flow Duration is higher and points toward attack' WHEN 1 THEN '. Flow Duration is lower' ELSE '' END
  || CASE WHEN doc_id % 4 < 2 THEN ', Total Fwd Packets of ' || n_chars || ' increase the score' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN '. HTTP on port 8080, payload unread' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '. See port ' || (doc_id % 100) ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN '. Ask an analyst to verifik the feature values. ' ELSE '. ' END || text AS text FROM documents),
e1 AS (SELECT *, lower(text) AS low, list_distinct(flatten(list_transform(vals || [c, -c, c] || [confidence, confidence * 100], lambda x: [x, round_even(x, 0), round_even(x, 1), round_even(x, 2), round_even(x, 3)]))) AS nums FROM expl)"""

FIND = EXPL + r""",
found AS (SELECT *, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS v4,
  len(list_filter(regexp_extract_all(text, '(?i)\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b'), lambda m: NOT regexp_matches(m, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))) AS v6,
  """ + " + ".join(f"len(regexp_extract_all(text, '(?i){t}'))" for t in T.PAYLOAD_TERMS) + r""" AS payload,
  len(list_filter(regexp_extract_all(text, '(?i)\b(?:port(?:a|at|it|in|es)?|porti)\s*(?:nr\.?|numer|numri)?\s*[:#]?\s*(\d{1,5})\b', 1),
    lambda p: len(list_filter(nums, lambda n: abs(n - CAST(p AS DOUBLE)) <= 0.000001)) = 0)) AS ports,
  """ + " + ".join(rf"CASE WHEN regexp_matches(text, '(?i)\b{w}\b') THEN 1 ELSE 0 END" for w in T.PROTOCOL_WORDS) + r""" AS protocols FROM e1)"""


def checked(spark, sf):
    return X.check_explanations(src.explanations(spark, sf))


@query("groundedness", f"""WITH {FIND}
SELECT explanation_id, v4 + v6 + payload + ports + protocols = 0 AS grounded, CAST(v4 + v6 + payload + ports + protocols AS INT) AS finding_count, CAST(v4 + v6 + payload AS INT) AS high_severity_count FROM found""")
def groundedness(spark, sf):
    return checked(spark, sf).select("explanation_id", "grounded", "finding_count", "high_severity_count")


@query("groundedness_by_kind", f"""WITH {FIND}
SELECT 'ip_address_not_in_evidence' AS kind, CAST(sum(v4 + v6) AS BIGINT) AS n FROM found UNION ALL SELECT 'payload_or_packet_content_claim', CAST(sum(payload) AS BIGINT) FROM found
UNION ALL SELECT 'port_not_in_evidence', CAST(sum(ports) AS BIGINT) FROM found UNION ALL SELECT 'protocol_not_in_evidence', CAST(sum(protocols) AS BIGINT) FROM found""")
def groundedness_by_kind(spark, sf):
    return checked(spark, sf).select(F.explode("findings").alias("f")).groupBy("f.kind").agg(F.count(F.lit(1)).alias("n"))


@query("grounding_matches", f"""WITH {EXPL},
p AS (SELECT explanation_id, nums, text, regexp_extract_all(text, '(?i)\\b(?:port(?:a|at|it|in|es)?|porti)\\s*(?:nr\\.?|numer|numri)?\\s*[:#]?\\s*(\\d{{1,5}})\\b') AS ports FROM e1),
m AS (SELECT explanation_id, 'port_not_in_evidence' AS kind, unnest(list_filter(ports, lambda p: len(list_filter(nums, lambda n: abs(n - CAST(regexp_extract(p, '\\d+') AS DOUBLE)) <= 0.000001)) = 0)) AS matched FROM p
UNION ALL {" UNION ALL ".join(f"SELECT explanation_id, 'protocol_not_in_evidence', regexp_extract(text, '(?i)\\b{w}\\b') FROM p WHERE regexp_matches(text, '(?i)\\b{w}\\b')" for w in T.PROTOCOL_WORDS)})
SELECT explanation_id, kind, matched, count(*) AS n FROM m GROUP BY ALL""")
def grounding_matches(spark, sf):
    return checked(spark, sf).select("explanation_id", F.explode("findings").alias("f")).where(
        F.col("f.kind").isin("port_not_in_evidence", "protocol_not_in_evidence")).groupBy("explanation_id", "f.kind", "f.matched").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_with_anomaly", f"""WITH {EXPL},
a AS (SELECT explanation_id, list_distinct(nums || flatten(list_transform([n_chars + 0.5, n_chars / 16.0::DOUBLE, -c / 2, c / 4], lambda x: [x, round_even(x, 0), round_even(x, 1), round_even(x, 2), round_even(x, 3)]))) AS nums FROM e1)
SELECT explanation_id, CAST(len(nums) AS INT) AS n, round(list_sum(nums), 6) AS total FROM a""")
def evidence_with_anomaly(spark, sf):
    doc, n = F.col("explanation_id"), F.col("evidence")[0]["value"]
    c = (doc % 10 + 1) / 16
    anomaly = F.array(F.struct(F.lit("Idle Mean").alias("feature"), (n + 0.5).alias("value"), (n / 16).alias("baseline"), (-c / 2).alias("contribution")))
    nums = T.evidence_numbers(F.col("evidence"), F.col("confidence"), anomaly, c / 4)
    return src.explanations(spark, sf).select("explanation_id", nums.alias("nums")).select(
        "explanation_id", F.size("nums").alias("n"), F.round(F.aggregate("nums", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("evidence_numbers", f"""WITH {EXPL} SELECT explanation_id, CAST(len(nums) AS INT) AS n, round(list_sum(nums), 6) AS total FROM e1""")
def evidence_numbers(spark, sf):
    nums = T.evidence_numbers(F.col("evidence"), F.col("confidence"))
    return src.explanations(spark, sf).select("explanation_id", nums.alias("nums")).select(
        "explanation_id", F.size("nums").alias("n"),
        F.round(F.aggregate("nums", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


STRUCTURE = FIND + f""",
st AS (SELECT *, CASE decision WHEN 'ATTACK' THEN {any_of('low', T.DECISION_TERMS['ATTACK'])} ELSE {any_of('low', T.DECISION_TERMS['BENIGN'])} END AS decision_mentioned,
  CASE decision WHEN 'ATTACK' THEN {any_of('low', T.DECISION_TERMS['BENIGN'])} ELSE {any_of('low', T.DECISION_TERMS['ATTACK'])} END AS opposite_mentioned,
  {any_of('low', T.EVIDENCE_TERMS)} AS has_evidence_reference, {any_of('low', T.CAUTION_TERMS)} AS has_caution FROM found),
full_st AS (SELECT *, (decision_mentioned OR contains(low, 'modeli')) AND has_evidence_reference AND has_caution AS structure_complete FROM st)"""


@query("decision_and_structure", f"WITH {STRUCTURE} SELECT explanation_id, decision_mentioned, opposite_mentioned, structure_complete FROM full_st")
def decision_and_structure(spark, sf):
    return checked(spark, sf).select("explanation_id", "decision_mentioned", "opposite_mentioned", "structure_complete")


@query("feature_grounding", f"""WITH {EXPL},
x AS (SELECT explanation_id, low, list_filter(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'), lambda m: (CAST(replace(m, ',', '.') AS DOUBLE) >= 1 OR CAST(replace(m, ',', '.') AS DOUBLE) = 0)
  AND len(list_filter(nums, lambda n: abs(n - CAST(replace(m, ',', '.') AS DOUBLE)) <= 0.000001)) = 0) AS un FROM e1)
SELECT explanation_id, concat_ws(',', CASE WHEN contains(low, 'flow duration') THEN 'Flow Duration' END, CASE WHEN contains(low, 'total fwd packets') THEN 'Total Fwd Packets' END,
  CASE WHEN contains(low, 'syn flag count') THEN 'SYN Flag Count' END) AS referenced, array_to_string(un[1:10], ' ') AS uncited, CAST(len(un) AS INT) AS uncited_count FROM x""")
def feature_grounding(spark, sf):
    return checked(spark, sf).select(
        "explanation_id", F.array_join("referenced_features", ",").alias("referenced"),
        F.array_join("numbers_not_in_evidence", " ").alias("uncited"), F.col("numbers_not_in_evidence_count").alias("uncited_count"))


CLAIMS = EXPL + f""",
w AS (SELECT explanation_id, f, expected, strpos(low, f) AS pos, low FROM (SELECT explanation_id, low, unnest(['flow duration', 'total fwd packets', 'syn flag count']) AS f,
  unnest(['increases_attack', 'decreases_attack', 'increases_attack']) AS expected FROM e1)),
win AS (SELECT *, substring(low, greatest(1, pos - 90), pos + length(f) + 90 - greatest(1, pos - 90)) AS win FROM w WHERE pos > 0),
ud AS (SELECT *, {any_of('win', T.INCREASE_TERMS)} AS up, {any_of('win', T.DECREASE_TERMS)} AS down FROM win),
cl AS (SELECT *, CASE WHEN up AND NOT down THEN 'increases_attack' WHEN down AND NOT up THEN 'decreases_attack' END AS claim FROM ud),
cc AS (SELECT explanation_id, count(claim) AS checked_claims, count(*) FILTER (claim = expected) AS consistent_claims, count(*) AS mentioned FROM cl GROUP BY 1)"""


@query("direction_consistency", f"""WITH {CLAIMS} SELECT explanation_id, CAST(coalesce(checked_claims, 0) AS INT) AS checked_claims, CAST(coalesce(consistent_claims, 0) AS INT) AS consistent_claims FROM expl LEFT JOIN cc USING (explanation_id)""")
def direction_consistency(spark, sf):
    return checked(spark, sf).select("explanation_id", "checked_claims", "consistent_claims")


@query("evidence_coverage", f"""WITH {CLAIMS} SELECT explanation_id, round(coalesce(mentioned, 0) / 3.0, 6) AS coverage FROM expl LEFT JOIN cc USING (explanation_id)""")
def evidence_coverage(spark, sf):
    return rounded(checked(spark, sf).select("explanation_id", "coverage"))


@query("explanation_rates", f"""WITH {STRUCTURE}, {CLAIMS[len(EXPL) + 2:]}
SELECT condition, count(*) AS n, round(avg(CASE WHEN decision_mentioned THEN 1.0 ELSE 0 END), 6) AS consistency_rate, round(avg(CASE WHEN structure_complete THEN 1.0 ELSE 0 END), 6) AS structure_rate,
  round(avg(CASE WHEN v4 + v6 + payload + ports + protocols = 0 THEN 1.0 ELSE 0 END), 6) AS clean_rate, CAST(coalesce(sum(checked_claims), 0) AS BIGINT) AS direction_claims,
  round(sum(consistent_claims) / CAST(sum(checked_claims) AS DOUBLE), 6) AS direction_rate, round(avg(coalesce(mentioned, 0) / 3.0), 6) AS mean_coverage FROM full_st LEFT JOIN cc USING (explanation_id) GROUP BY condition""")
def explanation_rates(spark, sf):
    return rounded(X.explanation_rates(checked(spark, sf), ["condition"]))


PROVIDER = "CASE WHEN starts_with(lower(text_model), 'claude') THEN 'claude' END"


@query("provider_of", f"WITH {EXPL} SELECT text_model, {PROVIDER} AS provider, count(*) AS n FROM expl GROUP BY ALL")
def provider_of(spark, sf):
    return src.explanations(spark, sf).groupBy("text_model", T.provider_of(F.col("text_model")).alias("provider")).agg(
        F.count(F.lit(1)).alias("n"))


@query("explanation_rows", f"""WITH {EXPL}, {ctes.ALARMS} SELECT explanation_id, alarm_id, a.severity, f.predicted_label, f.attack_type, f.model_name, {PROVIDER} AS provider, e.rating
FROM expl e JOIN alarms a USING (alarm_id) LEFT JOIN flows f ON f.flow_id = a.flow_id""")
def explanation_rows(spark, sf):
    return X.explanation_rows(src.alarms(spark, sf), src.flows(spark, sf), src.explanations(spark, sf)).select(
        "explanation_id", "alarm_id", "severity", "predicted_label", "attack_type", "model_name", "provider", "rating")


@query("explanation_summary", f"""WITH {FIND}, r AS (SELECT coalesce({PROVIDER}, 'unknown') AS provider, coalesce(prompt_version, 'unknown') AS pv, rating, coalesce(latency_ms, 0) AS l, v4 + v6 + payload + ports + protocols > 0 AS fl FROM found),
u AS (SELECT 'provider' AS dimension, provider AS value, rating, l, fl FROM r UNION ALL SELECT 'prompt_version', pv, rating, l, fl FROM r UNION ALL SELECT 'rating', rating, rating, l, fl FROM r WHERE rating IS NOT NULL)
SELECT dimension, value, count(*) AS explanations, count(rating) AS rated, count(*) FILTER (fl) AS flagged, round(avg(l), 6) AS mean_latency_ms FROM u GROUP BY 1, 2""")
def explanation_summary(spark, sf):
    rows = checked(spark, sf).withColumn("provider", T.provider_of(F.col("text_model")))
    return rounded(X.explanation_summary(rows))


@query("latest_rating", "SELECT conv_id AS explanation_id, arg_max(role, turn) AS rating FROM conversations GROUP BY conv_id")
def latest_rating(spark, sf):
    return X.latest_rating(src.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("explanation_id"), F.col("turn").alias("rated_at"), F.col("role").alias("rating")))


RESULTS = """results AS (SELECT p_name || '-' || p_partkey AS model, p_size / 64.0::DOUBLE AS f1, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS latency_ms,
  CASE p_partkey % 5 WHEN 0 THEN 'top_' || p_size || '_features' WHEN 1 THEN 'all features' ELSE 'top_x_features' END AS feature_set FROM part)"""


def results(spark, sf):
    k = F.col("p_partkey")
    return src.table(spark, sf, "part").select(
        F.concat_ws("-", "p_name", k.cast("string")).alias("model"), (F.col("p_size") / 64).alias("f1"),
        F.when(k % 7 != 0, F.col("p_retailprice")).alias("latency_ms"),
        F.when(k % 5 == 0, F.concat(F.lit("top_"), F.col("p_size").cast("string"), F.lit("_features")))
        .when(k % 5 == 1, "all features").otherwise("top_x_features").alias("feature_set"))


@query("experiment_leaders", f"WITH {RESULTS} SELECT max(f1) AS best_f1, min(latency_ms) AS fastest_latency_ms FROM results")
def experiment_leaders(spark, sf):
    return G.experiment_leaders(results(spark, sf))


@query("top_experiments", f"WITH {RESULTS} SELECT * FROM results ORDER BY f1 DESC, model LIMIT 5")
def top_experiments(spark, sf):
    return G.top_experiments(results(spark, sf))


@query("feature_count_series", f"""WITH {RESULTS} SELECT model, f1, CAST(regexp_extract(feature_set, '^top_(\\d+)_features$', 1) AS INT) AS n_features FROM results WHERE regexp_matches(feature_set, '^top_(\\d+)_features$')""")
def feature_count_series(spark, sf):
    return G.feature_count_series(results(spark, sf)).select("model", "f1", "n_features")


def reports(spark, sf):
    return src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("report_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.col("o_orderstatus").alias("status"))


REPORTS = "reports AS (SELECT o_orderkey AS report_id, epoch_us(o_orderdate) AS created_at, o_orderstatus AS status FROM orders)"


@query("latest_drift", f"WITH {REPORTS} SELECT * FROM reports ORDER BY created_at DESC, report_id DESC LIMIT 1")
def latest_drift(spark, sf):
    return G.latest_report(reports(spark, sf))


@query("drift_history", f"WITH {REPORTS} SELECT * FROM reports ORDER BY created_at DESC, report_id DESC LIMIT 20 OFFSET 40")
def drift_history(spark, sf):
    return G.report_history(reports(spark, sf), 2, 20)


@query("active_model", f"WITH {REPORTS}, a AS (SELECT status AS model, max(created_at) AS last_activated FROM reports GROUP BY 1) SELECT *, model = (SELECT arg_max(model, (last_activated, model)) FROM a) AS active FROM a")
def active_model(spark, sf):
    return G.active_model(reports(spark, sf).select(F.col("status").alias("model"), F.col("created_at").alias("activated_at")))


# -- sources and exports --------------------------------------------------------------

@query("read_features", f"WITH {ctes.FEATURES} SELECT l_returnflag, l_quantity, l_tax FROM lineitem")
def read_features(spark, sf):
    return R.read_features(spark, f"{sf}/lineitem.parquet", ["l_quantity", "l_tax"], ["l_returnflag"])


@query("parse_flow_events", f"""WITH {ctes.FLOWS} SELECT flow_id, source_ip, predicted_label, confidence AS prediction_confidence, CASE WHEN flow_id % 4 <> 0 THEN anomaly_score END AS anomaly_score, 'LAB_LIVE' AS dataset_source,
  CASE WHEN flow_id % 3 = 0 THEN 'ATTACK' ELSE 'UNKNOWN' END AS ground_truth_label, confidence IS NULL AND (anomaly_score IS NULL OR flow_id % 4 = 0) AS rejected, destination_port::VARCHAR AS port_text FROM flows""")
def parse_flow_events(spark, sf):
    f = src.flows(spark, sf)
    events = f.select("flow_id", F.to_json(F.struct(
        "source_ip", "destination_ip", "destination_port", "predicted_label", "attack_type",
        F.col("confidence").alias("prediction_confidence"), F.when(F.col("flow_id") % 4 != 0, F.col("anomaly_score")).alias("anomaly_score"),
        F.when(F.col("flow_id") % 3 == 0, "ATTACK").alias("ground_truth_label"),
        F.create_map(F.lit("Destination Port"), F.col("destination_port")).alias("feature_vector"))).alias("json"))
    return R.parse_flow_events(events).select(
        "flow_id", "source_ip", "predicted_label", "prediction_confidence", "anomaly_score", "dataset_source", "ground_truth_label",
        "rejected", F.col("feature_vector")["Destination Port"].alias("port_text"))


@query("feedback_jsonl", f"""WITH {FEEDBACK_SQL} SELECT alarm_id::VARCHAR AS alarm_id, verdict AS analyst_verdict, original_attack_type, round(original_confidence, 9) AS confidence, strftime(make_timestamp(recorded_at), '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at FROM feedback""")
def feedback_jsonl(spark, sf):
    lines = K.feedback_lines(feedback(spark, sf))
    parsed = F.from_json("value", "alarm_id string, analyst_verdict string, original_attack_type string, original_confidence double, created_at string")
    return lines.select(parsed.alias("r")).select(
        "r.alarm_id", "r.analyst_verdict", "r.original_attack_type", F.round("r.original_confidence", 9).alias("confidence"), "r.created_at")


@query("prediction_rows", f"""WITH {ctes.LIVE} SELECT run_id, scenario AS scenario_id, flow_index, expected_binary_label, predicted_label, validation_status, validation_status || '; again' AS validation_errors, NULL AS experiment_id FROM live""")
def prediction_rows(spark, sf):
    live = src.live_flows(spark, sf).withColumnRenamed("scenario", "scenario_id").withColumn(
        "validation_errors", F.array("validation_status", F.lit("again")))
    return K.prediction_rows(live).select("run_id", "scenario_id", "flow_index", "expected_binary_label", "predicted_label",
                                          "validation_status", "validation_errors", "experiment_id")


LINE_TEXT = "concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}::VARCHAR, '~')" for c in (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")) + ")"


@query("table_fingerprint", f"""WITH h AS (SELECT md5({LINE_TEXT}) AS m FROM lineitem)
SELECT count(*) AS n_rows, sum(('0x' || substr(m, 1, 16))::UBIGINT)::VARCHAR AS high_sum, sum(('0x' || substr(m, 17, 16))::UBIGINT)::VARCHAR AS low_sum FROM h""")
def table_fingerprint(spark, sf):
    return K.table_fingerprint(src.table(spark, sf, "lineitem"))
