"""The adapter tables of ``netweir.sources.adapters`` as SQL, for the oracles."""

SEVERITY = """CASE WHEN predicted_label = 'UNKNOWN' OR confidence IS NULL THEN 'MEDIUM'
    WHEN confidence >= 0.95 THEN 'CRITICAL' WHEN confidence >= 0.85 THEN 'HIGH'
    WHEN confidence >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END"""


def severity_rank(column: str) -> str:
    return (f"CASE {column} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 "
            f"WHEN 'MEDIUM' THEN 1 ELSE 0 END")


def severity_name(rank: str) -> str:
    return (f"CASE {rank} WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' "
            f"WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END")


FLOWS = """flow_k AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CASE WHEN event_type IN ('view', 'click') THEN 'BENIGN'
         WHEN event_type IN ('purchase', 'signup') THEN 'ATTACK' ELSE 'UNKNOWN' END AS predicted_label
  FROM events),
flows AS (SELECT event_id AS flow_id, ts AS flow_ts, epoch_us(ts) AS flow_us,
    '10.0.0.' || user_id AS source_ip, '192.168.1.' || k AS destination_ip,
    CAST(1024 + user_id AS INT) AS source_port, k AS destination_port,
    CASE k % 4 WHEN 0 THEN '6' WHEN 1 THEN '17' WHEN 2 THEN '1.0' ELSE 'x' END AS protocol,
    predicted_label,
    CASE event_type WHEN 'purchase' THEN 'PortScan' WHEN 'signup' THEN 'DoS Hulk' END AS attack_type,
    CASE WHEN predicted_label <> 'UNKNOWN' THEN value / (value + 20) END AS confidence,
    CASE WHEN predicted_label = 'UNKNOWN' THEN 20 / (value + 20) END AS anomaly_score,
    CASE WHEN predicted_label = 'UNKNOWN' THEN 'ANOMALY_DETECTION' ELSE 'SUPERVISED_ML' END AS detection_method,
    CASE WHEN event_id % 5 <> 4 THEN 'model-' || (event_id % 5) END AS model_name,
    CASE WHEN event_id % 3 = 0 THEN 'PortScan' END AS truth_attack_type, value
  FROM flow_k)"""

ALARMS = FLOWS + f""",
alarms AS (SELECT flow_id AS alarm_id, flow_id, flow_ts AS created_at, flow_us AS created_us,
    {SEVERITY} AS severity, source_ip, destination_ip, attack_type, detection_method,
    coalesce(source_ip, 'unknown-source') || '|' || coalesce(attack_type, 'UNKNOWN') AS correlation_key
  FROM flows WHERE predicted_label IN ('ATTACK', 'UNKNOWN'))"""

STATUS_EVENTS = ALARMS + """,
status_raw AS (SELECT alarm_id, created_us, alarm_id % 3 AS a3,
    CASE alarm_id % 5 WHEN 0 THEN ['NEW'] WHEN 1 THEN ['NEW', 'ACKNOWLEDGED']
      WHEN 2 THEN ['NEW', 'ACKNOWLEDGED', 'CONFIRMED']
      WHEN 3 THEN ['NEW', 'FALSE_POSITIVE', 'FALSE_POSITIVE']
      ELSE ['NEW', 'CONFIRMED', 'ACKNOWLEDGED', 'RESOLVED'] END AS history FROM alarms),
status_events AS (SELECT alarm_id, unnest(history) AS status,
    created_us + (unnest(range(len(history))) * 600000000) AS changed_us,
    'analyst-' || a3 AS analyst FROM status_raw)"""

LIFECYCLE = STATUS_EVENTS + """,
lifecycle AS (SELECT alarm_id, arg_max(status, changed_us) AS status,
    min(changed_us) FILTER (status = 'ACKNOWLEDGED') AS acknowledged_us,
    min(changed_us) FILTER (status IN ('RESOLVED', 'FALSE_POSITIVE')) AS resolved_us
  FROM status_events GROUP BY alarm_id),
alarm_states AS (SELECT a.*, l.status, l.acknowledged_us, l.resolved_us
  FROM alarms a JOIN lifecycle l USING (alarm_id))"""


def incidents(seconds: int) -> str:
    return ALARMS + f""",
gapped AS (SELECT *, created_us - lag(created_us) OVER (
      PARTITION BY correlation_key ORDER BY created_us, alarm_id) AS gap FROM alarms),
numbered AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > {seconds * 1000000} THEN 1 ELSE 0 END) OVER (
      PARTITION BY correlation_key ORDER BY created_us, alarm_id
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident_no FROM gapped),
links AS (SELECT *, correlation_key || '#' || incident_no AS incident_id FROM numbered),
incidents AS (SELECT incident_id, correlation_key, incident_no,
    arg_min(source_ip, created_us) AS source_ip, arg_min(attack_type, created_us) AS attack_type,
    arg_min(detection_method, created_us) AS detection_method,
    min(created_us) AS first_us, max(created_us) AS last_us, count(*) AS alarm_count,
    {severity_name(f"max({severity_rank('severity')})")} AS severity,
    count(DISTINCT destination_ip) AS destination_count
  FROM links GROUP BY incident_id, correlation_key, incident_no)"""


ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

FEATURES = f"""features AS (SELECT {ROW_ID} AS row_id,
    CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'A' THEN 'DoS Hulk' ELSE 'PortScan' END AS label,
    l_shipdate AS ts, epoch_us(l_shipdate) AS ts_us, 'day-' || year(l_shipdate) AS source_file,
    l_linestatus AS status, l_quantity AS quantity, l_extendedprice AS extendedprice,
    l_discount AS discount, l_tax AS tax FROM lineitem)"""

RARE = FEATURES + """,
rare AS (SELECT * REPLACE (CASE WHEN quantity = 50 THEN label || ' rare'
    WHEN quantity > 44 AND label = 'PortScan' THEN 'Bot' WHEN quantity > 40 THEN 'DDoS'
    WHEN quantity > 12 THEN 'BENIGN' ELSE label END AS label) FROM features)"""

PREDICTIONS = FEATURES + """,
predictions AS (SELECT row_id, label AS y_true,
    CASE WHEN quantity < 8 THEN 'BENIGN' WHEN quantity > 46 AND status = 'F' THEN 'Bot'
      WHEN quantity BETWEEN 20 AND 24 THEN 'DoS Hulk' ELSE label END AS y_pred,
    discount AS score, quantity, tax, status, ts, ts_us FROM features)"""

LIVE = f"""live_base AS (SELECT {ROW_ID} AS row_id, l_orderkey % 8 AS run, l_quantity AS q,
    l_returnflag AS flag, l_linestatus AS ls, l_discount AS d, l_tax AS t, l_linenumber AS ln,
    CASE WHEN l_orderkey % 8 < 3 THEN 'benign' WHEN l_orderkey % 8 < 6 THEN 'portscan' ELSE 'ssh' END AS scenario
  FROM lineitem),
live_expected AS (SELECT *, CASE WHEN scenario = 'benign' OR flag = 'N' THEN 'BENIGN'
    WHEN flag = 'R' AND q > 48 THEN 'UNLABELLED' ELSE 'ATTACK' END AS expected_binary_label
  FROM live_base),
live AS (SELECT row_id, 'run-' || run AS run_id, scenario, expected_binary_label,
    CASE WHEN d >= 0.095 THEN 'MISSING_FEATURE' WHEN t >= 0.075 THEN 'NONFINITE_VALUE' ELSE 'VALID' END AS validation_status,
    CASE WHEN expected_binary_label = 'ATTACK' AND q > 10 THEN
           CASE WHEN ls = 'F' THEN CASE scenario WHEN 'portscan' THEN 'PortScan' ELSE 'SSH-Patator' END
                ELSE 'DoS Hulk' END
         WHEN expected_binary_label = 'BENIGN' AND q > 47 THEN 'Bot' ELSE 'BENIGN' END AS predicted_label,
    q / (q + 20) AS prediction_confidence,
    (q + d * 100) / (q + d * 100 + 25) AS model_b_score,
    CAST(ln AS BIGINT) AS flow_index, run = 7 AS excluded FROM live_expected),
evaluable AS (SELECT * FROM live WHERE validation_status = 'VALID'
    AND expected_binary_label IN ('BENIGN', 'ATTACK'))"""

FAMILY_OF = """CASE {0} WHEN 'BENIGN' THEN 'BENIGN'
    WHEN 'FTP-Patator' THEN 'Brute Force' WHEN 'SSH-Patator' THEN 'Brute Force'
    WHEN 'DoS Hulk' THEN 'DoS' WHEN 'DoS GoldenEye' THEN 'DoS' WHEN 'DoS slowloris' THEN 'DoS'
    WHEN 'DoS Slowhttptest' THEN 'DoS' WHEN 'DDoS' THEN 'DDoS'
    WHEN 'Web Attack - Brute Force' THEN 'Web Attack' WHEN 'Web Attack - XSS' THEN 'Web Attack'
    WHEN 'Web Attack - Sql Injection' THEN 'Web Attack' WHEN 'Infiltration' THEN 'Infiltration'
    WHEN 'Bot' THEN 'Bot' WHEN 'PortScan' THEN 'PortScan' WHEN 'Heartbleed' THEN 'Heartbleed' END"""


def family_of(column: str) -> str:
    return FAMILY_OF.format(column)
