"""Packet-to-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweir.operators import packets as P
from netweir.plans.catalog.alarms import rounded
from netweir.plans.catalog.registry import query
from netweir.sources import adapters as src

T0 = src.T0_MICROS
PACKETS = f"""raw AS (SELECT event_id AS packet_id, {T0} + (epoch_us(ts) - {T0}) // 2000 + ((epoch_us(ts) - {T0}) // 864000000000) * 400000000 AS time_us,
    (event_id // 5) % 2 = 0 AS out, '10.1.0.' || (user_id % 12) || ':' || (40000 + user_id % 12) AS client,
    '10.2.0.' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4) || ':' || (80 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4) AS server,
    CASE WHEN event_id % 50 = 49 THEN 1 WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 = 3 THEN 17 ELSE 6 END AS protocol,
    CAST(floor(value) + 40 AS BIGINT) AS length, CASE WHEN event_id % 9 = 0 THEN 24 ELSE 20 END AS header_bytes,
    CASE WHEN event_id % 4 = 3 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS payload_bytes, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 1000 END AS window_bytes,
    CASE event_type WHEN 'view' THEN 'S' WHEN 'click' THEN 'PA' WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'FA' ELSE 'UR' END AS flags FROM events),
keyed AS (SELECT *, CASE WHEN out THEN client ELSE server END AS src, concat_ws('|', least(client, server), greatest(client, server), protocol) AS flow_key FROM raw WHERE protocol IN (6, 17)),
gapped AS (SELECT *, time_us - lag(time_us) OVER (PARTITION BY flow_key ORDER BY time_us, packet_id) AS key_gap FROM keyed),
numbered AS (SELECT *, CAST(sum(CASE WHEN key_gap IS NULL OR key_gap > 240000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_key ORDER BY time_us, packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS no FROM gapped),
named AS (SELECT *, flow_key || '#' || no AS flow_id FROM numbered),
pk AS (SELECT *, src = first_value(src) OVER w AS forward, min(time_us) OVER (PARTITION BY flow_id) AS start_us,
    lag(time_us) OVER w AS prev, lag(out) OVER w AS prev_out, lag(time_us) OVER (PARTITION BY flow_id, out ORDER BY time_us, packet_id) AS dir_prev
  FROM named WINDOW w AS (PARTITION BY flow_id ORDER BY time_us, packet_id))"""
SIDES = {"": "true", "fwd_": "forward", "bwd_": "NOT forward"}


def assigned(spark, sf):
    return P.assign_flows(src.packets(spark, sf))


@query("packet_flow_assignment", f"WITH {PACKETS} SELECT packet_id, flow_id, start_us, forward FROM pk")
def packet_flow_assignment(spark, sf):
    return assigned(spark, sf).select("packet_id", "flow_id", "start_us", "forward")


@query("packet_flows_max_age", f"WITH {PACKETS} SELECT flow_id || '.' || ((time_us - start_us) // 90000000) AS flow_id, count(*) AS n FROM pk GROUP BY 1")
def packet_flows_max_age(spark, sf):
    return P.assign_flows(src.packets(spark, sf), max_age_seconds=90).groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"))


@query("packet_counts", f"WITH {PACKETS} SELECT flow_id, " + ", ".join(
    f"count(*) FILTER ({c}) AS {p}packets, count(*) FILTER ({c} AND payload_bytes > 0) AS {p}payload_packets" for p, c in SIDES.items()) + " FROM pk GROUP BY flow_id")
def packet_counts(spark, sf):
    return P.packet_counts(assigned(spark, sf))


def shape_sql(p: str, d: int = 6) -> str:
    return (f"round(CASE WHEN {p}std <> 0 THEN 3 * ({p}mean - {p}median) / {p}std ELSE -10 END, {d}) AS {p}skew, "
            f"round(CASE WHEN {p}std <> 0 THEN ({p}mean - {p}mode) / {p}std ELSE -10 END, {d}) AS {p}skew_mode, "
            f"round(CASE WHEN {p}mean <> 0 THEN {p}std / {p}mean ELSE -1 END, {d}) AS {p}cov")


@query("length_stats", f"WITH {PACKETS}, c AS (SELECT flow_id, length, count(*) AS n FROM pk GROUP BY 1, 2), m AS (SELECT flow_id, arg_min(length, struct_pack(a := -n, b := length)) AS len_mode FROM c GROUP BY 1), s AS (SELECT flow_id, "
       + ", ".join(f"coalesce({f}(length) FILTER ({c}), 0) AS {p}len_{n}" for p, c in SIDES.items() for n, f in (
           ("total", "sum"), ("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"), ("var", "var_pop")))
       + ", quantile_cont(CAST(length AS DOUBLE), 0.5) AS len_median FROM pk GROUP BY flow_id) SELECT flow_id, len_mode, round(len_median, 6) AS len_median, "
       + ", ".join(f"CAST({p}len_{n} AS BIGINT) AS {p}len_{n}" for p in SIDES for n in ("total", "min", "max")) + ", "
       + ", ".join(f"round({p}len_{n}, 6) AS {p}len_{n}" for p in SIDES for n in ("mean", "std", "var"))
       + f", {shape_sql('len_')} FROM s JOIN m USING (flow_id)")
def length_stats(spark, sf):
    return rounded(P.length_stats(assigned(spark, sf)))


def gap_stats_sql(prefix: str, gap: str, source: str) -> str:
    return f"{prefix}s AS (SELECT flow_id, " + ", ".join(
        f"CASE WHEN count({gap}) > 1 THEN round({f}({gap}), 9) ELSE 0 END AS {prefix}{n}" for n, f in (
            ("total", "sum"), ("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + f" FROM {source} GROUP BY flow_id)"


@query("iat_stats", f"WITH {PACKETS}, " + ", ".join([
    gap_stats_sql("flow_iat_", "((time_us - prev) / 1000000.0::DOUBLE)", "pk"),
    gap_stats_sql("fwd_iat_", "((time_us - dir_prev) / 1000000.0::DOUBLE)", "(SELECT * FROM pk WHERE forward)"),
    gap_stats_sql("bwd_iat_", "((time_us - dir_prev) / 1000000.0::DOUBLE)", "(SELECT * FROM pk WHERE NOT forward)")])
    + " SELECT f.flow_id, " + ", ".join(f"coalesce({p}_iat_{n}, 0)::DOUBLE AS {p}_iat_{n}" for p in ("flow", "fwd", "bwd") for n in ("total", "mean", "std", "min", "max"))
    + " FROM flow_iat_s f LEFT JOIN fwd_iat_s a USING (flow_id) LEFT JOIN bwd_iat_s b USING (flow_id)")
def iat_stats(spark, sf):
    return rounded(P.iat_stats(assigned(spark, sf)), 9)


@query("packet_rates", f"""WITH {PACKETS}, s AS (SELECT flow_id, (max(time_us) - min(time_us)) / 1000000.0::DOUBLE AS duration, sum(length) AS bytes, count(*) AS n, count(*) FILTER (forward) AS f, count(*) FILTER (NOT forward) AS b FROM pk GROUP BY 1)
SELECT flow_id, round(duration, 6) AS duration, """ + ", ".join(f"round(coalesce({c} / nullif(duration, 0), 0), 6) AS {n}" for n, c in (
    ("bytes_s", "bytes"), ("packets_s", "n"), ("fwd_packets_s", "f"), ("bwd_packets_s", "b"))) + ", round(coalesce(b / nullif(CAST(f AS DOUBLE), 0), 0), 6) AS down_up_ratio FROM s")
def packet_rates(spark, sf):
    return rounded(P.rates(assigned(spark, sf)))


@query("flag_counts", f"WITH {PACKETS} SELECT flow_id, " + ", ".join(f"count(*) FILTER (contains(flags, '{c}')) AS {n}_count" for n, c in P.FLAGS.items())
       + ", " + ", ".join(f"count(*) FILTER (contains(flags, '{P.FLAGS[n]}') AND {SIDES[p]}) AS {p}{n}_count" for n in ("psh", "urg") for p in ("fwd_", "bwd_")) + " FROM pk GROUP BY flow_id")
def flag_counts(spark, sf):
    return P.flag_counts(assigned(spark, sf))


@query("header_bytes", f"""WITH {PACKETS}, s AS (SELECT flow_id, CAST(coalesce(sum(header_bytes) FILTER (forward), 0) AS BIGINT) AS f, CAST(coalesce(sum(header_bytes) FILTER (NOT forward), 0) AS BIGINT) AS b,
  CAST(min(header_bytes) FILTER (forward) AS BIGINT) AS m FROM pk GROUP BY 1) SELECT flow_id, f AS fwd_header_bytes, b AS bwd_header_bytes, m AS min_fwd_header_bytes, round(coalesce(f / nullif(CAST(b AS DOUBLE), 0), -1), 6) AS header_ratio FROM s""")
def header_bytes(spark, sf):
    return rounded(P.header_bytes(assigned(spark, sf)))


@query("init_window", f"WITH {PACKETS} SELECT flow_id, " + ", ".join(
    f"CAST(coalesce(arg_min(window_bytes, time_us * 1000 + packet_id % 1000) FILTER ({SIDES[p]} AND window_bytes > 0 AND protocol = 6), 0) AS BIGINT) AS {p}init_window" for p in ("fwd_", "bwd_")) + " FROM pk GROUP BY flow_id")
def init_window(spark, sf):
    return P.init_window(assigned(spark, sf))


@query("active_idle", f"""WITH {PACKETS}, a AS (SELECT *, sum(CASE WHEN prev IS NULL OR time_us - prev > 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY time_us, packet_id ROWS UNBOUNDED PRECEDING) AS p FROM pk),
act AS (SELECT flow_id, p, (max(time_us) - min(time_us)) / 1000000.0::DOUBLE AS gap FROM a GROUP BY 1, 2 HAVING max(time_us) > min(time_us)),
idl AS (SELECT flow_id, (time_us - prev) / 1000000.0::DOUBLE AS gap FROM pk WHERE time_us - prev > 5000000),
{gap_stats_sql('active_', 'gap', 'act')}, {gap_stats_sql('idle_', 'gap', 'idl')}
SELECT flow_id, """ + ", ".join(f"coalesce({p}_{n}, 0)::DOUBLE AS {p}_{n}" for p in ("active", "idle") for n in ("mean", "std", "min", "max")) + """
FROM (SELECT DISTINCT flow_id FROM pk) LEFT JOIN active_s USING (flow_id) LEFT JOIN idle_s USING (flow_id)""")
def active_idle(spark, sf):
    return rounded(P.active_idle(assigned(spark, sf)), 9)


@query("bulk", f"""WITH {PACKETS}, l AS (SELECT *, lag(time_us) OVER w AS lp, lag(forward) OVER w AS lf FROM pk WHERE payload_bytes > 0 WINDOW w AS (PARTITION BY flow_id ORDER BY time_us, packet_id)),
r AS (SELECT *, sum(CASE WHEN lp IS NULL OR forward <> lf OR time_us - lp > 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY time_us, packet_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
b AS (SELECT flow_id, run, forward, count(*) AS n, sum(payload_bytes) AS bytes, (max(time_us) - min(time_us)) / 1000000.0::DOUBLE AS secs FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 4),
s AS (SELECT flow_id, """ + ", ".join(f"round(coalesce(sum(bytes) FILTER ({SIDES[p]}) / nullif(CAST(count(*) FILTER ({SIDES[p]}) AS DOUBLE), 0), 0), 6) AS {p}bytes_per_bulk, round(coalesce(sum(n) FILTER ({SIDES[p]}) / nullif(CAST(count(*) FILTER ({SIDES[p]}) AS DOUBLE), 0), 0), 6) AS {p}packets_per_bulk, round(coalesce(sum(bytes) FILTER ({SIDES[p]}) / nullif(sum(secs) FILTER ({SIDES[p]}), 0), 0), 6) AS {p}bulk_rate" for p in ("fwd_", "bwd_"))
       + " FROM b GROUP BY flow_id) SELECT flow_id, " + ", ".join(f"coalesce({p}{n}, 0)::DOUBLE AS {p}{n}" for p in ("fwd_", "bwd_") for n in ("bytes_per_bulk", "packets_per_bulk", "bulk_rate")) + " FROM (SELECT DISTINCT flow_id FROM pk) LEFT JOIN s USING (flow_id)")
def bulk(spark, sf):
    return rounded(P.bulk(assigned(spark, sf)))


def times_sql(source: str, column: str, p: str) -> str:
    return f"""b AS (SELECT flow_id, avg({column}) AS {p}mean, var_pop({column}) AS {p}var, stddev_pop({column}) AS {p}std, quantile_cont({column}, 0.5) AS {p}median, max({column}) AS {p}max FROM {source} GROUP BY 1),
c AS (SELECT flow_id, {column} AS x, count(*) AS n FROM {source} GROUP BY 1, 2), m AS (SELECT flow_id, arg_min(x, struct_pack(a := -n, b := x)) AS {p}mode FROM c GROUP BY 1)
SELECT flow_id, round({p}mean, 9) AS {p}mean, round({p}var, 9) AS {p}var, round({p}std, 9) AS {p}std, round({p}median, 9) AS {p}median, round({p}mode, 9) AS {p}mode, {shape_sql(p, 9)}"""


@query("response_time", f"""WITH {PACKETS}, t AS (SELECT p.flow_id, (time_us - prev) / 1000000.0::DOUBLE AS gap FROM pk p WHERE NOT forward AND prev IS NOT NULL AND prev_out <> out), {times_sql('t', 'gap', 'response_')} FROM b JOIN m USING (flow_id)""")
def response_time(spark, sf):
    return rounded(P.response_time(assigned(spark, sf)), 9)


@query("packet_time_stats", f"""WITH {PACKETS}, t AS (SELECT flow_id, (time_us - start_us) / 1000000.0::DOUBLE AS o FROM pk), {times_sql('t', 'o', 'time_')}, round(time_max, 9) AS duration FROM b JOIN m USING (flow_id)""")
def packet_time_stats(spark, sf):
    return rounded(P.packet_time_stats(assigned(spark, sf)), 9)


@query("assembled_flows", f"""WITH {PACKETS} SELECT flow_id, arg_min(split_part(src, ':', 1), packet_id) AS src_ip, count(*) AS packets, CAST(sum(length) AS BIGINT) AS len_total, min(start_us) AS start_us, round((max(time_us) - min(time_us)) / 1000000.0::DOUBLE, 6) AS duration FROM pk GROUP BY flow_id""")
def assembled_flows(spark, sf):
    return rounded(P.assemble_flows(src.packets(spark, sf)).select(
        "flow_id", "src_ip", "packets", "len_total", F.unix_micros("timestamp").alias("start_us"), "duration"))
