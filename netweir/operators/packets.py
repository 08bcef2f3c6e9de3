"""Flow records from a packet table.

A flow is one bidirectional conversation without a silence over the idle timeout. Its
first packet gives the forward direction. A conversation may hold a large share of all
packets, so packets are grouped by conversation and time cell, and only cell summaries of
a conversation are ordered.

Every packet counts once. The activity statistics follow the intended meaning (silences
over the activity timeout split a flow into active periods).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions.numbers import count_if, ratio, ratio_or_zero
from netweir.functions.ordered import carried_lag, exact_quantiles, running_totals
from netweir.operators.incidents import cell_islands

IDLE_SECONDS = 240
ACTIVITY_SECONDS = 5
BULK_GAP_SECONDS = 1
BULK_PACKETS = 4
MICROS = 1000000
TRANSPORTS = [6, 17]


def flow_key() -> Column:
    """Key of a conversation, the same for both orientations."""
    source = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    target = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    return F.concat_ws("|", F.least(source, target), F.greatest(source, target),
                       F.col("protocol").cast("string"))


def _cell(seconds: int) -> Column:
    return F.floor(F.col("time_us") / F.lit(seconds * MICROS)).cast("long")


def assign_flows(packets: DataFrame, idle_seconds: int = IDLE_SECONDS,
                 max_age_seconds: int | None = None) -> DataFrame:
    """TCP and UDP packets with ``flow_id``, ``start_us`` and ``forward``.

    ``max_age_seconds`` also cuts a flow into slices of that length from its start.
    """
    kept = packets.where(F.col("protocol").isin(TRANSPORTS)).withColumns({
        "flow_key": flow_key(), "_cell": _cell(idle_seconds),
        "_end": F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))})
    cells = kept.groupBy("flow_key", "_cell").agg(
        F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"),
        F.min_by("_end", F.struct("time_us", "packet_id")).alias("opener"))
    islands = cell_islands(cells, ["flow_key"], F.lit(idle_seconds))
    starts = islands.groupBy("flow_key", "incident_no").agg(
        F.min("first_us").alias("start_us"), F.min_by("opener", "_cell").alias("opener"))
    named = islands.select("flow_key", "_cell", "incident_no").join(starts, ["flow_key", "incident_no"])
    joined = kept.join(named, ["flow_key", "_cell"]).withColumn("forward", F.col("_end") == F.col("opener"))
    flow_id = F.concat_ws("#", "flow_key", F.col("incident_no").cast("string"))
    if max_age_seconds:
        piece = F.floor((F.col("time_us") - F.col("start_us")) / F.lit(max_age_seconds * MICROS))
        flow_id = F.concat_ws(".", flow_id, piece.cast("string"))
    return joined.withColumn("flow_id", flow_id).drop("_cell", "_end", "opener", "incident_no")


def _seconds(us: Column) -> Column:
    return us / F.lit(float(MICROS))


def _sides():
    return {"": F.lit(True), "fwd_": F.col("forward"), "bwd_": ~F.col("forward")}


def packet_counts(assigned: DataFrame) -> DataFrame:
    """Packets, and packets with payload, of every flow and direction."""
    return assigned.groupBy("flow_id").agg(*[a for p, side in _sides().items() for a in (
        count_if(side).alias(f"{p}packets"),
        count_if(side & (F.col("payload_bytes") > 0)).alias(f"{p}payload_packets"))])


def length_stats(assigned: DataFrame) -> DataFrame:
    """Totals, extremes and spread of packet lengths; 0 where a direction has no packet.

    Median and mode keep counts per length, of which there are at most 65,536.
    """
    aggregates = []
    for p, side in _sides().items():
        length = F.when(side, F.col("length"))
        aggregates += [F.coalesce(f(length), F.lit(0)).alias(f"{p}len_{n}") for n, f in (
            ("total", F.sum), ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop),
            ("var", F.var_pop))]
    table = assigned.groupBy("flow_id").agg(
        *aggregates, F.median("length").alias("len_median"), F.mode("length", True).alias("len_mode"))
    return shape(table, "len_mean", "len_median", "len_mode", "len_std", "len_")


def shape(df: DataFrame, mean: str, median: str, mode: str, std: str, prefix: str) -> DataFrame:
    """Skew by median and by mode (-10 without spread) and coefficient of variation (-1 at mean 0)."""
    m, s = F.col(mean), F.col(std)
    return df.withColumns({
        f"{prefix}skew": F.when(s != 0, 3 * (m - F.col(median)) / s).otherwise(-10.0),
        f"{prefix}skew_mode": F.when(s != 0, (m - F.col(mode)) / s).otherwise(-10.0),
        f"{prefix}cov": F.when(m != 0, s / m).otherwise(-1.0)})


def _gap_statistics(gaps: DataFrame, prefix: str) -> DataFrame:
    """Statistics per flow of (flow_id, gap); all 0 with fewer than two values."""
    gap = F.col("gap")
    many = F.count(gap) > 1
    return gaps.groupBy("flow_id").agg(*[F.when(many, f(gap)).otherwise(0.0).alias(f"{prefix}{n}") for n, f in (
        ("total", F.sum), ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def _lagged(assigned: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return carried_lag(assigned.select("packet_id", *dict.fromkeys([*keys, "flow_id", "time_us", "forward", *columns])),
                       keys, _cell(IDLE_SECONDS), ["time_us", "packet_id"], columns)


def iat_stats(assigned: DataFrame) -> DataFrame:
    """Inter-arrival times in seconds, of the flow and of each direction."""
    gap = _seconds(F.col("time_us") - F.col("prev_time_us")).alias("gap")
    both = _lagged(assigned, ["flow_id"], ["time_us"]).select("flow_id", gap)
    each = _lagged(assigned, ["flow_id", "forward"], ["time_us"]).select("flow_id", "forward", gap)
    flows = assigned.select("flow_id").distinct()
    result = flows.join(_gap_statistics(both, "flow_iat_"), "flow_id", "left")
    for prefix, side in (("fwd_iat_", F.col("forward")), ("bwd_iat_", ~F.col("forward"))):
        result = result.join(_gap_statistics(each.where(side), prefix), "flow_id", "left")
    return result.na.fill(0.0)


def rates(assigned: DataFrame) -> DataFrame:
    """Bytes and packets per second (0 for an instant flow) and the backward/forward ratio."""
    sums = assigned.groupBy("flow_id").agg(
        _seconds(F.max("time_us") - F.min("time_us")).alias("duration"), F.sum("length").alias("bytes"),
        F.count(F.lit(1)).alias("packets"), count_if(F.col("forward")).alias("fwd"),
        count_if(~F.col("forward")).alias("bwd"))
    d = F.col("duration")
    return sums.select(
        "flow_id", "duration", ratio_or_zero(F.col("bytes"), d).alias("bytes_s"),
        ratio_or_zero(F.col("packets"), d).alias("packets_s"), ratio_or_zero(F.col("fwd"), d).alias("fwd_packets_s"),
        ratio_or_zero(F.col("bwd"), d).alias("bwd_packets_s"),
        ratio_or_zero(F.col("bwd"), F.col("fwd")).alias("down_up_ratio"))


FLAGS = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U", "ece": "E", "cwr": "C"}


def flag_counts(assigned: DataFrame) -> DataFrame:
    """Packets carrying each flag; PSH and URG also by direction."""
    has = {n: F.contains("flags", F.lit(c)) for n, c in FLAGS.items()}
    total = [count_if(c).alias(f"{n}_count") for n, c in has.items()]
    sided = [count_if(has[n] & side).alias(f"{p}{n}_count") for n in ("psh", "urg")
             for p, side in list(_sides().items())[1:]]
    return assigned.groupBy("flow_id").agg(*total, *sided)


def header_bytes(assigned: DataFrame) -> DataFrame:
    """Header bytes by direction, the smallest forward header, forward over backward (-1 if none)."""
    header, forward = F.col("header_bytes"), F.col("forward")
    sums = assigned.groupBy("flow_id").agg(
        F.coalesce(F.sum(F.when(forward, header)), F.lit(0)).alias("fwd_header_bytes"),
        F.coalesce(F.sum(F.when(~forward, header)), F.lit(0)).alias("bwd_header_bytes"),
        F.min(F.when(forward, header)).alias("min_fwd_header_bytes"))
    return sums.withColumn("header_ratio", F.coalesce(
        ratio(F.col("fwd_header_bytes"), F.col("bwd_header_bytes")), F.lit(-1.0)))


def init_window(assigned: DataFrame) -> DataFrame:
    """First non-zero TCP window of each direction, 0 without one."""
    open_window = (F.col("window_bytes") > 0) & (F.col("protocol") == 6)
    order = F.struct("time_us", "packet_id")
    return assigned.groupBy("flow_id").agg(*[
        F.coalesce(F.min_by("window_bytes", F.when(open_window & side, order)), F.lit(0)).alias(f"{p}init_window")
        for p, side in list(_sides().items())[1:]])


def active_idle(assigned: DataFrame, timeout_seconds: int = ACTIVITY_SECONDS) -> DataFrame:
    """Lengths of the active periods and of the silences between them, in seconds."""
    cells = assigned.groupBy("flow_id", _cell(timeout_seconds).alias("_cell")).agg(
        F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))
    periods = cell_islands(cells, ["flow_id"], F.lit(timeout_seconds)).groupBy("flow_id", "incident_no").agg(
        F.min("first_us").alias("from_us"), F.max("last_us").alias("to_us"))
    # the silence before a period: from the end of the one numbered before it
    earlier = periods.select("flow_id", (F.col("incident_no") + 1).alias("incident_no"), F.col("to_us").alias("left_us"))
    spans = periods.join(earlier, ["flow_id", "incident_no"], "left")
    active = spans.where(F.col("to_us") > F.col("from_us")).select(
        "flow_id", _seconds(F.col("to_us") - F.col("from_us")).alias("gap"))
    idle = spans.where(F.col("left_us").isNotNull()).select(
        "flow_id", _seconds(F.col("from_us") - F.col("left_us")).alias("gap"))
    flows = assigned.select("flow_id").distinct()
    return flows.join(_gap_statistics(active, "active_").drop("active_total"), "flow_id", "left").join(
        _gap_statistics(idle, "idle_").drop("idle_total"), "flow_id", "left").na.fill(0.0)


def bulk(assigned: DataFrame) -> DataFrame:
    """Bulk transfers: at least four payload packets of one direction, steps of a second at most."""
    loaded = assigned.where(F.col("payload_bytes") > 0)
    stepped = _lagged(loaded, ["flow_id"], ["time_us", "forward", "payload_bytes"])
    begins = (F.col("prev_time_us").isNull() | (F.col("forward") != F.col("prev_forward"))
              | (F.col("time_us") - F.col("prev_time_us") > BULK_GAP_SECONDS * MICROS))
    numbered = running_totals(stepped.withColumn("start", F.when(begins, 1).otherwise(0)), ["flow_id"],
                              ["time_us", "packet_id"], ["start"], _cell(IDLE_SECONDS))
    runs = numbered.groupBy("flow_id", "cum_start", "forward").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"),
        _seconds(F.max("time_us") - F.min("time_us")).alias("seconds")).where(F.col("n") >= BULK_PACKETS)
    sums = []
    for p, side in list(_sides().items())[1:]:
        count, size = F.count(F.when(side, 1)), F.sum(F.when(side, F.col("bytes")))
        sums += [ratio_or_zero(size, count).alias(f"{p}bytes_per_bulk"),
                 ratio_or_zero(F.sum(F.when(side, F.col("n"))), count).alias(f"{p}packets_per_bulk"),
                 ratio_or_zero(size, F.sum(F.when(side, F.col("seconds")))).alias(f"{p}bulk_rate")]
    return assigned.select("flow_id").distinct().join(runs.groupBy("flow_id").agg(*sums), "flow_id", "left").na.fill(0.0)


def _times(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """Mean, variance, deviation, median, mode, skews and variation of a column per flow."""
    base = values.groupBy("flow_id").agg(
        F.avg(column).alias(f"{prefix}mean"), F.var_pop(column).alias(f"{prefix}var"),
        F.stddev_pop(column).alias(f"{prefix}std"), F.max(column).alias(f"{prefix}max"))
    median = exact_quantiles(values, ["flow_id"], column, [0.5], broadcast_cells=False).select(
        "flow_id", F.element_at("quantiles", 1).alias(f"{prefix}median"))
    counts = values.groupBy("flow_id", column).agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy("flow_id").agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(f"{prefix}mode"))
    table = base.join(median, "flow_id").join(mode, "flow_id")
    return shape(table, f"{prefix}mean", f"{prefix}median", f"{prefix}mode", f"{prefix}std", prefix)


def response_time(assigned: DataFrame) -> DataFrame:
    """Turn-around times from a forward packet to the backward packet right after it."""
    turns = _lagged(assigned, ["flow_id"], ["time_us", "forward"]).where(F.col("prev_forward") & ~F.col("forward"))
    return _times(turns.select("flow_id", _seconds(F.col("time_us") - F.col("prev_time_us")).alias("gap")), "gap",
                  "response_").drop("response_max")


def packet_time_stats(assigned: DataFrame) -> DataFrame:
    """Duration and spread of the packets' offsets from the start of their flow."""
    offsets = assigned.select("flow_id", _seconds(F.col("time_us") - F.col("start_us")).alias("offset"))
    return _times(offsets, "offset", "time_").withColumnRenamed("time_max", "duration")


def assemble_flows(packets: DataFrame) -> DataFrame:
    """The flow table: endpoints, start and all statistics of every flow."""
    assigned = assign_flows(packets)
    order = F.struct("time_us", "packet_id")
    heads = assigned.groupBy("flow_id").agg(*[
        F.min_by(c, order).alias(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")],
        F.timestamp_micros(F.min("time_us")).alias("timestamp"))
    for part in (packet_counts, length_stats, iat_stats, rates, flag_counts, header_bytes, init_window,
                 active_idle, bulk):
        heads = heads.join(part(assigned), "flow_id")
    return heads
