"""Session gaps and incidents: runs of alarms of one key without a gap over the window.

A key (source and attack type) may hold a large share of all rows, so rows are never
sorted per key. Two rows of one key in the same time cell, when the cell is no longer
than the window, belong to one incident by definition; rows are therefore combined into
cells on the map side and only the cell summaries of a key are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.ordered import carried_lag, exact_quantiles
from netweir.operators.alarms import name_of, rank_of

MICROS = 1000000


def correlation_key(source: Column, attack: Column) -> Column:
    return F.concat_ws("|", F.coalesce(source, F.lit("unknown-source")),
                       F.coalesce(attack, F.lit("UNKNOWN")))


def time_cell(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * MICROS)).cast("long")


def cell_islands(cells: DataFrame, keys: list[str], window_seconds: Column) -> DataFrame:
    """Number the islands of each key from cell summaries (first_us, last_us)."""
    order = Window.partitionBy(*keys).orderBy("_cell")
    gap = F.col("first_us") - F.lag("last_us").over(order)
    starts = cells.withColumn(
        "_start", F.when(gap.isNull() | (gap > window_seconds.cast("long") * MICROS), 1).otherwise(0))
    return starts.withColumn("incident_no", F.sum("_start").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_start")


def time_cells(df: DataFrame, keys: list[str], ts: str, seconds: int, *extra: Column) -> DataFrame:
    return df.withColumn("_us", F.unix_micros(ts)).groupBy(
        *keys, time_cell(F.col(ts), seconds).alias("_cell")).agg(
        F.min("_us").alias("first_us"), F.max("_us").alias("last_us"),
        F.count(F.lit(1)).alias("rows"), *extra)


def incident_count(df: DataFrame, keys: list[str], ts: str, window_seconds: int) -> DataFrame:
    cells = time_cells(df, keys, ts, window_seconds)
    islands = cell_islands(cells, keys, F.lit(window_seconds))
    return islands.groupBy(*keys).agg(F.max("incident_no").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("incidents"))


def window_sweep(df: DataFrame, keys: list[str], ts: str, windows: list[int]) -> DataFrame:
    """Incidents and rows per incident for every candidate window, from one cell pass."""
    cells = time_cells(df, keys, ts, min(windows))
    order = Window.partitionBy(*keys).orderBy("_cell")
    gaps = cells.withColumn("_gap", F.col("first_us") - F.lag("last_us").over(order))
    starts = gaps.agg(
        F.sum("rows").alias("rows"),
        *[F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") > w * MICROS), 1).otherwise(0))
          .alias(f"w{w}") for w in windows])
    return starts.select("rows", F.explode(F.array(*[
        F.struct(F.lit(w).alias("window_seconds"), F.col(f"w{w}").alias("incidents"))
        for w in windows])).alias("s")).select(
        "s.window_seconds", "s.incidents", "rows",
        F.try_divide(F.col("rows").cast("double"), F.col("s.incidents").cast("double"))
        .alias("rows_per_incident"))


def gaps(df: DataFrame, keys: list[str], ts: str, cell_seconds: int = 600) -> DataFrame:
    """Seconds between consecutive rows of a key, one row per distinct gap pair.

    Rows at one instant are combined first: they contribute ``zero_gaps`` gaps of 0.
    """
    instants = df.groupBy(*keys, F.unix_micros(ts).alias("_us")).agg(
        F.count(F.lit(1)).alias("_n"))
    chunk = F.floor(F.col("_us") / F.lit(cell_seconds * MICROS))
    lagged = carried_lag(instants, keys, chunk, ["_us"], ["_us"])
    return lagged.select(
        *keys, ((F.col("_us") - F.col("prev__us")) / MICROS).alias("gap_seconds"),
        (F.col("_n") - 1).alias("zero_gaps"))


def gap_statistics(df: DataFrame, label: str, source: str, target: str, ts: str,
                   windows: list[int] = contract.CANDIDATE_WINDOWS,
                   min_rows: int = contract.MIN_CLAIM_SUPPORT) -> DataFrame:
    """Per label: quantiles of the gaps of a source, share of gaps within each window.

    Labels under ``min_rows`` rows are left out. Labels come from the fixed taxonomy.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("flows")).where(
        F.col("flows") >= min_rows)
    spread = df.groupBy(label, source).agg(F.lit(1).alias("_s")).groupBy(label).agg(
        F.count(F.lit(1)).alias("distinct_sources"))
    targets = df.groupBy(label, target).agg(F.lit(1).alias("_s")).groupBy(label).agg(
        F.count(target).alias("distinct_targets"))
    each = gaps(df, [label, source], ts)
    one = F.when(F.col("gap_seconds").isNull(), 0).otherwise(1)
    shares = each.groupBy(label).agg(
        F.sum(one + F.col("zero_gaps")).alias("gap_count"),
        F.max(F.when(F.col("zero_gaps") > 0, F.greatest(F.coalesce("gap_seconds", F.lit(0.0)),
                                                        F.lit(0.0)))
              .otherwise(F.col("gap_seconds"))).alias("max_gap"),
        *[F.sum(F.when(F.col("gap_seconds") <= w, 1).otherwise(0) + F.col("zero_gaps"))
          .alias(f"_under_{w}") for w in windows])
    weighted = each.select(label, F.explode(F.array(
        F.struct("gap_seconds", F.lit(1).cast("long").alias("w")),
        F.struct(F.lit(0.0).alias("gap_seconds"), F.col("zero_gaps").alias("w")))).alias("g")) \
        .select(label, "g.*").where((F.col("w") > 0) & F.col("gap_seconds").isNotNull())
    q = exact_quantiles(weighted, [label], "gap_seconds", [0.5, 0.9, 0.95, 0.99], weight="w")
    return sizes.join(spread, label).join(targets, label).join(shares, label).join(
        q.drop("n"), label).where(F.col("gap_count") > 0).select(
        label, "flows", "distinct_sources", "distinct_targets", "gap_count",
        *[F.element_at("quantiles", i + 1).alias(n)
          for i, n in enumerate(["p50", "p90", "p95", "p99"])], "max_gap",
        *[(F.col(f"_under_{w}") / F.col("gap_count")).alias(f"under_{w}") for w in windows])


def mean_gap_coverage(stats: DataFrame, windows: list[int]) -> DataFrame:
    """Mean over labels of the share of gaps within each window."""
    return stats.agg(*[F.avg(f"under_{w}").alias(f"w{w}") for w in windows]).select(
        F.explode(F.array(*[F.struct(F.lit(w).alias("window_seconds"),
                                     F.col(f"w{w}").alias("coverage")) for w in windows]))
        .alias("s")).select("s.*")


def _cells_to_incidents(alarms: DataFrame, window_seconds: int) -> tuple[DataFrame, DataFrame]:
    keyed = alarms.withColumn(
        "correlation_key", correlation_key(F.col("source_ip"), F.col("attack_type")))
    worst = F.max(rank_of(F.col("severity"), contract.SEVERITIES)).alias("worst")
    first = F.min_by(F.struct("source_ip", "attack_type", "detection_method"),
                     F.struct("_us", "alarm_id")).alias("opened_by")
    cells = time_cells(keyed, ["correlation_key"], "created_at", window_seconds, worst, first)
    return keyed, cell_islands(cells, ["correlation_key"], F.lit(window_seconds))


def incident_id(number: Column, key: Column) -> Column:
    return F.concat_ws("#", key, number.cast("string"))


def sessionise_incidents(alarms: DataFrame,
                         window_seconds: int = contract.CORRELATION_WINDOW_SECONDS,
                         max_destinations: int = contract.TRACKED_DESTINATIONS) -> DataFrame:
    """Incidents of an alarm table: extent, counts, worst severity, first destinations.

    The first ``max_destinations`` distinct destinations are listed in order of first
    appearance; ``destination_count`` stays exact and ``destinations_truncated`` tells
    whether the list is shorter.
    """
    keyed, islands = _cells_to_incidents(alarms, window_seconds)
    numbered = ["correlation_key", "incident_no"]
    incidents = islands.groupBy(*numbered).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum("rows").alias("alarm_count"), F.max("worst").alias("worst"),
        F.min_by("opened_by", "_cell").alias("opened_by"))
    per_cell = keyed.where(F.col("destination_ip").isNotNull()).groupBy(
        "correlation_key", time_cell(F.col("created_at"), window_seconds).alias("_cell"),
        "destination_ip").agg(F.min(F.unix_micros("created_at")).alias("seen_us"))
    seen = per_cell.join(islands.select("correlation_key", "_cell", "incident_no"),
                         ["correlation_key", "_cell"]).groupBy(
        *numbered, "destination_ip").agg(F.min("seen_us").alias("seen_us"))
    counts = seen.groupBy(*numbered).agg(F.count(F.lit(1)).alias("destination_count"))
    order = Window.partitionBy(*numbered).orderBy("seen_us", "destination_ip")
    listed = seen.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= max_destinations).groupBy(*numbered).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "destination_ip"))),
                    lambda d: d["destination_ip"]).alias("destination_ips"))
    joined = incidents.join(counts, numbered, "left").join(listed, numbered, "left")
    total = F.coalesce("destination_count", F.lit(0))
    return joined.select(
        incident_id(F.col("incident_no"), F.col("correlation_key")).alias("incident_id"),
        "correlation_key", "incident_no",
        F.col("opened_by.source_ip").alias("source_ip"),
        F.col("opened_by.attack_type").alias("attack_type"),
        F.col("opened_by.detection_method").alias("detection_method"),
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        F.col("alarm_count").alias("flow_count"), "alarm_count",
        name_of(F.col("worst"), contract.SEVERITIES).alias("severity"),
        F.coalesce("destination_ips", F.array().cast("array<string>")).alias("destination_ips"),
        (total > max_destinations).alias("destinations_truncated"),
        total.alias("destination_count"))


def incident_of_alarm(alarms: DataFrame, window_seconds: int) -> DataFrame:
    """(alarm_id, incident_id) for every alarm."""
    keyed, islands = _cells_to_incidents(alarms, window_seconds)
    return keyed.withColumn("_cell", time_cell(F.col("created_at"), window_seconds)).join(
        islands.select("correlation_key", "_cell", "incident_no"),
        ["correlation_key", "_cell"]).select(
        "alarm_id", incident_id(F.col("incident_no"), F.col("correlation_key"))
        .alias("incident_id"))


def distinct_destinations(alarms: DataFrame, links: DataFrame) -> DataFrame:
    """Exact number of distinct destinations of every incident."""
    pairs = links.join(alarms.select("alarm_id", "destination_ip"), "alarm_id").where(
        F.col("destination_ip").isNotNull())
    return pairs.groupBy("incident_id", "destination_ip").agg(F.lit(1).alias("_x")).groupBy(
        "incident_id").agg(F.count(F.lit(1)).alias("destination_count"))


def incident_stats(incidents: DataFrame) -> DataFrame:
    """Counts by severity and by status, absent values left out."""
    cells = incidents.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))
    return cells.select(F.explode(F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value"))))
        .alias("c"), "n").groupBy("c.dimension", "c.value").agg(F.sum("n").alias("n"))


def incident_status(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Status of each incident: the last status event of its own wins, NEW without any."""
    last = events.groupBy("incident_id").agg(F.max_by("status", F.struct(
        "changed_at", rank_of(F.col("status"), contract.STATUSES))).alias("status"))
    return incidents.join(last, "incident_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("NEW")))
