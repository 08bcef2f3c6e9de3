"""Alarms, their life cycle, analyst feedback and the dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.numbers import count_if, ratio_or_zero


def rank_of(value: Column, names: list[str]) -> Column:
    """Ordinal of an enumeration value, 0 for the first name."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), value) - 1


def name_of(rank: Column, names: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), (rank + 1).cast("int"))


def severity(confidence: Column, thresholds: dict | None = None) -> Column:
    """Severity of a detection; thresholds must fall from critical to medium."""
    limits = thresholds or contract.SEVERITY_THRESHOLDS
    if not limits["critical"] > limits["high"] > limits["medium"]:
        raise ValueError("severity thresholds must be strictly descending")
    return (F.when(confidence.isNull(), "MEDIUM")
            .when(confidence >= limits["critical"], "CRITICAL")
            .when(confidence >= limits["high"], "HIGH")
            .when(confidence >= limits["medium"], "MEDIUM").otherwise("LOW"))


def severity_from(flows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``severity`` against the one-row thresholds table (critical_min, high_min, medium_min).

    Fails unless the table has one row whose thresholds fall from critical to medium.
    """
    names = ("critical_min", "high_min", "medium_min")
    one = thresholds.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(c) for c in names])
    right = (F.col("_rows") == 1) & (F.col("critical_min") > F.col("high_min")) & (F.col("high_min") > F.col("medium_min"))
    limits = F.broadcast(one.select(F.when(right, F.col("critical_min")).otherwise(F.raise_error(F.lit(
        "the thresholds table must have one row of strictly descending thresholds")).cast("double")).alias("critical_min"),
        "high_min", "medium_min"))
    value = F.col("confidence")
    level = (F.when((F.col("predicted_label") == "UNKNOWN") | value.isNull(), "MEDIUM")
             .when(value >= F.col("critical_min"), "CRITICAL")
             .when(value >= F.col("high_min"), "HIGH")
             .when(value >= F.col("medium_min"), "MEDIUM").otherwise("LOW"))
    return flows.join(limits).withColumn("severity", level) \
        .drop("critical_min", "high_min", "medium_min")


def flow_label(detection_class: Column) -> Column:
    return (F.when(detection_class == "KNOWN_ATTACK", "ATTACK")
            .when(detection_class == "SUSPICIOUS", "UNKNOWN").otherwise("BENIGN"))


def raise_alarms(flows: DataFrame, thresholds: dict | None = None, raised_at: Column | None = None) -> DataFrame:
    """One alarm per flow predicted ATTACK or UNKNOWN; the latter is always MEDIUM.

    A flow without a time takes the alarm's own, ``raised_at``.
    """
    at = F.col("flow_ts") if raised_at is None else F.coalesce(F.col("flow_ts"), raised_at)
    return flows.where(F.col("predicted_label").isin("ATTACK", "UNKNOWN")).select(
        F.col("flow_id").alias("alarm_id"), "flow_id", at.alias("created_at"),
        F.when(F.col("predicted_label") == "UNKNOWN", "MEDIUM")
        .otherwise(severity(F.col("confidence"), thresholds)).alias("severity"),
        "source_ip", "destination_ip", "attack_type", "detection_method")


def alarm_lifecycle(alarms: DataFrame, events: DataFrame) -> DataFrame:
    """Current status (last event wins) and the first time it was acknowledged or resolved."""
    at = F.col("changed_at")
    changes = events.groupBy("alarm_id").agg(
        F.max_by("status", F.struct(
            at, rank_of(F.col("status"), contract.STATUSES))).alias("status"),
        F.min(F.when(F.col("status") == "ACKNOWLEDGED", at)).alias("acknowledged_at"),
        F.min(F.when(F.col("status").isin(contract.CLOSED_STATUSES), at)).alias("resolved_at"))
    return alarms.join(changes, "alarm_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("NEW")))


def count_by(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows per enumeration value, with a zero row for absent ones."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "value string")
    return F.broadcast(every).join(counts, "value", "left").select(
        "value", F.coalesce("n", F.lit(0)).alias("n"))


def alarm_stats(alarms: DataFrame) -> DataFrame:
    """(dimension, value, n) for the total, each severity and each status.

    One scan: alarms are first reduced to counts per (severity, status).
    """
    cells = alarms.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))
    zero = [("severity", v) for v in contract.SEVERITIES] \
        + [("status", v) for v in contract.STATUSES] + [("total", "all")]
    every = alarms.sparkSession.createDataFrame(zero, "dimension string, value string")
    found = cells.select(F.explode(F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")))).alias("c"),
        "n").groupBy("c.dimension", "c.value").agg(F.sum("n").alias("n"))
    return F.broadcast(every).join(found, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def alarms_per_hour(alarms: DataFrame, buckets: int = 24) -> DataFrame:
    """Counts of the last non-empty hours, in ascending order."""
    hourly = alarms.groupBy(F.date_trunc("hour", "created_at").alias("bucket")).agg(
        F.count(F.lit(1)).alias("alarm_count"))
    return hourly.orderBy(F.desc("bucket")).limit(buckets).orderBy("bucket")


def alarm_groups(alarms: DataFrame, flows: DataFrame, limit: int = 20) -> DataFrame:
    """Top groups by (source, attack type): count, worst severity, first and last alarm."""
    worst = F.max(rank_of(F.col("severity"), contract.SEVERITIES))
    sides = flows.where(F.col("source_ip").isNotNull()).select(
        "flow_id", "source_ip", "attack_type")
    return (alarms.select("flow_id", "severity", "created_at").join(sides, "flow_id")
            .groupBy("source_ip", "attack_type").agg(
                F.count(F.lit(1)).alias("alarm_count"),
                name_of(worst, contract.SEVERITIES).alias("severity"),
                F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
            .orderBy(F.desc("alarm_count"), "source_ip", F.col("attack_type").asc_nulls_last())
            .limit(limit))


def attack_type_counts(flows: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent attack types, next to the total number of flows."""
    counts = flows.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    totals = counts.withColumn("total_flows", F.sum("n").over(everything))
    return totals.where(F.col("attack_type").isNotNull()).orderBy(
        F.desc("n"), "attack_type").limit(limit)


def known_models_only(flows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows whose model is registered (or unnamed), and the refused rest."""
    models = registry.select("model_name").distinct()
    refused = flows.where(F.col("model_name").isNotNull()).join(models, "model_name", "left_anti")
    known = flows.where(F.col("model_name").isNull()).unionByName(
        flows.join(models, "model_name", "left_semi").select(flows.columns))
    return known, refused.select(flows.columns)


def record_feedback(events: DataFrame, alarms: DataFrame, flows: DataFrame,
                    incidents: DataFrame | None = None,
                    existing: DataFrame | None = None) -> DataFrame:
    """One feedback row per (alarm, verdict): its first event, with the flow's detection.

    The attack type is kept only for confirmed alarms. Pairs in ``existing`` are left out.
    """
    first = (events.where(F.col("status").isin(contract.VERDICTS))
             .groupBy("alarm_id", F.col("status").alias("verdict"))
             .agg(F.min(F.struct("changed_at", "analyst")).alias("_first"))
             .select("alarm_id", "verdict", F.col("_first.changed_at").alias("recorded_at"),
                     F.col("_first.analyst").alias("analyst")))
    if existing is not None:
        first = first.join(existing.select("alarm_id", "verdict"), ["alarm_id", "verdict"],
                           "left_anti")
    rows = first.join(alarms.select("alarm_id", "flow_id"), "alarm_id").join(
        flows.select("flow_id", "predicted_label", "attack_type", "confidence",
                     "anomaly_score", "detection_method", "model_name", "truth_attack_type"),
        "flow_id")
    if incidents is not None:
        rows = rows.join(incidents.select("alarm_id", "incident_id"), "alarm_id", "left")
    else:
        rows = rows.withColumn("incident_id", F.lit(None).cast("string"))
    return rows.select(
        "alarm_id", "flow_id", "incident_id", "verdict", "recorded_at", "analyst",
        F.col("predicted_label").alias("original_prediction"),
        F.col("attack_type").alias("original_attack_type"),
        F.col("confidence").alias("original_confidence"),
        F.col("anomaly_score").alias("original_anomaly_score"), "detection_method",
        F.when(F.col("verdict") == "CONFIRMED", F.col("attack_type"))
        .alias("analyst_attack_type"),
        "model_name", F.col("truth_attack_type").alias("ground_truth_label"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Counts per verdict and false-positive rate, overall and per model."""
    model = F.coalesce("model_name", F.lit("(unrecorded)"))
    counts = feedback.groupBy(model.alias("model_name")).agg(
        count_if(F.col("verdict") == "CONFIRMED").alias("confirmed"),
        count_if(F.col("verdict") == "FALSE_POSITIVE").alias("false_positive"))
    overall = counts.agg(
        F.lit("(all)").alias("model_name"),
        F.coalesce(F.sum("confirmed"), F.lit(0)).alias("confirmed"),
        F.coalesce(F.sum("false_positive"), F.lit(0)).alias("false_positive"))
    total = F.col("confirmed") + F.col("false_positive")
    return overall.unionByName(counts).select(
        "model_name", "confirmed", "false_positive", total.alias("total"),
        ratio_or_zero(F.col("false_positive"), total).alias("false_positive_rate"))


def search(df: DataFrame, equals: dict[str, str | None], text: str | None,
           text_columns: list[str], newest: str, row_id: str, page: int = 0,
           size: int = 50) -> DataFrame:
    """One page of matching rows, newest first, with the number of all matches.

    Filters with no value are left out; the text is looked for in any of the columns,
    without regard to case. The page size is held within 1..200.
    """
    size = max(1, min(200, size))
    found = df
    for column, value in equals.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    if text and text.strip():
        needle = text.lower()
        hit = F.lit(False)
        for column in text_columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(column).cast("string")),
                                              F.lit(needle)), F.lit(False))
        found = found.where(hit)
    total = F.broadcast(found.agg(F.count(F.lit(1)).alias("total_rows")))
    page_rows = found.orderBy(F.desc(newest), row_id).offset(max(page, 0) * size).limit(size)
    return page_rows.join(total)
