"""The flagship job: flows to alarms to incidents to the busiest sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.operators.alarms import name_of, raise_alarms, rank_of
from netweir.operators.incidents import sessionise_incidents


def top_incident_groups(flows: DataFrame, window_seconds: int, limit: int = 20) -> DataFrame:
    """Sources and attack types with the most alarms, with their incidents."""
    incidents = sessionise_incidents(raise_alarms(flows), window_seconds)
    worst = F.max(rank_of(F.col("severity"), contract.SEVERITIES))
    return (incidents.where(F.col("source_ip").isNotNull())
            .groupBy("source_ip", "attack_type").agg(
                F.count(F.lit(1)).alias("incidents"), F.sum("alarm_count").alias("alarms"),
                name_of(worst, contract.SEVERITIES).alias("severity"),
                F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
            .orderBy(F.desc("alarms"), "source_ip", F.col("attack_type").asc_nulls_last())
            .limit(limit))
