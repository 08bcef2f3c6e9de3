"""Small record tables: experiments, drift reports, model activations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def experiment_leaders(results: DataFrame) -> DataFrame:
    """Best F1 and lowest latency on record, 0 without any."""
    return results.agg(F.coalesce(F.max("f1"), F.lit(0.0)).alias("best_f1"),
                       F.coalesce(F.min("latency_ms"), F.lit(0.0)).alias("fastest_latency_ms"))


def top_experiments(results: DataFrame, limit: int = 5) -> DataFrame:
    return results.orderBy(F.desc("f1"), "model").limit(limit)


def feature_count_series(results: DataFrame) -> DataFrame:
    """F1 against the number of features, read from names such as top_30_features."""
    n = F.nullif(F.regexp_extract("feature_set", r"^top_(\d+)_features$", 1), F.lit("")).try_cast("int")
    return results.withColumn("n_features", n).where(F.col("n_features").isNotNull()).orderBy("n_features", "model")


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report. Only the best row of each task moves."""
    return reports.agg(F.max_by(F.struct(*reports.columns), F.struct("created_at", "report_id")).alias("r")).select("r.*")


def report_history(reports: DataFrame, page: int, size: int) -> DataFrame:
    return reports.orderBy(F.desc("created_at"), F.desc("report_id")).offset(page * size).limit(size)


def active_model(activations: DataFrame) -> DataFrame:
    """Every model with whether it is the active one: the last activated.

    The newest activation is found by an aggregate; models themselves are few.
    """
    newest = activations.agg(F.max_by("model", F.struct("activated_at", "model")).alias("_active"))
    models = activations.groupBy("model").agg(F.max("activated_at").alias("last_activated"))
    return models.join(F.broadcast(newest)).select(
        "model", "last_activated", (F.col("model") == F.col("_active")).alias("active"))
