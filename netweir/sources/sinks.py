"""Writers and exported forms of the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.functions import contract


def write_cleaned(df: DataFrame, path: str, by: str = "source_file") -> None:
    """The cleaned table, one folder per day file; rows of a file are not gathered in a task."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def feedback_lines(feedback: DataFrame) -> DataFrame:
    """One JSON text per feedback row, fields in fixed order, nulls kept."""
    return feedback.select(F.to_json(F.struct(
        F.col("alarm_id").cast("string").alias("alarm_id"), F.col("flow_id").cast("string").alias("network_flow_id"),
        "original_prediction", "original_attack_type", "original_confidence", "original_anomaly_score",
        "detection_method", F.col("verdict").alias("analyst_verdict"), "analyst_attack_type", "ground_truth_label",
        "model_name", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at")),
        {"ignoreNullFields": "false"}).alias("value"))


def export_feedback(feedback: DataFrame, path: str) -> None:
    feedback_lines(feedback).write.mode("overwrite").text(path)


def prediction_rows(flows: DataFrame) -> DataFrame:
    """Scored flows in the fixed column order; errors joined, columns not given are null."""
    kinds = dict(flows.dtypes)

    def column(name):
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        if kinds[name].startswith("array"):
            return F.array_join(name, "; ").alias(name)
        return F.col(name)

    return flows.select(*[column(c) for c in contract.PREDICTION_FIELDS])


def write_predictions(flows: DataFrame, path: str) -> None:
    prediction_rows(flows).write.mode("overwrite").partitionBy("run_id").option("header", True).csv(path)


def export_explanations(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """CSV without the nested evidence, JSON lines with it, and the summary."""
    kept = rows.persist()
    try:
        flat = [c for c, t in kept.dtypes if not t.startswith(("array", "struct", "map"))]
        kept.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
        kept.write.mode("overwrite").json(f"{path}/jsonl")
        summary.write.mode("overwrite").json(f"{path}/summary")
    finally:
        kept.unpersist()


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-free digest of a table's content, by default of all its columns.

    Each row is hashed by md5 over its values as texts, null apart from every text; both halves of the hashes
    are summed, so repeated rows count and parts of a table can be summed by themselves.
    """
    texts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in columns or df.columns]
    row = F.md5(F.concat_ws("\x1f", *texts).cast("binary"))

    def total(at: int):
        return F.sum(F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)")).cast("string")

    return df.agg(F.count(F.lit(1)).alias("n_rows"), total(1).alias("high_sum"), total(17).alias("low_sum"))
