"""Readers of flow tables, captures and ingest events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweir.functions import contract

CORRUPT = "_corrupt_line"


def day_schema(columns: list[str], text: list[str]) -> T.StructType:
    """Schema of a day file in file order; the duplicated header keeps a name of its own."""
    return T.StructType([T.StructField(c.strip(), T.StringType() if c.strip() in text else T.DoubleType())
                         for c in columns])


def read_flow_days(spark: SparkSession, paths: list[str], schema: T.StructType,
                   encoding: str = "ISO-8859-1") -> DataFrame:
    """All day files as one table with their ``source_file``; the duplicated column is dropped.

    The schema is always given: headers repeat a name and carry spaces.
    """
    days = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("encoding", encoding).option("nanValue", "NaN").option("positiveInf", "Infinity")
            .option("negativeInf", "-Infinity").csv(paths))
    return days.withColumn("source_file", F.col("_metadata.file_name")).drop(contract.DUPLICATE_HEADER)


def union_days(days: list[DataFrame]) -> DataFrame:
    """Day tables one after another, columns matched by name."""
    first, *rest = days
    for day in rest:
        first = first.unionByName(day)
    return first


def read_features(spark: SparkSession, path: str, feature_set: list[str], meta: list[str]) -> DataFrame:
    """The named features and metadata of a parquet table; missing columns are refused."""
    table = spark.read.parquet(path)
    missing = [c for c in [*feature_set, *meta] if c not in table.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return table.select(*[F.col(f"`{c}`") for c in [*meta, *feature_set]])


def read_capture(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows of a capture, all as text, and the lines with the wrong number of fields.

    Lines are parsed one by one, so a half-written last line spoils no other.
    """
    return parse_capture(spark.read.text(path), "value", columns)


def parse_capture(lines: DataFrame, line: str, columns: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines of a table or stream of capture lines; blank lines and headers are neither."""
    keep = keep or []
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    rows = lines.where((F.trim(line) != ",".join(columns)) & (F.trim(line) != ""))
    parsed = rows.select(*keep, F.from_csv(line, F.lit(schema), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select(*keep, "r.*")
    bad = F.col(CORRUPT).isNotNull()
    return parsed.where(~bad).drop(CORRUPT), parsed.where(bad).select(*keep, CORRUPT)


def capture_column_report(good: DataFrame, malformed: DataFrame, header: list[str]) -> DataFrame:
    """One row: rows, columns, repeated columns and malformed lines of a capture."""
    repeated = sorted({c for c in header if header.count(c) > 1})
    return good.agg(F.count(F.lit(1)).alias("row_count")).join(
        malformed.agg(F.count(F.lit(1)).alias("malformed_lines"))).select(
        "row_count", F.lit(len(header)).alias("column_count"), F.lit(",".join(repeated)).alias("duplicate_columns"),
        "malformed_lines")


EVENT = T.StructType([
    T.StructField("source_ip", T.StringType()), T.StructField("destination_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()), T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()), T.StructField("dataset_source", T.StringType()),
    T.StructField("ground_truth_label", T.StringType()), T.StructField("predicted_label", T.StringType()),
    T.StructField("attack_type", T.StringType()), T.StructField("prediction_confidence", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()), T.StructField("model_name", T.StringType()),
    T.StructField("flow_timestamp", T.TimestampType()),
    T.StructField("feature_vector", T.MapType(T.StringType(), T.StringType())),
])


def parse_flow_events(df: DataFrame, column: str = "json") -> DataFrame:
    """Typed detection events with their defaults, and ``rejected`` for the unusable ones.

    An event must carry a confidence or an anomaly score.
    """
    parsed = df.withColumn("_e", F.from_json(column, EVENT)).drop(column)
    events = parsed.select(*[c for c in parsed.columns if c != "_e"], "_e.*")
    return events.withColumns({
        "dataset_source": F.coalesce("dataset_source", F.lit("LAB_LIVE")),
        "ground_truth_label": F.coalesce("ground_truth_label", F.lit("UNKNOWN")),
        "rejected": F.col("prediction_confidence").isNull() & F.col("anomaly_score").isNull()})
