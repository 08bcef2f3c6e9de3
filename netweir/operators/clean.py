"""Cleaning of raw flow tables and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.cleaning import clean_label, parse_timestamp, protocol_name, to_int
from netweir.functions.numbers import count_if, finite, is_finite, parse_number

APPLIED = "_micros_applied"


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in ("double", "float")]


def drop_nonfinite(df: DataFrame, required: list[str] = contract.RATE_COLUMNS_REQUIRED) -> DataFrame:
    """Infinite and NaN values become null; rows without the required rates are dropped."""
    clean = {c: finite(F.col(f"`{c}`")) for c in numeric_columns(df)}
    return df.withColumns(clean).dropna(subset=required)


def nonfinite_by_column(df: DataFrame) -> DataFrame:
    """NaN and infinite values of every numeric column, from one pass."""
    columns = numeric_columns(df)
    sums = []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        sums += [count_if(value.isNull() | F.isnan(value)).alias(f"nan_{i}"),
                 count_if(F.abs(value) == float("inf")).alias(f"inf_{i}")]
    return df.agg(*sums).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"nan_{i}").alias("nan_count"),
                 F.col(f"inf_{i}").alias("inf_count")) for i, c in enumerate(columns)])).alias("r")
    ).select("r.*")


def redundant_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each pair of columns: rows on which they differ, null equal to null."""
    sums = [count_if(~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"d{i}")
            for i, (a, b) in enumerate(pairs)]
    return df.agg(*sums).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"),
                 F.col(f"d{i}").alias("differing"), (F.col(f"d{i}") == 0).alias("identical"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def coerce_fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers from text; whatever is no finite decimal number becomes 0."""
    def number(column):
        text = F.col(f"`{column}`").cast("string")
        value = F.when(~F.contains(text, F.lit("_")), parse_number(text)["value"])
        return F.coalesce(value, F.lit(0.0))

    return df.withColumns({c: number(c) for c in columns})


def rename_to_contract(df: DataFrame, mapping: dict[str, str] = contract.CAPTURE_TO_CONTRACT,
                       keep: list[str] | None = None) -> DataFrame:
    """Capture columns under their contract names; metadata and unknown columns are left out."""
    return df.select(*(keep or []), *[F.col(f"`{c}`").alias(mapping[c])
                                      for c in df.columns if c in mapping])


def seconds_to_micros(df: DataFrame, features: list[str] = contract.SECONDS_FEATURES) -> DataFrame:
    """Time features from seconds to microseconds, once; rates stay as they are."""
    if APPLIED in df.columns:
        raise ValueError("the unit conversion has been applied already")
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"time features are missing: {missing}")

    def scaled(name):
        value = F.col(f"`{name}`").cast("double")
        return F.when(is_finite(value), value * 1000000).otherwise(
            F.raise_error(F.lit(f"{name} is not a finite number")).cast("double"))

    return df.withColumns({f: scaled(f) for f in features}).withColumn(APPLIED, F.lit(True))


def resolve_capture_time(df: DataFrame, fallback: str | None = None, zone: str | None = None,
                         assume_utc: bool = True) -> DataFrame:
    """Capture time from the first usable candidate column, with where it came from.

    Without one, the ingest time stands in and is marked as an approximation.
    """
    present = [c for c in contract.CAPTURE_TIME_COLUMNS if c in df.columns]
    parsed = {c: parse_timestamp(F.col(f"`{c}`"), zone, assume_utc) for c in present}
    found = F.coalesce(*parsed.values(), F.lit(None).cast("timestamp"))
    column = F.lit(None).cast("string")
    for name in reversed(present):
        column = F.when(parsed[name].isNotNull(), name).otherwise(column)
    instead = F.col(fallback) if fallback else F.current_timestamp()
    return df.withColumns({"_found": found, "capture_timestamp_column": column}).withColumns({
        "capture_timestamp": F.coalesce("_found", instead),
        "capture_timestamp_source": F.when(F.col("_found").isNotNull(), "EXACT_CAPTURE")
        .otherwise("APPROXIMATE_INGEST"),
        "capture_timestamp_is_approximate": F.col("_found").isNull()}).drop("_found")


def replay_payload(df: DataFrame, feature_columns: list[str]) -> DataFrame:
    """Labelled source rows in the shape of the ingest contract."""
    truth = clean_label(F.col("Label"))
    return df.select(
        F.when(truth == "BENIGN", "BENIGN").otherwise("ATTACK").alias("ground_truth_label"),
        F.when(truth != "BENIGN", truth).alias("ground_truth_attack_type"),
        F.col("`Source IP`").cast("string").alias("source_ip"),
        F.col("`Destination IP`").cast("string").alias("destination_ip"),
        to_int(F.col("`Source Port`")).alias("source_port"),
        to_int(F.col("`Destination Port`")).alias("destination_port"),
        protocol_name(F.col("Protocol")).alias("protocol"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in feature_columns]),
                          F.array(*[F.col(f"`{c}`").cast("double") for c in feature_columns]))
        .alias("feature_vector"))
