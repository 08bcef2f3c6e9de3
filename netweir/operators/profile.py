"""Feature profiles: reference statistics, compatibility of live data, source summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.derive import RULES
from netweir.functions.numbers import computed_once, count_if, finite, is_finite, number_in, ratio, ratio_or_zero
from netweir.functions.ordered import carried_lag, exact_quantiles, quantiles_in, rank_cells, value_cell

PERCENT_GRID = [i / 100 for i in range(101)]


def long_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value), one row per feature of each row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value"))
                      for f in features])
    return df.select(*(keep or []), F.explode(pairs).alias("_p")).select(*(keep or []), "_p.*")


def feature_reference(df: DataFrame, features: list[str]) -> DataFrame:
    """Statistics of every feature, with the 101 percent quantiles.

    Every feature becomes a row of its own inside the scan stage, so all features share
    one small set of aggregates that combine on the map side; quantiles come from the
    counting passes of ``exact_quantiles``, distinct values from a two-step count. Mean and
    deviation are over finite values, fractions over all rows.
    """
    long = long_features(df, features)
    raw, value = F.col("value"), F.col("_finite")
    rows = F.count(F.lit(1))
    stats = long.withColumn("_finite", finite(raw)).groupBy("feature").agg(
        F.count(value).alias("count"), count_if(raw.isNull() | F.isnan(raw)).alias("nan_count"),
        count_if(F.abs(raw) == float("inf")).alias("inf_count"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(0.0).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        ratio_or_zero(count_if(raw == 0), rows).alias("zero_fraction"),
        ratio_or_zero(count_if((raw < 0) & ~F.isnan(raw)), rows).alias("negative_fraction"))
    distinct = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(
        "feature", "value").agg(F.lit(1).alias("_x")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("nunique"))
    q = exact_quantiles(long, ["feature"], "value", PERCENT_GRID).drop("n")
    named = {"p01": 1, "p25": 25, "p50": 50, "p75": 75, "p99": 99}
    return stats.join(F.broadcast(distinct), "feature", "left").join(F.broadcast(q), "feature", "left") \
        .withColumns({
            "nunique": F.coalesce("nunique", F.lit(0)),
            **{n: F.try_element_at("quantiles", F.lit(i + 1)) for n, i in named.items()}}) \
        .withColumn("constant", F.col("nunique") <= 1) \
        .withColumn("constant_value", F.when(F.col("constant"), F.col("min")))


def constant_and_near_zero(reference: DataFrame) -> DataFrame:
    """Features that are 0 throughout, and those 0 on at least 99 % of rows."""
    constant_zero = F.col("constant") & (F.col("min") == 0)
    return reference.select("feature", F.when(constant_zero, "constant_zero").when(
        F.col("zero_fraction") >= 0.99, "near_zero").alias("kind")).where("kind IS NOT NULL")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_windows(df: DataFrame, label: str, ts: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.min(ts).alias("first_occurrence"), F.max(ts).alias("last_occurrence"))


def source_summary(df: DataFrame, source: str, ts: str, row_order: list[str],
                   chunk: F.Column) -> DataFrame:
    """Per file: rows, time range, share of steps that do not go back in file order.

    The row order must be stored with the rows; ``chunk`` cuts it into pieces.
    """
    stepped = carried_lag(df.select(source, *[c for c in row_order if c != ts], ts), [source],
                          chunk, row_order, [ts])
    previous = F.col(f"prev_{ts}")
    return stepped.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_timestamp"),
        F.max(ts).alias("last_timestamp"),
        F.try_divide(count_if(F.col(ts) >= previous).cast("double"),
                     F.count(previous).cast("double")).alias("non_decreasing_share"))


def source_class_counts(df: DataFrame, source: str, label: str) -> DataFrame:
    return df.groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))


def benign_baseline_quantiles(df: DataFrame, features: list[str], label: str,
                              benign: str = contract.BENIGN) -> DataFrame:
    """Median, quartiles and p99 of every feature over benign rows."""
    rows = long_features(df.where(F.col(label) == benign), features)
    q = exact_quantiles(rows, ["feature"], "value", [0.25, 0.5, 0.75, 0.99])
    return q.select("feature", *[F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(
        ["p25", "median", "p75", "p99"])])


def partition_report(df: DataFrame, label: str, ts: str, split: str) -> DataFrame:
    """Sizes, time ranges, order and classes of a train/test split.

    One pass counts per (label, split); the report is made from those few rows.
    """
    cells = df.groupBy(label, split).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    train, test = F.col(split) == "train", F.col(split) == "test"
    by_label = cells.groupBy(label).agg(
        F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("train"),
        F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias("test"),
        F.min(F.when(train, F.col("first"))).alias("train_first"),
        F.max(F.when(train, F.col("last"))).alias("train_last"),
        F.min(F.when(test, F.col("first"))).alias("test_first"),
        F.max(F.when(test, F.col("last"))).alias("test_last"))
    only_test = (F.col("test") > 0) & (F.col("train") == 0)
    unseen = F.coalesce(F.sum(F.when(only_test, F.col("test"))), F.lit(0))

    def names(condition):
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col(label)))), ",")

    return by_label.agg(
        F.sum("train").alias("train_rows"), F.sum("test").alias("test_rows"),
        ratio(F.sum("test"), F.sum("train") + F.sum("test")).alias("test_fraction"),
        F.min("train_first").alias("train_first"), F.max("train_last").alias("train_last"),
        F.min("test_first").alias("test_first"), F.max("test_last").alias("test_last"),
        (F.max("train_last") <= F.min("test_first")).alias("chronology_respected"),
        names((F.col("train") > 0) & (F.col("test") > 0)).alias("classes_in_both"),
        names((F.col("train") > 0) & (F.col("test") == 0)).alias("classes_only_in_train"),
        names(only_test).alias("classes_only_in_test"),
        unseen.alias("unseen_test_rows"), ratio_or_zero(unseen, F.sum("test")).alias("unseen_test_fraction"))


def split_support(df: DataFrame, label: str, split: str) -> DataFrame:
    return df.groupBy(label).agg(count_if(F.col(split) == "train").alias("train_support"),
                                 count_if(F.col(split) == "test").alias("test_support"))


def latency_summary(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Count, mean, median, p95, quartiles, spread and extremes of a latency column."""
    q = exact_quantiles(df, groups, column, [0.25, 0.5, 0.75, 0.95])
    moments = df.groupBy(*groups).agg(
        F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    low, median, high, p95 = [F.element_at("quantiles", i) for i in (1, 2, 3, 4)]
    return q.join(moments, groups).select(
        *groups, "n", "mean", median.alias("median"), p95.alias("p95"), "min", "max",
        low.alias("q1"), high.alias("q3"), (high - low).alias("iqr"))


def verify_derivations(df: DataFrame, tolerance: float = 1e-6, slack: float = 0.01) -> DataFrame:
    """Share of rows each derivation rule reproduces, and whether that is a step back.

    A rule counts only where the column and all its inputs are in the table.
    """
    have = set(df.columns)
    rules = [f for f, r in RULES.items() if f in have and all(n in have for n in r.inputs)]
    sums = []
    for i, f in enumerate(rules):
        rule = RULES[f]
        actual = finite(F.col(f"`{f}`"))
        guess = rule.expression(*[F.col(f"`{n}`") for n in rule.inputs])
        guess = F.when(is_finite(guess), guess)
        comparable = actual.isNotNull() & guess.isNotNull()
        close = F.abs(guess - actual) <= tolerance * F.greatest(F.abs(actual), F.lit(1.0))
        sums += [count_if(comparable).alias(f"n{i}"), count_if(comparable & close).alias(f"ok{i}")]
    return df.agg(*sums).select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"n{i}").alias("comparable"), F.col(f"ok{i}").alias("exact"),
        ratio(F.col(f"ok{i}"), F.col(f"n{i}")).alias("exact_rate"),
        F.lit(RULES[f].exact_rate).alias("claimed_rate")) for i, f in enumerate(rules)])).alias("r")).select(
        "r.*", (F.col("r.exact_rate") < F.col("r.claimed_rate") - slack).alias("regression"))


def compatibility_profile(capture: DataFrame, reference: DataFrame, feature_set: list[str],
                          active_set: list[str]) -> DataFrame:
    """How live values of each feature compare with the reference, and what blocks scoring.

    ``capture`` has raw texts under capture names. The texts are parsed in two passes: sums of every
    value cell, from which all live statistics come, then the values of the cells that hold a quantile.
    """
    name_of = {v: k for k, v in contract.CAPTURE_TO_CONTRACT.items()}
    present = [f for f in feature_set if name_of.get(f) in capture.columns]
    long = capture.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.trim(F.col(f"`{name_of[f]}`").cast("string")).alias("text"))
        for f in present])).alias("x")).select("x.*")
    long = computed_once(long, number=number_in(F.col("text"))).select("feature", finite(F.col("number")).alias("_v"))
    value = F.col("_v")
    celled = long.withColumn("_cell", F.when(value.isNotNull(), value_cell(value)))
    sums = celled.groupBy("feature", "_cell").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.avg(value).alias("_mean"), count_if(value == 0).alias("_zero"), count_if(value < 0).alias("_negative")).persist()
    valid = F.sum("_n")
    live = sums.groupBy("feature").agg(
        F.sum("_rows").alias("observed"), valid.alias("n_valid"),
        F.min("_lo").alias("live_min"), F.max("_hi").alias("live_max"),
        ratio(F.sum(F.col("_mean") * F.col("_n")), valid).alias("live_mean"),
        ratio(F.sum("_zero"), valid).alias("live_zero_fraction"), ratio(F.sum("_negative"), valid).alias("live_negative_fraction"))
    needed = rank_cells(sums.where("_n > 0").select("feature", "_cell", "_n"), ["feature"], [0.01, 0.5, 0.99])
    values = celled.join(F.broadcast(needed.select("feature", "_cell")), ["feature", "_cell"], "left_semi").groupBy(
        "feature", "_cell", "_v").agg(F.count(F.lit(1)).alias("_n"))
    q = quantiles_in(values, F.broadcast(needed), ["feature"]).select("feature", *[
        F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(["live_p01", "live_p50", "live_p99"])])
    ref = reference.select("feature", "p01", "p99", "zero_fraction", "negative_fraction")
    every = capture.sparkSession.createDataFrame(
        [(i, f, f in present, f in active_set, f in contract.CONSTANT_ZERO) for i, f in enumerate(feature_set)],
        "position int, feature string, present boolean, active boolean, constant_zero boolean")
    joined = F.broadcast(every).join(live, "feature", "left").join(q, "feature", "left").join(
        ref, "feature", "left")
    usable = F.coalesce(F.col("n_valid"), F.lit(0)) > 0
    first = (F.when(~F.col("present"), F.when(F.col("constant_zero"), "CONST_ZERO_OK").otherwise("MISSING"))
             .when(~usable, F.when(F.col("constant_zero"), "CONST_ZERO_OK").otherwise("ALL_INVALID"))
             .when(F.col("observed") > F.col("n_valid"), "OK_WITH_INVALIDS").otherwise("OK"))
    flags = F.array_compact(F.array(
        F.when((F.col("live_p50") < F.col("p01")) | (F.col("live_p50") > F.col("p99")), "RANGE_SHIFT"),
        F.when((F.col("negative_fraction") == 0) & (F.col("live_negative_fraction") > 0), "SIGN_SHIFT"),
        F.when(F.abs(F.col("live_zero_fraction") - F.col("zero_fraction")) > 0.25, "ZERO_SHIFT")))
    table = joined.withColumns({
        "first_verdict": first,
        "flags": F.when(usable, F.concat_ws(",", flags)).otherwise("")})
    resolved = F.collect_set(F.when(~F.col("first_verdict").isin("MISSING", "ALL_INVALID"), F.col("feature"))) \
        .over(Window.partitionBy())
    table = table.withColumn("_resolved", resolved)
    can = F.lit(False)
    for f, rule in RULES.items():
        if f in feature_set:
            inputs = F.array(*[F.lit(n) for n in rule.inputs])
            can = F.when(F.col("feature") == f, F.size(F.array_except(inputs, "_resolved")) == 0).otherwise(can)
    open_verdict = F.col("first_verdict").isin("MISSING", "ALL_INVALID")
    verdict = F.when(open_verdict & can, "MISSING_BUT_DERIVABLE").otherwise(F.col("first_verdict"))
    return table.withColumn("verdict", verdict).select(
        "feature", "active", "observed", "n_valid",
        (1 - ratio(F.col("n_valid"), F.col("observed"))).alias("invalid_fraction"),
        "live_min", "live_max", "live_mean", "live_p01", "live_p50", "live_p99",
        "live_zero_fraction", "live_negative_fraction", "flags", "verdict",
        (F.col("active") & F.col("verdict").isin("MISSING", "ALL_INVALID")).alias("blocking"))
