"""Distribution drift and shift between samples.

Kolmogorov-Smirnov distances come from counts per value cell. The deviation at the ends
of a cell is exact and what may lie inside is bounded by them, so only cells that could
beat the best end are looked into, value by value. No feature is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.draws import draw, draw_key
from netweir.functions.numbers import computed_once, count_if, interpolate, is_finite, ratio, ratio_or_zero
from netweir.functions.ordered import exact_quantiles, quantiles_in, rank_cells, value_cell
from netweir.operators.profile import PERCENT_GRID, long_features

CALIBRATION_WINDOWS = [200, 500, 1000, 2000]
CALIBRATION_DRAWS = 200


def _levels() -> Column:
    return F.array(*[F.lit(p) for p in PERCENT_GRID])


def _cell_windows(groups: list[str]):
    order = Window.partitionBy(*groups).orderBy("_cell")
    return order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)


def ks_vs_reference(long: DataFrame, reference: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Distance of each sample from the piecewise-linear reference distribution.

    ``long`` has (groups, feature, value), ``reference`` (feature, quantiles) with the 101
    percent quantiles. A constant reference gives 0 or 1; a feature without a finite value
    0. Groups come from a fixed list (windows, draws), so the cell tables stay small.
    """
    keys = [*(groups or []), "feature"]
    rows = long.where(is_finite(F.col("value"))).withColumn("_cell", value_cell(F.col("value")))
    cells = bounded_cells(rows.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")), reference, keys)
    values = rows.join(open_cells(cells).select(*keys, "_cell"), [*keys, "_cell"], "left_semi").groupBy(
        *keys, "_cell", F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    result = ks_in(cells, values, reference, keys)
    if groups:
        return result
    return F.broadcast(reference.select("feature")).join(result, "feature", "left").select(
        "feature", F.coalesce("ks_statistic", F.lit(0.0)).alias("ks_statistic"),
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"))


def bounded_cells(cells: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, _cell, _n, _lo, _hi) with the deviation seen at their ends and the most that may lie inside."""
    before, everything = _cell_windows(keys)
    cells = cells.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(everything)})
    cells = cells.join(F.broadcast(reference.select("feature", "quantiles")), "feature")
    cells = computed_once(cells, _glo=interpolate(F.col("_lo"), F.col("quantiles"), _levels()),
                          _ghi=interpolate(F.col("_hi"), F.col("quantiles"), _levels())).drop("quantiles")
    start, end = F.col("_before") / F.col("_total"), (F.col("_before") + F.col("_n")) / F.col("_total")
    return cells.withColumns({
        "_seen": F.max(F.greatest(F.col("_glo") - start, end - F.col("_ghi"))).over(everything),
        "_bound": F.greatest(end - F.col("_glo"), F.col("_ghi") - start)})


def open_cells(cells: DataFrame) -> DataFrame:
    """Those of the bounded cells that could hold a larger deviation than any cell end."""
    return cells.where((F.col("_bound") > F.col("_seen")) & (F.col("_lo") < F.col("_hi")))


def ks_in(cells: DataFrame, values: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ks_statistic, sample_size) from bounded cells and the counts (keys, _cell, _v, _n) inside the open ones."""
    knots = F.broadcast(reference.select("feature", "quantiles"))
    best = cells.groupBy(*keys).agg(F.max("_seen").alias("_best"), F.min("_lo").alias("_min"),
                                    F.max("_hi").alias("_max"), F.max("_total").alias("sample_size"))
    values = values.join(open_cells(cells).select(*keys, "_cell", "_before", "_total"), [*keys, "_cell"])
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).join(knots, "feature")
    values = computed_once(values, _g=interpolate(F.col("_v"), F.col("quantiles"), _levels()))
    deviation = F.greatest(F.col("_upto") / F.col("_total") - F.col("_g"),
                           F.col("_g") - (F.col("_upto") - F.col("_n")) / F.col("_total"))
    refined = values.groupBy(*keys).agg(F.max(deviation).alias("_inner"))
    found = best.join(refined, keys, "left").join(knots, "feature")
    low, high = F.col("quantiles")[0], F.element_at("quantiles", -1)
    same = (F.col("_min") == low) & (F.col("_max") == low)
    statistic = F.when(high <= low, F.when(same, 0.0).otherwise(1.0)).otherwise(
        F.greatest("_best", F.coalesce("_inner", F.col("_best"))))
    return found.select(*keys, statistic.alias("ks_statistic"), "sample_size")


def ks_two_sample(base: DataFrame, other: DataFrame) -> DataFrame:
    """Exact two-sample distance per feature of two (feature, value) tables.

    Null where the base is constant.
    """
    both = base.select("feature", "value", F.lit(1).alias("_a")).unionAll(
        other.select("feature", "value", F.lit(0).alias("_a"))).where(is_finite(F.col("value")))
    rows = both.withColumn("_cell", value_cell(F.col("value")))
    before, everything = _cell_windows(["feature"])
    a, b = F.sum("_a"), F.sum(1 - F.col("_a"))
    cells = rows.groupBy("feature", "_cell").agg(
        a.alias("_na"), b.alias("_nb"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    zero = F.lit(0)
    cells = cells.withColumns({
        "_ba": F.coalesce(F.sum("_na").over(before), zero), "_bb": F.coalesce(F.sum("_nb").over(before), zero),
        "_ta": F.sum("_na").over(everything), "_tb": F.sum("_nb").over(everything)})
    sa, ea = F.col("_ba") / F.col("_ta"), (F.col("_ba") + F.col("_na")) / F.col("_ta")
    sb, eb = F.col("_bb") / F.col("_tb"), (F.col("_bb") + F.col("_nb")) / F.col("_tb")
    cells = cells.withColumn("_seen", F.max(F.abs(ea - eb)).over(everything))
    bound = F.greatest(ea - sb, eb - sa)
    best = cells.groupBy("feature").agg(F.max("_seen").alias("_best"))
    open_cells = cells.where((bound > F.col("_seen")) & (F.col("_lo") < F.col("_hi"))).select(
        "feature", "_cell", "_ba", "_bb", "_ta", "_tb")
    values = rows.join(open_cells, ["feature", "_cell"]).groupBy(
        "feature", "_cell", "value", "_ba", "_bb", "_ta", "_tb").agg(a.alias("_na"), b.alias("_nb"))
    inside = Window.partitionBy("feature", "_cell").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    gap = F.abs((F.col("_ba") + F.col("_ca")) / F.col("_ta") - (F.col("_bb") + F.col("_cb")) / F.col("_tb"))
    refined = values.withColumns({"_ca": F.sum("_na").over(inside), "_cb": F.sum("_nb").over(inside)}).groupBy(
        "feature").agg(F.max(gap).alias("_inner"))
    spread = base.where(is_finite(F.col("value"))).groupBy("feature").agg(
        F.stddev_pop("value").alias("_std"))
    return best.join(refined, "feature", "left").join(spread, "feature").select(
        "feature", F.when(F.col("_std") > contract.NEAR_CONSTANT_STD, F.greatest(
            "_best", F.coalesce("_inner", F.col("_best")))).alias("ks_statistic"))


SHIFT_GRID = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


def _describe(long: DataFrame, prefix: str) -> DataFrame:
    value = F.col("value")
    moments = long.groupBy("feature").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        ratio(count_if(value == 0), F.count(value)).alias("zero_fraction"))
    q = exact_quantiles(long, ["feature"], "value", list(SHIFT_GRID.values())).select("feature", *[
        F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(SHIFT_GRID)])
    both = moments.join(q, "feature")
    return both.select("feature", *[F.col(c).alias(f"{prefix}_{c}") for c in both.columns if c != "feature"])


def feature_shift(base: DataFrame, live: DataFrame) -> DataFrame:
    """How each feature moved between two (feature, value) tables."""
    a, b = _describe(base, "base"), _describe(live, "live")
    limits = F.broadcast(a.select("feature", "base_p01", "base_p25", "base_p75", "base_p99"))
    value = F.col("value")
    outside = live.join(limits, "feature").groupBy("feature").agg(
        (F.avg(F.when((value < F.col("base_p25")) | (value > F.col("base_p75")), 1.0).otherwise(0.0)) * 100)
        .alias("pct_outside_iqr"),
        (F.avg(F.when((value < F.col("base_p01")) | (value > F.col("base_p99")), 1.0).otherwise(0.0)) * 100)
        .alias("pct_outside_p01_p99"))
    pooled = F.sqrt((F.col("base_std") * F.col("base_std") + F.col("live_std") * F.col("live_std")) / 2)
    tiny = contract.NEAR_CONSTANT_STD
    return a.join(b, "feature").join(outside, "feature").join(ks_two_sample(base, live), "feature").withColumns({
        "abs_standardized_diff": F.when(pooled > tiny, F.abs(F.col("live_mean") - F.col("base_mean")) / pooled),
        "median_diff": F.col("live_median") - F.col("base_median"),
        "median_ratio": F.when(F.abs("base_median") > tiny, F.col("live_median") / F.col("base_median")),
        "base_constant": F.col("base_std") <= tiny, "live_constant": F.col("live_std") <= tiny})


def shift_rank(shift: DataFrame, top: int | None = None) -> DataFrame:
    """Features by falling distance, those without one last. One row per feature goes in."""
    order = Window.partitionBy().orderBy(F.col("ks_statistic").desc_nulls_last(), "feature")
    ranked = shift.select("feature", "ks_statistic", F.row_number().over(order).alias("shift_rank"))
    return ranked if top is None else ranked.where(F.col("shift_rank") <= top)


def shift_overview(shift: DataFrame) -> DataFrame:
    """Summary over features. One row per feature goes in."""
    ks, out = F.col("ks_statistic"), F.col("pct_outside_p01_p99")
    return shift.agg(
        F.count(ks).alias("comparable_features"), count_if(ks.isNull()).alias("not_comparable"),
        F.median(ks).alias("median_ks"), F.percentile(ks, F.lit(0.75)).alias("p75_ks"), F.max(ks).alias("max_ks"),
        *[count_if(ks >= t).alias(f"ks_ge_0_{int(t * 10)}") for t in (0.3, 0.5, 0.8)],
        count_if(out >= 50).alias("ge_50pct_outside"), count_if(out >= 100).alias("all_outside"))


def feature_kind(feature: Column) -> Column:
    return (F.when(feature.isin(contract.SECONDS_FEATURES + contract.LIKELY_SECONDS_FEATURES), "time")
            .when(feature.isin(contract.RATE_FEATURES), "rate")
            .when(feature.isin(contract.FLAG_FEATURES), "flag").otherwise("other"))


def unit_mismatch_audit(shift: DataFrame) -> DataFrame:
    """What kind each feature is and whether its median hints at another time unit."""
    kind = feature_kind(F.col("feature"))
    hint = F.when(F.abs("live_median") > contract.NEAR_CONSTANT_STD, F.col("base_median") / F.col("live_median"))
    suspect = (kind == "time") & F.coalesce(hint.between(1e4, 1e8), F.lit(False))
    masked = (kind == "time") & ~suspect & (F.col("base_constant") | F.col("live_constant"))
    status = (F.when(masked, "LIKELY_SAME").when(kind == "time", "UNIT_MISMATCH_SUSPECTED")
              .when(kind.isin("rate", "flag"), "POSSIBLE_IMPLEMENTATION_DIFFERENCE")
              .when(F.contains(F.col("feature"), F.lit("Bulk")), "SEMANTICS_UNRESOLVED").otherwise("LIKELY_SAME"))
    return shift.select("feature", kind.alias("kind"), status.alias("semantic_status"), "base_median",
                        "live_median", "median_ratio", suspect.alias("unit_ratio_found"))


def contract_audit(base: DataFrame, live: DataFrame) -> DataFrame:
    """Scale of every time and rate feature on both sides and the conversion it needs."""
    timed = contract.SECONDS_FEATURES + contract.LIKELY_SECONDS_FEATURES + contract.RATE_FEATURES

    def side(long, prefix):
        rows = long.where(F.col("feature").isin(timed))
        q = exact_quantiles(rows, ["feature"], "value", [0.99])
        m = rows.groupBy("feature").agg(
            F.max("value").alias(f"{prefix}_max"),
            F.avg(F.when(F.col("value") != 0, 1.0).otherwise(0.0)).alias(f"{prefix}_nonzero"))
        return m.join(q.select("feature", F.element_at("quantiles", 1).alias(f"{prefix}_p99")), "feature")

    f = F.col("feature")
    confirmed, rate = f.isin(contract.SECONDS_FEATURES), f.isin(contract.RATE_FEATURES)
    return side(base, "base").join(side(live, "live"), "feature").select(
        "feature", "base_p99", "base_max", "live_p99", "live_nonzero",
        (F.col("base_p99") >= 1e5).alias("base_microsecond_scale"),
        ((F.col("live_nonzero") > 0) & (F.col("live_p99") < 1e4)).alias("live_second_scale"),
        F.when(rate, "SEMANTICS_DIFFER").when(confirmed, "CONFIRMED_UNIT_CONVERSION")
        .otherwise("LIKELY_UNIT_CONVERSION").alias("semantic_status"),
        F.when(confirmed, "seconds_to_microseconds").otherwise("none").alias("required_transformation"))


def rank_features(importances: DataFrame) -> DataFrame:
    """Features by falling importance, ties in dataset order. One row per feature goes in."""
    order = Window.partitionBy().orderBy(F.desc("importance"), "dataset_position")
    return importances.withColumn("rank", F.row_number().over(order))


def feature_sets_from_importance(importances: DataFrame, sizes: list[int]) -> DataFrame:
    """(feature_set, position, feature) of the top-n sets, and the features without importance."""
    ranked = rank_features(importances)
    sets = ranked.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(
        F.col("rank") <= F.col("n")).select(
        F.concat(F.lit("top"), F.col("n").cast("string")).alias("feature_set"),
        F.col("rank").alias("position"), "feature")
    zero = ranked.where(F.col("importance") <= 0).select(
        F.lit("zero_importance").alias("feature_set"), F.col("rank").alias("position"), "feature")
    return sets.unionAll(zero)


def importance_vs_shift(importances: DataFrame, shift: DataFrame, top: int = 15) -> DataFrame:
    """The most important features with their distance and its rank."""
    leading = rank_features(importances).where(F.col("rank") <= top).select(
        "feature", F.col("rank").alias("importance_rank"), "importance")
    return leading.join(shift_rank(shift), "feature").withColumn(
        "substantially_shifted", F.coalesce(F.col("ks_statistic") >= 0.5, F.lit(False)))


def before_after_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distances of every feature before and after a conversion."""
    kept = ["feature", "live_median", "ks_statistic", "pct_outside_p01_p99"]
    return before.select("feature", "base_median", F.col("ks_statistic").alias("ks_before"),
                         F.col("pct_outside_p01_p99").alias("outside_before")).join(
        after.select(kept).withColumnsRenamed({"ks_statistic": "ks_after", "pct_outside_p01_p99": "outside_after"}),
        "feature").withColumn("is_time_feature", feature_kind(F.col("feature")) == "time")


def nearest_calibration(thresholds: DataFrame, size: Column) -> DataFrame:
    """The calibrated window size closest to a sample size; the smaller one on a tie."""
    n = F.col("window_size")
    return thresholds.groupBy().agg(F.min_by("window_size", F.struct(F.abs(n - size), n)).alias("window_size"))


def nearest_limits(thresholds: DataFrame) -> DataFrame:
    """(feature, _limits): the calibrated window sizes of a feature with their p95, a few for each."""
    return thresholds.groupBy("feature").agg(F.collect_list(F.struct("window_size", "p95")).alias("_limits"))


def report_columns(validated: DataFrame, feature_set: list[str]) -> DataFrame:
    """What a drift report reads of validated rows, a few plain columns that a columnar table keeps small.

    `_marks` has a letter for each feature, the first of its outcome, a capital if the value is out of range; `_v<i>`
    are the values of accepted rows.
    """
    def mark(i):
        letter = F.substring(F.col("checks")[i]["outcome"], 1, 1)
        return F.when(F.array_contains("out_of_range_features", feature_set[i]), F.upper(letter)).otherwise(letter)

    return validated.select(F.concat(*[mark(i) for i in range(len(feature_set))]).alias("_marks"), *[
        F.when(F.col("valid"), F.coalesce(F.col("checks")[i]["value"], F.lit(0.0))).alias(f"_v{i}") for i in range(len(feature_set))])


def _kept_entries(validated: DataFrame, feature_set: list[str], outcomes: tuple[str, ...], keep) -> DataFrame:
    rows = keep(report_columns(validated, feature_set))
    outcome = F.create_map(*[F.lit(x) for o in outcomes for x in (o[0], o)])

    def entry(i):
        letter = F.substring("_marks", i + 1, 1)
        return F.struct(F.lit(feature_set[i]).alias("feature"), F.try_element_at(outcome, F.lower(letter)).alias("outcome"),
                        F.col(f"_v{i}").alias("_v"), (letter != F.lower(letter)).alias("outside"))

    return rows.select(F.inline(F.array(*[entry(i) for i in range(len(feature_set))])))


def drift_report(validated: DataFrame, reference: DataFrame, thresholds: DataFrame, feature_set: list[str] | None = None,
                 keep=None) -> DataFrame:
    """Per feature: how often it was missing, bad, repaired or out of range, and its drift.

    ``validated`` is the output of ``validate`` with a range check, ``thresholds`` has
    (window_size, feature, p95). The calibration nearest to the number of accepted rows
    decides. The rows are read twice. ``keep`` is given what the report reads of them, and returns it written, so
    that they are validated once; it takes the ``feature_set`` of the validation.
    """
    if keep:
        long = _kept_entries(validated, feature_set, ("raw", "missing", "invalid", "derived", "zero_filled"), keep)
    else:
        entry = F.transform("checks", lambda c: F.struct(
            c["feature"].alias("feature"), c["outcome"].alias("outcome"),
            F.when(F.col("valid"), F.coalesce(c["value"], F.lit(0.0))).alias("_v"),
            F.array_contains("out_of_range_features", c["feature"]).alias("outside")))
        long = validated.select(F.explode(entry).alias("e")).select("e.*")
    long = long.withColumn("_cell", value_cell(F.col("_v")))
    kinds, value = ("missing", "invalid", "derived", "zero_filled"), F.col("_v")

    # Two passes over the rows: sums of every cell, kept as they are read often, then the values of the few cells that matter.
    sums = long.groupBy("feature", F.when(value.isNotNull(), F.col("_cell")).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.avg(value).alias("_mean"), (F.var_pop(value) * F.count(value)).alias("_squares"),
        *[count_if(F.col("outcome") == o).alias(f"_{o}") for o in kinds], count_if(F.col("outside")).alias("_outside")).persist()
    observed, accepted = F.sum("_rows"), F.sum("_n")
    mean = ratio(F.sum(F.col("_mean") * F.col("_n")), accepted)
    totals = sums.groupBy("feature").agg(
        observed.alias("observed"), accepted.alias("accepted"),
        *[ratio_or_zero(F.sum(f"_{o}"), observed).alias(f"{o}_rate") for o in kinds],
        ratio_or_zero(F.sum("_outside"), observed).alias("out_of_range_rate"), mean.alias("mean"))
    off = F.col("_mean") - F.col("mean")
    spread = sums.where("_n > 0").join(F.broadcast(totals.select("feature", "mean")), "feature").groupBy("feature").agg(
        F.sum(F.col("_squares") + F.col("_n") * off * off).alias("_squares"))
    rates = totals.join(spread, "feature", "left").withColumn("std", F.when(
        F.col("accepted") > 1, F.sqrt(F.col("_squares") / (F.col("accepted") - 1))).otherwise(0.0)).drop("_squares")

    cells = sums.where("_n > 0").select("feature", "_cell", "_n", "_lo", "_hi")
    needed, bounded = rank_cells(cells, ["feature"], [0.25, 0.5, 0.75]), bounded_cells(cells, reference, ["feature"])
    wanted = needed.select("feature", "_cell").union(open_cells(bounded).select("feature", "_cell")).distinct()
    values = long.where(value.isNotNull()).join(F.broadcast(wanted), ["feature", "_cell"], "left_semi").groupBy(
        "feature", "_cell", "_v").agg(F.count(F.lit(1)).alias("_n")).persist()
    q = quantiles_in(values, F.broadcast(needed), ["feature"]).select("feature", *[
        F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(["p25", "p50", "p75"])])
    distances = ks_in(bounded, values, reference, ["feature"])
    ks = F.broadcast(reference.select("feature")).join(distances, "feature", "left").select(
        "feature", F.coalesce("ks_statistic", F.lit(0.0)).alias("ks_statistic"))
    limits = F.broadcast(nearest_limits(thresholds))
    table = rates.join(q, "feature", "left").join(ks, "feature", "left").join(limits, "feature", "left")
    nearest = F.array_min(F.transform("_limits", lambda t: F.struct(
        F.abs(t["window_size"] - F.col("accepted")).alias("d"), t["window_size"].alias("window_size"), t["p95"].alias("p95"))))
    return table.withColumns({"ks_threshold": nearest["p95"], "calibration_window": nearest["window_size"]}).drop(
        "_limits").withColumn("drifted", F.col("ks_statistic") > F.col("ks_threshold"))


def drift_status(report: DataFrame, totals: DataFrame, null_fraction: float) -> DataFrame:
    """Overall status of a report with the reasons.

    ``totals`` is one row with observed and rejected flows, ``null_fraction`` the share of
    drifted features that is still normal (p99 of the calibration).
    """
    facts = report.agg(
        count_if(F.col("missing_rate") > contract.MISSING_RATE_CRITICAL).alias("badly_missing"),
        count_if(F.coalesce("drifted", F.lit(False))).alias("drifted_features"),
        ratio_or_zero(count_if(F.coalesce("drifted", F.lit(False))), F.count(F.lit(1))).alias("drifted_fraction"))
    row = facts.join(totals).withColumn("invalid_rate", ratio_or_zero(F.col("rejected"), F.col("observed")))
    status, reasons = status_and_reasons(F.col("invalid_rate"), F.col("badly_missing"), F.col("drifted_fraction"), F.lit(null_fraction))
    return row.select(status.alias("status"), reasons.alias("reasons"), "observed", "rejected", "invalid_rate", "badly_missing",
                      "drifted_features", "drifted_fraction")


def status_and_reasons(bad: Column, badly_missing: Column, drifted: Column, null_fraction: Column) -> tuple[Column, Column]:
    """Status and reasons from the invalid rate, the number of badly missing features, the drifted share and its normal limit.

    Without a calibration (a null limit) the drifted share decides nothing.
    """
    calibrated = null_fraction.isNotNull()
    above = calibrated & (drifted > contract.DRIFTED_FRACTION_CRITICAL)
    critical = (bad > contract.INVALID_RATE_CRITICAL) | (badly_missing > 0) | above
    warning = (bad > contract.INVALID_RATE_WARNING) | (drifted > null_fraction)
    reasons = F.array_compact(F.array(
        F.when(bad > contract.INVALID_RATE_CRITICAL, "invalid rate critical")
        .when(bad > contract.INVALID_RATE_WARNING, "invalid rate raised"),
        F.when(badly_missing > 0, "features missing"),
        F.when(above, "drifted share above policy").when(drifted > null_fraction, "drifted share above calibration")))
    return (F.when(critical, "CRITICAL").when(warning, "WARNING").otherwise("NORMAL"),
            F.when(F.size(reasons) == 0, "within calibrated no-drift bounds").otherwise(F.array_join(reasons, "; ")))


def calibration_draws(df: DataFrame, row_id: str, windows: list[int], draws: int, seed: int) -> DataFrame:
    """(window_size, draw_no, row) samples without replacement for every window and draw.

    Each row is offered to so many draws that a draw is offered about twice its size, at
    least one; of the offered rows exactly the window is drawn. What is multiplied is
    bounded by draws x window, not by the table. One pass counts the offers in 4,096 ranges of the
    draw's key; past the range in which a draw is full, nothing of it goes on.
    """
    size = df.agg(F.count(F.lit(1)).alias("_rows"))
    window = F.col("window_size")
    shares = F.least(F.lit(draws), F.greatest(F.lit(1), F.ceil(F.lit(2 * draws) * window / F.col("_rows")))).cast("int")
    offered = df.join(F.broadcast(size)).withColumn(
        "window_size", F.explode(F.array(*[F.lit(w) for w in windows])))
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), window.cast("string"), F.col(row_id))), 1, 8),
                   16, 10).cast("long")
    offered = offered.withColumn("_offer", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn(
        "draw_no", ((first + F.col("_offer")) % draws).cast("int"))
    keyed = offered.withColumn("_key", F.concat_ws("|", F.col("draw_no").cast("string"), F.col(row_id)))
    targets = df.sparkSession.range(draws).select(
        F.col("id").cast("int").alias("draw_no"), F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_size")
    ).withColumn("k", F.col("window_size"))
    keys = ["window_size", "draw_no"]
    range_ = F.substring(draw_key(F.col("_key"), seed), 1, 3)
    counts = keyed.groupBy(*keys, range_.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(
        F.col("_before") < F.col("window_size")).groupBy(*keys).agg(F.max("_range").alias("_last"))
    offered = keyed.join(F.broadcast(last), keys).where(range_ <= F.col("_last")).drop("_last").persist()
    return draw(offered, keys, "_key", seed, targets, "k").where("drawn").drop("drawn", "_key", "_offer", "_rows")


def calibrate_thresholds(df: DataFrame, reference: DataFrame, features: list[str], row_id: str, seed: int,
                         windows: list[int] | None = None, draws: int = CALIBRATION_DRAWS) -> DataFrame:
    """Distances to expect without drift: p95 and p99 per window size and feature.

    ``fraction_p95`` and ``fraction_p99`` tell the same of the share of features over
    their own p95, ``mean_drifted_fraction`` is its mean, ``median_feature_p95`` the median of p95 over
    features. The final percentiles are over the draws, a few hundred values. The reference, the samples
    and their distances are bounded by features, draws and windows, and kept, as they are read again.
    """
    reference = reference.select("feature", "quantiles").persist()
    samples = calibration_draws(df, row_id, windows or CALIBRATION_WINDOWS, draws, seed).select(
        "window_size", "draw_no", *[F.col(f"`{f}`") for f in features]).persist()
    ks = ks_vs_reference(long_features(samples, features, ["window_size", "draw_no"]), reference,
                         ["window_size", "draw_no"]).persist()
    limits = ks.groupBy("window_size", "feature").agg(
        F.percentile("ks_statistic", F.lit(0.95)).alias("p95"), F.percentile("ks_statistic", F.lit(0.99)).alias("p99"))
    shares = ks.join(F.broadcast(limits), ["window_size", "feature"]).groupBy("window_size", "draw_no").agg(
        F.avg(F.when(F.col("ks_statistic") > F.col("p95"), 1.0).otherwise(0.0)).alias("share"))
    fractions = shares.groupBy("window_size").agg(
        F.percentile("share", F.lit(0.95)).alias("fraction_p95"), F.percentile("share", F.lit(0.99)).alias("fraction_p99"),
        F.avg("share").alias("mean_drifted_fraction"))
    medians = limits.groupBy("window_size").agg(F.median("p95").alias("median_feature_p95"))
    return limits.join(F.broadcast(fractions.join(medians, "window_size")), "window_size")
