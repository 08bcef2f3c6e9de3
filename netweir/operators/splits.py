"""Splits, draws and leakage checks. Draws order rows by md5 of seed and row id.

``keep``, where a split takes it, writes the few rows that describe its cut, see ``cut_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.draws import cut_first, draw, draw_key
from netweir.functions.numbers import count_if, ratio, ratio_or_zero

HOUR = 3600000000


def label_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _as_split(marked: DataFrame, flag: str, inside: str, outside: str) -> DataFrame:
    return marked.withColumn("split", F.when(F.col(flag), inside).otherwise(outside)).drop(flag)


def stratified_split(df: DataFrame, label: str, row_id: str, test_size: float, seed: int, keep=None) -> DataFrame:
    """Adds ``split``: the given share of each label is test."""
    targets = label_sizes(df, label).withColumn("k", F.bround(F.col("n") * test_size))
    return _as_split(draw(df, [label], row_id, seed, targets, "k", "_test", keep=keep), "_test", "test", "train")


def _time_levels(ts: str) -> list[Column]:
    us = F.unix_micros(ts)
    return [F.floor(us / F.lit(HOUR)), us]


def temporal_split(df: DataFrame, ts: str, test_size: float, keep=None) -> DataFrame:
    """Adds ``split``: the last share by time is test, and no instant is on both sides.

    The boundary is found from counts per hour, then per instant of one hour; rows are
    not sorted.
    """
    everything = df.withColumn("_all", F.lit(0))
    targets = everything.groupBy("_all").agg(F.bround(F.count(F.lit(1)) * (1.0 - test_size)).alias("k"))
    marked = cut_first(everything, ["_all"], _time_levels(ts), targets, "k", "_train", keep=keep)
    return _as_split(marked, "_train", "train", "test").drop("_all")


def temporal_split_per_class(df: DataFrame, label: str, ts: str, row_id: str, test_size: float = 0.2,
                             counts: DataFrame | None = None, keep=None) -> DataFrame:
    """Adds ``split``: the last rows of each label are test, by share or by given counts.

    ``counts`` has (label, wanted). Rows of one instant are ordered by their draw key, as
    a table has no file order.
    """
    sizes = label_sizes(df, label)
    if counts is None:
        sizes = sizes.withColumn("wanted", F.bround(F.col("n") * test_size))
    else:
        sizes = sizes.join(F.broadcast(counts), label, "left").withColumn(
            "wanted", F.coalesce("wanted", F.lit(0)))
    targets = sizes.withColumn("k", F.col("n") - F.least("wanted", F.col("n")))
    key = draw_key(F.col(row_id), "order")
    levels = [*_time_levels(ts), F.substring(key, 1, 5), key]
    return _as_split(cut_first(df, [label], levels, targets, "k", "_train", keep=keep), "_train", "train", "test")


def stratified_subset(df: DataFrame, label: str, row_id: str, rows: int, seed: int,
                      floor: int = 10) -> DataFrame:
    """A proportional sample of about ``rows`` rows with at least ``floor`` of each label."""
    kept = draw(df, [label], row_id, seed, subset_targets(df, label, rows, floor), "k")
    return kept.where("drawn").drop("drawn")


def subset_targets(df: DataFrame, label: str, rows: int, floor: int = 10) -> DataFrame:
    """(label, n, k, floored): sample size of each label and whether the floor raised it."""
    sizes = label_sizes(df, label)
    total = F.broadcast(sizes.agg(F.sum("n").alias("_total")))
    share = F.bround(F.col("n") * (F.lit(rows) / F.col("_total")))
    wanted = F.least(F.col("n"), F.greatest(F.lit(floor), share))
    return sizes.join(total).select(
        label, "n", F.when(F.lit(rows) >= F.col("_total"), F.col("n")).otherwise(wanted).cast("long").alias("k"),
        ((wanted > share) & (F.lit(rows) < F.col("_total"))).alias("floored"))


def remove_family(df: DataFrame, family: str, held_out: str) -> DataFrame:
    """Training rows without the held-out family."""
    return df.where(F.col(family).isNull() | (F.col(family) != held_out))


def family_leaks(df: DataFrame, family: str, held_out: str) -> DataFrame:
    """Number of held-out rows in a table that should have none."""
    return df.agg(count_if(F.col(family) == held_out).alias("leaked_rows"))


def nested_calibration_split(df: DataFrame, label: str, row_id: str, test_size: float, seed: int,
                             calibration: float = 0.2) -> DataFrame:
    """``part`` of every row: test, train_attack, fit or calibrate.

    The benign training rows are split once more into fitting and calibration rows.
    """
    split = stratified_split(df, label, row_id, test_size, seed)
    benign = (F.col("split") == "train") & (F.col(label) == contract.BENIGN)
    pooled = split.withColumn("_pool", F.when(benign, "benign").otherwise("other"))
    targets = pooled.groupBy("_pool").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "k", F.when(F.col("_pool") == "benign", F.bround(F.col("n") * calibration)).otherwise(0))
    marked = draw(pooled, ["_pool"], row_id, f"{seed}-calibration", targets, "k")
    return marked.withColumn(
        "part", F.when(F.col("split") == "test", "test").when(F.col("_pool") == "other", "train_attack")
        .when(F.col("drawn"), "calibrate").otherwise("fit")).drop("_pool", "drawn", "split")


def attack_ratio_sample(df: DataFrame, attack: Column, row_id: str, limit: int, attack_share: float,
                        seed: int) -> DataFrame:
    """``limit`` rows with the given share of attacks, in drawn order.

    Fewer attacks than wanted are made up for by benign rows. The limit is the sample.
    """
    kinds = df.withColumn("_kind", F.when(attack, "attack").otherwise("benign"))
    sizes = kinds.agg(count_if(F.col("_kind") == "attack").alias("a"), count_if(F.col("_kind") == "benign").alias("b"))
    wanted = F.least(F.lit(int(limit * attack_share)), F.col("a"))
    targets = sizes.select(F.explode(F.array(
        F.struct(F.lit("attack").alias("_kind"), wanted.cast("long").alias("k")),
        F.struct(F.lit("benign").alias("_kind"), F.least(F.lit(limit) - wanted, F.col("b")).cast("long").alias("k"))
    )).alias("t")).select("t.*")
    chosen = draw(kinds, ["_kind"], row_id, seed, targets, "k").where("drawn")
    return chosen.drop("drawn", "_kind").orderBy(draw_key(F.col(row_id), f"{seed}-shuffle"))


def evidence_strata(df: DataFrame, row_id: str, order: str, per_stratum: int, seed: int,
                    pool: int = 2000) -> DataFrame:
    """Rows to explain: false positives, and true positives among the first ``pool``.

    ``df`` has stratum 'false_positive' or 'true_positive', null for other rows.
    """
    found = df.where(F.col("stratum").isNotNull())
    key = F.col(order)
    sizes = found.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.withColumn("k", F.when(F.col("stratum") == "true_positive", F.least("n", F.lit(pool)))
                             .otherwise(F.col("n")))
    pooled = cut_first(found, ["stratum"], [F.substring(key, 1, 4), key], first, "k", "_pooled") \
        .where("_pooled").drop("_pooled")
    targets = sizes.select("stratum", F.lit(per_stratum).alias("k"))
    return draw(pooled, ["stratum"], row_id, seed, targets, "k").where("drawn").drop("drawn")


def overlap_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows that are in both tables; empty when they are disjoint.

    Both sides are reduced to distinct rows before they meet.
    """
    return a.select(*columns).distinct().join(b.select(*columns).distinct(), columns, "left_semi")


def split_leakage(rows: DataFrame, historical: DataFrame) -> DataFrame:
    """Runs that break the separation of roles, with what they break.

    Roles are adaptation, validation and final_test; a final run may be neither an
    adaptation nor a validation run nor one of the historical runs.
    """
    roles = rows.groupBy("run_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    past = historical.select("run_id").distinct().withColumn("_past", F.lit(True))
    known = F.array(F.lit("adaptation"), F.lit("validation"), F.lit("final_test"))

    def has(role):
        return F.array_contains("roles", role)

    checks = F.array_compact(F.array(
        F.when(has("adaptation") & has("final_test"), "adaptation and final_test"),
        F.when(has("validation") & has("final_test"), "validation and final_test"),
        F.when(F.size("roles") > 1, "several roles"),
        F.when(has("final_test") & F.col("_past").isNotNull(), "historical run in final_test"),
        F.when(F.size(F.array_except("roles", known)) > 0, "unknown role")))
    return roles.join(past, "run_id", "left").select("run_id", F.explode(checks).alias("violation"))


def duplicate_straddle(df: DataFrame, columns: list[str], split: str) -> DataFrame:
    """How many rows repeat another exactly, and how many copies lie on both sides of a split.

    Copies are combined on the map side, so a vector that makes up much of the table is
    no hot group.
    """
    groups = df.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col(split) == "train", 1).otherwise(0)).alias("in_train"),
        F.max(F.when(F.col(split) == "test", 1).otherwise(0)).alias("in_test"))
    straddles = (F.col("in_train") == 1) & (F.col("in_test") == 1)
    rows = F.sum("n")
    inside = F.coalesce(F.sum(F.when(straddles, F.col("n"))), F.lit(0))
    return groups.agg(
        rows.alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"),
        (1 - ratio(F.count(F.lit(1)), rows)).alias("duplicate_rate"),
        count_if(F.col("n") > 1).alias("duplicate_groups"), count_if(straddles).alias("straddling_groups"),
        inside.alias("rows_in_straddling_groups"), ratio_or_zero(inside, rows).alias("straddling_fraction"))


def dedupe_explanations(df: DataFrame) -> DataFrame:
    """The first explanation of each (alarm, model, prompt version)."""
    keys = ["alarm_id", "text_model", "prompt_version"]
    first = F.min_by(F.struct(*df.columns), "explanation_id").alias("r")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first).select("r.*")


def key_set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shared keys, union, Jaccard and keys of one side only."""
    left = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    shared = count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(
        F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), shared.alias("shared"),
        F.count(F.lit(1)).alias("union_size"), ratio(shared, F.count(F.lit(1))).alias("jaccard"),
        count_if(F.col("_b").isNull()).alias("only_in_a"), count_if(F.col("_a").isNull()).alias("only_in_b"))
