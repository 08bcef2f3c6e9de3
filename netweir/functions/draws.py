"""Reproducible draws: rows are ordered by an md5 of seed and row id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(row_id: Column, seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string")))


def _first(*parts: Column) -> Column:
    return F.struct(*[p.alias(f"l{i}") for i, p in enumerate(parts)])


def cut_first(df: DataFrame, group: list[str], levels: list[Column], targets: DataFrame,
              target: str, flag: str, few_groups: bool = True, keep=None) -> DataFrame:
    """Mark, in each group, exactly the first ``target`` rows in the order of ``levels``.

    ``levels`` runs from coarse to fine and ends with a column that is unique in the
    group. At every level only counts per (group, level value) are shuffled, after
    map-side combining; the next level looks at the rows of one level value alone. No
    group is sorted as a whole, so a label holding most of the table is no hot task.
    ``targets`` holds one row per group. With ``few_groups`` (class labels and the like,
    a fixed list) it is broadcast and the table itself is never shuffled; for groups that
    grow with the data pass False. Rows of groups without a target are not marked, and no
    level is computed for them. ``keep`` is given the table of cuts, one row per group, and
    returns it written, so that what reads the result again does not look for the cuts again.
    """
    small = F.broadcast if few_groups else (lambda frame: frame)
    bound = targets.select(*group, F.col(target).cast("long").alias("_left"))
    running = Window.partitionBy(*group).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for depth, level in enumerate(levels):
        here = df.join(small(bound), group)
        here = here.where(reduce(
            lambda a, b: a & b,
            [value == F.col(f"_cut{i}") for i, value in enumerate(levels[:depth])],
            F.col("_left") > 0))
        carried = [f"_cut{i}" for i in range(depth)]
        counts = here.groupBy(*group, *carried, "_left", level.alias("_value")).agg(
            F.count(F.lit(1)).alias("_n"))
        stepped = counts.withColumn("_upto", F.sum("_n").over(running))
        # the last value reached that is still needed: rows before it are all inside
        inside = stepped.where(F.col("_upto") - F.col("_n") < F.col("_left"))
        bound = inside.groupBy(*group).agg(
            F.max_by(F.struct(*carried, F.col("_value").alias(f"_cut{depth}"),
                              (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left")),
                     "_value").alias("_b")).select(*group, "_b.*")
    bound = bound.drop("_left")
    if keep:
        bound = keep(bound)
    cuts = [f"_cut{i}" for i in range(len(levels))]
    marked = df.join(small(bound), group, "left")
    within = F.coalesce(_first(*levels) <= _first(*[F.col(c) for c in cuts]), F.lit(False))
    return marked.withColumn(flag, F.when(F.col("_cut0").isNull(), False).otherwise(within)).drop(*cuts)


def draw(df: DataFrame, group: list[str], row_id: str, seed: int | str,
         targets: DataFrame, target: str, flag: str = "drawn",
         few_groups: bool = True, keep=None) -> DataFrame:
    """Mark ``target`` rows of each group, drawn by md5 without replacement."""
    key = draw_key(F.col(row_id), seed)
    return cut_first(df, group, [F.substring(key, 1, 4), key], targets, target, flag,
                     few_groups, keep)
