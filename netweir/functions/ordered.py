"""Order-dependent results without sorting a whole group in one task.

Values are put into cells by a monotone, fixed rule. Counts per cell are small and
combine on the map side; whatever needs the exact order is settled inside the few
cells that matter, or cell by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OCTAVE_CELLS = 1 << 10
OCTAVES = 1080  # of a double below 1, subnormal numbers included


def value_cell(value: Column) -> Column:
    """Monotone cell number of a finite double: logarithmic in the magnitude, zero by itself.

    A cell spans under 0.07 % of its value however small that is, so that scores crowded near
    zero are told apart; a group has at most about 4.3 million cells however many rows it holds.
    """
    magnitude = F.log2(F.abs(value)) * OCTAVE_CELLS
    offset = OCTAVES * OCTAVE_CELLS
    return (F.when(value > 0, F.lit(offset) + F.floor(magnitude))
            .when(value < 0, -(F.lit(offset) + F.floor(magnitude)))
            .otherwise(F.lit(0))).cast("long")


def _before(groups: list[str]):
    return Window.partitionBy(*groups).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)


def running_totals(counts: DataFrame, groups: list[str], value: str | list[str], sums: list[str],
                   cell: Column | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<s>`` in value order inside each group.

    ``counts`` holds one row per (groups, value); with a list of columns to order by, the
    cell must be given and be monotone in them. The running sum is taken cell by cell
    and shifted by the total of the cells before it.
    """
    celled = counts.withColumn("_cell", value_cell(F.col(value)) if cell is None else cell)
    totals = celled.groupBy(*groups, "_cell").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(*groups, "_cell", *[
        F.coalesce(F.sum(f"_t_{s}").over(_before(groups)), F.lit(0)).alias(f"_b_{s}")
        for s in sums])
    order = [value] if isinstance(value, str) else value
    inside = Window.partitionBy(*groups, "_cell").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = celled.withColumns({f"_l_{s}": F.sum(s).over(inside) for s in sums})
    return local.join(totals, [*groups, "_cell"]).withColumns(
        {f"cum_{s}": F.col(f"_b_{s}") + F.col(f"_l_{s}") for s in sums}
    ).drop("_cell", *[f"_l_{s}" for s in sums], *[f"_b_{s}" for s in sums])


def exact_quantiles(rows: DataFrame, groups: list[str], value: str, grid: list[float],
                    cell: Column | None = None, broadcast_cells: bool = True,
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one row per group: ``n`` and ``quantiles``.

    The first pass counts rows per cell, which tells the cells holding the wanted ranks
    (at most two per grid point); the second orders the distinct values of those cells
    only. ``broadcast_cells`` is for groups from a fixed list, where the wanted cells are
    few; with groups that grow with the data pass False. ``weight`` names a column that
    says how many equal rows a row stands for.
    """
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value)
                        & (F.abs(F.col(value)) != float("inf")))
    celled = usable.select(
        *groups, F.col(value).cast("double").alias("_v"),
        (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"),
        (value_cell(F.col(value).cast("double")) if cell is None else cell).alias("_cell"))
    per_cell = celled.groupBy(*groups, "_cell").agg(F.sum("_w").alias("_n"))
    needed = rank_cells(per_cell, groups, grid)
    # only the cell goes along with each row; its ranks join the counts of distinct values
    small = F.broadcast if broadcast_cells else (lambda frame: frame)
    distinct = celled.join(small(needed.select(*groups, "_cell")), [*groups, "_cell"], "left_semi").groupBy(
        *groups, "_cell", "_v").agg(F.sum("_w").alias("_n"))
    return quantiles_in(distinct, small(needed), groups)


def rank_cells(per_cell: DataFrame, groups: list[str], grid: list[float]) -> DataFrame:
    """The cells that hold a rank of the grid, with these ranks, from the counts (groups, _cell, _n) of all cells."""
    per_cell = per_cell.withColumns({
        "_start": F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)),
        "_total": F.sum("_n").over(Window.partitionBy(*groups))})
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"))
                       for i, q in enumerate(grid)])

    def wanted(p):
        at = p["q"] * (F.col("_total") - 1)
        return F.struct(p["i"].alias("i"), at.alias("at"), F.floor(at).alias("lo"),
                        F.ceil(at).alias("hi"))

    def inside(rank, start, end):
        return (rank >= start) & (rank < end)

    cell_end = F.col("_start") + F.col("_n")
    last = len(grid) - 1
    if last > 10 and all(abs(q - i / last) < 1e-12 for i, q in enumerate(grid)):
        # evenly spaced points: only those around the ranks of the cell can fall into it
        step = F.lit(float(last)) / F.greatest(F.col("_total") - 1, F.lit(1))
        first = F.greatest(F.lit(0), F.floor((F.col("_start") - 1) * step)).cast("int")
        final = F.least(F.lit(last), F.ceil(cell_end * step)).cast("int")
        points = F.slice(points, first + 1, final - first + 1)
    ranks = F.filter(F.transform(points, wanted), lambda p: inside(p["lo"], F.col("_start"), cell_end)
                     | inside(p["hi"], F.col("_start"), cell_end))
    return per_cell.withColumn("_ranks", ranks).where(F.size("_ranks") > 0) \
        .select(*groups, "_cell", "_start", "_total", "_ranks")


def quantiles_in(values: DataFrame, needed: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, quantiles) from the counts (groups, _cell, _v, _n) of the distinct values of the needed cells."""
    def inside(rank, start, end):
        return (rank >= start) & (rank < end)

    distinct = values.join(needed, [*groups, "_cell"])
    order = Window.partitionBy(*groups, "_cell").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = distinct.withColumn("_end", F.col("_start") + F.sum("_n").over(order)) \
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    hits = placed.select(
        *groups, "_v", "_total", "_begin", "_end",
        F.explode(F.filter("_ranks", lambda p: inside(p["lo"], F.col("_begin"), F.col("_end"))
                           | inside(p["hi"], F.col("_begin"), F.col("_end")))).alias("p"))
    low = F.max(F.when(inside(F.col("p.lo"), F.col("_begin"), F.col("_end")), F.col("_v")))
    high = F.max(F.when(inside(F.col("p.hi"), F.col("_begin"), F.col("_end")), F.col("_v")))
    quantile = low + (high - low) * F.max(F.col("p.at") - F.col("p.lo"))
    per_point = hits.groupBy(*groups, F.col("p.i").alias("i")).agg(
        quantile.alias("v"), F.max("_total").alias("n"))
    return per_point.groupBy(*groups).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
        .alias("quantiles"))


def carried_lag(df: DataFrame, keys: list[str], chunk: Column, order: list[str],
                columns: list[str]) -> DataFrame:
    """``prev_<c>`` of the row before, per key, taken chunk by chunk.

    ``chunk`` must be monotone in ``order``. The first row of a chunk takes its value
    from the last row of the key's previous chunk, which comes from a per-chunk summary;
    a hot key is thus spread over its chunks.
    """
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    last = F.max_by(F.struct(*[F.col(c).alias(c) for c in columns]),
                    F.struct(*order)).alias("_last")
    summary = chunked.groupBy(*keys, "_chunk").agg(last)
    summary = summary.select(*keys, "_chunk", F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"))
    local = chunked.withColumns({
        "_first": F.row_number().over(inside) == 1,
        **{f"_local_{c}": F.lag(c).over(inside) for c in columns}})
    return local.join(summary, [*keys, "_chunk"]).withColumns({
        f"prev_{c}": F.when(F.col("_first"), F.col(f"_carried.{c}"))
        .otherwise(F.col(f"_local_{c}")) for c in columns
    }).drop("_chunk", "_first", "_carried", *[f"_local_{c}" for c in columns])
