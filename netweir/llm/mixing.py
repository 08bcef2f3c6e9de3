"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

The mix is a row of slots, one block of equal tokens each. Slot i has the point (i g mod 2^31) / 2^31 with
g / 2^31 near the golden ratio; the points fill the unit interval evenly in every prefix of the schedule.
Laid on the cumulative weights of the sources, a point names the slot's source, and the rank of the slot
among those of its source names a block: the source's documents in shuffled order, cut every `block`
words. After the last block the source starts over, at most `cap` times in all.

Running totals (words before a document in its source, earlier slots of a source) are taken in two levels,
inside cells and over the totals of cells, so that a source with a third of all rows is not one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweir.llm.common import checkpointed, n_words, one_row_each, staged, text_key

PERIOD, STEP = 1 << 31, 1327217885  # an odd integer next to 2^31 times the golden ratio's fraction
CHUNK = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes (skey, source_size) with `target`: words the source has in the mix.

    Sources in order of skey weigh as `weights`, repeating, and share all words; what exceeds `cap` times a
    source's size is shared again among the others. In the limit every source has the least of cap * size and
    weight * level, and the level follows from the sources sorted by cap * size / weight.
    """
    order = Window.orderBy("skey")
    place = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    s = s.withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double")).withColumn("ratio", F.col("most") / F.col("w"))
    rising = Window.orderBy("ratio", "skey")
    everything = Window.partitionBy()
    s = (s.withColumn("before", F.sum("most").over(rising) - F.col("most"))
         .withColumn("weight_from", F.sum("w").over(everything) - F.sum("w").over(rising) + F.col("w"))
         .withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("weight_from")))
    free = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "skey", "level"))
    s = s.withColumn("level", F.min(free).over(everything)["level"])
    return s.select("skey", "source_size", F.least("most", F.coalesce(F.col("w") * F.col("level"), "most")).alias("target"))


def shuffled(docs: DataFrame, cell_digits: int, seed: int) -> DataFrame:
    """docs (skey, size, id, tie) with `begin`, the words of the source before the document in shuffled order."""
    d = docs.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    d = d.withColumn("cell", F.substring("h", 1, cell_digits))
    cells = d.groupBy("skey", "cell").agg(F.sum("size").alias("words"))
    cells = cells.select("skey", "cell", (F.sum("words").over(Window.partitionBy("skey").orderBy("cell"))
                                          - F.col("words")).alias("cell_begin"))
    inside = Window.partitionBy("skey", "cell").orderBy("h", "id", "size", "tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inside))
    return d.join(cells, ["skey", "cell"]).withColumn("begin", F.col("cell_begin") + F.col("upto") - F.col("size")).drop(
        "h", "cell", "cell_begin", "upto", "tie")


def schedule(sources: DataFrame, block: int, cap: int) -> DataFrame:
    """Slots (slot, skey, rank, block, pass) for sources (skey, source_size, target)."""
    spark = sources.sparkSession
    s = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn(
        "need", F.col("target") * F.col("blocks") / F.col("source_size"))
    total, n_sources = s.agg(F.sum("need"), F.count(F.lit(1))).first()
    slots = round(total or 0)
    grid = min(1 << 31, max(1 << 12, 1 << math.ceil(math.log2(4 * max(1, n_sources)))))
    wide = PERIOD // grid
    order = Window.orderBy("skey")
    s = s.withColumn("hi", F.round(F.sum("need").over(order) / F.lit(total or 1) * PERIOD).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0))).where("hi > lo")
    s = s.withColumn("cell", F.explode(F.expr(f"sequence(lo div {wide}, (hi - 1) div {wide})")))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % PERIOD) * STEP % PERIOD).alias("x"))
    placed = points.withColumn("cell", F.expr(f"x div {wide}")).join(s, "cell").where("x >= lo and x < hi").select(
        "slot", "skey", "blocks", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = placed.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("skey", "chunk", (F.sum("n").over(Window.partitionBy("skey").orderBy("chunk"))
                                             - F.col("n")).alias("earlier"))
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1).join(
        counts, ["skey", "chunk"]).withColumn("rank", F.col("earlier") + F.col("r"))
    return ranked.select("slot", "skey", "rank", (F.col("rank") % F.col("blocks")).alias("block"),
                         F.expr("rank div blocks").alias("pass")).where(F.col("pass") < cap)


def source_key(source: str):
    """A source's text with a mark before it, so that null is a source of its own and comes last."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block: int = 128, seed: int = 17) -> DataFrame:
    """One row per document: id, k1, k2 (its text's key), skey, size, source_size, target, taken.

    size: words; taken: words the mix takes of the document, each repetition counted. Null and blank texts
    have size 0 and are never taken. A null source is a source of its own, last in order; a source without
    words has target 0. Repeated rows are separate documents. Equal ids are ordered by size and text. Other
    columns are not read. An empty table gives an empty result.
    """
    d = checkpointed(docs.select(F.col(id_col).alias("id"), source_key(source).alias("skey"), n_words(F.col(text)).alias("size"),
                                 *text_key(F.col(text))).withColumn("tie", F.struct("k1", "k2")))
    rows = d.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / 2048, 16)))
    sizes = d.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, cap))
    placed = shuffled(d.where("size > 0"), digits, seed)
    uses = schedule(targets, block, cap).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("uses"))
    parts = placed.withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("begin", F.col("block") * block)
    taken = parts.withColumn("words", words).join(uses, ["skey", "block"], "left").groupBy(
        "skey", "begin", "id", "k1", "k2", "size").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken")).drop("begin")
    empty = d.where("size = 0").select("skey", "id", "k1", "k2", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).join(targets, "skey").select(
        F.col("id").alias(id_col), "k1", "k2", "skey", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as rows: each document as often as taken / size, rounded to whole copies, says.

    Rows of one id, source and text are one document here, with the copies of all of them; a null id or
    source is one of its own. Blank texts are never taken. An empty table stays empty.
    """
    keys = ["__k1", "__k2", "__skey", "__none", "__id"]

    def key(k1, k2, skey, name):
        return [k1.alias("__k1"), k2.alias("__k2"), skey.alias("__skey"), name.isNull().alias("__none"), F.coalesce(name, F.lit(-1)).alias("__id")]

    shares = mix(docs, id_col, text, source, **how).groupBy(*key(F.col("k1"), F.col("k2"), F.col("skey"), F.col(id_col))).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int").alias("__copies"))
    keyed = docs.select("*", *key(*text_key(F.col(text)), source_key(source), F.col(id_col)))
    chosen = one_row_each(keyed, staged(shares.where("__copies > 0")), keys)
    return chosen.withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*docs.columns)
