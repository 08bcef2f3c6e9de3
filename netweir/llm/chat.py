"""Dialogues from every participant's view; DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that participant as the assistant and all
others as named users:

    <|assistant|>\\ntext\\n<|end|>\\n          a turn of the participant
    <|user:name|>\\ntext\\n<|end|>\\n          a turn of anyone else

The mask covers what the participant has to produce: the text and the end mark of its own turns. A dialogue
is cut into pieces of `piece` turns, each with the characters before it, so that a conversation of any
length is never one task; nearly every dialogue has one piece. Turns are numbered in two levels (inside
cells of turn numbers, over cells), and a piece is the group that meets in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "\n<|end|>\n"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
                 piece: int = 64) -> DataFrame:
    """One row per conversation, participant and piece.

    Columns: the conversation, perspective (the participant), piece, first_turn, n_turns, n_own_turns, begin
    (characters of the dialogue before the piece), rendered, masks (spans start, end in characters of the
    dialogue, end exclusive), n_masked (their characters).

    Turns are ordered by turn number, nulls first, ties by a hash of speaker and text; repeated rows are
    turns of their own. A null text is an empty turn; a null speaker is a participant with a null name, shown as
    'unknown' to others. Null conversation ids form one conversation. Turns of a conversation without a
    second speaker give one perspective. Other columns are not read. An empty table gives no rows.
    """
    def key(column):
        return F.when(column.isNull(), "1").otherwise(F.concat(F.lit("0"), column.cast("string")))

    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(speaker).cast("string").alias("name"),
                     F.coalesce(F.col(text), F.lit("")).alias("body"))
    t = t.withColumns({"ck": key(F.col("conv")), "tk": key(F.col("turn")), "who": key(F.col("name")),
                       "cell": F.coalesce(F.floor(F.col("turn") / piece), F.lit(-(1 << 62))),
                       "salt": F.pmod(F.xxhash64("name", "body"), F.lit(64)).cast("int")})
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("ck", "cell", "tk", "salt").orderBy("who", "body")) - 1)
    # turns before: by the totals of cells, then of turn numbers and hashes inside a cell
    groups = t.groupBy("ck", "cell", "turn", "tk", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = groups.groupBy("ck", "cell").agg(F.sum("n").alias("m"))
    cells = cells.select("ck", "cell", (F.sum("m").over(Window.partitionBy("ck").orderBy("cell")) - F.col("m")).alias("cell_before"))
    inner = F.sum("n").over(Window.partitionBy("ck", "cell").orderBy("turn", "salt")) - F.col("n")
    groups = groups.withColumn("inner", inner).join(cells, ["ck", "cell"]).select(
        "ck", "cell", "tk", "salt", (F.col("cell_before") + F.col("inner")).alias("before"))
    t = t.join(groups, ["ck", "cell", "tk", "salt"]).select(
        "ck", "conv", "name", "who", "body", (F.col("before") + F.col("at")).alias("place"))
    t = t.withColumn("piece", F.floor(F.col("place") / piece))
    people = t.select("ck", F.col("name").alias("perspective"), F.col("who").alias("me")).distinct()
    seen = t.join(people, "ck")
    own = F.col("who") == F.col("me")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), F.coalesce("name", F.lit("unknown")), F.lit("|>\n")))
    seen = seen.select("ck", "conv", "perspective", "me", "piece", "place", own.alias("own"), head.alias("head"),
                       F.concat("body", F.lit(END)).alias("tail"))
    inside = Window.partitionBy("ck", "me", "piece").orderBy("place")
    length = F.length("head") + F.length("tail")
    seen = seen.withColumn("upto", F.sum(length).over(inside))
    pieces = seen.groupBy("ck", "me", "piece").agg(
        F.first("conv").alias("conv"), F.first("perspective").alias("perspective"), F.min("place").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"),
        F.count_if("own").alias("n_own_turns"), F.sum(length).alias("size"),
        F.array_sort(F.collect_list(F.struct("place", F.concat("head", "tail").alias("text")))).alias("texts"),
        F.array_sort(F.collect_list(F.when(F.col("own"), F.struct((F.col("upto") - F.length("tail")).alias("start"),
                                                                   F.col("upto").alias("end"))))).alias("spans"))
    begin = F.sum("size").over(Window.partitionBy("ck", "me").orderBy("piece")) - F.col("size")
    pieces = pieces.withColumn("begin", begin)
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("begin")).alias("start"), (s["end"] + F.col("begin")).alias("end")))
    return pieces.select(F.col("conv").alias(conv), "perspective", "piece", "first_turn", "n_turns", "n_own_turns", "begin",
                         F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("rendered"), shifted.alias("masks"),
                         F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_masked"))
