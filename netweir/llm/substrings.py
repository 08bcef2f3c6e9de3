"""Repeated substrings: every byte covered by a string of `length` bytes that also starts elsewhere.

The suffixes of the corpus are merged shard by shard by refining their interleave: suffixes are first
alike if their first few bytes agree, and each round tells apart those of one class by more bytes, until a
class holds a single suffix, which leaves, or agrees over `length` bytes, which is a repeated interval. No
round sorts suffixes again: a shard looks up the next bytes of its own suffixes by a hash of their prefix,
and the shards meet in a count of class members.

Byte after byte this would take `length` rounds over every byte. Two exact short cuts make it few rounds
over few rows:

* Suffixes are sampled. Of each window of `length` bytes the least of its hashed words of `WORD` bytes is its
  anchor, which equal windows share at the same offset. Windows of one anchor are consecutive: a *run* of
  starts, and a corpus has about two runs per `length - WORD` bytes. Rounds go over runs.
* A round decides whole ranges of starts. All windows of a range lie in its hull (first start to last end)
  and hold its core (last start to first end). A hull found again makes all windows repeated; a core not found
  again makes none. Ranges in between are cut into blocks of `BLOCK` starts, then into single windows.

Rounds: (1) anchors by their word; (2) runs by their hull; (3) blocks of the classes that round 2 left
mixed, by core and hull; (4) the single windows of blocks that are still mixed. Hashes are 2 x 64-bit
polynomials in one 64-bit value.

Equal texts have equal answers, so a document is known by its text's key and a group of copies of any size is
one row in each count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import map_texts, mix64, raw, shared_folder, slices, staged, text_key

WORD, BLOCK = 32, 16
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = [int(x) | 1 for x in _SEED.integers(1 << 40, 1 << 62, 2)]
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.back = [], []
        for table, base, inverse in zip(_BYTE, _BASE, _INVERSE):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * _powers(base, n), dtype=np.uint64)]))
            self.back.append(_powers(inverse, n + 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[start]) * p[start] for s, p in zip(self.sums, self.back))
        return mix64(mix64(a) + b + (end - start).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of `width` values."""
    have, out = 1, values
    while 2 * have <= width:
        out = pick(out[:len(out) - have], out[have:])
        have *= 2
    return pick(out[:len(values) - width + 1], out[width - have:width - have + len(values) - width + 1])


def runs(data: np.ndarray, ends: np.ndarray, length: int):
    """(first, last, anchor, hash of the anchor's word): the runs of window starts with one anchor.

    data: texts end to end; ends: for each byte the end of its text. Windows that cross an end are none.
    """
    none = np.zeros(0, np.int64)
    width = length - WORD + 1
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    h = _BYTE[0][data]
    have = 1
    while have < WORD:
        h = mix64(h[:len(h) - have] * np.uint64(_BASE[0]) + h[have:])
        have *= 2
    low = _sliding(h, width, np.minimum)
    start = np.arange(len(low))
    valid = start + length <= ends[:len(low)]
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (h[:len(low) - 1] == low[:-1]) | ~valid[:-1]]) & valid
    first = np.flatnonzero(fresh)
    if not len(first):
        return none, none, none, none.view(np.uint64)
    stop = np.flatnonzero(np.concatenate([fresh[1:] | ~valid[1:], [True]]) & valid)
    last = stop
    # the anchor: the first word at or after the run's start whose hash is the least
    least = np.unique(low[first])
    spots = np.flatnonzero(np.isin(h, least)) if len(first) < 64 else np.flatnonzero(_chosen(h, low, width))
    at = np.searchsorted(spots, first)
    anchor = spots[at]
    wrong = h[anchor] != low[first]
    while wrong.any():
        at[wrong] += 1
        anchor = spots[at]
        wrong = h[anchor] != low[first]
    return first, last, anchor, low[first]


def _chosen(h: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Whether a word is the least of some window."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return _sliding(padded, width, np.maximum)[:len(h)] == h


def _joined(texts: list[bytes]):
    """(bytes end to end, text number of each byte's text start, ends per byte, starts per text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, begins, np.repeat(begins[1:], sizes)


def _run_rows(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, first, last, anchor, word, hull): the runs of every text; positions in bytes of the text."""
    def run(batches):
        for batch in slices(batches, 2, 1 << 20):
            texts = [t or b"" for t in raw(batch.column(2))]
            data, begins, ends = _joined(texts)
            first, last, anchor, word = runs(data, ends, length)
            hashes = Hashes(data)
            doc = np.searchsorted(begins, first, side="right") - 1
            hull = hashes.of(first, last + length)
            zero = begins[doc]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x - zero).astype(np.int32)) for x in (first, last, anchor)),
                 pa.array(word.view(np.int64)), pa.array(hull.view(np.int64))], ["k1", "k2", "first", "last", "anchor", "word", "hull"])

    return map_texts(docs, run, "k1 long, k2 long, first int, last int, anchor int, word long, hull long")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, text) of each distinct text, in buckets by key, so that later joins don't move texts again."""
    spark = docs.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, "texts")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    docs.repartition(n, "k1", "k2").dropDuplicates(["k1", "k2"]).write.bucketBy(n, "k1", "k2").option("path", path).saveAsTable(name)
    return spark.table(name)


def _lookup(texts: DataFrame, wanted: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows made from the texts that `wanted` (k1, k2, struct column w) names; rows_of(hashes, size, items)."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("w"))
    found = texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "w")

    def run(batches):
        for batch in slices(batches, 2, 1 << 20):
            for k1, k2, text, items in zip(batch.column(0), batch.column(1), raw(batch.column(2)), batch.column(3)):
                data = np.frombuffer(text or b"", np.uint8)
                fields = {f.name: items.values.field(f.name).to_numpy(zero_copy_only=False) for f in items.values.type}
                made = rows_of(Hashes(data), len(data), fields)
                n = len(next(iter(made.values())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1.as_py())), pa.array(np.full(n, k2.as_py())),
                                                  *map(pa.array, made.values())], ["k1", "k2", *made])

    return map_texts(found, run, schema)


def _block_rows(hashes: Hashes, size: int, f: dict, length: int) -> dict:
    """Blocks of BLOCK starts, aligned to the anchor, of some runs."""
    low, high = (f["anchor"] - f["last"]) // BLOCK, (f["anchor"] - f["first"]) // BLOCK
    n = high - low + 1
    at = np.repeat(np.arange(len(n)), n)
    block = low[at] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    anchor = f["anchor"][at].astype(np.int64)
    first, last = np.maximum(f["first"][at], anchor - (block + 1) * BLOCK + 1), np.minimum(f["last"][at], anchor - block * BLOCK)
    # core and hull of the whole block, whatever part of it the run has
    a, b = anchor - (block + 1) * BLOCK + 1, anchor - block * BLOCK
    own = mix64(f["word"][at].view(np.uint64) + block.astype(np.uint64))  # neighbours of another anchor are not alike
    core = hashes.of(b, a + length) ^ own
    whole = (a >= 0) & (b + length <= size)
    hull = np.where(whole, hashes.of(np.where(whole, a, 0), np.where(whole, b + length, 0)) ^ own, np.uint64(0))
    return {"first": first.astype(np.int32), "last": last.astype(np.int32), "core": core.view(np.int64),
            "hull": hull.view(np.int64), "whole": whole, "n": f["n"][at]}


def _window_rows(hashes: Hashes, size: int, f: dict, length: int) -> dict:
    """The single windows of some blocks."""
    n = f["last"] - f["first"] + 1
    at = np.repeat(np.arange(len(n)), n)
    start = f["first"][at].astype(np.int64) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return {"start": start.astype(np.int32), "window": hashes.of(start, start + length).view(np.int64), "n": f["n"][at]}


def repeated_intervals(docs: DataFrame, texts: DataFrame, length: int = 200) -> DataFrame:
    """(k1, k2, first, last): ranges of starts, in bytes, of windows found again, for each distinct text.

    docs: columns k1, k2 (the text's key) and text, a row per document; texts: a row per distinct text.
    Ranges may touch, and repeat one another's starts. What a round joins to its rows is written first, so that
    both sides of the join are plain shuffles and Spark splits a hash that very many rows share.
    """
    # round 1: anchors; a word found once belongs to no repeated window
    run_rows = staged(_run_rows(docs, length))
    again = staged(run_rows.groupBy("word").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("word"))
    run_rows = staged(run_rows.join(again, "word", "left_semi"))
    # round 2: whole runs
    place = F.struct("k1", "k2", "first", "last", "anchor")
    hulls = staged(run_rows.groupBy("word", "hull").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n"), F.min(place).alias("at")))
    whole = run_rows.join(hulls.where("n > 1").select("word", "hull"), ["word", "hull"], "left_semi").select("k1", "k2", "first", "last").distinct()
    # a word with one hull only has nothing left to tell apart
    mixed = staged(hulls.groupBy("word").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("word"))
    members = hulls.join(mixed, "word").select("at.*", "word", "n")
    members = members.select("k1", "k2", F.struct("first", "last", "anchor", "word", "n").alias("w"))
    # round 3: blocks
    shape = "k1 long, k2 long, first int, last int, core long, hull long, whole boolean, n int"
    blocks = staged(_lookup(texts, members, shape, lambda h, size, f: _block_rows(h, size, f, length)))
    cores = staged(blocks.groupBy("core").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 AND least = 1").select("core"))
    blocks = staged(blocks.join(cores, "core", "left_semi"))
    alike = staged(blocks.where("whole").groupBy("hull").agg(F.sum("n").alias("total")).where("total > 1").select("hull", F.lit(True).alias("again")))
    told = staged(blocks.join(alike, "hull", "left").withColumn("again", F.col("whole") & F.coalesce("again", F.lit(False))))
    block_hits = told.where("again AND n = 1").select("k1", "k2", "first", "last")
    # round 4: single windows of the cores that still have an undecided block
    open_cores = staged(told.where("NOT again AND n = 1").select("core").distinct())
    left = told.join(open_cores, "core", "left_semi").select("k1", "k2", F.struct("first", "last", "n").alias("w"))
    windows = staged(_lookup(texts, left, "k1 long, k2 long, start int, window long, n int",
                             lambda h, size, f: _window_rows(h, size, f, length)))
    twice = staged(windows.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window"))
    window_hits = windows.where("n = 1").join(twice, "window", "left_semi").select("k1", "k2", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(block_hits).unionByName(window_hits)


def remaining(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, the remaining bytes) of a text with repeated starts [first, last]."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, digest: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the remaining bytes; their SHA-256 as
    hexadecimal digits in kept_sha256 with `digest`).

    Strings are compared as UTF-8 bytes within documents. Null texts are empty, texts shorter than `length`
    lose nothing by themselves. Repeated rows repeat each other's strings. Null ids stay. Other columns are
    not read. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("__id"), *text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = distinct_texts(keyed.select("k1", "k2", "text"))
    found = repeated_intervals(keyed.select("k1", "k2", "text"), texts, length)
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = texts.join(lists, ["k1", "k2"], "left").select("k1", "k2", "text", "spans")
    last, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches):
        for batch in slices(batches, 2):
            out = []
            for body, spans in zip(raw(batch.column(2)), batch.column(3)):
                if spans.is_valid:
                    n, gone, runs_gone, body = len(body), *remaining(body, *(spans.values.field(c).to_numpy() for c in ("first", "last")), length)
                else:
                    n, gone, runs_gone = len(body), 0, 0
                out.append((n, gone, runs_gone, hashlib.sha256(body).hexdigest() if digest else body))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:3]),
                                              pa.array(columns[3], pa.string() if digest else pa.binary())],
                                             ["k1", "k2", "n_bytes", "n_removed", "n_spans", last])

    by_text = map_texts(rows, run, f"k1 long, k2 long, n_bytes long, n_removed long, n_spans long, {last} {kind}")
    return keyed.select("__id", "k1", "k2").join(by_text, ["k1", "k2"]).drop("k1", "k2").withColumnRenamed("__id", id_col)
