"""Benchmark items inside documents: size-partitioned MinHash containment search, confirmed exactly.

The containment of a short item in a long document says little about their Jaccard similarity, so a MinHash
signature of fixed length can't find it. The documents are therefore partitioned by size: a document whose
distinct shingles number up to 2^p belongs to partition p, and its sketch is a one-permutation MinHash of
2^p bins, the least shingle hash of each bin. A bin holds one shingle or less on average, in every
partition alike, so that a shared shingle is in the sketch with a probability of at least 0.63 whatever the
document's length; an item's own sketch at that many bins is the set of its hashes. An item with s shared
shingles is missed by the sketch with a probability of 0.37^s at most: none worth naming for the 52 or more
that a hit on an item of over 64 shingles has. Shorter items take an exact path: every shingle hash of a
document that is in a bitmap of their hashes goes to the join, not only those of the sketch. Candidates (a
hash among the item's hashes) are confirmed on the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import Bitmap, WordHashes, map_texts, raw, shingle_hashes, slices, staged, text_key


def shingles(text: bytes | None, n: int) -> set[bytes]:
    """Distinct runs of n words, A-Z lower-cased; a shorter text is one run."""
    words = text.lower().split() if text else []
    return {b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(partition, sketch) of the distinct shingle hashes of a document, sorted."""
    if not len(hashes):
        return 0, hashes
    p = (len(hashes) - 1).bit_length()
    bins = hashes >> np.uint64(64 - p) if p else np.zeros(len(hashes), np.uint64)
    return p, hashes[np.concatenate([[True], bins[1:] != bins[:-1]])]


SHARED = 52  # an item of which a hit shares fewer shingles takes the exact path


def sketches(docs: DataFrame, text: str = "text", words: int = 5, always=None) -> DataFrame:
    """(k1, k2, partition, sketch) of each document; the sketch has all its hashes in the broadcast bitmap `always`, too."""
    def full(hashes):
        p, s = sketch(hashes)
        return p, s if always is None else np.union1d(s, hashes[always.value.of(hashes)])

    rows = docs.select(*text_key(F.col(text)), F.col(text).cast("string").alias("body"))

    def run(batches):
        memo = WordHashes()
        for batch in slices(batches, 2):
            found = [full(np.unique(shingle_hashes(memo.of(t.lower().split()), words))) if t else (0, np.zeros(0, np.uint64))
                     for t in raw(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.int32()),
                 pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["k1", "k2", "partition", "sketch"])

    return map_texts(rows, run, "k1 long, k2 long, partition int, sketch array<long>")


def item_hashes(items: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(item, hash) for each distinct shingle of each item."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text).alias("body"))
    schema = rows.select("item", F.lit(0).cast("long").alias("hash")).schema

    def run(batches):
        memo = WordHashes()
        for batch in slices(batches, 1):
            found = [np.unique(shingle_hashes(memo.of((t or b"").lower().split()), words)) for t in raw(batch.column(1))]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)),
                                              pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())],
                                             ["item", "hash"])

    return map_texts(rows, run, schema)


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(k1, k2, item_id, n_item, n_shared, containment) of texts that hold at least `threshold` of an item.

    k1, k2 are the text's key, see common.text_key; copies of a text have one row. Containment is the share
    of the item's distinct shingles that the text has. An item of fewer words than a shingle is found only in
    texts equal to it, an empty item nowhere; null texts are empty. Items with a null id take part as item
    null. Repeated items with one id and text count once. Other columns are not read. Without documents or
    items the result is empty.
    """
    its = items.select(F.col(item_id).alias("__item"), F.col(item_text).alias("__text")).where("__text IS NOT NULL").distinct()
    its = its.withColumn("__no", F.xxhash64("__item", "__text"))
    hashes = staged(item_hashes(its, "__no", "__text", words))
    short = staged(hashes.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(threshold * F.col("n") < SHARED).select("item"))
    always = docs.sparkSession.sparkContext.broadcast(Bitmap(hashes.join(short, "item").select("hash")))
    found = sketches(docs, text, words, always).select("k1", "k2", F.explode("sketch").alias("hash")).join(hashes, "hash")
    pairs = staged(found.select("k1", "k2", "item").distinct())
    texts = docs.select(*text_key(F.col(text)), F.col(text).alias("body"))
    wanted = pairs.select("k1", "k2").distinct()
    texts = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    both = texts.join(pairs, ["k1", "k2"]).join(its, F.col("item") == F.col("__no")).select("k1", "k2", "__item", "body", "__text")
    schema = both.select("k1", "k2", "__item", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).schema

    def run(batches):
        for batch in slices(batches, 3):
            n_item, n_shared = [], []
            for body, item in zip(raw(batch.column(3)), raw(batch.column(4))):
                own = shingles(item, words)
                n_item.append(len(own))
                n_shared.append(len(own & shingles(body, words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_item, pa.int64()), pa.array(n_shared, pa.int64())],
                                             ["k1", "k2", "__item", "n_item", "n_shared"])

    exact = map_texts(both, run, schema).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return exact.where(F.col("containment") >= threshold).withColumnRenamed("__item", item_id)


def leaking_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each document and each item that it holds: id, item_id, n_item, n_shared, containment.

    Repeated documents have a row each.
    """
    ids = docs.select(F.col(id_col).alias("__doc"), *text_key(F.col(text)))
    found = leaks(docs, items, text, **how)
    return ids.join(found, ["k1", "k2"]).drop("k1", "k2").withColumnRenamed("__doc", id_col)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs, all columns, without the rows whose text holds an item."""
    k1, k2 = text_key(F.col(text))
    bad = staged(leaks(docs, items, text, **how).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct())
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
    return keyed.join(bad, ["__k1", "__k2"], "left_anti").select(*docs.columns)
