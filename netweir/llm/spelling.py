"""Spelling variants by permuterm rotations.

A word w gets an end mark, and every rotation of "w$" is a row. A rotation names a place in the word; what
stands before its last character is the rest of the word, read from behind that place. So words that differ
by one replaced character share a rotation but for its last character, and a word that lacks that character
has the shared prefix as a whole rotation of its own: replacements and indels are prefix ranges of the
sorted rotations that skip the edited character. Sorted by prefix, one scan meets each range as a run of
rows. A run holds one row per character of the alphabet and one more, so none can grow with the data, and
of each run a word takes a count and its best neighbour: no pairs are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import map_texts, raw, slices, staged

LETTERS = "A-Za-zÀ-ÿ"
END = "$"  # no letter
ENTRIES = 200_000  # of a task's counter before it is passed on


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 7, drop: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, and how often they occur.

    With `drop`, a run loses one character where the crc32 of "<id>:<run>" is a multiple of it: that of the
    remainder by the run's length. Words under least_length code points, after the loss, are left out. Null
    texts have no words, a null id counts as an empty one.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.col(text).alias("__text"))
    find = re.compile(f"[{LETTERS}]{{{max(least_length, 1)},}}").findall

    def found(batch, counts):
        for name, body in zip(raw(batch.column(0)), raw(batch.column(1))):
            if not body:
                continue
            runs = find(body.lower().decode())
            if drop is None:
                counts.update(runs)
                continue
            begin = zlib.crc32(name + b":")
            for run, n in Counter(runs).items():
                h = zlib.crc32(run.encode(), begin)
                if h % drop == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < least_length:
                        continue
                counts[run] += n

    def run(batches):
        counts = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for batch in slices(batches, 1):
            found(batch, counts)
            if len(counts) > ENTRIES:
                yield flush()
        yield flush()

    return map_texts(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n) for each rotation of each word: once without its last character, once whole.

    The first is a place where the word may be edited, the second (nothing skipped) one where it may lack a
    character. Rotation i of w is w[i:] + "$" + w[:i].
    """
    word, end = F.col("word"), F.length("word")
    whole = F.transform(F.sequence(F.lit(0), end), lambda i: F.struct(
        F.concat(word.substr(i + 1, end), F.lit(END), word.substr(F.lit(1), i)).alias("prefix"), F.lit("").alias("skipped")))
    cut = F.transform(F.sequence(F.lit(1), end), lambda i: F.struct(
        F.concat(word.substr(i + 1, end), F.lit(END), word.substr(F.lit(1), i - 1)).alias("prefix"), word.substr(i, F.lit(1)).alias("skipped")))
    return words.select("n", F.explode(F.concat(whole, cut)).alias("r")).select("r.prefix", "r.skipped", "n")


def scan_run(prefix: str, members: list[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
    """(word, near, n of the best, best) of the words of one run that have a neighbour in it.

    members: (skipped character, n). All that skip a character are a replacement apart from each other. The
    word that skips none lacks it; a character equal to the next one can be taken from either place, and
    counts at the last one only.
    """
    tail, head = prefix.split(END)
    rows = sorted((-n, head + c + tail, c) for c, n in members)
    lacking = any(not c for _, _, c in rows)
    twin = tail[:1]
    out = []
    for _, word, c in rows:
        if not c:
            others = [r for r in rows if r[2] and r[2] != twin]
            near, best = len(others), others[:1]
        else:
            near = len(rows) - 1 - (lacking and c == twin)
            best = next(([r] for r in rows if r[1] != word and (r[2] or c != twin)), [])
        if near:
            out.append((word, near, -best[0][0], best[0][1]))
    return out


def neighbour_summaries(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) for each run of rotations in which a word has neighbours.

    Each neighbour of a word comes up in one run only.
    """
    ordered = rotations(words).repartition("prefix").sortWithinPartitions("prefix")

    def found(rows, ends):
        """Scans the runs that end at the given rows; most hold one row and are passed over."""
        begins = np.concatenate([[0], ends[:-1]])
        several = ends - begins > 1
        begins, sizes = begins[several], (ends - begins)[several]
        if not len(sizes):
            return
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        prefix = rows.column(0).take(pa.array(begins)).to_pylist()
        members = list(zip(rows.column(1).take(pa.array(at)).to_pylist(), rows.column(2).take(pa.array(at)).to_pylist()))
        out, i = [], 0
        for key, size in zip(prefix, sizes.tolist()):
            out += scan_run(key, members[i:i + size])
            i += size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["word", "near", "best_n", "best"])

    def run(batches):
        held = None  # the rows of a run that may go on in the next batch
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            prefix = rows.column(0)
            ends = pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            if len(ends):
                yield from found(rows, ends)
            held = rows.slice(ends[-1] if len(ends) else 0)
        if held is not None:
            yield from found(held, np.array([held.num_rows]))

    return ordered.mapInArrow(run, "word string, near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last one, which has none. Paths double each round."""
    paths = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("__ahead"))
        longer = paths.join(ahead, "root", "left")
        if longer.where("__ahead IS NOT NULL").isEmpty():
            return paths
        paths = staged(longer.select("word", F.coalesce("__ahead", "root").alias("root")))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word; words: (word, n), each word once.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. The form of a
    word is its near word of largest n, the smallest in code-point order among equals, if that is at least
    `ratio` times the word's own n; the root is the end of the forms, or the word itself. Words with a null
    word or holding the end mark "$" are an error; no words give no rows. Of letters only those that are in
    the words matter, so a run of rotations has as many rows as the alphabet, plus one.
    """
    wrong = F.col("word").isNull() | F.contains("word", F.lit(END))
    words = staged(words.select(F.when(wrong, F.raise_error(F.lit("a word is null or holds the end mark"))).otherwise(
        F.col("word")).alias("word"), "n"))
    near = staged(neighbour_summaries(words).groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")))
    judged = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("form")))
    kept = F.col("best_n") >= ratio * F.col("n")
    judged = judged.select("word", "n", "n_near", F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n"))
    return judged.join(roots(judged.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2,
                    ratio: int = 10, drop: int | None = None) -> DataFrame:
    """variants() of the words of whole texts that have least_length code points and occur least_count times.

    Rows are one per word whatever the number, order or repetition of documents; null and empty texts add
    nothing, a very long one is counted piece by piece, and other columns are not read.
    """
    return variants(word_counts(docs, id_col, text, least_length, drop).where(F.col("n") >= least_count), ratio)
