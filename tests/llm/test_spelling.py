"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from netweir.llm import spelling
from netweir.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def lower(text):
    return text.encode().lower().decode()


def count_words(rows, least_length=7, least_count=2, drop=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def by_hand(counts, ratio=10):
    shape = {}
    for w in counts:  # candidates by what is left after a deletion, so that the whole table can be compared
        for i in range(-1, len(w)):
            shape.setdefault(w if i < 0 else w[:i] + w[i + 1:], set()).add(w)
    partners = {w: {v for i in range(-1, len(w)) for v in shape[w if i < 0 else w[:i] + w[i + 1:]] if v != w and near(w, v)} for w in counts}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(partners[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("alphabet, lengths", [("ab", (1, 7)), ("abcé", (2, 6)), ("aÿ", (3, 9))])
def test_random_words_against_all_pairs(spark, alphabet, lengths):
    r = random.Random(alphabet)
    counts = {"".join(r.choice(alphabet) for _ in range(r.randint(*lengths))): int(10 ** r.uniform(0, 4)) for _ in range(400)}
    pairs = sum(near(a, b) for a in counts for b in counts)
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    got = sorted(tuple(x) for x in got.collect())
    assert got == by_hand(counts) and sum(x[4] for x in got) == pairs


def test_runs_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        counts = {a + "bcdefg"[:5] + b: 3 for a in "abcdefgh" for b in "uvwxyz"}
        got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
        assert sorted(tuple(x) for x in got.collect()) == by_hand(counts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_spelling_variants"](spark, SF)
    assert sorted(tuple(x) for x in got.collect()) == by_hand(count_words(rows))


def test_awkward_rows_ties_and_long_texts(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    rows += [(9, "Strasse STRASSE strasse ÉTAGÈRE étagère × straßenbahn straßenbann " * 3)] * 2 + [(10, "lettering letterin lettering9lettering " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    for drop in (2, 31, None):
        got = spelling.spelling_groups(docs.repartition(3), drop=drop)
        assert sorted(tuple(x) for x in got.collect()) == by_hand(count_words(rows, drop=drop))


def test_no_documents(spark, nothing):
    out = spelling.spelling_groups(nothing)
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_words_with_the_end_mark_are_an_error(spark):
    with pytest.raises(Exception, match="end mark"):
        spelling.variants(spark.createDataFrame([("a$b", 1)], "word string, n long")).collect()
