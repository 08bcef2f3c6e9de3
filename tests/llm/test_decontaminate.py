from collections import Counter

import numpy as np

from netweir.llm import decontaminate as D
from tests.llm.conftest import awkward_rows, prose


def shingles(text):
    w = (text or "").lower().split(" ") if text else []
    w = [x for x in (text or "").lower().split() if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_against_brute_force(spark, awkward):
    base = prose(1, 120).split()
    long = prose(2, 6000).split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(long[4000:4020])), (3, " ".join(base[50:70] + ["zz"] * 12)), (4, "one"), (5, ""), (6, None),
             (None, " ".join(base[0:20])), (7, "W1 " + " ".join(long[100:117]).upper()), (8, prose(77, 30)), (9, " ".join(base[90:120])), (1, " ".join(base[10:40]))]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = Counter()
    for doc in awkward_rows():
        for i, t in dict.fromkeys(items):
            own = shingles(t)
            if own and len(own & shingles(doc[1])) >= 0.8 * len(own):
                want[doc[0], i, len(own), len(own & shingles(doc[1]))] += 1
    got = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in D.leaking_documents(awkward, frame).collect())
    assert got == want and len(want) > 5
    clean = D.without_leaks(awkward, frame)
    assert clean.columns == awkward.columns
    assert clean.count() == sum(not any((d[0], i, len(shingles(t)), len(shingles(t) & shingles(d[1]))) in want for i, t in items) for d in awkward_rows())


def test_no_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.leaking_documents(nothing, items).count() == 0
    assert D.leaking_documents(awkward, items.limit(0)).count() == 0


def test_sketch_has_most_hashes_at_every_size():
    r = np.random.default_rng(1)
    for n in (1, 2, 40, 1000, 33_000):
        h = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        p, s = D.sketch(h)
        assert n <= 1 << p < 2 * n + 1 and np.isin(s, h).all() and len(s) >= 0.55 * n


def test_short_items_in_many_texts(spark):
    """Items of one to twelve shingles inside texts of all lengths: the sketch alone has each shingle by chance."""
    docs, items, want = [], [], set()
    for k in range(240):
        words = ["d%dw%d" % (k, j) for j in range(30 + 7 * (k % 60))]
        docs.append((k, " ".join(words)))
        items.append((k, " ".join(words[11:16 + k % 12])))
        want.add((k, k))
    found = D.leaking_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_bitmap_has_all_its_hashes(spark):
    h = np.unique(np.random.default_rng(2).integers(-1 << 63, 1 << 63, 5000))
    b = D.Bitmap(spark.createDataFrame([(int(x),) for x in h[::2]], "hash long"))
    has = b.of(h.view(np.uint64))
    assert has[::2].all() and has[1::2].mean() < 0.05
