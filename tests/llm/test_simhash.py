import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from netweir.llm import simhash as S
from tests.llm.conftest import awkward_rows, prose


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_awkward_rows_against_brute_force(awkward):
    rows = [(r[0], brute_fingerprint(r[1])) for r in awkward_rows()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
    root = roots(len(rows), links)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    expected = Counter((i, f, least[r]) for (i, f), r in zip(rows, root))
    got = Counter((r[0], r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(awkward).collect())
    assert got == expected


def test_no_rows(nothing):
    assert S.near_duplicates(nothing).count() == 0
    assert S.one_of_each_group(nothing).columns == nothing.columns


def test_long_text_in_chunks():
    text = prose(5, S.CHUNK + 50)
    words = text.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    assert S.simhash_text(text.encode()) == S.majority([h])


def crowd(n, seed):
    """Fingerprints in tight clusters and at random, some differing in the low bits only."""
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, 5, dtype=np.uint64)
    near = centres[r.integers(0, 5, n)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) * r.integers(0, 2, n).astype(np.uint64)
    return np.unique(np.concatenate([near, r.integers(0, 1 << 63, n, dtype=np.uint64), np.arange(60, dtype=np.uint64)]))


def test_walk_of_one_trie():
    fps = crowd(300, 1)
    a, b, d = (np.concatenate(x) for x in zip(*S.trie_pairs(fps, None, 2, leaf=4)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(near <= 2)) if i < j}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)
    left, right = fps[::2], fps[1::2]
    a, b, d = (np.concatenate(x) for x in zip(*S.trie_pairs(left, right, 2, leaf=4)))
    both = np.concatenate([left, right])
    want = {(i, j + len(left)) for i, j in zip(*np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= 2))}
    assert set(zip(a.tolist(), b.tolist())) == want and (np.bitwise_count(both[a] ^ both[b]) == d).all()


def test_split_nodes_give_the_same_components(spark):
    fps = crowd(250, 2)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = roots(len(fps), [(i, j) for i, j in zip(*np.nonzero(near <= 2)) if i < j])
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").select(F.lit(3).alias("space"), "fp")
    for limit in (4096, 6):
        links = S.trie_links(frame, 2, limit).collect()
        at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        assert all(r.space == 3 and near[at[r.a], at[r.b]] <= 2 for r in links)
        assert roots(len(fps), [(at[r.a], at[r.b]) for r in links]) == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in S.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_of_each_group_against_brute_force(spark, awkward):
    kept = awkward.columns
    got = S.one_of_each_group(awkward)
    assert got.columns == kept
    rows = awkward_rows()
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8])
    want = Counter(min((rows[i][0] is None, rows[i][0] or -1) for i in range(len(rows)) if root[i] == r) for r in set(root))
    assert Counter((r.doc_id is None, r.doc_id or -1) for r in got.collect()) == want


def test_recall_of_similar_texts(spark):
    import random
    r, docs = random.Random(9), []
    for base in range(60):
        words = prose(1000 + base, 200).split()
        docs.append((len(docs), " ".join(words)))
        for _ in range(2):
            edited = list(words)
            for _ in range(r.randint(0, 4)):
                edited[r.randrange(200)] = "edit%d" % r.randrange(10 ** 6)
            docs.append((len(docs), " ".join(edited)))
    root = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(max(0, i - 3), i) if jaccard(docs[i][1], docs[j][1]) >= 0.8])
    got = S.one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert len(set(root)) <= got <= len(set(root)) * 1.05


def new_words(r, n):
    return ["new%d" % r.randrange(10 ** 9) for _ in range(n)]


def test_appended_blocks_against_brute_force(spark):
    """Pairs that differ by a block of new words, down to the similarity itself."""
    import random
    r, docs = random.Random(4), []
    for size, tail in [(200, 48), (200, 35), (200, 20), (1000, 240), (22, 4), (40, 4), (40, 9), (22, 1), (60, 13), (5, 0), (4, 0)] * 6:
        body = new_words(r, size)
        docs += [body, body + new_words(r, tail), new_words(r, tail) + body, body[:size - 1] + new_words(r, 1)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i - i % 4, i) if jaccard(rows[i][1], rows[j][1]) >= 0.8])
    got = S.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} == {min(i for i in range(len(rows)) if root[i] == g) for g in set(root)}


def test_similar_texts_behind_unlike_representatives(spark):
    """Orders of one set of words have equal fingerprints; the two that are similar are seldom the least of them."""
    import random
    r, docs = random.Random(6), []
    for group in range(4):
        body = new_words(r, 120)
        for _ in range(30):
            docs.append(r.sample(body, len(body)))
        docs += [body, body[1:] + body[:1]]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    assert {x.doc_id for x in S.one_of_each_group(frame).collect()} == {i for i in range(len(docs)) if i % 32 != 31}


def test_pairs_of_joined_texts_are_not_confirmed_again(spark, monkeypatch):
    """A group of n texts with all its n * (n - 1) / 2 candidates confirms about one pair a text."""
    import random
    r, docs = random.Random(8), []
    for group in range(3):
        body = new_words(r, 60)
        docs += [(" ".join(body + ["end%d" % i]), group) for i in range(12)] + [(" ".join(new_words(r, 60)), -1 - group)]
    frame = spark.createDataFrame(docs, "text string, g int")
    keyed = frame.select(F.struct(*S.text_key(F.col("text"))).alias("node"), "g")
    ends = keyed.select(F.col("node").alias("a"), "g").where("g >= 0").join(keyed.select(F.col("node").alias("b"), F.col("g").alias("h")))
    pairs = S.staged(ends.where("a < b AND g IN (h, -1 - h)").select("a", "b"))
    left = []
    apart = S.still_apart
    monkeypatch.setattr(S, "still_apart", lambda *given: (left.append(apart(*given)), left[-1])[1])
    whole = S.confirmed(frame, pairs, "text", 5, 0.8, S.staged)
    links = S.confirmed(frame, pairs, "text", 5, 0.8, S.staged, spanning=True)
    assert whole.count() == 3 * 66 and 33 <= links.count() < 2 * 36
    assert sorted(S.components(links).collect()) == sorted(S.components(whole).collect())
    assert links.join(whole, ["a", "b"], "left_anti").isEmpty() and len(left) == 1
