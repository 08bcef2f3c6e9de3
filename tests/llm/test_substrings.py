import random
from collections import Counter

import numpy as np
import pytest

from netweir.llm import substrings as S
from tests.llm.conftest import awkward_rows


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    starts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[:len(t)]).sum()),
                    np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def shared_passages(seed):
    r = random.Random(seed)

    def noise(n):
        return "".join(r.choice("abcdefghij klmné\n") for _ in range(n))

    passages = [noise(n) for n in (199, 200, 201, 260, 420)] + ["ab" * 150, "z" * 230]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            cut = r.choice([0, 0, r.randint(0, 40)])
            parts += [noise(r.randint(0, 300)), p[cut:len(p) - r.choice([0, 0, r.randint(0, 40)])]]
        texts.append("".join(parts + [noise(r.randint(0, 80))]))
    return texts + [texts[3], texts[3], "", None, "x" * 199, "y" * 200, "y" * 201, passages[4] * 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = shared_passages(seed)
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, first string, word string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(frame).collect()}
    want = brute(texts, 200)
    assert [got[i] for i in range(len(texts))] == want


def test_awkward_rows(awkward, nothing):
    want = Counter((r[0], *w) for r, w in zip(awkward_rows(), brute([r[1] for r in awkward_rows()], 200)))
    assert Counter((r[0], r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(awkward).collect()) == want
    assert S.remove_repeats(nothing).count() == 0


def test_runs_cover_every_window_once():
    r = np.random.default_rng(2)
    data = r.integers(97, 101, 3000).astype(np.uint8)
    data[500:900] = 97
    ends = np.repeat([1000, 1100, 3000], [1000, 100, 1900])
    first, last, anchor, word = S.runs(data, ends, 200)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(covered.tolist()) == [i for i in range(2801) if i + 200 <= ends[i]]
    assert ((anchor >= first) & (anchor + S.WORD <= first + 200) & (anchor >= last)).all()
