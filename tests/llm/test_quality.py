import re

import numpy as np

from netweir.llm import quality_rules as Q
from netweir.llm.common import WordHashes
from tests.llm.conftest import awkward_rows, prose


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    again = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_counts_against_brute_force(awkward):
    texts = [r[1] for r in awkward_rows()] + ["a b c d e f g h " * 3, "x\nx\n \n\nx\ty | # é$", "q r s t u v w x q r s t u v w"]
    texts = [t for t in texts if not t or len(t) < 4000]
    for t in texts:
        assert Q.text_counts(t.encode() if t is not None else None, WordHashes())[:5] == brute_counts(t)


def test_outliers_go_and_the_rest_stays(spark):
    rows = [(i, prose(i, 60 + i % 80), "en", "s%d" % (i % 2)) for i in range(400)]
    rows += [(1000 + i, " ".join("W%d!! ##%d$$" % (j, j) for j in range(i, i + 90)), "en", "s0") for i in range(12)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n string")
    got = {r.doc_id: r["__verdict"] for r in Q.judge(docs).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[1000 + i].kept for i in range(12))
    assert all(not v.failed for v in got.values())


def test_estimate_is_robust(spark):
    """A fifth of far rows moves the mean of all rows but not the estimate."""
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 6))
    x[:100] += 25
    frame = spark.createDataFrame([("g", *map(float, v)) for v in x], "gid string, " + ", ".join(f"{v} double" for v in Q.VECTOR))
    fit = Q.mcd(frame).first()
    assert np.abs(np.array(fit.mean)).max() < 0.4
    white = np.array(fit.white).reshape(6, 6)
    d = (((x - np.array(fit.mean)) @ white.T) ** 2).sum(1) / fit.scale
    assert d[:100].min() > 100 and np.median(d[100:]) < 12


def test_small_groups_are_pooled(spark):
    rows = [("a", "x")] * 70 + [("a", "y")] * 10 + [("a", "z")] * 55 + [("b", "x")] * 30 + [("c", "x")] * 31
    frame = spark.createDataFrame(rows, "lang_key string, source_key string")
    got = {(r.lang_key, r.source_key): r.gid for r in Q.groups(frame, 60).collect()}
    assert got == {("a", "x"): "s|a|x", ("a", "y"): "l|a", ("a", "z"): "l|a", ("b", "x"): "all", ("c", "x"): "all"}


def test_awkward_rows(awkward, nothing):
    rows = Q.judge(awkward).collect()
    assert len(rows) == len(awkward_rows()) and Q.judge(nothing).count() == 0
    for r in rows:
        n, _, _, _, again = brute_counts(r.text) if len(r.text or "") < 9000 else (6000, 0, 0, 0, 0)
        assert r["__verdict"].failed == (n < 20 or 100 * again > 30 * n)
        assert r["__verdict"].kept == (not r["__verdict"].failed)  # too few rows for an estimate
