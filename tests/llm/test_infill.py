"""Fill-in-middle: cuts, scatter and restoration against slicing of strings."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netweir.llm import infill

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    parts = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **how):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = infill.restore(infill.fill_in_middle(table.repartition(2), **how)).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    expected = sorted([(*by_hand(i, t, **how), t or "") for i, t in rows], key=key)
    assert sorted([tuple(r) for r in got], key=key) == expected


def test_against_string_slices(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    rows += [(i, "<" * (i % 4) + " a<P b>é 日本\U0001f600  x\x1cy\t\n" * (i % 5) + ">" * (i % 3)) for i in range(100, 220)]
    rows += [(i, t) for i in range(300, 330) for t in ("a <M> b", "<P>", "one", " ", "", None, "P> <S", "\n\nword\n")]
    check(spark, rows)
    check(spark, rows, rate=100, spm_rate=0, seed=7)


def test_a_very_long_text_and_ties(spark):
    long = "wörd \n" * 300_000
    check(spark, [(1, long), (1, long), (None, long[:100]), (None, long[:100])], rate=100)


def test_no_rows_and_columns(spark, nothing):
    out = infill.restore(infill.fill_in_middle(nothing))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def test_markers_that_do_not_fit_are_an_error(spark):
    bad = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="markers"):
        infill.restore(bad).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a<PSM> \né", max_size=12), st.integers(1, 2), st.integers(0, 12), st.integers(0, 12)), max_size=6))
def test_gather_undoes_scatter(texts):
    texts = [(t, f, a, b) for t, f, a, b in texts if not re.search("<[PSM]>", t)]
    raw = [t.encode() for t, *_ in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    form = np.array([f for _, f, *_ in texts], np.int64)
    cuts = np.array([sorted((min(a, len(t)), min(b, len(t)))) for t, (_, _, a, b) in zip(raw, texts)], np.int64).reshape(-1, 2)
    data = np.frombuffer(b"".join(raw), np.uint8)
    written, outs = infill.scatter(data, starts, form, cuts[:, 0], cuts[:, 1])
    back, where = infill.gather(written, outs, form)
    assert back.tobytes() == data.tobytes() and np.array_equal(where, starts)
