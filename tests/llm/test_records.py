import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from netweir.llm import records as R
from netweir.llm.common import shared_folder
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_parts_have_the_ids_of_whole_texts():
    r = random.Random(3)
    bits = ["a", "Bc", " ", "\n", "'s", "!", "9", "é", "\t", "  ", "　", "<|endoftext|>", "\r\n", ".,", "日", "x\x1c", "\u0085"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["it's we'll. 45.6,\nFoo!? bar\nbaz. baz"]
    enc = R.Encoder(PATH, entries=50)
    for part in (texts[:200], texts[200:]):
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(part)] == [whole(t) for t in part]


def test_round_trip(spark, awkward):
    path, index = shared_folder(spark, "records"), shared_folder(spark, "index")
    R.write_records(awkward, path, PATH, records_per_file=4)
    rows = sorted(R.write_index(spark, path, index).collect(), key=lambda r: r.start)
    assert [r.id is not None and r.id for r in rows] == sorted((i or 0 for i, *_ in awkward_rows()), key=lambda i: i)[:0] + [
        i if i else False for i in sorted((r[0] or 0 for r in awkward_rows()))]
    want = sorted((r[0] or 0, whole(r[1]) + [0]) for r in awkward_rows())
    assert sorted((r.id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    read = R.shuffled_read(spark, path, spark.read.parquet(f"{index}/index"), 1).collect()
    assert sorted((r.id or 0, list(r.ids)) for r in read) == want and len({r.position for r in read}) == len(read)


def test_wrong_bytes_are_found():
    good = R.frame(5, np.array([1, 2, 0], "<u2").tobytes(), 2) + b"\n"
    doc, ids, size = R.parse_record(good, 0)
    assert (doc, ids.tolist(), size) == (5, [1, 2, 0], len(good))
    for at in (0, 9, 13, 25, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.parse_record(bytes(bad), 0)


def test_no_rows(spark, nothing):
    path, index = shared_folder(spark, "records"), shared_folder(spark, "index")
    R.write_records(nothing, path, PATH)
    assert R.write_index(spark, path, index).count() == 0


def test_files_are_cut_by_bytes_where_texts_are_long(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (2000 if i % 2 else 1)) for i in range(20)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "r")
    R.write_records(docs, path, PATH, bytes_per_file=100_000)
    index = R.write_index(spark, path, str(tmp_path / "i"))
    assert index.count() == 20 and index.select("file").distinct().count() > 5
    assert index.groupBy("file").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 100_000
