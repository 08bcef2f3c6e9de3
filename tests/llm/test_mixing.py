import duckdb
import pytest

from netweir.llm import mixing as M
from netweir.llm.queries import MIX_SQL
from tests.llm.conftest import awkward_rows, prose
from tools.check_oracles import compare


def test_awkward_rows_against_sql(awkward):
    rows = awkward_rows()
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    got = M.mix(awkward).select("doc_id", "size", "source_size", "target", "taken")
    problem, n = compare(got, MIX_SQL, connection)
    assert problem is None and n == len(rows)


def test_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, prose(i, 20 + i % 50), "s%d" % (i % 7 if i % 3 else 0)) for i in range(900)], "doc_id long, text string, source string")
    rows = M.mix(docs, block=16).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        s = by.setdefault(r.skey, [r.source_size, r.target, 0])
        s[2] += r.taken
    assert sum(s[0] for s in by.values()) == pytest.approx(sum(s[1] for s in by.values()))
    assert all(abs(taken - target) <= 4 * 16 and target <= 3 * size + 1e-9 for size, target, taken in by.values())
    again = M.mix(docs.repartition(5), block=16).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 1000), ("0d", 0)], "skey string, source_size long")
    got = {r.skey: r.target for r in M.source_targets(sizes).collect()}
    assert got == pytest.approx({"0a": 30, "0b": 1980 * 2 / 3, "0c": 1980 / 3, "0d": 0})


def test_rows_keep_columns_and_copies(awkward, nothing):
    got = M.mixed_rows(awkward)
    assert got.columns == awkward.columns and got.where("trim(text) = ''").count() == 0
    assert M.mixed_rows(nothing).count() == 0 and M.mix(nothing).count() == 0


def test_slots_are_evenly_spread(spark):
    s = spark.createDataFrame([("0a", 4096, 5120.0), ("0b", 4096, 3072.0)], "skey string, source_size long, target double")
    slots = M.schedule(s, 16, 3).orderBy("slot").collect()
    seen = 0
    for i, r in enumerate(slots):
        seen += r.skey == "0a"
        assert abs(seen - 0.625 * (i + 1)) < 3
    ranks = [r["rank"] for r in slots if r.skey == "0b"]
    assert ranks == list(range(len(ranks))) and abs(len(ranks) - 192) <= 2


def test_rows_of_two_sources_and_null_ids_are_documents_of_their_own(spark):
    text = "w " * 128
    rows = [(1, text, "a"), (1, text, "b"), (-1, text, "a"), (None, text, "a"), (2, text, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.source) for r in M.mixed_rows(docs).collect()}
    taken = {(r.doc_id, r.skey) for r in M.mix(docs).where("taken > 0").collect()}
    assert {(i, "1" if s is None else "0" + s) for i, s in got} == taken and {(1, "a"), (1, "b")} <= got
