"""The registered queries on the smallest tables: against SQL where there is some, else their shape."""

import pytest

from netweir.llm.queries import ORACLES, QUERIES
from tools.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
SHAPES = {
    "op2_robust_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_line_blocks": {"page_id", "url", "text", "n_chars"}, "op6_repeated_substrings": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7_token_records": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op8_ordinal_quality": {"doc_id", "expected_grade", "tail_probability", "kept"},
    "op9_simhash_trie": {"doc_id", "fingerprint", "component_id"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem, _ = compare(QUERIES[name](spark, SF), ORACLES[name], connect(SF))
    assert problem is None


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_query_has_a_row_for_each_input(spark, name):
    got = QUERIES[name](spark, SF)
    table = "pages" if name.startswith("op4") else "documents"
    assert SHAPES[name] <= set(got.columns)
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
