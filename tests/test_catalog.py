"""Every catalog query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20


# the SQL of these names facts of the sf0.01 data
LARGER_ONLY = {"report_violations", "compare_classes", "compatibility_profile", "evidence_strata",
               "class_distribution"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LARGER_ONLY))
def test_query_equals_sql(spark, duck, name):
    problem, _ = compare(QUERIES[name](spark, SF), ORACLES[name], duck)
    assert problem is None
