import pytest
from oracle import agree, connect

from lociform.plans import queries as core

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_matches_sql(spark, con, name):
    agree(spark, con, core.QUERIES[name], core.ORACLES[name], D)


def test_entry_has_queries_and_sql(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_candidates_have_98_fields(spark):
    lines = core.QUERIES["candidate_lines"](spark, D).collect()
    assert lines and all(len(r.line.split("\t")) == 98 for r in lines)
