import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from oracle import agree, connect  # noqa: E402

from lociform.llm import queries as llm  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, con, name):
    agree(spark, con, llm.QUERIES[name], llm.ORACLES[name], D)


def test_found_columns(spark):
    want = {"p1_found": ["rec_id"], "p3_found": ["read_id", "cut_kind"], "p4_found": ["run_id", "field_tag"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "lang_code"]}
    for name, columns in want.items():
        got = llm.QUERIES[name](spark, D)
        assert got.columns == columns and got.distinct().count() == got.count()
