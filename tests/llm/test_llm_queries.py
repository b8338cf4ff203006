from __future__ import annotations

import pytest

from tests.compare import connection, differs
from tonearm.llm.queries import llm


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", list(llm.sql))
def test_equals_sql(spark, sf, con, name):
    assert differs(llm.queries[name](spark, sf), con, llm.sql[name]) == ""


@pytest.mark.parametrize("name", [n for n in llm.queries if n not in llm.sql])
def test_runs(spark, sf, name):
    df = llm.queries[name](spark, sf)
    assert df.schema == llm.queries[name](spark, sf).schema
    df.collect()


def test_columns_of_the_found_queries(spark, sf):
    want = {
        "p2_found": {"artist_no": "bigint", "track_no": "bigint"},
        "p4_found": {"track_no_a": "bigint", "track_no_b": "bigint"},
        "p5_found": {"artist_no_a": "bigint", "artist_no_b": "bigint"},
        "p6_found": {"caption_id": "bigint", "global_index": "bigint"},
        "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
        "p9_found": {"doc_id": "bigint"},
    }
    for name, columns in want.items():
        df = llm.queries[name](spark, sf)
        assert dict(df.dtypes) == columns
        assert df.count() == df.distinct().count()
