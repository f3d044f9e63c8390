import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from threadwise.llm import queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, note
