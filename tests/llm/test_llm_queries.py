"""Every registered query of the subpackage runs over the smallest test data."""

import pytest

from tidemark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    rows = df.count()
    assert rows > 0 and len(set(df.columns)) == len(df.columns)


def test_columns_of_found():
    from tidemark.llm import queries

    assert {n for n in queries.QUERIES if n.endswith("_found")} == {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p9_found"}
