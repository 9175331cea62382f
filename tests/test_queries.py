"""Every query against its SQL, on the smallest tables."""

import pytest

from framewright import queries as Q
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_agrees_with_sql(spark, con, name):
    said = compare(spark, con, SF, Q.QUERIES[name], Q.SQL[name])
    assert said is None or (said == "no rows" and name in ("dropped_set_difference",)), said


def test_scores_of_all_suppliers(spark):
    rows = Q.score_suppliers(spark, SF).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 100 for r in rows)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
