import pytest

from fathomline.plans import cleaning_queries, extract_queries, filter_queries, model_queries, more_queries, plane_queries, series_queries, space_queries, stream_queries
from tests.oracle import both

SF = "/root/testdata/sf0.001"
ALL = series_queries.Q | space_queries.Q | filter_queries.Q | stream_queries.Q | more_queries.Q | extract_queries.Q | model_queries.Q | plane_queries.Q | cleaning_queries.Q


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_agrees_with_sql(spark, name):
    query, sql = ALL[name]
    if sql is None:  # held against plain versions in other tests
        assert query(spark, SF).count() > 0
        return
    got, want = both(spark, SF, query, sql)
    assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
