"""Every query that SQL can express gives the same rows as its SQL."""

import pytest

from sparsight import catalog

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, name):
    compare(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.count() > 0 and sorted(map(repr, df.collect())) == sorted(map(repr, catalog.queries()[name](spark, sf).collect()))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
