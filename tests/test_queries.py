import pytest

import __spark_entry__ as entry
from feedlens import queries as feed
from oracle import same


@pytest.mark.parametrize("name", sorted(feed.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, feed.queries()[name], feed.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "count", "bytes"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
