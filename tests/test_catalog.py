import pytest

import __spark_entry__ as entry
from quillspark import catalog
from oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
