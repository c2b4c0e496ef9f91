import sys

import pytest

from lorekeep.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from oracle import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], sf)


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert {"query_id", "id", "score", "rank"} == set(e.entry(spark).columns)
    assert set(QUERIES) <= set(e.queries())
