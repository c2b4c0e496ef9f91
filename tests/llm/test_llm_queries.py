import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare  # noqa: E402

from lorekeep.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], sf)


def test_one_query_for_each_operator():
    assert [k for n in range(1, 14) for k in QUERIES if k.startswith(f"op{n}_")] == [k for k in QUERIES if k != "pipeline"]
