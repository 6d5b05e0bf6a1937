"""Every operator with SQL against that SQL."""

import pytest

from compare import connect, differences
from folioline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def test_thirteen_operators():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
