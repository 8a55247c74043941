import pytest

from tests.oracle import check
from tidewheel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, sf):
    check(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf)


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
