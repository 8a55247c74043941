import pytest

from tests.oracle import check
from tidewheel.plans import catalogue, payloads, registry  # noqa: F401  # each registers its queries


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, sf):
    check(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
