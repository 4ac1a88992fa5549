import compare
import pytest

from lodestone.plans import registry


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(LARGER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare.differences(registry.QUERIES[name](spark, LARGER), con, registry.ORACLE_SQL[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_point():
    import __spark_entry__

    assert registry.FLAGSHIP in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
