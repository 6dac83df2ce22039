import pytest

from lumenframe.plans import registry

from .oracle import rows_of, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ours, theirs = rows_of(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
    assert same(ours, theirs), (len(ours), len(theirs), [x for x in zip(ours, theirs) if x[0] != x[1]][:2])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
