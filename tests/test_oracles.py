import pytest
from conftest import rows_of, rows_of_sql

from weftline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf, name):
    assert rows_of(registry.queries()[name](spark, sf)) == rows_of_sql(duck, registry.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
