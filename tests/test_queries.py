"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import pytest
from conftest import rows

from tesserae.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    found = registry.QUERIES[name](spark, data).toPandas()
    if name in registry.ORACLES:
        wanted = duck.execute(registry.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
