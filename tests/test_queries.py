"""Every query of the engine's own operators against its SQL, over the smallest tables."""

import pytest
from compare import differences, tables

from studyloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name not in registry.ORACLES:
        assert df.count() > 0
        return
    assert differences(df, tables(FOLDER), registry.ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
