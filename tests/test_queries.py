"""Every registered query of the library against its SQL."""

import pytest
from compare import assert_same, connect
from conftest import SF

from strataflow.plans import registry

registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert_same(df, con, registry.ORACLE_SQL[name])
    else:
        assert df.columns
        df.collect()
