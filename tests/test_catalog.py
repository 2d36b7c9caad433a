"""Every query of the catalogue against its SQL."""

import pytest

from ctxspark.plans import catalog
from tests.oracle import connect, differences

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, con):
    df = catalog.queries()[name](spark, sf)
    if name not in SQL:
        assert df.count() > 0
        return
    rows, diff = differences(df, SQL[name], con)
    assert not diff, diff
    assert rows > 0


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) >= 85
