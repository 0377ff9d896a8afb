"""Every core query runs on the smallest tables, and equals its SQL where it has some."""

import pytest

from tallyfold.plans import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, tiny, name):
    compare(registry.QUERIES[name](spark, tiny), registry.ORACLE[name], tiny)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
