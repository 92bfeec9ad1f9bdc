"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import importlib

import pytest
from helpers import same

MODULES = [f"rankweave.plans.{m}_queries" for m in ("overlap", "function", "maintenance", "report", "source", "timestamp", "nested")]
CASES = [(m, n) for m in MODULES for n in importlib.import_module(m).QUERIES]


@pytest.mark.parametrize(("module", "name"), CASES)
def test_query(spark, sf, duck, module, name):
    m = importlib.import_module(module)
    df = m.QUERIES[name](spark, sf)
    if name in m.SQL:
        same(df, duck, m.SQL[name])
    else:
        assert df.columns
        df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
