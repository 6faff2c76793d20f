"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib

import pytest

from tests.conftest import assert_same

MODULES = [importlib.import_module(f"strataframe.queries.{m}") for m in ("near", "calls", "rasters", "vectors", "shapes", "clouds", "features", "accessors")]
CASES = [(name, m.QUERIES[name], m.ORACLES.get(name)) for m in MODULES for name in m.QUERIES]


@pytest.mark.parametrize(("name", "run", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, data, name, run, sql):
    df = run(spark, data)
    assert sql is not None
    assert_same(df, duck.sql(sql))


def test_entry_lists_all_core_queries(spark):
    import __spark_entry__ as entry

    assert {c[0] for c in CASES} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["uuid_function", "root_uuid", "depth"]
