"""Every query with a DuckDB oracle must agree with it (rows, columns,
values) on the sf0.001 tables; the driver runs the same check at sf0.01."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import canon, duck, rows_key

from conftest import SF_SMALL

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def _sorted(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=rows_key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(canon(v) for v in r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = [tuple(canon(v) for v in r) for r in res.fetchall()]
    assert sorted(cols) == sorted(dcols)
    assert _sorted(srows, cols) == _sorted(drows, dcols)


def test_every_query_has_callable_and_most_have_oracles():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 70
    assert len(ORACLES) >= 55


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "reorder_point" in df.columns


def test_entry_module_loads_by_path_from_elsewhere(tmp_path, monkeypatch):
    """The driver may load __spark_entry__.py by file path from another
    directory; the module must put the package on sys.path itself."""
    import importlib.util
    import os
    import sys
    monkeypatch.chdir(tmp_path)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    monkeypatch.setattr(sys, "path", [p for p in sys.path if os.path.abspath(p or ".") != root])
    spec = importlib.util.spec_from_file_location("entry_by_path", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert root in sys.path
    assert set(mod.oracle_sql()) <= set(mod.queries())
