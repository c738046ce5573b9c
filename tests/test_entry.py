import importlib
import sys

import pytest

import __spark_entry__ as entry
from tools.compare import connect, rows_of

CORE = {n: f for m in entry._CORE for n, f in importlib.import_module(m).QUERIES.items()}
SQL = {n: s for m in entry._CORE for n, s in importlib.import_module(m).ORACLE.items()}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, duck, name):
    df = CORE[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, found.fetchall())


def test_sql_only_for_queries():
    assert set(SQL) <= set(CORE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_llm_subpackage(monkeypatch):
    class Blocker:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("lookout.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [m for m in sys.modules if m.startswith("lookout.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Blocker(), *sys.meta_path])
    assert set(entry.queries()) == set(CORE)
