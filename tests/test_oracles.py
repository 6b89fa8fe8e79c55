"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import importlib
import os
from collections import Counter
from datetime import UTC

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"threadloom.{m}") for m in ("queries_pipeline", "queries_search", "queries_sessions", "queries_functions")]
CASES = [(m, n) for m in MODULES for n in m.ORACLE]


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(normal, v))
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.astimezone(UTC).replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_same_rows(spark, db, module, name):
    df = module.QUERIES[name](spark, SF)
    cursor = db.execute(module.ORACLE[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in MODULES for n in m.QUERIES if n not in m.ORACLE], ids=str)
def test_others_run(spark, module, name):
    assert module.QUERIES[name](spark, SF).count() > 0
