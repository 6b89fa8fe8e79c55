import importlib


def test_contract():
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert {f"p{n}_found" for n in (1, 2, 3, 4)} <= set(queries)
