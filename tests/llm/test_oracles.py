"""Every query on texts: those with SQL against DuckDB, the others run, over the smallest tables."""

import pytest

from tests.test_oracles import SF, db, rows_of  # noqa: F401
from threadloom.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_same_rows(spark, db, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    cursor = db.execute(queries.ORACLE[name])
    names = [x[0] for x in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_defined_relations(spark):
    """p7_found lists what takes more than one container; redaction changes exactly the rows found."""
    sizes = queries.packing.sizes(queries.table(spark, SF, "documents"))
    assert {r.doc_id for r in queries.p7_found(spark, SF).collect()} == {r.doc_id for r in sizes.where("tokens > 2048").collect()}
    redacted = queries.p5_redacted(spark, SF).where("types <> ''").select("src_table", "row_id").collect()
    assert set(redacted) == set(queries.p5_found(spark, SF).select("src_table", "row_id").collect())
