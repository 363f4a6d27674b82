"""The text queries that SQL can express against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from geoloom.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = [tuple(row[i] for i in order) for row in found.fetchall()]
    assert sorted((tuple(row[c] for c in sorted(columns)) for row in df.collect()), key=str) == sorted(want, key=str)
