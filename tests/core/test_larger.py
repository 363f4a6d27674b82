"""Queries whose results at the smallest scale say too little, against DuckDB on tables of ten times its rows."""

from pathlib import Path

import pytest

from geoloom.plans import registry

DATA = Path("/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", ["s47_shapefile", "m15_large_jobs", "w24_card"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    got = registry.QUERIES[name](spark, str(DATA)).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)


def test_card_of_a_million(spark, tmp_path):
    spark.range(1_000_000).selectExpr("id AS p_partkey", "'b' AS p_brand", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    lines = {r.line for r in registry.QUERIES["w24_card"](spark, str(tmp_path)).collect()}
    assert {"1000000 patches.", "- n>1M"} <= lines
