"""Queries with an oracle, against DuckDB on sf0.001."""

import duckdb
import pytest

from corpusmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(names).collect())
