"""Every query with an oracle, against DuckDB on sf0.001."""

import math
from decimal import Decimal

import duckdb
import pytest

from corpusmill.plans import catalogue, catalogue_assess, catalogue_decisions, catalogue_findings, catalogue_lexical, catalogue_more, catalogue_passages, catalogue_records, catalogue_reports, catalogue_segments, catalogue_text  # noqa: F401  the others add to the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 5) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x
    return sorted([tuple(norm(r[i]) for i in order) for r in got], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
