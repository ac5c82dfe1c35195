"""Queries against DuckDB where SQL can say what they return."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from waymark.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_base_columns(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want.project(", ".join(columns)).fetchall(), key=key)
