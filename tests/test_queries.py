"""Each query against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from waymark.plans import queries

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ("clean_accuracy", "clean_jumps", "clean_driving", "two_pass_clusters", "join_candidates", "cluster_summary", "place_bbox", "bbox_union", "candidate_ranks", "unmatched_clusters", "visits")


def test_every_query_has_sql():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"gbdt_train_nodes"}


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("events", "supplier", "nation", "region"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, str(DATA)).collect()]
    assert sorted(got) == sorted(want.project(", ".join(columns)).fetchall())
