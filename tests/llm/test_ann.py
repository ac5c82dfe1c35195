"""Nearest neighbours: the index against all codes, and recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import ann


@pytest.mark.parametrize("radius", [0, 1, 5, 15, 16, 37, 52, 64, 100, 128, 200])
def test_pigeonhole(radius):
    """Bounds add up to more than the radius, and probing finds every code within it."""
    limit = ann.bounds(radius, 16)
    assert sum(b + 1 for b in limit) >= min(radius, 128) + 1 - (radius >= 128)
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 256, (600, 16), dtype=np.uint8)
    near = codes[:200] ^ np.packbits(rng.random((200, 128)) < radius / 140, axis=1)
    codes = np.concatenate([codes, near, codes[:5]])
    asked = codes[:40]
    index = ann.Index(codes)
    for code, found in zip(asked, index.within(asked, radius), strict=True):
        apart = np.bitwise_count(codes ^ code).sum(axis=1)
        assert found.tolist() == np.flatnonzero(apart <= radius).tolist()
    for bound in (-1, 0, 1, 2, 5, 8):
        assert np.flatnonzero(index.marked(3, 77, bound)).tolist() == sorted(index.buckets(3, 77, bound).tolist())
    assert sorted(index.buckets(3, 77, 2).tolist()) == np.flatnonzero(np.bitwise_count(codes[:, 3] ^ np.uint8(77)) <= 2).tolist()


def test_search_recall():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[700:900] = v[3]
    ids = np.arange(1500)
    codes = ann.fit(v[:1000], 1.0)
    hits = 0
    for q, found, scores in ann.search(codes, ids, v, ids[::20], v[::20], 20):
        s = ann.products(v, v[q])
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        hits += len(set(want.tolist()) & set(found.tolist()))
        assert (scores == s[found]).all()
    assert hits >= 0.9 * 75 * 20


def recall(table, got, every=20):
    rows = [r for r in table.collect() if r["embedding"] is not None]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = n = 0
    for q in np.flatnonzero(ids % every == 0):
        s = ann.products(x, x[q])
        s[ids == ids[q]] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.array_equal(own["score"].to_numpy(), s[np.searchsorted(ids, own["vec_id"])])
        order = list(zip((-own["score"]).tolist(), own["vec_id"].tolist(), strict=True))
        assert order == sorted(order)
        hits, n = hits + len(set(want.tolist()) & set(own["vec_id"])), n + 20
    return hits / n


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").coalesce(1)
    assert recall(table, ann.nearest(table).toPandas()) >= 0.93


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    v = [[float(x) for x in rng.normal(size=8)] for _ in range(300)]
    rows = [(i, v[i] if i % 50 else v[7]) for i in range(300)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (341, [None] + [1.0] * 7), (342, [1.0]), (343, []), (None, v[0]), (344, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' AS v", "1 AS d", "2 AS square", "3 AS rank", "4 AS score", "5 AS q", "6 AS b")
    got = ann.nearest(table, block=128).toPandas()
    assert set(got["query_id"]) == set(range(0, 300, 20))
    assert recall(spark.createDataFrame(rows[:300], "vec_id long, embedding array<float>"), got) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0
    assert len(ann.nearest(table.filter("vec_id < 5")).collect()) == 4
    # A repeated id asks once, and is never its own candidate; its rows are candidates of others.
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in ann.nearest(twice).collect())
    assert [(q, i) for q, _, i, _ in found] == [(0, 1), (0, 1), (0, 20), (20, 1), (20, 1), (20, 0), (20, 0)]
