"""Facts of each stage on hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.errors import InvalidInput
from waymark.functions import geo, vector
from waymark.operators import clean, cluster, features, join, rank, spatial
from waymark.gbdt import FeatureSchema, GbdtModel
from waymark.plans.attribute import VisitAttributor

from .helpers import PINGS, PLACES, pings, places, ring, seqs, square

ZERO = GbdtModel(FeatureSchema(()), 0.0, 0.1, ())
BOX = [(0, 0), (0, 0.001), (0.001, 0.001), (0.001, 0), (0, 0)]


def test_config():
    assert Config.builder().join_radius_m(0.0).build().join_radius_m == 0
    for bad in ({"max_dist_threshold_m": 10.0}, {"max_time_gap_s": 0.0}, {"join_radius_m": -1.0}, {"max_speed_m_s": math.nan}, {"min_cluster_pings": 0}):
        with pytest.raises(InvalidInput):
            Config(**bad)
    with pytest.raises(InvalidInput):
        VisitAttributor.builder().build()


def test_scalars(spark):
    hours = [(0.0, 0), (3600.0, 1), (86399.0, 23), (86400.0, 0), (3600.5, 1), (-1.0, 23), (math.nan, 0), (math.inf, 0), (-math.inf, 0)]
    got = spark.createDataFrame(hours, "t double, want int").select(geo.hour_of_day(F.col("t")).alias("h"), "want").collect()
    assert all(r["h"] == r["want"] for r in got)
    codes = [(445110, 4451), (44511, 4451), (4451, 4451), (None, None), (7, 7)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(codes, "c long, want long").select(geo.naics4(F.col("c")), "want").collect())
    assert spark.range(1).select(geo.haversine_m(*map(F.lit, (51.5, -0.12, 51.5, -0.12)))).first()[0] < 1e-6
    geo.register(spark)
    assert spark.sql("SELECT round(haversine_m(0D, 0D, 0D, 1D)), hour_of_day(-1D), naics4(445110)").first()[:] == (111195.0, 23, 4451)


def test_rings(spark):
    inside = [((0.0005, 0.0005), True), ((0.002, 0.002), False), ((0, 0.0005), True), ((0.0005, 0.001), True), ((0.001, 0.001), True)]
    edges = geo.edges(geo.ensure_closed(F.col("ring")))
    for (lat, lon), want in inside:
        assert ring(spark, BOX).select(geo.point_in_ring(F.lit(float(lat)), F.lit(float(lon)), edges)).first()[0] is want
    for points in ([], [(0, 0), (0, 1)]):
        row = ring(spark, points).select(geo.point_in_ring(F.lit(0.0), F.lit(0.0), edges), geo.ring_area_m2(geo.ensure_closed(F.col("ring")), edges), geo.distance_to_ring_m(F.lit(1.0), F.lit(0.5), edges)).first()
        assert row[0] is False and row[1] == 0.0 and (row[2] == math.inf) == (not points)


def test_vector_forms_agree(spark):
    notch = [(0, 0), (0, 0.002), (0.001, 0.002), (0.001, 0.001), (0.002, 0.001), (0.002, 0)]
    df = places(spark, (1, 1, [tuple(map(float, p)) for p in notch], (0.0, 0.0), None)).crossJoin(spark.range(60).select(((F.col("id") % 8) * 0.0004 - 0.0003).alias("lat"), ((F.col("id") / 8).cast("int") * 0.0004 - 0.0003).alias("lon")))
    edges = geo.edges(geo.ensure_closed(F.col("polygon")))
    got = df.select(geo.point_in_ring(F.col("lat"), F.col("lon"), edges).alias("a"), geo.distance_to_ring_m(F.col("lat"), F.col("lon"), edges).alias("c"), geo.ring_area_m2(geo.ensure_closed(F.col("polygon")), edges).alias("e"), vector.inside(F.col("lat"), F.col("lon"), F.col("flat")).alias("b"), vector.distance_m(F.col("lat"), F.col("lon"), F.col("flat")).alias("d"), "area_m2").collect()
    assert {r["a"] for r in got} == {True, False}
    assert all(r["a"] == r["b"] and abs(r["c"] - r["d"]) < 1e-6 and abs(r["e"] - r["area_m2"]) < 1e-3 for r in got)


@pytest.mark.parametrize(("rows", "kept"), [
    ([(0, 0, 0), (1, 0, 1), (1.0001, 0, 2)], [0]),
    ([(0, 0, 0), (0.00001, 0, 10), (0, 0.00001, 20)], [0, 1, 2]),
    ([(0, 0, 0), (0, 0, 0), (0, 0, 10), (0, 0, 10), (0, 0, 20)], [0, 2, 4]),
    ([(0, 0, 0, 10), (0, 0, 1, 5000)], [0]),
    ([(0, 0, 0), (math.nan, 0, 1), (0, math.inf, 2), (0, 0, math.nan), (0, 0, 4), (0, 0, 5, -math.inf)], [0, 4]),
])
def test_cleaning(spark, rows, kept):
    c = Config()
    assert seqs(clean.filter_jumps(clean.filter_accuracy(pings(spark, rows), c), c)) == kept


def test_driving(spark):
    drive = seqs(clean.filter_driving(pings(spark, [(0.0003 * i, 0, 3 * i) for i in range(5)]), Config()))
    assert drive[0] == 0 and len(drive) < 4
    stay = seqs(clean.filter_driving(pings(spark, [(0, 0, 0), (0, 0.00001, 10), (0, 0, 20), (0.01, 0, 30), (0.02, 0, 40), (0.03, 0, 50)]), Config()))
    assert {0, 1, 2} <= set(stay) and len(stay) < 6
    assert seqs(clean.filter_driving(pings(spark, [(0, 0, 0), (1, 0, 1)]), Config())) == [0, 1]


def runs(spark, rows, *catalog):
    made = cluster.assign_runs(pings(spark, rows), places(spark, *catalog) if catalog else vector.with_geometry(spark.createDataFrame([], PLACES)), Config(large_poi_area_m2=100.0))
    return [(r["pass"], r["cluster_seq"], r["used"]) for r in made.orderBy("position").collect()]


def test_large_places(spark):
    mall, plaza = square(1, -0.002, -0.002, 0.004), square(2, -0.0005, -0.0005, 0.001)
    rows = [(0, 0, 0), (0.0001, 0, 10), (0.001, 0, 20), (0.0011, 0, 30)]
    for order in ((mall, plaza), (plaza, mall)):
        assert runs(spark, rows, *order) == [(0, 0, True), (0, 0, True), (0, 1, True), (0, 1, True)]
    assert runs(spark, [(0, 0, 0)], mall) == [(None, None, False)]
    assert runs(spark, [(0.5, 0, 0), (0.5, 0, 10), (0, 0, 1000), (0, 0, 1010), (0.5, 0, 2000), (0.5, 0, 2010)], mall) == [(1, 1, False)] * 2 + [(0, 0, True)] * 2 + [(1, 2, False)] * 2


def test_density(spark):
    assert [s for _, s, _ in runs(spark, [(0, 0, 0), (0, 0, 10), (0, 0, 10000), (0, 0, 10010)])] == [0, 0, 1, 1]
    assert [s for _, s, _ in runs(spark, [(0, 0, 0), (0.0001, 0, 10), (0.002, 0, 20), (0.0021, 0, 30)])] == [0, 0, 1, 1]
    assert [s for _, s, _ in runs(spark, [(0, 0, 0), (0.0008, 0, 10), (0.0016, 0, 20)])] == [None] * 3


def found(spark, rows, catalog, order="catalog", **settings):
    c = Config(**settings)
    clusters = spark.createDataFrame([(1, 0)], "device_id long, cluster_seq int").join(pings(spark, rows), "device_id")
    members = clusters.withColumn("pass", F.lit(0))
    got = join.candidates(cluster.summarise(members), places(spark, *catalog), c, order)
    return [r["place_id"] for r in got.orderBy("cand_idx").collect()]


def test_candidates(spark):
    box = square(7, 0, 0, 0.001)
    assert found(spark, [(0.0005, 0.0005, 0)], [box]) == [7]
    assert found(spark, [(0.0005, 0.002, 0)], [box], join_radius_m=20.0) == []
    assert found(spark, [(0.0005, 0.002, 0, 200)], [box], join_radius_m=20.0) == [7]
    assert found(spark, [(0, 0, 0)], [(1, 1, [], (0.0, 0.0), None)]) == []
    many = [square(i, 0.5 + 0.01 * i, 0.5, 0.001) for i in range(2, 90)]
    for order in ("catalog", "quadtree"):
        assert found(spark, [(0.0005, 0.0005, 0)], [square(1, 0, 0, 0.001), *many], order) == [1]
    dense = [square(i, 0.001 * (i % 9), 0.001 * (i // 9), 0.0002) for i in range(1, 64)]
    assert sorted(found(spark, [(0.004, 0.003, 0, 100)], dense, "quadtree")) == sorted(found(spark, [(0.004, 0.003, 0, 100)], dense))


def test_quadtree():
    boxes = [(i * 0.1, i * 0.1 + 0.05, (i * 7 % 40) * 0.1, (i * 7 % 40) * 0.1 + 0.05) for i in range(200)]
    root = spatial.build(boxes)
    for q in ((0.0, 3.0, 0.0, 1.0), (5.0, 5.2, 0.0, 9.0), (-9.0, -8.0, 0.0, 1.0)):
        assert {i for i in spatial.query(root, q) if spatial.overlap(boxes[i], q)} == {i for i, b in enumerate(boxes) if spatial.overlap(b, q)}
    assert spatial.build([]) is None and spatial.query(None, boxes[0]) == []


@pytest.mark.parametrize(("values", "want"), [([3, 1, 2], [3, 1, 2]), ([1, 1, 2], [1, 1, 3]), ([5], [1]), ([], []), ([1, 1 + 5e-10, 1 + 1.2e-9], [1, 1, 3])])
def test_ranks(spark, values, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    assert df.select(features.tie_ranks(F.col("v"))).first()[0] == want


def candidates_df(spark, ids, near=1.0):
    rows = [(1, 0, i, i, p, None, 0.0, near, near) for i, p in enumerate(ids)]
    return spark.createDataFrame(rows, "device_id long, cluster_seq int, cand_idx int, place_seq long, place_id long, naics4 long, start_time_s double, centroid_m double, polygon_m double")


@pytest.mark.parametrize(("ids", "base", "want"), [([5, 2], 0, (5, 1)), ([2, 5], 0, (2, 1)), ([3, 3], 0, (3, 1)), ([1, 2], -1, (2, 1)), ([9], 0, (9, 0)), ([1, 2], math.nan, (2, 1))])
def test_rank(spark, ids, base, want):
    r = rank.rank(candidates_df(spark, ids), GbdtModel(FeatureSchema(()), base, 0.1, ())).first()
    assert (r["place_id"], r["wins"]) == want and r["candidates"] == ids


def test_preference_pairs(spark):
    lists = features.lists(candidates_df(spark, [1, 2, 3]))
    for true, labels in ((1, [1.0, 1.0]), (3, [-1.0, -1.0]), (8, [])):
        truth = spark.createDataFrame([(1, 0, true)], "device_id long, cluster_seq int, true_place_id long")
        assert [r["label"] for r in features.preference_pairs(lists, truth).collect()] == labels


def test_schema(spark):
    p = places(spark, *(square(i, 0, 0, 0.001, n) for i, n in enumerate((445110, 445110, 445110, 722515, None))))
    assert features.schema_from_places(p, 1) == FeatureSchema((4451,))
    assert features.schema_from_places(p, 0).dim == 28


def test_strip_mall(spark):
    rows = [(0.0004, 0.0004, 0), (0.00041, 0.0004, 60), (0.0004, 0.00041, 120), (0.00041, 0.00041, 180)]
    catalog = places(spark, square(10, 0, 0, 0.0008, 445110), square(20, 0, 0.0010, 0.0008, 722515))
    model = GbdtModel.from_text("VA_GBDT 1\nbase 0\nlr 1\ndim 28\nnaics\ntrees 1\nB 0 0 L 1 L -1\n")
    result = VisitAttributor(rank.GbdtRanker(model), Config(join_radius_m=80.0)).attribute(pings(spark, rows), catalog)
    assert [(r["place_id"], r["candidates"]) for r in result.visits.collect()] == [(10, [10, 20])] and result.unmatched_clusters.count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], PINGS)
    result = VisitAttributor(rank.GbdtRanker(ZERO)).attribute(none, places(spark, square(1, 0, 0, 0.001)))
    assert result.visits.count() == 0 and result.unmatched_clusters.count() == 0
