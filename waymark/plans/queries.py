"""One query for each operator over the fixture of pings and places, and DuckDB's SQL for it.

Distances and areas are whole millimetres and square decimetres, so that the last bits of doubles don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, TrainConfig
from ..functions import geo
from ..gbdt.model import GbdtModel
from ..operators import clean, cluster, features, join, rank
from ..sources import fixtures
from .attribute import VisitAttributor

CONFIG = Config()
#: A model without zero scores: nearer centroids win, then nearer polygons, then a code at ten o'clock.
MODEL = GbdtModel.from_text("VA_GBDT 1\nbase 0\nlr 0.5\ndim 52\nnaics 4451\ntrees 3\nB 0 0 L 1 L -1\nB 1 -5 L 0.7 B 1 5 L 0.1 L -0.7\nB 14 -0.5 L -0.2 L 0.05\n")
Query = Callable[[SparkSession, str], DataFrame]
#: Added before rounding down. Means of whole microdegrees often end in exact halves, where engines part ways; none ends here.
SHIFT = 0.37


def mm(x) -> F.Column:
    return F.floor(x * 1000 + SHIFT).cast("bigint")


def _pings(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pings(spark, d)


def _places(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.places(spark, d)


def _jumps(spark: SparkSession, d: str) -> DataFrame:
    return clean.filter_jumps(clean.filter_accuracy(_pings(spark, d), CONFIG), CONFIG)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.default_cleaner(CONFIG)(_pings(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return cluster.assign_runs(_cleaned(spark, d), _places(spark, d), CONFIG)


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.summarise(_runs(spark, d))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return join.candidates(_clusters(spark, d), _places(spark, d), CONFIG)


def _truth(found: DataFrame) -> DataFrame:
    """The lowest id among each cluster's nearest polygons, for clusters with a choice."""
    key = list(features.KEY)
    return found.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(mm(F.col("polygon_m")), F.col("place_id")))["place_id"].alias("true_place_id")).filter("n > 1").drop("n")


def clean_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return clean.filter_accuracy(_pings(spark, d), CONFIG)


def haversine_hops(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_hops(clean.filter_accuracy(_pings(spark, d), CONFIG)).filter("hop_m is not null").select("device_id", "ping_seq", mm(F.col("hop_m")).alias("hop_mm"), F.col("dt_s"))


def hop_speed(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_hops(_jumps(spark, d)).filter("hop_m is not null").select("device_id", "ping_seq", mm(F.col("speed_m_s")).alias("speed_mm_s"))


def clean_jumps(spark: SparkSession, d: str) -> DataFrame:
    return _jumps(spark, d).select("device_id", "ping_seq")


def driving_windows(spark: SparkSession, d: str) -> DataFrame:
    w = clean.with_driving(_jumps(spark, d), CONFIG)
    return w.select("device_id", "ping_seq", F.col("n_window").cast("bigint").alias("n_window"), "t_left", mm(F.col("path_m")).alias("path_mm"), mm(F.col("net_m")).alias("net_mm"), "driving")


def clean_driving(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("device_id", "ping_seq")


def clean_all(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).groupBy("device_id").agg(F.count("*").alias("n_pings"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))


def place_area(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("place_seq", F.floor(F.col("area_m2") * 10 + 0.5).cast("bigint").alias("area"))


def place_bbox(spark: SparkSession, d: str) -> DataFrame:
    b = join.place_boxes(_places(spark, d), CONFIG)
    return b.select("place_seq", *(F.floor(F.col(f"bbox.{c}") * 1e9 + SHIFT).cast("bigint").alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))


def bbox_union(spark: SparkSession, d: str) -> DataFrame:
    u = geo.bbox_union(join.place_boxes(_places(spark, d), CONFIG))
    return u.select(*(F.floor(F.col(f"bbox.{c}") * 1e9 + SHIFT).cast("bigint").alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))


def place_naics4(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("place_seq", F.coalesce("naics4", F.lit(-1)).alias("naics4"))


def ping_in_large_place(spark: SparkSession, d: str) -> DataFrame:
    return cluster.in_large_places(_cleaned(spark, d), _places(spark, d), CONFIG).filter("place_id is not null").select("device_id", "ping_seq", "place_id")


def smallest_large_place(spark: SparkSession, d: str) -> DataFrame:
    return cluster.smallest_large_place(_cleaned(spark, d), _places(spark, d), CONFIG)


def large_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).filter("large_run is not null").groupBy("device_id", F.col("large_run").cast("bigint").alias("large_run")).agg(F.min("ping_seq").alias("low_seq"), F.count("*").alias("n_pings"), F.first("used").alias("used"))


def unused_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).filter("not used").groupBy("device_id", F.col("unused_run").cast("bigint").alias("unused_run")).agg(F.min("time_s").alias("first_s"), F.count("*").alias("n_pings"))


def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    alone = cluster.density_clusterer(CONFIG)(_cleaned(spark, d), _places(spark, d))
    return alone.select("device_id", F.size("pings").cast("bigint").alias("n_pings"), "start_time_s", "end_time_s")


def two_pass_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), F.col("pass").cast("bigint").alias("pass"), F.size("pings").cast("bigint").alias("n_pings"), "start_time_s", "end_time_s")


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.with_duration(_clusters(spark, d))
    nano = lambda x: F.floor(F.col(x) * 1e9 + SHIFT).cast("bigint")
    return c.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), nano("centroid.lat").alias("lat"), nano("centroid.lon").alias("lon"), "duration_s", F.col("hour").cast("bigint").alias("hour"))


def join_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), F.col("cand_idx").cast("bigint").alias("cand_idx"), "place_id")


def place_distance(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), "place_seq", mm(F.col("polygon_m")).alias("polygon_mm"), mm(F.col("centroid_m")).alias("centroid_mm"))


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    n = _found(spark, d).groupBy("device_id", "cluster_seq").count().groupBy(F.col("count").alias("n_candidates")).agg(F.count("*").alias("n_clusters"))
    return n


def unmatched_clusters(spark: SparkSession, d: str) -> DataFrame:
    result = VisitAttributor(rank.GbdtRanker(MODEL)).attribute(_pings(spark, d), _places(spark, d))
    return result.unmatched_clusters.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), "start_time_s")


def naics_schema(spark: SparkSession, d: str) -> DataFrame:
    schema = features.schema_from_places(_places(spark, d), 2)
    return spark.createDataFrame([(i, c) for i, c in enumerate(schema.naics4)], "block long, naics4 long")


def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.absolute_features(_found(spark, d))
    return f.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), F.col("place_seq"), mm(F.col("centroid_m")).alias("centroid_mm"), mm(F.col("polygon_m")).alias("polygon_mm"), F.coalesce("naics4", F.lit(-1)).alias("naics4"), F.col("hour").cast("bigint").alias("hour"))


def candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    f = features.absolute_features(_found(spark, d))
    return f.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), "place_seq", F.col("centroid_rank").cast("bigint").alias("centroid_rank"), F.col("polygon_rank").cast("bigint").alias("polygon_rank"))


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    p = features.preference_pairs(features.lists(found), _truth(found))
    return p.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), F.col("a.place_id").alias("left_id"), F.col("b.place_id").alias("right_id"), "label")


def tree_score(spark: SparkSession, d: str) -> DataFrame:
    p = features.pairs(features.lists(_found(spark, d)))
    return p.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), F.col("a.place_seq").alias("left_seq"), F.col("b.place_seq").alias("right_seq"), mm(rank.score(MODEL)).alias("score"))


def tournament_wins(spark: SparkSession, d: str) -> DataFrame:
    w = rank.wins(features.lists(_found(spark, d)), MODEL)
    return w.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), F.col("cand_idx").cast("bigint").alias("cand_idx"), F.col("wins").cast("bigint").alias("wins"))


def _visits(spark: SparkSession, d: str) -> DataFrame:
    return VisitAttributor(rank.GbdtRanker(MODEL)).attribute(_pings(spark, d), _places(spark, d)).visits


def visits(spark: SparkSession, d: str) -> DataFrame:
    v = _visits(spark, d)
    return v.select("device_id", F.col("cluster_seq").cast("bigint").alias("cluster_seq"), "place_id", F.col("wins").cast("bigint").alias("wins"), F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("candidates"))


def visits_by_place(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d).groupBy("place_id").agg(F.count("*").alias("n_visits"), F.countDistinct("device_id").alias("n_devices"))


def visits_by_hour(spark: SparkSession, d: str) -> DataFrame:
    clusters = _clusters(spark, d)
    v = rank.rank(join.candidates(clusters, _places(spark, d), CONFIG), MODEL)
    timed = v.join(clusters.select("device_id", "cluster_seq", geo.hour_of_day(F.col("start_time_s")).cast("bigint").alias("hour")), ["device_id", "cluster_seq"])
    return timed.groupBy("hour").agg(F.count("*").alias("n_visits"))


def gbdt_train_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The text of a model trained on all pairs of the labelled clusters with the default parameters, a line a row."""
    found = _found(spark, d)
    model = rank.GbdtRanker.train(found, _truth(found), TrainConfig()).model
    return spark.createDataFrame(list(enumerate(model.to_text().splitlines())), "line_no long, line string")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (clean_accuracy, haversine_hops, hop_speed, clean_jumps, driving_windows, clean_driving, clean_all, place_area, place_bbox, bbox_union, place_naics4, ping_in_large_place, smallest_large_place, large_runs, unused_runs, density_clusters, two_pass_clusters, cluster_summary, join_candidates, place_distance, candidate_counts, unmatched_clusters, naics_schema, candidate_features, candidate_ranks, preference_pairs, tree_score, tournament_wins, visits, visits_by_place, visits_by_hour, gbdt_train_nodes)}


# DuckDB's side. Each part is a common table expression that builds on the ones before it.


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(12742000.0 * asin(sqrt(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))))"


def _mm(x: str) -> str:
    return f"CAST(floor(({x}) * 1000 + {SHIFT}) AS BIGINT)"


def _nano(x: str) -> str:
    return f"CAST(floor(({x}) * 1e9 + {SHIFT}) AS BIGINT)"


def _segment(lat: str, lon: str, a: tuple[str, str], b: tuple[str, str]) -> str:
    """Distance from a point to an edge between two corners (lat, lon)."""
    mx, my = f"(1.0 / (111320.0 * greatest(abs(cos(radians({lat}))), 1e-6)))", "(1.0 / 111320.0)"
    px, py, ax, ay, bx, by = f"({lon} / {mx})", f"({lat} / {my})", f"({a[1]} / {mx})", f"({a[0]} / {my})", f"({b[1]} / {mx})", f"({b[0]} / {my})"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"greatest(0.0, least(1.0, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    x, y = f"({px} - ({ax} + {t} * {dx}))", f"({py} - ({ay} + {t} * {dy}))"
    return f"sqrt({x} * {x} + {y} * {y})"


def _square_distance(lat: str, lon: str) -> str:
    sw, se, ne, nw = ("s", "w"), ("s", "e"), ("n", "e"), ("n", "w")
    edges = ", ".join(_segment(lat, lon, a, b) for a, b in ((sw, se), (se, ne), (ne, nw), (nw, sw)))
    return f"CASE WHEN {lat} BETWEEN s AND n AND {lon} BETWEEN w AND e THEN 0.0 ELSE least({edges}) END"


_MEAN_LAT = "((3 * s + 2 * n) / 5)"
_AREA = f"((n - s) * 111320.0 * (e - w) * 111320.0 * abs(cos(radians({_MEAN_LAT}))))"
_PAD = "(50.0 / (111320.0 * abs(cos(radians((s + n) * 0.5)))))"
PARTS = {
    "places": f"raw_places AS ({fixtures.PLACES}), places AS (SELECT *, {_AREA} AS area, CASE WHEN naics >= 10000 THEN CAST(substr(CAST(naics AS VARCHAR), 1, 4) AS BIGINT) ELSE naics END AS naics4, s - 50.0 / 111320.0 AS b_s, n + 50.0 / 111320.0 AS b_n, w - {_PAD} AS b_w, e + {_PAD} AS b_e FROM (SELECT *, lat_u / 1e6 AS s, lon_u / 1e6 AS w, (lat_u + side_u) / 1e6 AS n, (lon_u + side_u) / 1e6 AS e, lat_u / 1e6 + side_u / 1e6 * 0.5 AS c_lat, lon_u / 1e6 + side_u / 1e6 * 0.5 AS c_lon FROM raw_places))",
    "pings": f"pings AS ({fixtures.PINGS.format(us=fixtures.US_DUCKDB, supplier='supplier', events='events')})",
    "acc": "acc AS (SELECT * FROM pings WHERE horizontal_accuracy_m <= 100)",
    "jumps": f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY time_s, ping_seq) AS rn FROM acc),
        walk AS (SELECT device_id, rn, ping_seq, true AS kept, lat AS a_lat, lon AS a_lon, time_s AS a_t FROM numbered WHERE rn = 1
        UNION ALL SELECT device_id, rn, ping_seq, ok, CASE WHEN ok THEN lat ELSE a_lat END, CASE WHEN ok THEN lon ELSE a_lon END, CASE WHEN ok THEN time_s ELSE a_t END
        FROM (SELECT x.*, a_lat, a_lon, a_t, x.time_s - a_t > 0 AND {_hav('a_lat', 'a_lon', 'x.lat', 'x.lon')} / CASE WHEN x.time_s > a_t THEN x.time_s - a_t ELSE 1 END <= 50 AS ok FROM walk JOIN numbered x ON x.device_id = walk.device_id AND x.rn = walk.rn + 1)),
        jumps AS (SELECT acc.* FROM acc JOIN walk USING (device_id, ping_seq) WHERE kept)""",
    "windows": f"""hops AS (SELECT *, time_s - lag(time_s) OVER h AS dt, {_hav('lag(lat) OVER h', 'lag(lon) OVER h', 'lat', 'lon')} AS hop FROM jumps WINDOW h AS (PARTITION BY device_id ORDER BY time_s, ping_seq)),
        framed AS (SELECT *, hop / greatest(dt, 1e-6) AS speed, count(*) OVER f AS n_window, first(time_s) OVER f AS t_left, coalesce(sum(hop) OVER f, 0) - coalesce(first(hop) OVER f, 0) AS path, first(lat) OVER f AS l_lat, first(lon) OVER f AS l_lon FROM hops WINDOW f AS (PARTITION BY device_id ORDER BY time_s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)),
        netted AS (SELECT *, {_hav('l_lat', 'l_lon', 'lat', 'lon')} AS net FROM framed),
        windows AS (SELECT *, n_window >= 3 AND CASE WHEN net >= 1 THEN path / net <= 1.15 ELSE false END AND path / greatest(time_s - t_left, 1e-6) >= 8 AS driving FROM netted)""",
    "cleaned": """ahead AS (SELECT *, min(CASE WHEN driving THEN t_left END) OVER (PARTITION BY device_id ORDER BY time_s RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS reach FROM windows),
        cleaned AS (SELECT device_id, ping_seq, lat, lon, time_s, horizontal_accuracy_m FROM ahead WHERE NOT coalesce(speed >= 8 AND reach < time_s, false))""",
    "held": "held AS (SELECT device_id, ping_seq, place_id, area FROM cleaned JOIN (SELECT * FROM places WHERE area >= 50000) ON lat BETWEEN s AND n AND lon BETWEEN w AND e)",
    "large": """marked AS (SELECT c.*, row_number() OVER (PARTITION BY device_id ORDER BY time_s, ping_seq) AS rn, ids, smallest FROM cleaned c LEFT JOIN (SELECT device_id, ping_seq, list(place_id) AS ids, arg_min(place_id, (area, place_id)) AS smallest FROM held GROUP BY ALL) USING (device_id, ping_seq)),
        stay AS (SELECT device_id, rn, smallest AS pid, CASE WHEN smallest IS NULL THEN -1 ELSE 0 END AS run FROM marked WHERE rn = 1
        UNION ALL SELECT m.device_id, m.rn, CASE WHEN coalesce(list_contains(m.ids, pid), false) THEN pid ELSE m.smallest END, CASE WHEN coalesce(list_contains(m.ids, pid), false) OR m.smallest IS NULL THEN run ELSE run + 1 END FROM stay JOIN marked m ON m.device_id = stay.device_id AND m.rn = stay.rn + 1),
        sized AS (SELECT *, CASE WHEN pid IS NULL THEN 0 ELSE count(*) FILTER (WHERE pid IS NOT NULL) OVER (PARTITION BY device_id, run) END AS run_n FROM stay),
        large AS (SELECT m.*, CASE WHEN pid IS NULL THEN NULL ELSE run END AS large_run, run_n >= 2 AS used FROM marked m JOIN sized USING (device_id, rn))""",
    "sessions": f"""free AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY rn) AS fn FROM large WHERE NOT used),
        gapped AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY fn) - 1 AS unused_run FROM (SELECT *, coalesce(rn - lag(rn) OVER (PARTITION BY device_id ORDER BY fn) > 1, true) AS fresh FROM free)),
        backs AS (SELECT *, coalesce(time_s - lag(time_s) OVER b > 1800, true) AS gap, {', '.join(f"{_hav(f'lag(lat, {k}) OVER b', f'lag(lon, {k}) OVER b', 'lat', 'lon')} AS d{k}" for k in range(1, 9))} FROM gapped WINDOW b AS (PARTITION BY device_id ORDER BY fn)),
        judged AS (SELECT *, fresh OR gap OR d1 > 100 AS hard, CASE {' '.join(f'WHEN d{k} <= 80 THEN {k}' for k in range(1, 9))} ELSE 1000000 END AS near FROM backs),
        walked AS (SELECT device_id, fn, fn AS start FROM judged WHERE fn = 1
        UNION ALL SELECT j.device_id, j.fn, CASE WHEN j.hard OR (j.d1 > 80 AND j.fn - j.near < start) THEN j.fn ELSE start END FROM walked JOIN judged j ON j.device_id = walked.device_id AND j.fn = walked.fn + 1),
        sessions AS (SELECT j.*, start, count(*) OVER (PARTITION BY device_id, start) AS session_n FROM judged j JOIN walked USING (device_id, fn))""",
    "clusters": """members AS (SELECT device_id, ping_seq, lat, lon, time_s, horizontal_accuracy_m, 0 AS pass, large_run AS no FROM large WHERE used UNION ALL SELECT device_id, ping_seq, lat, lon, time_s, horizontal_accuracy_m, 1, start FROM sessions WHERE session_n >= 2),
        grouped AS (SELECT device_id, pass, no, count(*) AS n_pings, avg(lat) AS lat, avg(lon) AS lon, min(time_s) AS start_time_s, max(time_s) AS end_time_s, max(horizontal_accuracy_m) AS worst FROM members GROUP BY ALL),
        clusters AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY pass, no) - 1 AS cluster_seq, CAST(floor((start_time_s - 86400 * floor(start_time_s / 86400)) / 3600) AS BIGINT) AS hour, 50 + greatest(worst, 0) AS radius FROM grouped)""",
    "found": f"""boxed AS (SELECT c.*, greatest(radius, 1) / 111320.0 AS dlat, greatest(radius, 1) / (111320.0 * greatest(abs(cos(radians(lat))), 1e-6)) AS dlon FROM clusters c),
        met AS (SELECT b.device_id, b.cluster_seq, b.pass, b.no, b.lat AS k_lat, b.lon AS k_lon, b.hour, b.radius, p.*, {_square_distance('b.lat', 'b.lon')} AS polygon_m, {_hav('b.lat', 'b.lon', 'c_lat', 'c_lon')} AS centroid_m FROM boxed b JOIN places p ON b_s <= b.lat + dlat AND b_n >= b.lat - dlat AND b_w <= b.lon + dlon AND b_e >= b.lon - dlon),
        reached AS (SELECT DISTINCT t.device_id, t.cluster_seq, t.place_seq FROM met t JOIN members m ON m.device_id = t.device_id AND m.pass = t.pass AND m.no = t.no WHERE {_square_distance('m.lat', 'm.lon')} <= radius),
        found AS (SELECT t.*, row_number() OVER (PARTITION BY device_id, cluster_seq ORDER BY place_seq) - 1 AS cand_idx, rank() OVER (PARTITION BY device_id, cluster_seq ORDER BY round(centroid_m, 8)) AS centroid_rank, rank() OVER (PARTITION BY device_id, cluster_seq ORDER BY round(polygon_m, 8)) AS polygon_rank FROM met t WHERE polygon_m <= radius OR EXISTS (SELECT 1 FROM reached r WHERE r.device_id = t.device_id AND r.cluster_seq = t.cluster_seq AND r.place_seq = t.place_seq))""",
    "scored": """scored AS (SELECT a.device_id, a.cluster_seq, a.place_seq AS left_seq, b.place_seq AS right_seq, a.place_id AS left_id, b.place_id AS right_id, a.cand_idx AS i, b.cand_idx AS j,
        0.5 * CASE WHEN a.centroid_m - b.centroid_m <= 0 THEN 1 ELSE -1 END + 0.5 * CASE WHEN a.polygon_m - b.polygon_m <= -5 THEN 0.7 WHEN a.polygon_m - b.polygon_m <= 5 THEN 0.1 ELSE -0.7 END
        + 0.5 * CASE WHEN a.hour = 10 AND coalesce(a.naics4 = 4451, false) = false AND coalesce(b.naics4 = 4451, false) THEN -0.2 ELSE 0.05 END AS score
        FROM found a JOIN found b ON a.device_id = b.device_id AND a.cluster_seq = b.cluster_seq AND a.cand_idx < b.cand_idx)""",
    "won": "won AS (SELECT device_id, cluster_seq, CASE WHEN score >= 0 THEN i ELSE j END AS cand_idx, count(*) AS wins FROM scored GROUP BY ALL)",
    "visits": "standing AS (SELECT f.*, coalesce(wins, 0) AS wins FROM found f LEFT JOIN won USING (device_id, cluster_seq, cand_idx)), visits AS (SELECT device_id, cluster_seq, any_value(hour) AS hour, arg_min(place_id, (-wins, place_id)) AS place_id, max(wins) AS wins, string_agg(CAST(place_id AS VARCHAR), ',' ORDER BY cand_idx) AS candidates FROM standing GROUP BY ALL)",
    "truth": f"truth AS (SELECT device_id, cluster_seq, arg_min(place_id, ({_mm('polygon_m')}, place_id)) AS true_id FROM found GROUP BY ALL HAVING count(*) > 1)",
    # Sessions alone: as `large` with no ping used.
    "none_large": "large AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY time_s, ping_seq) AS rn, false AS used FROM cleaned)",
}
_CLEAN = ("pings", "acc", "jumps", "windows", "cleaned")
_FOUND = ("places", *_CLEAN, "held", "large", "sessions", "clusters", "found")


#: Parts that later ones read more than once: DuckDB is told to compute them once.
SHARED = ("clusters", "members", "found")


def _sql(parts: tuple[str, ...], select: str) -> str:
    text = "WITH RECURSIVE " + ",\n".join(PARTS[p] for p in parts) + "\n" + select
    return re.sub(rf"\b({'|'.join(SHARED)}) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", text)


def oracle_sql() -> dict[str, str]:
    box = ", ".join(f"{_nano(a)} AS {b}" for a, b in (("b_s", "min_lat"), ("b_n", "max_lat"), ("b_w", "min_lon"), ("b_e", "max_lon")))
    union = ", ".join(f"{_nano(a)} AS {b}" for a, b in (("min(b_s)", "min_lat"), ("max(b_n)", "max_lat"), ("min(b_w)", "min_lon"), ("max(b_e)", "max_lon")))
    hop = f"{_hav('lag(lat) OVER h', 'lag(lon) OVER h', 'lat', 'lon')}"
    window = "WINDOW h AS (PARTITION BY device_id ORDER BY time_s, ping_seq)"
    return {
        "clean_accuracy": _sql(("pings", "acc"), "SELECT * FROM acc"),
        "haversine_hops": _sql(("pings", "acc"), f"SELECT * FROM (SELECT device_id, ping_seq, {_mm(hop)} AS hop_mm, time_s - lag(time_s) OVER h AS dt_s FROM acc {window}) WHERE hop_mm IS NOT NULL"),
        "hop_speed": _sql(("pings", "acc", "jumps", "windows"), f"SELECT device_id, ping_seq, {_mm('speed')} AS speed_mm_s FROM windows WHERE hop IS NOT NULL"),
        "clean_jumps": _sql(("pings", "acc", "jumps"), "SELECT device_id, ping_seq FROM jumps"),
        "driving_windows": _sql(("pings", "acc", "jumps", "windows"), f"SELECT device_id, ping_seq, n_window, t_left, {_mm('path')} AS path_mm, {_mm('net')} AS net_mm, driving FROM windows"),
        "clean_driving": _sql(_CLEAN, "SELECT device_id, ping_seq FROM cleaned"),
        "clean_all": _sql(_CLEAN, "SELECT device_id, count(*) AS n_pings, min(time_s) AS first_s, max(time_s) AS last_s FROM cleaned GROUP BY ALL"),
        "place_area": _sql(("places",), "SELECT place_seq, CAST(floor(area * 10 + 0.5) AS BIGINT) AS area FROM places"),
        "place_bbox": _sql(("places",), f"SELECT place_seq, {box} FROM places"),
        "bbox_union": _sql(("places",), f"SELECT {union} FROM places"),
        "place_naics4": _sql(("places",), "SELECT place_seq, coalesce(naics4, -1) AS naics4 FROM places"),
        "ping_in_large_place": _sql(("places", *_CLEAN, "held"), "SELECT device_id, ping_seq, place_id FROM held"),
        "smallest_large_place": _sql(("places", *_CLEAN, "held"), "SELECT device_id, ping_seq, arg_min(place_id, (area, place_id)) AS place_id FROM held GROUP BY ALL"),
        "large_runs": _sql(("places", *_CLEAN, "held", "large"), "SELECT device_id, CAST(large_run AS BIGINT) AS large_run, min(ping_seq) AS low_seq, count(*) AS n_pings, any_value(used) AS used FROM large WHERE large_run IS NOT NULL GROUP BY ALL"),
        "unused_runs": _sql(("places", *_CLEAN, "held", "large", "sessions"), "SELECT device_id, CAST(unused_run AS BIGINT) AS unused_run, min(time_s) AS first_s, count(*) AS n_pings FROM sessions GROUP BY ALL"),
        "density_clusters": _sql((*_CLEAN, "none_large", "sessions"), "SELECT device_id, count(*) AS n_pings, min(time_s) AS start_time_s, max(time_s) AS end_time_s FROM sessions WHERE session_n >= 2 GROUP BY device_id, start"),
        "two_pass_clusters": _sql(_FOUND[:-1], "SELECT device_id, cluster_seq, CAST(pass AS BIGINT) AS pass, n_pings, start_time_s, end_time_s FROM clusters"),
        "cluster_summary": _sql(_FOUND[:-1], f"SELECT device_id, cluster_seq, {_nano('lat')} AS lat, {_nano('lon')} AS lon, end_time_s - start_time_s AS duration_s, hour FROM clusters"),
        "join_candidates": _sql(_FOUND, "SELECT device_id, cluster_seq, cand_idx, place_id FROM found"),
        "place_distance": _sql(_FOUND, f"SELECT device_id, cluster_seq, place_seq, {_mm('polygon_m')} AS polygon_mm, {_mm('centroid_m')} AS centroid_mm FROM found"),
        "candidate_counts": _sql(_FOUND, "SELECT n_candidates, count(*) AS n_clusters FROM (SELECT count(*) AS n_candidates FROM found GROUP BY device_id, cluster_seq) GROUP BY ALL"),
        "unmatched_clusters": _sql(_FOUND, "SELECT device_id, cluster_seq, start_time_s FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.device_id = c.device_id AND f.cluster_seq = c.cluster_seq)"),
        "naics_schema": _sql(("places",), "SELECT row_number() OVER (ORDER BY naics4) - 1 AS block, naics4 FROM (SELECT naics4 FROM places WHERE naics4 IS NOT NULL GROUP BY naics4 ORDER BY count(*) DESC, naics4 LIMIT 2)"),
        "candidate_features": _sql(_FOUND, f"SELECT device_id, cluster_seq, place_seq, {_mm('centroid_m')} AS centroid_mm, {_mm('polygon_m')} AS polygon_mm, coalesce(naics4, -1) AS naics4, hour FROM found"),
        "candidate_ranks": _sql(_FOUND, "SELECT device_id, cluster_seq, place_seq, centroid_rank, polygon_rank FROM found"),
        "preference_pairs": _sql((*_FOUND, "scored", "truth"), "SELECT device_id, cluster_seq, left_id, right_id, CAST(CASE WHEN left_id = true_id THEN 1 ELSE -1 END AS DOUBLE) AS label FROM scored JOIN truth USING (device_id, cluster_seq) WHERE (left_id = true_id) <> (right_id = true_id)"),
        "tree_score": _sql((*_FOUND, "scored"), f"SELECT device_id, cluster_seq, left_seq, right_seq, {_mm('score')} AS score FROM scored"),
        "tournament_wins": _sql((*_FOUND, "scored", "won"), "SELECT * FROM won"),
        "visits": _sql((*_FOUND, "scored", "won", "visits"), "SELECT device_id, cluster_seq, place_id, wins, candidates FROM visits"),
        "visits_by_place": _sql((*_FOUND, "scored", "won", "visits"), "SELECT place_id, count(*) AS n_visits, count(DISTINCT device_id) AS n_devices FROM visits GROUP BY ALL"),
        "visits_by_hour": _sql((*_FOUND, "scored", "won", "visits"), "SELECT hour, count(*) AS n_visits FROM visits GROUP BY ALL"),
    }
