"""Geometry on a sphere as Column expressions. Rings are arrays of structs (lat, lon) in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Metres in a degree of latitude, and the least cosine of a latitude that is told from zero.
METRES_A_DEGREE, LEAST_COS = 111_320.0, 1e-6
#: Spacing of doubles at 1, and the tolerance of a point on an edge in degrees.
EPSILON, ON_EDGE = 2.220446049250313e-16, 1e-12
RING = "array<struct<lat:double,lon:double>>"


def point(lat, lon) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t))


def meters_to_degrees(lat, metres) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that so many metres span at a latitude."""
    return metres / METRES_A_DEGREE, metres / (METRES_A_DEGREE * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(LEAST_COS)))


def ensure_closed(ring) -> Column:
    """The ring with its first vertex at its end, unless it is there; an empty one stays empty."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    differs = (F.abs(first["lat"] - last["lat"]) > EPSILON) | (F.abs(first["lon"] - last["lon"]) > EPSILON)
    return F.when(F.size(ring) == 0, ring).when(differs, F.concat(ring, F.array(first))).otherwise(ring)


def edges(closed) -> Column:
    """Array of (a, b) of consecutive vertices of a closed ring."""
    n = F.greatest(F.size(closed) - 1, F.lit(0))
    return F.zip_with(F.slice(closed, 1, n), F.slice(closed, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ray_hits_edge(lat, lon, a, b) -> Column:
    """Whether a ray to the east of the point crosses the edge."""
    rise = b["lat"] - a["lat"]
    crosses = (a["lat"] > lat) != (b["lat"] > lat)
    return F.when((F.abs(rise) < EPSILON) | ~crosses, F.lit(False)).otherwise(lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(rise == 0, F.lit(1.0)).otherwise(rise) + a["lon"])


def point_on_segment(lat, lon, a, b) -> Column:
    inside = lambda x, p, q: (x >= F.least(p, q) - ON_EDGE) & (x <= F.greatest(p, q) + ON_EDGE)
    dlat, dlon = b["lat"] - a["lat"], b["lon"] - a["lon"]
    cross = (lat - a["lat"]) * dlon - (lon - a["lon"]) * dlat
    return inside(lat, a["lat"], b["lat"]) & inside(lon, a["lon"], b["lon"]) & (F.abs(cross) <= ON_EDGE * (1 + F.abs(dlon) + F.abs(dlat)))


def distance_to_segment_m(lat, lon, a, b) -> Column:
    """Distance in a flat frame scaled at the point's latitude."""
    my, mx = meters_to_degrees(lat, F.lit(1.0))
    px, py, ax, ay = lon / mx, lat / my, a["lon"] / mx, a["lat"] / my
    dx, dy = b["lon"] / mx - ax, b["lat"] / my - ay
    square = dx * dx + dy * dy
    t = F.when(square < 1e-18, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square == 0, F.lit(1.0)).otherwise(square))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _walk(lat, lon, ring_edges, finish, measure: bool) -> Column:
    """One fold over the edges: their number, crossings of a ray, whether one holds the point, and the least distance."""

    def step(state: Column, e: Column) -> Column:
        on = state["on"] | point_on_segment(lat, lon, e["a"], e["b"])
        hits = state["hits"] + ray_hits_edge(lat, lon, e["a"], e["b"]).cast("int")
        least = F.least(state["least"], distance_to_segment_m(lat, lon, e["a"], e["b"])) if measure else state["least"]
        return F.struct((state["n"] + 1).alias("n"), hits.alias("hits"), on.alias("on"), least.alias("least"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(False).alias("on"), F.lit(float("inf")).alias("least"))
    return F.aggregate(ring_edges, start, step, finish)


def _inside(state: Column) -> Column:
    return (state["n"] >= 3) & (state["on"] | (state["hits"] % 2 == 1))


def point_in_ring(lat, lon, ring_edges) -> Column:
    """Boundary included; rings of fewer than three edges hold nothing."""
    return _walk(lat, lon, ring_edges, _inside, False)


def distance_to_ring_m(lat, lon, ring_edges) -> Column:
    """0 inside or on the boundary; infinite for a ring without edges."""
    return _walk(lat, lon, ring_edges, lambda s: F.when(_inside(s), F.lit(0.0)).otherwise(s["least"]), True)


def ring_area_m2(closed, ring_edges) -> Column:
    """Shoelace area, scaled at the mean latitude over the closed ring's vertices; 0 below four of them."""
    mean = F.aggregate(closed, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(closed)
    my, mx = meters_to_degrees(mean, F.lit(1.0))
    twice = F.aggregate(ring_edges, F.lit(0.0), lambda s, e: s + (e["a"]["lon"] / mx) * (e["b"]["lat"] / my) - (e["b"]["lon"] / mx) * (e["a"]["lat"] / my))
    return F.when(F.size(closed) < 4, F.lit(0.0)).otherwise(F.abs(twice) * 0.5)


def ring_bbox(ring, pad_m) -> Column:
    """(min_lat, max_lat, min_lon, max_lon), padded by metres at the middle latitude; null for an empty ring."""
    low = lambda c: F.array_min(F.transform(ring, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(ring, lambda p: p[c]))
    dlat, dlon = meters_to_degrees((low("lat") + high("lat")) * 0.5, pad_m)
    return F.when(F.size(ring) > 0, F.struct((low("lat") - dlat).alias("min_lat"), (high("lat") + dlat).alias("max_lat"), (low("lon") - dlon).alias("min_lon"), (high("lon") + dlon).alias("max_lon")))


def bbox_intersects(a, b) -> Column:
    return (a["min_lat"] <= b["max_lat"]) & (a["max_lat"] >= b["min_lat"]) & (a["min_lon"] <= b["max_lon"]) & (a["max_lon"] >= b["min_lon"])


def bbox_union(boxes: DataFrame, column: str = "bbox") -> DataFrame:
    """One row: the box around all boxes of a column."""
    c = F.col(column)
    return boxes.agg(F.struct(F.min(c["min_lat"]).alias("min_lat"), F.max(c["max_lat"]).alias("max_lat"), F.min(c["min_lon"]).alias("min_lon"), F.max(c["max_lon"]).alias("max_lon")).alias(column))


def square(lat, lon, side) -> Column:
    """Closed ring of a square by its south-west corner and side in degrees."""
    north, east = lat + side, lon + side
    return F.array(point(lat, lon), point(lat, east), point(north, east), point(north, lon), point(lat, lon))


def naics4(code) -> Column:
    """The first four digits; shorter codes and null stay."""
    return F.substring(code.cast("string"), 1, 4).cast("bigint")


def hour_of_day(seconds) -> Column:
    """Hour 0 to 23 of a time in seconds; 0 if it isn't finite."""
    finite = ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when(finite, F.least(F.floor(F.pmod(seconds, F.lit(86400.0)) / 3600).cast("int"), F.lit(23))).otherwise(F.lit(0))


def register(spark: SparkSession) -> None:
    """SQL functions haversine_m, hour_of_day and naics4, as temporary SQL UDFs that Catalyst inlines."""
    r = EARTH_RADIUS_M
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 2 * {r} * asin(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hour_of_day(s DOUBLE) RETURNS INT RETURN CASE WHEN isnan(s) OR abs(s) = double('infinity') THEN 0 ELSE least(int(floor(pmod(s, 86400.0D) / 3600)), 23) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION naics4(c BIGINT) RETURNS BIGINT RETURN bigint(substring(string(c), 1, 4))")
