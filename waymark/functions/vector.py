"""Geometry of many points and rings at once: Arrow-batched functions for the hot paths.

The Column forms in geo nest folds over edges, which Spark interprets step by step; here a batch's edges lie in one
array. Rings come as `flat`, four numbers (lat, lon, lat, lon) for each edge of the closed ring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import geo


def haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle distances in metres, as geo.haversine_m."""
    s, t = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    with np.errstate(invalid="ignore"):
        return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(s * s + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * t * t))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column (null counts as empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def _per_point(values: np.ndarray, counts: np.ndarray, how, empty: float) -> np.ndarray:
    out = np.full(len(counts), empty)
    some = counts > 0
    if some.any():
        out[some] = how.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def measure(lat: np.ndarray, lon: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inside, distance in metres) of each point to its ring; counts: numbers of edges."""
    a_lat, a_lon, b_lat, b_lon = flat.reshape(-1, 4).T
    y, x = np.repeat(lat, counts), np.repeat(lon, counts)
    rise, run = b_lat - a_lat, b_lon - a_lon
    with np.errstate(all="ignore"):
        crosses = ((a_lat > y) != (b_lat > y)) & (np.abs(rise) >= geo.EPSILON) & (x < run * (y - a_lat) / rise + a_lon)
        near = lambda v, p, q: (v >= np.minimum(p, q) - geo.ON_EDGE) & (v <= np.maximum(p, q) + geo.ON_EDGE)
        on = near(y, a_lat, b_lat) & near(x, a_lon, b_lon) & (np.abs((y - a_lat) * run - (x - a_lon) * rise) <= geo.ON_EDGE * (1 + np.abs(run) + np.abs(rise)))
        north, east = 1 / geo.METRES_A_DEGREE, 1 / (geo.METRES_A_DEGREE * np.maximum(np.abs(np.cos(np.radians(y))), geo.LEAST_COS))
        px, py, ax, ay = x / east, y / north, a_lon / east, a_lat / north
        dx, dy = b_lon / east - ax, b_lat / north - ay
        square = dx * dx + dy * dy
        t = np.where(square < 1e-18, 0.0, np.clip(((px - ax) * dx + (py - ay) * dy) / square, 0.0, 1.0))
        apart = np.hypot(px - (ax + t * dx), py - (ay + t * dy))
    odd = _per_point(crosses.astype(float), counts, np.add, 0.0) % 2 == 1
    inside = (counts >= 3) & (odd | (_per_point(on.astype(float), counts, np.maximum, 0.0) > 0))
    return inside, np.where(inside, 0.0, _per_point(apart, counts, np.minimum, np.inf))


def _inside(lat: pa.Array, lon: pa.Array, flat: pa.Array) -> pa.Array:
    values, lengths = _lists(flat)
    return pa.array(measure(lat.to_numpy(zero_copy_only=False), lon.to_numpy(zero_copy_only=False), values, lengths // 4)[0])


def _distance(lat: pa.Array, lon: pa.Array, flat: pa.Array) -> pa.Array:
    values, lengths = _lists(flat)
    return pa.array(measure(lat.to_numpy(zero_copy_only=False), lon.to_numpy(zero_copy_only=False), values, lengths // 4)[1])


def _least(lats: pa.Array, lons: pa.Array, flat: pa.Array) -> pa.Array:
    """The least distance of several points of a row to the row's ring."""
    lat, n = _lists(lats)
    lon, _ = _lists(lons)
    values, lengths = _lists(flat)
    counts = lengths // 4
    # Each point takes its own copy of the row's edges.
    row = np.repeat(np.arange(len(n)), n)
    each = counts[row]
    first = (np.cumsum(counts) - counts)[row]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    apart = measure(lat, lon, values.reshape(-1, 4)[at].ravel(), each)[1]
    return pa.array(_per_point(apart, n, np.minimum, np.inf))


def _closed(lats: pa.Array, lons: pa.Array) -> pa.Array:
    """Edges of each ring, closed if its last vertex isn't its first one."""
    out = []
    for lat, lon in zip(lats.to_pylist(), lons.to_pylist(), strict=True):
        ring = list(zip(lat or (), lon or (), strict=True))
        if ring and max(abs(ring[0][0] - ring[-1][0]), abs(ring[0][1] - ring[-1][1])) > geo.EPSILON:
            ring.append(ring[0])
        out.append([v for a, b in zip(ring, ring[1:], strict=False) for v in (*a, *b)])
    return pa.array(out, pa.list_(pa.float64()))


def _area(flat: pa.Array) -> pa.Array:
    values, lengths = _lists(flat)
    a_lat, a_lon, b_lat, b_lon = values.reshape(-1, 4).T
    counts = lengths // 4
    # The mean latitude is over all vertices of the closed ring: each edge's first one, and the last edge's second.
    starts = _per_point(a_lat, counts, np.add, 0.0)
    last = np.zeros(len(counts))
    last[counts > 0] = b_lat[np.cumsum(counts)[counts > 0] - 1]
    mean = (starts + last) / (counts + 1)
    north, east = 1 / geo.METRES_A_DEGREE, 1 / (geo.METRES_A_DEGREE * np.maximum(np.abs(np.cos(np.radians(mean))), geo.LEAST_COS))
    e = np.repeat(east, counts)
    twice = _per_point((a_lon / e) * (b_lat / north) - (b_lon / e) * (a_lat / north), counts, np.add, 0.0)
    return pa.array(np.where(counts >= 3, np.abs(twice) * 0.5, 0.0))


def with_geometry(places: DataFrame) -> DataFrame:
    """places with flat (their edges), area_m2 and naics4, computed once for each place."""
    ship(places.sparkSession)
    of = lambda c: F.transform("polygon", lambda p: p[c])
    df = places.withColumn("flat", F.arrow_udf(_closed, "array<double>")(of("lat"), of("lon")))
    return df.withColumn("area_m2", F.arrow_udf(_area, "double")(F.col("flat"))).withColumn("naics4", geo.naics4(F.col("naics")))


def inside(lat, lon, flat) -> Column:
    return F.arrow_udf(_inside, "boolean")(lat, lon, flat)


def distance_m(lat, lon, flat) -> Column:
    return F.arrow_udf(_distance, "double")(lat, lon, flat)


def least_distance_m(lats, lons, flat) -> Column:
    return F.arrow_udf(_least, "double")(lats, lons, flat)
