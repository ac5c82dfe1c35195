"""Clustering: stays inside large places first, then time-and-distance sessions of what is left over."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geo, vector
from ..shipping import ship
from .clean import PING

#: A stage from (pings, places) to clusters.
Clusterer = Callable[[DataFrame, DataFrame], DataFrame]
#: Members that a newcomer may be near to, and the side of a grid cell in degrees.
LOOKBACK, CELL = 8, 0.005
RUNS = ("device_id long, ping_seq long, lat double, lon double, time_s double, horizontal_accuracy_m double, position int, "
        "large_place long, large_run int, used boolean, unused_run int, density_run int, pass int, cluster_seq int")  # fmt: skip


def cell(x) -> F.Column:
    return F.floor(x / CELL).cast("long")


def large_places(places: DataFrame, config: Config) -> DataFrame:
    return places.filter(F.col("area_m2") >= config.large_poi_area_m2)


def in_large_places(pings: DataFrame, places: DataFrame, config: Config) -> DataFrame:
    """pings with place_id and area_m2 of each large place that holds them: a row for each, or one with nulls.

    Places and pings meet in the cells of a grid, so the join has keys; whether it broadcasts is up to the sizes.
    """
    ship(pings.sparkSession)
    cells = large_places(places, config).withColumn("_b", geo.ring_bbox(F.col("polygon"), F.lit(1.0))).filter("_b is not null")
    cells = cells.withColumn("cell_lat", F.explode(F.sequence(cell(F.col("_b.min_lat")), cell(F.col("_b.max_lat"))))).withColumn("cell_lon", F.explode(F.sequence(cell(F.col("_b.min_lon")), cell(F.col("_b.max_lon")))))
    p, c = pings.alias("p"), cells.select("place_id", "area_m2", "flat", "_b", "cell_lat", "cell_lon").alias("c")
    same = (cell(F.col("p.lat")) == F.col("c.cell_lat")) & (cell(F.col("p.lon")) == F.col("c.cell_lon"))
    box = F.col("p.lat").between(F.col("c._b.min_lat"), F.col("c._b.max_lat")) & F.col("p.lon").between(F.col("c._b.min_lon"), F.col("c._b.max_lon"))
    near = p.join(c, same & box, "left").select("p.*", "c.place_id", "c.area_m2", "c.flat")
    held = near.withColumn("_in", vector.inside(F.col("lat"), F.col("lon"), F.col("flat")))
    return held.select(*pings.columns, F.when(F.col("_in"), F.col("place_id")).alias("place_id"), F.when(F.col("_in"), F.col("area_m2")).alias("area_m2"))


def smallest_large_place(pings: DataFrame, places: DataFrame, config: Config) -> DataFrame:
    """device_id, ping_seq and the id of the smallest large place around each ping, if there is one."""
    held = in_large_places(pings, places, config).filter("place_id is not null")
    return held.groupBy("device_id", "ping_seq").agg(F.min(F.struct("area_m2", "place_id"))["place_id"].alias("place_id"))


def large_runs(inside: list[set[int]], smallest: list[int | None]) -> np.ndarray:
    """Number of the run that each ping belongs to, or -1. A run lasts while its pings are inside its first one's place."""
    out, run, place = np.full(len(inside), -1), -1, None
    for i, ids in enumerate(inside):
        if place is None or place not in ids:
            place = smallest[i]
            run += place is not None
        if place is not None:
            out[i] = run
    return out


def density_starts(lat: np.ndarray, lon: np.ndarray, time: np.ndarray, fresh: np.ndarray, config: Config) -> np.ndarray:
    """Place of the first member of each ping's session; a session also begins where `fresh` says so."""
    n = len(lat)
    near = np.full(n, n)  # how many members back the nearest close one is
    last = np.full(n, np.nan)
    for k in range(min(LOOKBACK, n - 1), 0, -1):
        d = vector.haversine(lat[:-k], lon[:-k], lat[k:], lon[k:])
        near[k:][d <= config.dist_threshold_m] = k
        if k == 1:
            last[1:] = d
    gap = np.zeros(n, bool)
    gap[1:] = np.diff(time) > config.max_time_gap_s
    hard = fresh | gap | (last > config.max_dist_threshold_m)
    far = last > config.dist_threshold_m
    out = np.zeros(n, np.int64)
    for i in range(n):
        out[i] = i if i == 0 or hard[i] or (far[i] and i - near[i] < out[i - 1]) else out[i - 1]
    return out


def assign_runs(pings: DataFrame, places: DataFrame, config: Config) -> DataFrame:
    """Each ping with its runs of both passes, its pass (0 large, 1 density) and cluster_seq (null for noise).

    One task a device: the runs carry state from ping to ping. Clusters count all large ones first, then the others.
    """
    minimum = config.min_cluster_pings

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("time_s", "ascending"), ("ping_seq", "ascending"), ("area_m2", "ascending"), ("place_id", "ascending")])
        seq, ids = t["ping_seq"].to_numpy(), t["place_id"].to_pylist()
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        inside = [{x for x in ids[a:z] if x is not None} for a, z in zip(first, [*first[1:], len(ids)], strict=True)]
        smallest = [ids[a] for a in first]
        t = t.take(pa.array(first))
        n = t.num_rows
        lat, lon, time = (t[c].to_numpy() for c in ("lat", "lon", "time_s"))
        runs = large_runs(inside, smallest)
        used = (runs >= 0) & (np.bincount(np.maximum(runs, 0), runs >= 0)[np.maximum(runs, 0)] >= minimum)
        # Sessions never bridge pings that the large pass has used.
        free = np.flatnonzero(~used)
        starts = density_starts(lat[free], lon[free], time[free], np.r_[True, np.diff(free) > 1][: len(free)], config) if len(free) else free
        dense = np.bincount(starts, minlength=len(free))[starts] >= minimum if len(free) else np.zeros(0, bool)
        large_seq = {r: i for i, r in enumerate(dict.fromkeys(runs[used].tolist()))}
        dense_seq = {s: i + len(large_seq) for i, s in enumerate(dict.fromkeys(starts[dense].tolist()))}
        cluster, step, density_run, unused = [None] * n, [None] * n, [None] * n, [None] * n
        for i in np.flatnonzero(used):
            cluster[i], step[i] = large_seq[int(runs[i])], 0
        gaps = np.cumsum(np.r_[True, np.diff(free) > 1][: len(free)]) - 1
        for i, s, ok, g in zip(free.tolist(), starts.tolist(), dense.tolist(), gaps.tolist(), strict=True):
            density_run[i], unused[i] = int(free[s]), g
            if ok:
                cluster[i], step[i] = dense_seq[s], 1
        out = t.select(["device_id", *PING])
        for name, value, kind in (("position", range(n), pa.int32()), ("large_place", smallest, pa.int64()), ("large_run", [int(r) if r >= 0 else None for r in runs], pa.int32()), ("used", used, pa.bool_()), ("unused_run", unused, pa.int32()), ("density_run", density_run, pa.int32()), ("pass", step, pa.int32()), ("cluster_seq", cluster, pa.int32())):
            out = out.append_column(name, pa.array(list(value), kind))
        return out

    return in_large_places(pings, places, config).groupBy("device_id").applyInArrow(run, RUNS)


def summarise(runs: DataFrame) -> DataFrame:
    """One row for each cluster: device_id, cluster_seq, pass, pings in order of time, centroid, start and end."""
    members = runs.filter("cluster_seq is not null")
    return members.groupBy("device_id", "cluster_seq").agg(
        F.min("pass").alias("pass"),
        F.array_sort(F.collect_list(F.struct("time_s", "ping_seq", "lat", "lon", "horizontal_accuracy_m"))).alias("pings"),
        geo.point(F.avg("lat"), F.avg("lon")).alias("centroid"), F.min("time_s").alias("start_time_s"), F.max("time_s").alias("end_time_s"),
    )


def with_duration(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("duration_s", F.greatest(F.col("end_time_s") - F.col("start_time_s"), F.lit(0.0))).withColumn("hour", geo.hour_of_day(F.col("start_time_s")))


def two_pass_clusterer(config: Config) -> Clusterer:
    return lambda pings, places: summarise(assign_runs(pings, places, config))


def large_clusterer(config: Config) -> Clusterer:
    return lambda pings, places: summarise(assign_runs(pings, places, config).filter("pass = 0"))


def density_clusterer(config: Config) -> Clusterer:
    """Sessions alone: no place is large enough to come first."""
    return lambda pings, places: summarise(assign_runs(pings, places.limit(0), config))
