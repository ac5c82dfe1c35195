"""Cleaning: accuracy, impossible jumps, driving. Jumps are walked in order of time, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geo import haversine_m
from ..functions.vector import haversine
from ..shipping import ship

#: A stage that returns a time-ordered subset of pings.
PingCleaner = Callable[[DataFrame], DataFrame]
PING = ("ping_seq", "lat", "lon", "time_s", "horizontal_accuracy_m")
LEAST_SECONDS = 1e-6


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def above(x: Column, than) -> Column:
    """x > than, where no number is above nothing."""
    return ~F.isnan(x) & (x > than)


def filter_accuracy(pings: DataFrame, config: Config) -> DataFrame:
    """Finite pings whose accuracy is at most the limit (negative ones pass)."""
    finite = is_finite(F.col("horizontal_accuracy_m")) & is_finite(F.col("time_s")) & is_finite(F.col("lat")) & is_finite(F.col("lon"))
    return pings.filter(finite & (F.col("horizontal_accuracy_m") <= config.max_horizontal_accuracy_m))


def by_time() -> Window:
    return Window.partitionBy("device_id").orderBy("time_s", "ping_seq")


class JumpWalk:
    """Which pings of a device stay, as its pings come in order of time; the last one that stayed is carried along."""

    def __init__(self, max_speed_m_s: float) -> None:
        self.most = max_speed_m_s
        self.anchor: tuple[float, float, float] | None = None

    def bad(self, lat, lon, time, to_lat, to_lon, to_time) -> np.ndarray:
        """Whether a ping isn't later than the one before, or couldn't be reached from it in time."""
        dt = to_time - time
        with np.errstate(invalid="ignore"):
            return (dt <= 0) | (haversine(lat, lon, to_lat, to_lon) / np.where(dt <= 0, 1.0, dt) > self.most)

    def add(self, lat: np.ndarray, lon: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Flags of the next pings. Only jumps are walked one by one: between them each ping is the next one's anchor."""
        n = len(lat)
        kept = np.zeros(n, bool)
        jumps = np.flatnonzero(self.bad(lat[:-1], lon[:-1], time[:-1], lat[1:], lon[1:], time[1:])) + 1
        at = 0 if self.anchor is None else self._landing(0, lat, lon, time)
        while at < n:
            k = int(np.searchsorted(jumps, at, "right"))
            end = int(jumps[k]) if k < len(jumps) else n
            kept[at:end] = True
            self.anchor = (lat[end - 1], lon[end - 1], time[end - 1])
            at = end if end == n else self._landing(end + 1, lat, lon, time)
        return kept

    def _landing(self, at: int, lat: np.ndarray, lon: np.ndarray, time: np.ndarray) -> int:
        """The first place from `at` on that can be reached from the anchor."""
        width = 16
        while at < len(lat):
            good = np.flatnonzero(~self.bad(*self.anchor, lat[at : at + width], lon[at : at + width], time[at : at + width]))
            if len(good):
                return at + int(good[0])
            at, width = at + width, 2 * width
        return len(lat)


def filter_jumps(pings: DataFrame, config: Config) -> DataFrame:
    """Drops a ping which isn't later than the last kept one, or couldn't be reached from it in time.

    Devices are dealt over tasks and sorted there; a task holds one batch of pings and the anchor of one device.
    """
    ship(pings.sparkSession)
    rows = pings.select("device_id", *PING)
    most = float(config.max_speed_m_s)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, device = JumpWalk(most), object()
        for b in batches:
            if not b.num_rows:
                continue
            ids = pc.fill_null(b.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            lat, lon, time = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            kept = np.zeros(len(ids), bool)
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, z in zip(edges, edges[1:], strict=False):
                if (own := b.column(0)[a].as_py()) != device:
                    state, device = JumpWalk(most), own
                kept[a:z] = state.add(lat[a:z], lon[a:z], time[a:z])
            yield b.filter(pa.array(kept))

    dealt = rows.repartition("device_id").sortWithinPartitions("device_id", "time_s", "ping_seq")
    return dealt.mapInArrow(walk, rows.schema)


def with_hops(pings: DataFrame) -> DataFrame:
    """pings with dt_s, hop_m and speed_m_s from the ping before (null for the first)."""
    w = by_time()
    before = lambda c: F.lag(c).over(w)
    hops = pings.withColumn("dt_s", F.col("time_s") - before("time_s")).withColumn("hop_m", haversine_m(before("lat"), before("lon"), F.col("lat"), F.col("lon")))
    return hops.withColumn("speed_m_s", F.col("hop_m") / F.greatest(F.col("dt_s"), F.lit(LEAST_SECONDS)))


def _span(before: float, after: float) -> str:
    """SQL of a frame of seconds around each ping; the Python API has no frames of doubles."""
    return f"OVER (PARTITION BY device_id ORDER BY time_s RANGE BETWEEN {before!r}D PRECEDING AND {after!r}D FOLLOWING)"


def with_driving(pings: DataFrame, config: Config) -> DataFrame:
    """with_hops() and, for the window of at most the span that ends at each ping, n_window, t_left, net_m, path_m and driving."""
    f = _span(float(config.linearity_window_s), 0.0)
    of = lambda call: F.expr(f"{call} {f}")
    df = with_hops(pings).withColumns({"n_window": of("count(*)"), "t_left": of("first(time_s)"), "_lat": of("first(lat)"), "_lon": of("first(lon)"), "_sum": of("sum(hop_m)"), "_first": of("first(hop_m)")})
    df = df.withColumn("path_m", F.coalesce("_sum", F.lit(0.0)) - F.coalesce("_first", F.lit(0.0)))
    df = df.withColumn("net_m", haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    straight = F.when(F.col("net_m") >= 1, F.col("path_m") / F.when(F.col("net_m") >= 1, F.col("net_m")).otherwise(F.lit(1.0)) <= config.linearity_threshold).otherwise(F.lit(False))
    fast = F.col("path_m") / F.greatest(F.col("time_s") - F.col("t_left"), F.lit(LEAST_SECONDS)) >= config.driving_speed_m_s
    return df.withColumn("driving", F.coalesce((F.col("n_window") >= 3) & straight & fast, F.lit(False))).drop("_lat", "_lon", "_sum", "_first")


def filter_driving(pings: DataFrame, config: Config) -> DataFrame:
    """Drops fast arrivals inside a driving window; a window's first ping stays."""
    df = with_driving(pings, config).withColumn("_left", F.expr(f"min(CASE WHEN driving THEN t_left END) {_span(0.0, float(config.linearity_window_s))}"))
    drop = F.coalesce((F.col("speed_m_s") >= config.driving_speed_m_s) & ~F.isnan("speed_m_s") & (F.col("_left") < F.col("time_s")), F.lit(False))
    return df.filter(~drop).select("device_id", *PING)


def default_cleaner(config: Config) -> PingCleaner:
    """Accuracy, then jumps, then driving."""
    return lambda pings: filter_driving(filter_jumps(filter_accuracy(pings, config), config), config)
