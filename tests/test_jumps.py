"""The walk over jumps against a plain loop, in batches and on large devices."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.functions import geo
from waymark.functions.vector import haversine
from waymark.operators import clean

from .helpers import PINGS


def plain(rows, most):
    """Flags of a device's pings (lat, lon, time), in order of time."""
    out, anchor = [], None
    for lat, lon, t in rows:
        ok = anchor is None
        if anchor:
            dt = t - anchor[2]
            s, u = math.sin(math.radians(lat - anchor[0]) / 2), math.sin(math.radians(lon - anchor[1]) / 2)
            d = 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(s * s + math.cos(math.radians(anchor[0])) * math.cos(math.radians(lat)) * u * u))
            ok = dt > 0 and not d / dt > most
        if ok:
            anchor = (lat, lon, t)
        out.append(ok)
    return out


def trail(rng, n):
    rows, lat, t = [], 0.0, 0.0
    for _ in range(n):
        t += rng.choice((0, 0, 5, 20, 600))
        lat += rng.choice((0, 0.0001, 0.0005, 0.01))
        rows.append((lat + rng.choice((0, 0, 0, 0, 1.0, -2.0)), rng.choice((0.0, 0.0001)), t))
    return rows


@pytest.mark.parametrize("width", [1, 3, 50, 1000])
def test_walk_in_batches(width):
    rng = random.Random(width)
    for n in (0, 1, 2, 40, 300):
        rows = trail(rng, n)
        walk = clean.JumpWalk(50.0)
        got = []
        for at in range(0, n, width):
            got += walk.add(*(np.array(x, float) for x in zip(*rows[at : at + width], strict=True))).tolist()
        assert got == plain(rows, 50.0)


def test_devices_in_one_task(spark):
    rng = random.Random(7)
    trails = {d: trail(rng, rng.randint(1, 80)) for d in [*range(30), None]}
    rows = [(d, i, *r, 5.0) for d, t in trails.items() for i, r in enumerate(t)]
    rng.shuffle(rows)
    pings = spark.createDataFrame(rows, PINGS).withColumn("other", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["device_id"], r["ping_seq"]) for r in clean.filter_jumps(pings, Config()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(d, i) for d, t in trails.items() for i, ok in enumerate(plain(t, 50.0)) if ok}
    assert clean.filter_jumps(pings.limit(0), Config()).count() == 0


def test_a_device_with_many_pings(spark):
    """Time grows with the pings, not with their square."""
    one = spark.range(300_000).select(F.lit(1).cast("long").alias("device_id"), F.col("id").alias("ping_seq"), (F.col("id") * 1e-5 + F.when(F.col("id") % 7 == 3, 1.0).otherwise(0.0)).alias("lat"), F.lit(0.0).alias("lon"), (F.col("id") * 10.0).alias("time_s"), F.lit(5.0).alias("horizontal_accuracy_m"))
    begun = time.time()
    assert clean.filter_jumps(one, Config()).count() == 300_000 - 42_857
    assert time.time() - begun < 20


def test_haversine_is_that_of_columns(spark):
    rows = [(51.5, -0.12, 48.85, 2.35), (0.0, 0.0, 0.0, 180.0), (-33.9, 151.2, 40.7, -74.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(geo.haversine_m(*map(F.col, "abcd"))).collect()]
    assert np.allclose(haversine(*(np.array(x) for x in zip(*rows, strict=True))), got, rtol=1e-12)
