"""Pings and places derived from the driver's tables, in whole microdegrees so that any engine gets the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, vector

PLACES = """
SELECT CAST(s_suppkey AS BIGINT) AS place_seq, 1000 + CAST(s_suppkey AS BIGINT) AS place_id,
  CAST(floor(s_suppkey / 10) AS BIGINT) * 1500 AS lat_u, CAST(s_suppkey % 10 AS BIGINT) * 1500 AS lon_u, CAST(800 AS BIGINT) AS side_u,
  CAST(CASE s_suppkey % 5 WHEN 0 THEN 445110 WHEN 1 THEN 722515 WHEN 2 THEN 531120 WHEN 3 THEN 44511 END AS BIGINT) AS naics
FROM supplier
UNION ALL SELECT 1000000 + CAST(n_nationkey AS BIGINT), 1 + CAST(n_nationkey AS BIGINT),
  CAST(floor(n_nationkey / 5) AS BIGINT) * 3000, CAST(n_nationkey % 5 AS BIGINT) * 3000, CAST(2300 AS BIGINT), CAST(531120 AS BIGINT)
FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 2000000 + CAST(r_regionkey AS BIGINT), 500 + CAST(r_regionkey AS BIGINT),
  CAST(r_regionkey AS BIGINT) * 3000 + 1000, CAST(r_regionkey AS BIGINT) * 3000 + 1000, CAST(2050 AS BIGINT), CAST(NULL AS BIGINT)
FROM region
"""
#: {us}: microseconds since the epoch in the engine's words; {supplier}: number of suppliers.
PINGS = """
SELECT e.user_id AS device_id, e.event_id * 16 + j AS ping_seq,
  CAST(CAST(floor(k / 10) AS BIGINT) * 1500 + 400
    + CASE WHEN event_type = 'click' AND j >= 4 THEN (j - 3) * 3000 ELSE (event_id * 37 + j * 61) % 121 - 60 END
    + CASE WHEN event_type = 'signup' THEN -500000 ELSE 0 END
    + CASE WHEN event_type = 'view' AND j = 2 THEN 1000000 ELSE 0 END AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat,
  CAST((k % 10) * 1500 + 400
    + CASE WHEN event_type = 'click' AND j >= 4 THEN 0 ELSE (event_id * 53 + j * 29) % 121 - 60 END
    + CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN ((j + 1) % 3) * 400 ELSE j * 800 END ELSE 0 END AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
  CAST({us} + CASE WHEN event_type = 'click' AND j >= 4 THEN 60 + (j - 3) * 10 ELSE j * 20 END * 1000000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS time_s,
  CAST(CASE WHEN event_type = 'error' AND j = 1 THEN 5000 ELSE 5 + (event_id + j) % 20 END AS DOUBLE) AS horizontal_accuracy_m
FROM (SELECT event_id, user_id, event_type, ts, (event_id * 7919 + user_id) % (SELECT count(*) FROM {supplier}) AS k FROM {events}) e
CROSS JOIN range(0, 8) AS r(j)
"""
US_DUCKDB = "epoch_us(ts)"
#: Free of the session's time zone: ts has none.
US_SPARK = "unix_date(CAST(ts AS DATE)) * 86400000000L + (hour(ts) * 3600 + minute(ts) * 60) * 1000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_seq, place_id, polygon, centroid, naics, and geometry columns."""
    raw = spark.sql(PLACES.replace("FROM supplier", "FROM {supplier}").replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}"), supplier=load(spark, sf_dir, "supplier"), nation=load(spark, sf_dir, "nation"), region=load(spark, sf_dir, "region"))
    at = lambda c: F.col(c).cast("double") / F.lit(1e6)
    corner = lambda c: (F.col(c) + F.col("side_u")).cast("double") / F.lit(1e6)
    south, west, north, east = at("lat_u"), at("lon_u"), corner("lat_u"), corner("lon_u")
    ring = F.array(geo.point(south, west), geo.point(south, east), geo.point(north, east), geo.point(north, west), geo.point(south, west))
    half = at("side_u") * 0.5
    return vector.with_geometry(raw.select("place_seq", "place_id", ring.alias("polygon"), geo.point(south + half, west + half).alias("centroid"), "naics"))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, ping_seq, lat, lon, time_s, horizontal_accuracy_m."""
    text = PINGS.replace("{us}", US_SPARK)
    return spark.sql(text, supplier=load(spark, sf_dir, "supplier"), events=load(spark, sf_dir, "events"))
