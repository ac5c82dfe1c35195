"""Small inputs in the words of the data model."""

from pyspark.sql import functions as F

from waymark.functions import vector

PINGS = "device_id long, ping_seq long, lat double, lon double, time_s double, horizontal_accuracy_m double"
PLACES = "place_seq long, place_id long, polygon array<struct<lat:double,lon:double>>, centroid struct<lat:double,lon:double>, naics long"


def pings(spark, rows, device=1):
    """rows: (lat, lon, time) or (lat, lon, time, accuracy)."""
    return spark.createDataFrame([(device, i, *map(float, (*r, 10.0)[:4])) for i, r in enumerate(rows)], PINGS)


def square(place_id, lat, lon, side, naics=None, seq=None):
    lat, lon, side = float(lat), float(lon), float(side)
    n, e = lat + side, lon + side
    return (place_id if seq is None else seq, place_id, [(lat, lon), (lat, e), (n, e), (n, lon), (lat, lon)], (lat + side / 2, lon + side / 2), naics)


def places(spark, *rows):
    return vector.with_geometry(spark.createDataFrame(list(rows), PLACES))


def seqs(df):
    return sorted(r["ping_seq"] for r in df.collect())


def ring(spark, points):
    return spark.createDataFrame([([tuple(map(float, p)) for p in points],)], "ring array<struct<lat:double,lon:double>>").select(F.col("ring"))
