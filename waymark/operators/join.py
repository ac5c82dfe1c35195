"""Candidate places of clusters: boxes that meet, then exact distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geo, vector
from ..shipping import ship
from . import spatial
from .cluster import cell

#: A stage from (clusters, places) to candidates, and what makes one from parameters.
PlaceIndex = Callable[[DataFrame, DataFrame], DataFrame]
PlaceIndexFactory = Callable[[Config], PlaceIndex]
LEAST_PROBE_M = 1.0


def with_probe(clusters: DataFrame, config: Config) -> DataFrame:
    """clusters with radius_m (of the join and of the worst accuracy) and probe, a box around the centroid alone."""
    worst = F.array_max(F.transform("pings", lambda p: p["horizontal_accuracy_m"]))
    df = clusters.withColumn("radius_m", F.lit(config.join_radius_m) + F.greatest(worst, F.lit(0.0)))
    lat, lon = F.col("centroid.lat"), F.col("centroid.lon")
    dlat, dlon = geo.meters_to_degrees(lat, F.greatest(F.col("radius_m"), F.lit(LEAST_PROBE_M)))
    return df.withColumn("probe", F.struct((lat - dlat).alias("min_lat"), (lat + dlat).alias("max_lat"), (lon - dlon).alias("min_lon"), (lon + dlon).alias("max_lon")))


def place_boxes(places: DataFrame, config: Config) -> DataFrame:
    """places with bbox, padded by the join's radius; a place without a ring has the box of its centroid."""
    at = F.struct(F.col("centroid.lat").alias("min_lat"), F.col("centroid.lat").alias("max_lat"), F.col("centroid.lon").alias("min_lon"), F.col("centroid.lon").alias("max_lon"))
    return places.withColumn("bbox", F.coalesce(geo.ring_bbox(F.col("polygon"), F.lit(config.join_radius_m)), at))


def _cells(df: DataFrame, box: str) -> DataFrame:
    span = lambda a, b: F.sequence(cell(F.col(f"{box}.{a}")), cell(F.col(f"{box}.{b}")))
    return df.withColumn("cell_lat", F.explode(span("min_lat", "max_lat"))).withColumn("cell_lon", F.explode(span("min_lon", "max_lon")))


def candidate_pairs(clusters: DataFrame, places: DataFrame, config: Config) -> DataFrame:
    """Clusters and the places within reach, unordered.

    Boxes meet in grid cells; a pair counts in one cell only, that of the lower corner of what its boxes share, so
    nothing has to be made distinct.
    """
    ship(clusters.sparkSession)
    c = _cells(with_probe(clusters, config), "probe").alias("c")
    kept = place_boxes(places, config).filter(F.size("flat") > 0).select("place_seq", "place_id", "naics4", F.col("centroid").alias("place_centroid"), "flat", "bbox")
    p = _cells(kept, "bbox").alias("p")
    corner = lambda side: F.col(f"c.cell_{side}") == F.greatest(cell(F.col(f"c.probe.min_{side}")), cell(F.col(f"p.bbox.min_{side}")))
    near = c.join(p, (F.col("c.cell_lat") == F.col("p.cell_lat")) & (F.col("c.cell_lon") == F.col("p.cell_lon")) & corner("lat") & corner("lon") & geo.bbox_intersects(F.col("p.bbox"), F.col("c.probe")))
    near = near.select("c.device_id", "c.cluster_seq", "c.centroid", "c.start_time_s", "c.radius_m", "c.pings", "c.probe", "p.place_seq", "p.place_id", "p.naics4", "p.place_centroid", "p.flat")
    of = lambda name: F.transform("pings", lambda x: x[name])
    near = near.withColumn("polygon_m", vector.distance_m(F.col("centroid.lat"), F.col("centroid.lon"), F.col("flat"))).withColumn("_pings_m", vector.least_distance_m(of("lat"), of("lon"), F.col("flat")))
    within = (F.col("polygon_m") <= F.col("radius_m")) | (F.col("_pings_m") <= F.col("radius_m"))
    return near.filter(within).withColumn("centroid_m", geo.haversine_m(F.col("centroid.lat"), F.col("centroid.lon"), F.col("place_centroid.lat"), F.col("place_centroid.lon"))).drop("pings", "flat", "_pings_m", "place_centroid")


def candidates(clusters: DataFrame, places: DataFrame, config: Config, order: str = "catalog") -> DataFrame:
    """device_id, cluster_seq, cand_idx, place_seq, place_id and what features need.

    order: `catalog` numbers a cluster's candidates by place_seq; `quadtree` as a quadtree over the catalog meets them.
    """
    pairs = candidate_pairs(clusters, places, config)
    if order == "quadtree":
        # The tree is made from one row of four numbers a place, on the driver: catalogs, unlike pings, are small.
        boxes = place_boxes(places, config).select("place_seq", "bbox").orderBy("place_seq").collect()
        leaves = spatial.leaf_table(pairs.sparkSession, [(r["place_seq"], tuple(r["bbox"])) for r in boxes]).withColumnRenamed("item", "place_seq")
        met = pairs.join(leaves, "place_seq").filter(geo.bbox_intersects(F.struct("min_lat", "max_lat", "min_lon", "max_lon"), F.col("probe")))
        first = met.groupBy("device_id", "cluster_seq", "place_seq").agg(F.min(F.struct("leaf_ord", "pos")).alias("_at"))
        pairs = pairs.join(first, ["device_id", "cluster_seq", "place_seq"])
    elif order == "catalog":
        pairs = pairs.withColumn("_at", F.col("place_seq"))
    else:
        raise ValueError(order)
    number = F.row_number().over(Window.partitionBy("device_id", "cluster_seq").orderBy("_at")) - 1
    return pairs.withColumn("cand_idx", number).drop("_at", "probe")


def quadtree_index(config: Config, order: str = "catalog") -> PlaceIndex:
    return lambda clusters, places: candidates(clusters, places, config, order)


def unmatched(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters without a candidate."""
    return clusters.join(found.select("device_id", "cluster_seq").distinct(), ["device_id", "cluster_seq"], "left_anti")
