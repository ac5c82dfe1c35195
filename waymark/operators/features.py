"""Features of candidates and preference pairs. One-hot blocks stay two numbers: a block and an hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..gbdt.model import HOURS, NUMERIC, FeatureSchema

#: Distances closer than this to the first of their group are a tie.
TIE = 1e-9
KEY = ("device_id", "cluster_seq")
NUMBERS = ("centroid_m", "polygon_m", "centroid_rank", "polygon_rank")


def schema_from_places(places: DataFrame, most: int) -> FeatureSchema:
    """The codes that most places (or candidate occurrences) have; of equal counts the smaller codes."""
    top = places.filter("naics4 is not null").groupBy("naics4").count().orderBy(F.desc("count"), "naics4").limit(most).collect()
    return FeatureSchema.of(int(r["naics4"]) for r in top)


def tie_ranks(values: Column) -> Column:
    """Rank of each value of an array: 1 for the least, ties share the smallest rank of theirs (1, 1, 3)."""
    ordered = F.array_sort(values)

    def step(state: Column, v: Column) -> Column:
        same = (state["n"] > 0) & (v - state["first"] < TIE)
        first, rank = F.when(same, state["first"]).otherwise(v), F.when(same, state["rank"]).otherwise((state["n"] + 1).cast("double"))
        return F.struct((state["n"] + 1).alias("n"), first.alias("first"), rank.alias("rank"), F.array_append(state["out"], rank).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("first"), F.lit(0.0).alias("rank"), F.array().cast("array<double>").alias("out"))
    ranks = F.aggregate(ordered, start, step)["out"]
    return F.transform(values, lambda v: F.element_at(ranks, F.array_position(ordered, v).cast("int")))


def lists(found: DataFrame) -> DataFrame:
    """One row for each cluster with cands: its candidates with their features, in candidate order."""
    fields = ("cand_idx", "place_seq", "place_id", "naics4", "centroid_m", "polygon_m")
    grouped = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"), F.first("start_time_s").alias("start_time_s"))
    of = lambda name: F.transform("c", lambda x: x[name])
    ranked = grouped.withColumn("_cr", tie_ranks(of("centroid_m"))).withColumn("_pr", tie_ranks(of("polygon_m")))
    both = F.transform("c", lambda x, i: F.struct(*(x[f].alias(f) for f in fields), F.get("_cr", i).alias("centroid_rank"), F.get("_pr", i).alias("polygon_rank")))
    return ranked.select(*KEY, "start_time_s", geo.hour_of_day(F.col("start_time_s")).alias("hour"), both.alias("cands"))


def absolute_features(found: DataFrame) -> DataFrame:
    """One row for each candidate with its four numbers, its naics4 and the hour."""
    return lists(found).select(*KEY, "hour", F.inline("cands"))


def dense(schema: FeatureSchema, rows: DataFrame) -> Column:
    """The whole feature vector of absolute_features(), for training and export."""
    on = lambda b, h: ((schema.bucket(F.col("naics4")) == b) & (F.col("hour") == h)).cast("double")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(schema.dim - NUMERIC - 1)), lambda i: on(F.floor(i / HOURS), i % HOURS))
    return F.concat(F.array(*(F.col(c).cast("double") for c in NUMBERS)), blocks)


def pairs(lists_: DataFrame) -> DataFrame:
    """Rows (a, b) of each cluster's candidates with a before b, from within its list: no join, no shuffle."""
    first = lists_.select(*KEY, "hour", "cands", F.posexplode("cands").alias("_i", "a"))
    n = F.size("cands") - F.col("_i") - 1
    return first.filter(n > 0).select(*KEY, "hour", "a", F.explode(F.slice("cands", F.col("_i") + 2, n)).alias("b"))


def difference(schema: FeatureSchema, feature: int) -> Column:
    """Feature of a minus that of b, on rows of pairs()."""
    if feature < NUMERIC:
        return F.col(f"a.{NUMBERS[feature]}") - F.col(f"b.{NUMBERS[feature]}")
    block, hour = divmod(feature - NUMERIC, HOURS)
    on = lambda side: (schema.bucket(F.col(f"{side}.naics4")) == block).cast("double")
    return F.when(F.col("hour") == hour, on("a") - on("b")).otherwise(F.lit(0.0))


def preference_pairs(lists_: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of which exactly one side is the true place: label 1.0 if it is a, -1.0 if b. truth: device_id, cluster_seq, true_place_id."""
    joined = pairs(lists_).join(truth, list(KEY))
    left, right = F.col("a.place_id") == F.col("true_place_id"), F.col("b.place_id") == F.col("true_place_id")
    return joined.filter(left != right).withColumn("label", F.when(left, F.lit(1.0)).otherwise(F.lit(-1.0)))
