"""Ranking: a tournament of all pairs of a cluster's candidates, decided by the compiled model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..errors import InvalidInput
from ..gbdt.model import HOURS, NUMERIC, Branch, FeatureSchema, GbdtModel, Node
from ..gbdt.train import fit_pairs
from ..shipping import ship
from . import features

#: A stage from candidates to visits.
Ranker = Callable[[DataFrame], DataFrame]
#: Nodes up to which a model becomes an expression; larger ones are scored by a vectorised UDF.
MOST_COMPILED = 2000


def _nodes(node: Node) -> int:
    return 1 + (_nodes(node.left) + _nodes(node.right) if isinstance(node, Branch) else 0)


def score(model: GbdtModel) -> Column:
    """Score of a pair's difference, on rows of features.pairs()."""
    if sum(map(_nodes, model.trees)) <= MOST_COMPILED:
        return model.compiled(lambda f: features.difference(model.schema, f))
    from pyspark.sql.pandas.functions import pandas_udf

    from ..gbdt.train import evaluate

    @pandas_udf("double")
    def scored(rows):
        x = np.stack(rows.to_numpy())
        return rows.__class__(model.base_score + sum(model.learning_rate * evaluate(t, x) for t in model.trees))

    return scored(F.array(*(features.difference(model.schema, f) for f in range(model.schema.dim))))


def wins(lists: DataFrame, model: GbdtModel) -> DataFrame:
    """Wins of each candidate that has any: a score of zero or more is a win of the first of a pair, all else of the second."""
    ship(lists.sparkSession)
    s = score(model)
    first = ~F.isnan(s) & (s >= 0)
    winner = F.when(first, F.col("a.cand_idx")).otherwise(F.col("b.cand_idx"))
    return features.pairs(lists).select(*features.KEY, winner.alias("cand_idx")).groupBy(*features.KEY, "cand_idx").agg(F.count("*").cast("int").alias("wins"))


def rank(found: DataFrame, model: GbdtModel) -> DataFrame:
    """Visits: device_id, cluster_seq, place_id, wins and candidates. Most wins, then the smallest id; one candidate wins with 0."""
    lists = features.lists(found)
    # One row of a map for each cluster: all of it keeps the partitioning by cluster.
    counted = wins(lists, model).groupBy(*features.KEY).agg(F.map_from_entries(F.collect_list(F.struct("cand_idx", "wins"))).alias("won"))
    both = lists.join(counted, list(features.KEY), "left")
    standing = F.transform("cands", lambda c: F.struct((-F.coalesce(F.try_element_at("won", c["cand_idx"]), F.lit(0))).alias("minus"), c["place_id"].alias("place_id")))
    best = F.array_min(standing)
    return both.select(*features.KEY, best["place_id"].alias("place_id"), (-best["minus"]).alias("wins"), F.transform("cands", lambda c: c["place_id"]).alias("candidates"))


def _labelled_pairs(found: DataFrame, truth: DataFrame, config: TrainConfig) -> tuple[FeatureSchema, pa.Table]:
    """The codes, and the pairs of the labelled clusters in order of their keys: four numbers, and one that packs blocks, hour and label."""
    labelled = found.join(truth.select(*features.KEY), list(features.KEY), "left_semi")
    schema = features.schema_from_places(labelled, config.max_naics)
    chosen = features.preference_pairs(features.lists(labelled), truth)
    blocks = len(schema.naics4) + 1
    rest = ((schema.bucket(F.col("a.naics4")) * blocks + schema.bucket(F.col("b.naics4"))) * HOURS + F.col("hour")) * 2 + (F.col("label") > 0).cast("int")
    names = [f"d{f}" for f in range(NUMERIC)]
    cells = chosen.select(*features.KEY, F.col("a.cand_idx").alias("i"), F.col("b.cand_idx").alias("j"), *(features.difference(schema, f).cast("double").alias(names[f]) for f in range(NUMERIC)), rest.cast("long").alias("rest"))
    return schema, cells.orderBy(*features.KEY, "i", "j").select(*names, "rest").toArrow()


class GbdtRanker:
    def __init__(self, model: GbdtModel) -> None:
        self.model = model

    @property
    def schema(self) -> FeatureSchema:
        return self.model.schema

    def __call__(self, found: DataFrame) -> DataFrame:
        return rank(found, self.model)

    def save(self, path: str) -> None:
        self.model.save(path)

    @staticmethod
    def load(path: str) -> GbdtRanker:
        return GbdtRanker(GbdtModel.load(path))

    @staticmethod
    def train(found: DataFrame, truth: DataFrame, config: TrainConfig | None = None) -> GbdtRanker:
        """Fits on labelled clusters: features and pairs are made in parallel, the trees grow on the driver.

        found: candidates of the labelled clusters; truth: device_id, cluster_seq, true_place_id. Labels are made by
        hand, so their pairs fit in memory; rows come in order of their keys, as the subsampling goes by position.
        """
        config = config or TrainConfig()
        # Codes, pairs and as a rule the truth come from the candidates: found once, in memory or on the executors' disks.
        held = None if found.is_cached else found.persist()
        try:
            schema, rows = _labelled_pairs(found, truth, config)
        finally:
            if held is not None:
                held.unpersist()
        if not rows.num_rows:
            raise InvalidInput("no labelled cluster yields a pair")
        packed, label = np.divmod(rows["rest"].to_numpy(), 2)
        packed, hour = np.divmod(packed, HOURS)
        first, second = np.divmod(packed, len(schema.naics4) + 1)
        numbers = [rows[f"d{f}"].to_numpy() for f in range(NUMERIC)]
        del rows, packed
        return GbdtRanker(fit_pairs(schema, numbers, first, second, hour, label * 2.0 - 1, config))
