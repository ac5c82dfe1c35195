"""The whole plan: clean, cluster, find candidates, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import Config
from ..errors import InvalidInput
from ..operators.clean import PingCleaner, default_cleaner
from ..operators.cluster import Clusterer, two_pass_clusterer
from ..operators.join import PlaceIndex, PlaceIndexFactory, quadtree_index, unmatched
from ..operators.rank import Ranker


@dataclass(frozen=True)
class AttributionResult:
    visits: DataFrame
    unmatched_clusters: DataFrame


class VisitAttributor:
    """Stages with one configuration; each may be replaced by any callable of its kind."""

    def __init__(self, ranker: Ranker, config: Config | None = None, cleaner: PingCleaner | None = None, clusterer: Clusterer | None = None, index: PlaceIndexFactory | None = None) -> None:
        self.config = config or Config()
        self.ranker = ranker
        self.cleaner = cleaner or default_cleaner(self.config)
        self.clusterer = clusterer or two_pass_clusterer(self.config)
        self.index: PlaceIndex = (index or quadtree_index)(self.config)

    @staticmethod
    def builder() -> VisitAttributorBuilder:
        return VisitAttributorBuilder()

    @staticmethod
    def with_parts(config: Config, cleaner: PingCleaner, clusterer: Clusterer, index: PlaceIndexFactory, ranker: Ranker) -> VisitAttributor:
        return VisitAttributor(ranker, config, cleaner, clusterer, index)

    def attribute(self, pings: DataFrame, places: DataFrame) -> AttributionResult:
        """Lazy results for all devices: visits, and clusters without a candidate."""
        clusters = self.clusterer(self.cleaner(pings), places)
        found = self.index(clusters, places)
        return AttributionResult(self.ranker(found), unmatched(clusters, found))


class VisitAttributorBuilder:
    def __init__(self) -> None:
        self._config, self._ranker = Config(), None

    def config(self, config: Config) -> VisitAttributorBuilder:
        self._config = config
        return self

    def ranker(self, ranker: Ranker) -> VisitAttributorBuilder:
        self._ranker = ranker
        return self

    def build(self) -> VisitAttributor:
        if self._ranker is None:
            raise InvalidInput("a ranker is required")
        return VisitAttributor(self._ranker, self._config)
