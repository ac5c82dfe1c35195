"""Parameters of all stages, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from .errors import InvalidInput


@dataclass(frozen=True)
class Config:
    max_horizontal_accuracy_m: float = 100.0  # a ping's accuracy at most
    max_speed_m_s: float = 50.0  # against the last ping that was kept; above it a ping is a jump
    linearity_threshold: float = 1.15  # path over net distance of a driving window at most
    linearity_window_s: float = 60.0  # span of a driving window at most
    driving_speed_m_s: float = 8.0  # of a driving window, and of the hops that it drops, at least
    dist_threshold_m: float = 80.0  # to one of the last eight members at most
    max_dist_threshold_m: float = 100.0  # to the last member at most
    max_time_gap_s: float = 1800.0
    min_cluster_pings: int = 2
    large_poi_area_m2: float = 50_000.0
    join_radius_m: float = 50.0

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "min_cluster_pings":
                if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                    raise InvalidInput("min_cluster_pings must be a whole number of at least 1")
            elif not math.isfinite(value) or value < 0 or (value == 0 and f.name != "join_radius_m"):
                raise InvalidInput(f"{f.name} must be finite and {'not negative' if f.name == 'join_radius_m' else 'positive'}")
        if self.max_dist_threshold_m < self.dist_threshold_m:
            raise InvalidInput("max_dist_threshold_m must not be below dist_threshold_m")

    def validate(self) -> None:
        self.__post_init__()

    @staticmethod
    def builder() -> ConfigBuilder:
        return ConfigBuilder()


class ConfigBuilder:
    """One setter for each parameter; build() checks them together."""

    def __init__(self) -> None:
        self._set: dict[str, float] = {}

    def __getattr__(self, name: str):
        if name not in Config.__dataclass_fields__:
            raise AttributeError(name)

        def put(value: float) -> ConfigBuilder:
            self._set[name] = value
            return self

        return put

    def build(self) -> Config:
        return replace(Config(), **self._set)


@dataclass(frozen=True)
class TrainConfig:
    n_trees: int = 32
    max_depth: int = 3
    min_leaf: int = 2
    learning_rate: float = 0.1
    subsample_stride: int = 1
    max_bins: int = 16
    max_naics: int = 32
