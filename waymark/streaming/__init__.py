"""Stages that hold no state work on streams as they are; `clean_stream` is the one to begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Config
from ..operators.clean import filter_accuracy


def clean_stream(pings: DataFrame, config: Config | None = None) -> DataFrame:
    """The accuracy filter on a streaming DataFrame of pings."""
    return filter_accuracy(pings, config or Config())
