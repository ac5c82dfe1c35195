"""Gradient-boosted preference trees: model, text format, scoring and training."""

from .model import Branch, FeatureSchema, GbdtModel, Leaf

__all__ = ["Branch", "FeatureSchema", "GbdtModel", "Leaf"]
