"""The model, its portable text and its compiled score."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput, IoError, ModelError

#: Fixed values of the format: the header line, and limits of a model that may be loaded.
HEADER = "VA_GBDT 1"
MAX_BYTES, MAX_TREES, MAX_NODES, MAX_DEPTH = 8 * 1024 * 1024, 256, 8192, 32
HOURS, NUMERIC = 24, 4


@dataclass(frozen=True)
class FeatureSchema:
    """Four-digit industry codes with blocks of their own; all others share one more block."""

    naics4: tuple[int, ...]

    @staticmethod
    def of(codes) -> FeatureSchema:
        return FeatureSchema(tuple(sorted(set(codes))))

    @property
    def dim(self) -> int:
        return NUMERIC + (len(self.naics4) + 1) * HOURS

    def bucket(self, code: Column) -> Column:
        """Number of a code's block."""
        out = F.lit(len(self.naics4))
        for i, c in enumerate(self.naics4):
            out = F.when(code == c, F.lit(i)).otherwise(out)
        return out


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Branch:
    feature: int
    threshold: float
    left: Leaf | Branch
    right: Leaf | Branch


Node = Leaf | Branch


def _number(x: float) -> str:
    """Shortest decimal digits that give x back, never with an exponent."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    s = format(Decimal(repr(float(x))), "f")
    return s.removesuffix(".0")


def _written(node: Node) -> str:
    if isinstance(node, Leaf):
        return f"L {_number(node.value)}"
    return f"B {node.feature} {_number(node.threshold)} {_written(node.left)} {_written(node.right)}"


def _float(token: str) -> float:
    if not re.fullmatch(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|infinity|nan)", token, re.I):
        raise ModelError(f"not a number: {token}")
    return float(token)


def _whole(token: str, most: int = 2**64 - 1) -> int:
    if not re.fullmatch(r"\+?\d+", token, re.A) or int(token) > most:
        raise ModelError(f"not a whole number in range: {token}")
    return int(token)


class _Reader:
    def __init__(self, line: str, dim: int) -> None:
        self.tokens, self.dim, self.nodes = iter(line.split()), dim, 0

    def next(self) -> str:
        token = next(self.tokens, None)
        if token is None:
            raise ModelError("a tree ends too early")
        return token

    def node(self, depth: int) -> Node:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise ModelError(f"a tree has more than {MAX_NODES} nodes")
        kind = self.next()
        if kind == "L":
            return Leaf(_float(self.next()))
        if kind != "B":
            raise ModelError(f"unknown node: {kind}")
        if depth >= MAX_DEPTH:
            raise ModelError(f"a tree is deeper than {MAX_DEPTH}")
        feature, threshold = _whole(self.next()), _float(self.next())
        if feature >= self.dim:
            raise ModelError(f"feature {feature} is not below {self.dim}")
        return Branch(feature, threshold, self.node(depth + 1), self.node(depth + 1))


def _keyed(lines, key: str) -> list[str]:
    tokens = next(lines, "").split()
    if tokens[:1] != [key]:
        raise ModelError(f"a line `{key}` is missing")
    return tokens[1:]


def _one(lines, key: str) -> str:
    values = _keyed(lines, key)
    if not values:
        raise ModelError(f"`{key}` has no value")
    return values[0]


@dataclass(frozen=True)
class GbdtModel:
    schema: FeatureSchema
    base_score: float
    learning_rate: float
    trees: tuple[Node, ...]

    def to_text(self) -> str:
        codes = "".join(f" {c}" for c in self.schema.naics4)
        head = [HEADER, f"base {_number(self.base_score)}", f"lr {_number(self.learning_rate)}", f"dim {self.schema.dim}", f"naics{codes}", f"trees {len(self.trees)}"]
        return "\n".join([*head, *map(_written, self.trees)]) + "\n"

    @staticmethod
    def from_text(text: str) -> GbdtModel:
        if len(text.encode()) > MAX_BYTES:
            raise ModelError(f"the text has more than {MAX_BYTES} bytes")
        lines = iter([x.removesuffix("\r") for x in text.split("\n") if x.strip()])
        if next(lines, None) != HEADER:
            raise ModelError("unknown header")
        base, rate, dim = _float(_one(lines, "base")), _float(_one(lines, "lr")), _whole(_one(lines, "dim"))
        schema = FeatureSchema(tuple(_whole(t, 2**32 - 1) for t in _keyed(lines, "naics")))
        n = _whole(_one(lines, "trees"))
        if dim != schema.dim:
            raise ModelError(f"dim {dim} is not the schema's width {schema.dim}")
        if n > MAX_TREES:
            raise ModelError(f"more than {MAX_TREES} trees")
        trees = []
        for _ in range(n):
            line = next(lines, None)
            if line is None:
                raise ModelError("a tree is missing")
            reader = _Reader(line, dim)
            trees.append(reader.node(0))
            if next(reader.tokens, None) is not None:
                raise ModelError("a tree line goes on after its tree")
        return GbdtModel(schema, base, rate, tuple(trees))

    def save(self, path: str | Path) -> None:
        try:
            Path(path).write_text(self.to_text(), encoding="utf-8")
        except OSError as e:
            raise IoError(str(e)) from e

    @staticmethod
    def load(path: str | Path) -> GbdtModel:
        try:
            text = Path(path).read_text(encoding="utf-8")
        except OSError as e:
            raise IoError(str(e)) from e
        return GbdtModel.from_text(text)

    def predict(self, row: list[float]) -> float:
        """Score of one difference vector."""
        if len(row) != self.schema.dim:
            raise InvalidInput(f"{len(row)} values, not {self.schema.dim}")
        total = self.base_score
        for node in self.trees:
            while isinstance(node, Branch):
                if node.feature >= len(row):
                    raise ModelError(f"feature {node.feature} is out of range")
                node = node.left if row[node.feature] <= node.threshold else node.right
            total += self.learning_rate * node.value
        return total

    def compiled(self, feature) -> Column:
        """The score as one expression; feature(i) is the column of the difference in feature i."""

        def case(node: Node) -> Column:
            if isinstance(node, Leaf):
                return F.lit(node.value)
            x = feature(node.feature)
            return F.when(~F.isnan(x) & (x <= node.threshold), case(node.left)).otherwise(case(node.right))

        total = F.lit(float(self.base_score))
        for tree in self.trees:
            total = total + F.lit(float(self.learning_rate)) * case(tree)
        return total
