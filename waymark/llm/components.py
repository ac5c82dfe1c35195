"""Connected components by alternating large and small stars; edges stay in tables, never on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, hot_keys, spread_join, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) pairs with the same components as the edges a-b; the root is the component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        while not np.array_equal(further := label[label], label):
            label = further
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (or itself). A node with many of them is dealt over tasks."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hot = hot_keys(both.groupBy("a").count(), "a", "count", 2 * total)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return spread_join(both, least, ["a"], F.xxhash64("b"), hot).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them.

    Edges point to the smaller node; after a large star a node has as many smaller neighbours as neighbourhoods it lay in.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it reaches."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = digest(now)
    for _ in range(most_rounds):
        # Every larger node pointing at one root that points at nothing is the end; one aggregate shows it.
        then = written(_small_star(_large_star(now, mark[0])), "edges")
        seen = digest(then)
        erase(now)
        now, same = then, tuple(seen) == tuple(mark)
        mark = seen
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
