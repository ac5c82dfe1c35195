"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after rotations that are learned (iterative quantisation) on a bounded sample. The
largest inner product is a nearest direction once each candidate has a further component that fills its norm up to
the largest one. Codes are cut into substrings of eight bits, each of them indexed by lists of the codes in a bucket.
The pigeonhole principle says how far each substring is probed: a code within Hamming radius r of a query is within
its bound in one substring at least, if the bounds and one more for each substring add up to more than r. Probing
these buckets retrieves every code within r; those are ranked by their original vectors. The radius is what the
sample's own neighbours ask for.

Candidates and queries are dealt in blocks by hash, every row is indexed, and each pair of blocks is a task of its own
whose size doesn't depend on the table.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do those
of another length than most; equal scores go to the smaller vec_id; rows that repeat a vec_id are candidates of their
own, but never of a query of that id, and such queries are answered as one (the smallest vector of the id asks); rows
with a null vec_id take no part; if a block's buckets hold fewer codes than are asked for, all its codes are ranked;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

#: Vectors that rotations and radius are fit on.
SAMPLE = 8192
BITS = 128
#: Rows of a block at most; small tables are cut into smaller ones, so that all cores have some.
BLOCK, LEAST = 32_768, 2_048
NEIGHBOURS, QUERY_EVERY = 20, 20
#: The part of the sample's true neighbours that the radius has to cover.
COVERED = 0.97
#: Probed buckets from which on their codes are looked up, not listed.
MANY = 16
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass(frozen=True)
class Codes:
    rotation: np.ndarray  # (dimensions + 1, bits)
    longest: float
    radius: int

    def of(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Codes as bytes, one for each substring."""
        return np.packbits(_filled(v, self.longest, query) @ self.rotation > 0, axis=1)


def _filled(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    if query:
        return np.hstack([v / np.maximum(norm, 1e-300), np.zeros((len(v), 1))])
    return np.hstack([v / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))])


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order: equal vectors have equal scores."""
    return (vectors * query).sum(axis=1)


def fit(sample: np.ndarray, longest: float, bits: int = BITS, seed: int = 9) -> Codes:
    x = _filled(sample, longest, False)
    rng, parts, d = np.random.default_rng(seed), [], x.shape[1]
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(12):
            u, _, w = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ w).T
        parts.append(r)
    codes = Codes(np.hstack(parts)[:, :bits], longest, bits)
    held = np.flatnonzero(np.arange(len(sample)) % max(1, len(sample) // 256) == 0)
    asked, all_codes, apart = codes.of(sample[held], True), codes.of(sample, False), []
    for code, i in zip(asked, held, strict=True):
        scores = products(sample, sample[i])
        scores[i] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(NEIGHBOURS, len(sample) - 1)]
        apart.append(np.bitwise_count(all_codes[near] ^ code).sum(axis=1, dtype=np.int64))
    apart = np.concatenate(apart) if apart else np.zeros(0)
    return Codes(codes.rotation, longest, int(np.quantile(apart, COVERED, method="higher")) if len(apart) else bits)


def bounds(radius: int, substrings: int) -> list[int]:
    """How far each substring is probed: radius + 1 is dealt evenly, and a bound is one less than its part (-1: not at all)."""
    each, more = divmod(min(radius, 8 * substrings) + 1, substrings)
    return [min(8, each - 1 + (t < more)) for t in range(substrings)]


class Index:
    """Codes by the value of each substring: the places of a bucket's codes stand together."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.whole = np.ascontiguousarray(codes).view(np.uint64)
        self.columns = np.ascontiguousarray(codes.T)
        self.places = [np.argsort(codes[:, t], kind="stable").astype(np.int32) for t in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[:, t][p], np.arange(257)) for t, p in enumerate(self.places)]

    def buckets(self, t: int, value: int, bound: int) -> np.ndarray:
        """Places of the codes whose substring t is within the bound of the value."""
        start = self.starts[t]
        return np.concatenate([self.places[t][start[v] : start[v + 1]] for v in np.flatnonzero(_NEAR[value] <= bound)] or [self.places[t][:0]])

    def marked(self, t: int, value: int, bound: int) -> np.ndarray:
        """The same as flags; where many buckets are probed, it is quicker to look up each code's bucket among them."""
        probed = _NEAR[value] <= bound
        if probed.sum() > MANY:
            return probed[self.columns[t]]
        out = np.zeros(len(self.codes), bool)
        out[self.buckets(t, value, bound)] = True
        return out

    def within(self, asked: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For each query code, the places of all codes within the radius."""
        limit = bounds(radius, self.codes.shape[1])
        # What a value of a substring retrieves is the same for all queries that have it.
        seen: dict[tuple[int, int], np.ndarray] = {}
        wholes = np.ascontiguousarray(asked).view(np.uint64)
        for code, whole in zip(asked.tolist(), wholes, strict=True):
            hit = np.zeros(-(-len(self.codes) // 8), np.uint8)
            for t, value in enumerate(code):
                if limit[t] >= 0:
                    if (t, value) not in seen:
                        seen[t, value] = np.packbits(self.marked(t, value, limit[t]))
                    hit |= seen[t, value]
            found = np.flatnonzero(np.unpackbits(hit, count=len(self.codes)))
            some = self.whole if len(found) == len(self.codes) else self.whole[found]
            apart = np.bitwise_count(some[:, 0] ^ whole[0])
            for k in range(1, len(whole)):
                apart += np.bitwise_count(some[:, k] ^ whole[k])
            yield found[apart <= radius]


def search(codes: Codes, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, its k nearest candidates of the block, their scores) for each query."""
    index = Index(codes.of(vectors, False))
    for query_id, query, found in zip(query_ids, queries, index.within(codes.of(queries, True), codes.radius), strict=True):
        found = found[ids[found] != query_id]
        if len(found) < k:
            found = np.flatnonzero(ids != query_id)
        scores = products(vectors[found], query)
        if len(found) > 4 * k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            found, scores = found[some], scores[some]
        best = np.lexsort((ids[found], -scores))[:k]
        yield int(query_id), ids[found][best], scores[best]


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nearest(table: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest candidates; queries are the ids that `every` divides."""
    spark = table.sparkSession
    ship(spark)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    rows = written(rows.withColumn("d", F.size("v")).withColumn("square", square), "vectors")
    kinds = rows.groupBy("d").agg(F.count("*").alias("n"), F.max("square").alias("longest"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asked")).orderBy(F.desc("n"), "d").first()
    if kinds is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("d") == kinds["d"]).select("vec_id", "v")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    codes = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in sorted(sample, key=lambda r: (r["vec_id"], r["v"]))], float), float(np.sqrt(kinds["longest"])) * (1 + 1e-12)))
    cores = spark.sparkContext.defaultParallelism
    n_base, n_query = (max(1, -(-n // block), min(most, -(-n // LEAST))) for n, most in ((kinds["n"], cores), (kinds["asked"], 1)))
    part = lambda n, *by: F.pmod(F.xxhash64("vec_id", *by), F.lit(n)).cast("int")
    # Copies of one vec_id, however many, are dealt by their vectors; an id asks once.
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    base = rows.withColumn("b", part(n_base, F.lit(1), F.monotonically_increasing_id())).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    asked = asked.withColumn("q", part(n_query, F.lit(2))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))))

    def one_block(left: pa.Table, right: pa.Table) -> pa.Table:
        as_matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float)
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = list(search(codes.value, left["vec_id"].to_numpy(), as_matrix(left), right["vec_id"].to_numpy(), as_matrix(right), k))
        return pa.table({"query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64), "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    best = base.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(one_block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
