"""Exact n-gram Jaccard join with prefix trees.

A document's set holds 64-bit hashes of its distinct shingles. Equal sets become one representative. All sets follow
one global order, rarest first: the order's key is a count of shingles in a fixed number of hash buckets over the
whole corpus, then the hash; any such order gives the same links, a good one keeps common shingles out of prefixes.
Two linked sets share a shingle in their prefixes. Representatives that share one there are a candidate pair, unless their
sketches (parities of hash buckets, about a bit a shingle) differ in more places than linked sets can; those of a pair
that stays fall in one family. Without the sketches families would grow faster than the corpus, as ever more sets
share some shingle by chance. A shingle in the prefixes of many sets chains them without a look at sketches.
A family is joined whole: its ordered sets become a trie, each set walks it with all partial overlaps shared along
common beginnings, and a subtree goes as soon as the sets' remaining lengths can't make up for what has been missed.
Families with many shingles are cut into bands of sizes (sets of different bands are only linked with the next band)
and these into blocks; each pair of blocks that may hold links is a task of its own.

Keys that hold many rows (a node with many neighbours, a set with many copies, a shingle in many prefixes, a large
family) are dealt over many tasks or combined before they are shuffled.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; equal rows, and different
rows with one doc_id, are documents of their own; a null doc_id comes after all others, and a class of such rows alone
has a null component_id; an empty table gives an empty result; very long texts are taken whole; other columns are
ignored, whatever their names (representatives keeps them). Two different sets are taken for one only if their 64-bit
hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, hot_keys, ship, spread_join, text_bytes, window_hashes, word_hashes, written
from .components import components, forest

SHINGLE = 4
#: Similarity of linked documents, in hundredths.
PERCENT = 85
#: Buckets of the corpus counts that order the shingles: a table of a fixed size, one byte each.
COUNT_BITS = 21
SLICES = 64
#: Bits of a set's sketch: the power of two that is no smaller than the set, within these.
SKETCH_LEAST, SKETCH_MOST = 64, 1 << 17
#: Groups of a shingle up to this size are compared by length and position pair by pair, larger ones chained by length.
PAIRWISE = 48
#: Postings that a task sorts at once, and rows of a shingle among them from which on it combines them.
POSTED, LOCAL = 300_000, 4 * PAIRWISE
#: Shingles of a block of a family: a task inserts one block and walks one.
BLOCK = 400_000
#: Bits of the members' filter for each of them, and the powers of two within which its size stays (64 MB at most).
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 20, 29
#: Numbers of a band's blocks begin at a multiple of this.
BAND = 1 << 32
#: Shingles of the groups that a task joins together.
TOGETHER = 800_000
#: Pairs of set and trie node that are walked at once.
FRONT = 400_000


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    return distinct(window_hashes(word_hashes((text or b"").lower()), width))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of an ordered set of size n among which it meets every set that it is linked with."""
    return n - -(-percent * n // 100) + 1


def most_apart(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference of two linked sets of these sizes."""
    return (n + m) * (100 - percent) // (100 + percent)


def trie_links(sets: list[np.ndarray], queries: list[np.ndarray], percent: int = PERCENT, groups: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All (query, set) pairs with 100 * intersection >= percent * union. Arrays hold ranks in the global order, ascending.

    groups: a number for each set and each query; a query meets the sets of its own group only. Each group is a trie of
    its own, and all are walked together.

    The trie is level by level: nodes of a level are the distinct beginnings of that length. The front holds pairs
    (query, node) with the number of the node's items that the query lacks and the place that the query has reached.
    """
    if not sets or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_set, of_query = groups or (np.zeros(len(sets), np.int64), np.zeros(len(queries), np.int64))
    # Big-endian bytes sort as the numbers do, with a beginning before what it begins.
    order = sorted(range(len(sets)), key=lambda i: (of_set[i], sets[i].astype(">i8").tobytes()))
    ranked = [sets[i] for i in order]
    sizes = np.array([len(s) for s in ranked])
    q_sizes = np.array([len(q) for q in queries])
    depth = int(sizes.max())
    # item[i, d]: the d-th item of set i; shared[i]: items that set i has in common with the set before it.
    shared = np.zeros(len(ranked), np.int64)
    for i in range(1, len(ranked)):
        k = min(sizes[i - 1], sizes[i])
        apart = np.flatnonzero(ranked[i - 1][:k] != ranked[i][:k])
        shared[i] = apart[0] if len(apart) else k
    edge = of_set[order]
    shared[1:][edge[1:] != edge[:-1]] = 0
    root_from, root_to = np.searchsorted(edge, of_query, "left"), np.searchsorted(edge, of_query, "right")
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(ranked)
    q_flat = np.concatenate(queries)
    q_starts = np.cumsum(q_sizes) - q_sizes
    found_q, found_s = [], []
    # Queries go in runs whose groups hold so many sets at most, counted once for each query.
    load = np.cumsum(root_to - root_from)
    lo = 0
    while lo < len(queries):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + FRONT, "right")))
        q, lo = np.arange(lo, hi), hi
        # A node is named by the first set below it; its last set follows from where the next node of the level begins.
        q = q[root_from[q] < root_to[q]]
        node, reached, missed = root_from[q], np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        below_from, below_to = root_from[q], root_to[q]
        for d in range(depth + 1):
            if not len(q):
                break
            # Sets that end at this depth are the first ones below their node.
            ends = sizes[node] == d
            if ends.any():
                a, s, r, x = q[ends], node[ends], reached[ends], missed[ends]
                both = d - x
                ok = 100 * both >= percent * (q_sizes[a] + d - both)
                found_q.append(a[ok])
                found_s.append(s[ok])
                # Equal sets are one representative, so at most one set ends at a node.
                below_from = np.where(ends, below_from + 1, below_from)
                alive = below_from < below_to
                q, reached, missed, below_from, below_to = q[alive], reached[alive], missed[alive], below_from[alive], below_to[alive]
                if not len(q):
                    break
            # Children: below_from, and every later set below that shares no more than d items with the one before it.
            heads = np.flatnonzero(shared <= d)
            first = np.searchsorted(heads, below_from, side="right")
            last = np.searchsorted(heads, below_to, side="left")
            extra = last - first
            parent = np.repeat(np.arange(len(q)), extra + 1)
            offset = np.arange(len(parent)) - np.repeat(np.cumsum(extra + 1) - (extra + 1), extra + 1)
            child = np.where(offset == 0, below_from[parent], heads[np.minimum(first[parent] + offset - 1, len(heads) - 1)] if len(heads) else 0)
            child_to = np.where(offset == extra[parent], below_to[parent], heads[np.minimum(first[parent] + offset, len(heads) - 1)] if len(heads) else 0)
            item = flat[starts[child] + d]
            pq = q[parent]
            at = _advance(q_flat, q_starts[pq], q_sizes[pq], reached[parent], item)
            hit = (at < q_sizes[pq]) & (q_flat[q_starts[pq] + np.minimum(at, q_sizes[pq] - 1)] == item)
            lacks = missed[parent] + ~hit
            # Query items passed without a match, and node items that the query lacks, are apart for good.
            skipped = at - (d + 1 - lacks) + hit
            longest = 100 * q_sizes[pq] // percent
            keep = lacks + skipped <= most_apart(q_sizes[pq], longest, percent)
            # What can still be shared is bounded by what remains of the query.
            keep &= 100 * (d + 1 - lacks + q_sizes[pq] - at - hit) >= percent * q_sizes[pq]
            q, node, reached, missed, below_from, below_to = pq[keep], child[keep], (at + hit)[keep], lacks[keep], child[keep], child_to[keep]
    a, b = np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found_s])
    return a, np.array(order)[b] if len(b) else b


def _advance(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each query, the first place from `at` on whose item is not below `item`: a search by doubling, then halving."""
    lo, hi, reach = at.copy(), at.copy(), np.ones(len(at), np.int64)
    grow = np.arange(len(at))
    while len(grow):
        inside = hi[grow] < sizes[grow]
        grow = grow[inside]
        grow = grow[flat[starts[grow] + hi[grow]] < item[grow]] if len(grow) else grow
        lo[grow] = hi[grow] + 1
        hi[grow] += reach[grow]
        reach[grow] *= 2
    hi = np.minimum(hi, sizes)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = flat[starts[open_] + mid] < item[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def sketch(s: np.ndarray) -> bytes:
    """Whether each hash bucket holds an odd number of the set's shingles; halves combine to the sketch of half the buckets."""
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << max(0, len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def surely_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the sets with these sketches: the buckets where it is odd."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def prefix_links(token: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, for each shingle, all representatives which may be linked and have it in their prefixes."""
    compared, chains = prefix_pairs(token, node, size, place, None, percent)
    return np.concatenate([compared[0], chains[0]]), np.concatenate([compared[1], chains[1]])


def prefix_pairs(token: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, before: np.ndarray | None, percent: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of small groups, and edges that chain large ones.

    before: the shingle ahead of this one in the set's order. Where both sets of a pair have the same one, this is not
    the first shingle that they share, and the pair is found at that.
    """
    order = np.lexsort((size, token))
    token, node, size, place = token[order], node[order], size[order], place[order]
    before = None if before is None else before[order]
    cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    n = np.diff(np.r_[cut, len(token)])
    out_a, out_b = [], []
    for k in range(1, PAIRWISE):
        # The k-th next of each member of a small group.
        start, width = cut[(n > k) & (n <= PAIRWISE)], n[(n > k) & (n <= PAIRWISE)]
        if not len(start):
            continue
        i = np.repeat(start, width - k) + np.arange((width - k).sum()) - np.repeat(np.cumsum(width - k) - (width - k), width - k)
        j = i + k
        ok = (100 * size[i] >= percent * size[j]) & (place[i] + place[j] <= most_apart(size[i], size[j], percent))
        if before is not None:
            ok &= (before[i] != before[j]) | (place[i] == 0) | (place[j] == 0)
        out_a.append(node[i[ok]])
        out_b.append(node[j[ok]])
    i = np.flatnonzero(np.r_[token[1:] == token[:-1], False]) if len(token) else np.zeros(0, np.int64)
    i = i[np.repeat(n, n)[i] > PAIRWISE]
    i = i[100 * size[i] >= percent * size[i + 1]]
    return (np.concatenate([np.zeros(0, np.int64), *out_a]), np.concatenate([np.zeros(0, np.int64), *out_b])), (node[i], node[i + 1])


def chained(node: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between neighbours in order of size whose sizes allow a link."""
    i = np.flatnonzero(100 * size[:-1] >= percent * size[1:])
    return node[i], node[i + 1]


def thinned(size: np.ndarray, percent: int) -> np.ndarray:
    """Places in ascending sizes such that any size which chains with one of them also chains with one that is kept."""
    kept, i = [], 0
    while i < len(size):
        kept.append(i)
        # The furthest that still chains with it, or the first of what comes after a gap.
        ahead = int(np.searchsorted(percent * size, 100 * size[i], "right")) - 1
        i = ahead if ahead > i else i + 1
    return np.array(kept, np.int64)


def combined(token: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the postings that have to meet those of other tasks, and (token, a, b) edges of shingles that many sets here have in their prefixes."""
    order = np.lexsort((size, token))
    cut = np.flatnonzero(np.r_[True, token[order][1:] != token[order][:-1]]) if len(token) else np.zeros(0, np.int64)
    n = np.diff(np.r_[cut, len(token)])
    stay, out = [order[np.repeat(n <= LOCAL, n)]], [np.zeros((3, 0), np.int64)]
    for at, k in zip(cut[n > LOCAL].tolist(), n[n > LOCAL].tolist(), strict=True):
        own = order[at : at + k]
        a, b = chained(node[own], size[own], percent)
        out.append(np.stack([np.full(len(a), token[own[0]]), a, b]))
        # As many remain that the shingle is chained, not compared pair by pair, where it is met again.
        some = np.union1d(thinned(size[own], percent), np.arange(PAIRWISE + 1))
        stay.append(own[some])
    return np.concatenate(stay), tuple(np.concatenate(out, axis=1))


class Chunks:
    """Edges of postings that come in order of shingle and size, a bounded number of rows at a time."""

    def __init__(self, percent: int, most: int = POSTED) -> None:
        self.percent, self.most = percent, most
        self.held: np.ndarray | None = None
        self.long: int | None = None  # a shingle of which the last row is held, the others being chained already

    def add(self, rows: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """rows: token, node, size and place. (member, root) pairs of what is now known."""
        compared, chains = self.pairs(rows, last)
        return forest(*(np.concatenate([compared[i], chains[i]]) for i in range(2)))

    def pairs(self, rows: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """rows: token, node, size, place and, if known, before. Distinct candidate pairs, the smaller node first, and the forest of chains."""
        self.held = rows if self.held is None else np.concatenate([self.held, rows], axis=1)
        if self.held.shape[1] < self.most and not last:
            return np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        found, compared = [], np.zeros((2, 0), np.int64)
        token = self.held[0]
        if self.long is not None and len(token):
            k = int(np.searchsorted(token, self.long, "right"))
            found.append(chained(self.held[1, :k], self.held[2, :k], self.percent))
            whole = k < len(token) or last
            self.held = self.held[:, k if whole else k - 1 :]
            self.long = None if whole else self.long
        if self.long is None and self.held.shape[1]:
            token = self.held[0]
            begin = len(token) if last else int(np.searchsorted(token, token[-1], "left"))
            if begin or last:
                own = self.held[:, :begin]
                near, far = prefix_pairs(*own[:4], own[4] if len(own) > 4 else None, self.percent)
                found.append(far)
                near = np.sort(np.stack(near), axis=0)
                near = near[:, near[0] != near[1]]
                near = near[:, np.lexsort(near)]
                compared = near[:, np.r_[True, (near[:, 1:] != near[:, :-1]).any(axis=0)][: near.shape[1]]]
                self.held = self.held[:, begin:]
            if self.held.shape[1] >= self.most:
                self.long = int(self.held[0, 0])
                found.append(chained(self.held[1], self.held[2], self.percent))
                self.held = self.held[:, -1:]
        return compared, np.stack(forest(*(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(2))))


def _signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """For each document: doc_id, key (a hash of the text), n_shingles, class (null for an empty set), component_id and n_links."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), text_bytes().alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of all sets, and this part's counts of shingles in buckets, in slices."""
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        names = ["doc_id", "key", "n", "node", "sketch", "slice", "counts"]

        def count(sets: list[np.ndarray]) -> None:
            nonlocal counts
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)

        for b in batches:
            n, node, sketches, held, held_n = [], [], [], [], 0
            for t in b.column(2):
                s = shingle_set(t.as_py(), width)
                n.append(len(s))
                node.append(_signature(s))
                sketches.append(sketch(s))
                held.append(s)
                held_n += len(s)
                if held_n > 1_000_000:
                    count(held)
                    held, held_n = [], 0
            if held_n:
                count(held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names)
        if counts.any():
            kind = np.uint16 if counts.max() < 65536 else np.int64
            parts = [x.astype(kind).tobytes() for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, pa.int64()) for _ in range(4)), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    gathered = written(texts.mapInArrow(gather, "doc_id long, key long, n long, node long, sketch binary, slice int, counts binary"), "ngram-sets")
    each = (1 << COUNT_BITS) // SLICES

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(each, np.int64)
        for part in parts:
            for raw in part["counts"]:
                total += np.frombuffer(raw, np.uint16 if len(raw) == 2 * each else np.int64)
        # Eighths of a power of two: one byte for any count.
        yield pd.DataFrame({"slice": [key[0]], "counts": [np.minimum(255, np.round(8 * np.log2(1.0 + total))).astype(np.uint8).tobytes()]})

    sums = gathered.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    table = np.zeros((SLICES, each), np.uint8)
    for r in sums:
        table[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    # 2**COUNT_BITS bytes, whatever the size of the corpus.
    common = spark.sparkContext.broadcast(table.ravel())

    rows = gathered.filter("slice is null").select("doc_id", "key", "n", "node", "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    own = rows.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch"), first.alias("first"), F.count("*").alias("copies"))
    sketched = written(own.select("node", "n", "first.none", "first.doc_id", "copies", "sketch"), "ngram-reps")
    rows, reps = rows.drop("sketch"), sketched.drop("sketch")
    hot = hot_keys(reps, "node", "copies", rows.count())

    def ordered(s: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, common.value[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))]

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles of the prefixes, `at` holding the set's size and the place in it; a row with `other` is an edge."""
        met, held, held_n = set(), [], 0
        names = ["token", "node", "at", "before", "other"]

        def out() -> Iterator[pa.RecordBatch]:
            token, node, size, place, before = np.concatenate(held, axis=1)
            stay, (by, a, b) = combined(token, node, size, place, percent)
            for at in range(0, len(stay), 100_000):
                some = stay[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(token[some]), pa.array(node[some]), pa.array(size[some] << 32 | place[some]), pa.array(before[some]), pa.nulls(len(some), pa.int64())], names)
            if len(a):
                low, high = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(low), pa.array(np.zeros(len(low), np.int64)), pa.nulls(len(low), pa.int64()), pa.array(high)], names)

        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), width)
                if len(s) and (node := _signature(s)) not in met:
                    met.add(node)
                    p = ordered(s)[: prefix_length(len(s), percent)].view(np.int64)
                    held.append(np.stack([p, np.full(len(p), node), np.full(len(p), len(s)), np.arange(len(p)), np.r_[np.int64(0), p[:-1]]]))
                    held_n += len(p)
                    if held_n >= POSTED:
                        yield from out()
                        held, held_n = [], 0
        if held:
            yield from out()

    # Each part of the table posts a set once; the same posting from several parts makes no edge of its own.
    posted = texts.select("text").mapInArrow(postings, "token long, node long, at long, before long, other long").repartition("token").sortWithinPartitions("token", "at")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) with a < b; `sure` ones are chained."""
        chunks = Chunks(percent)

        def out(found: np.ndarray, sure: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, found.shape[1], 100_000):
                a, b = np.sort(found[:, at : at + 100_000], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])

        def both(compared: np.ndarray, chains: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from out(compared, False)
            yield from out(chains, True)

        for b in batches:
            other = b.column(4)
            is_edge = other.is_valid().to_numpy(zero_copy_only=False)
            if is_edge.any():
                yield from out(np.stack([b.column(1).filter(other.is_valid()).to_numpy(), other.drop_null().to_numpy()]), True)
            token, node, place, before = (b.column(i).filter(other.is_null()).to_numpy() for i in range(4))
            yield from both(*chunks.pairs(np.stack([token, node, place >> 32, place & 0xFFFFFFFF, before])))
        yield from both(*chunks.pairs(np.zeros((5, 0), np.int64), True))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chained pairs, and those whose sketches allow a link."""
        for b in batches:
            sure, n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in ("sure", "n_a", "n_b"))
            most = most_apart(n, m, percent)
            ok = [s or surely_apart(x.as_py(), y.as_py()) <= k for s, x, y, k in zip(sure.tolist(), b.column("sketch_a"), b.column("sketch_b"), most.tolist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    candidates = posted.mapInArrow(edges, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))
    for side in "ab":
        candidates = candidates.join(sketched.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    families = components(candidates.mapInArrow(alike, "a long, b long"))
    # Sizes of linked sets are within one band or neighbouring ones (which are a little wider, for rounding's sake).
    band = F.floor(F.log("n") / F.lit(1.0001 * float(np.log(100 / percent)))).cast("long")
    members = written(families.join(reps, "node").withColumn("band", band), "families")
    bands = members.groupBy("root", "band").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    blocks = F.ceil(F.col("shingles") / BLOCK).cast("long")
    sized = bands.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct(F.col("band"), blocks))).alias("blocks"), F.sum("shingles").alias("shingles"), F.sum("sets").alias("sets"))
    large = hot_keys(sized, "root", "sets", members.count())
    placed = spread_join(members.select("root", "node", "band", "copies"), sized.drop("sets"), ["root"], F.xxhash64("node"), large)
    of = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0).cast("long"))
    numbers = lambda b: F.when(of(b) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(of(b), F.lit(1)) - 1), lambda k: b * BAND + k)).otherwise(F.array().cast("array<long>"))
    cut = F.col("shingles") > BLOCK
    placed = placed.withColumn("block", F.when(cut, F.col("band") * BAND + F.pmod(F.xxhash64("node"), of(F.col("band")))).otherwise(0))
    # Each pair of blocks of a band or of neighbouring bands is a group; a small family is one group.
    pair = lambda x, y: F.struct(x.alias("i"), y.alias("j"))
    own = F.transform(numbers(F.col("band")), lambda k: pair(F.least("block", k), F.greatest("block", k)))
    above = F.transform(numbers(F.col("band") + 1), lambda k: pair(F.col("block"), k))
    below = F.transform(numbers(F.col("band") - 1), lambda k: pair(k, F.col("block")))
    groups = F.when(cut, F.concat(own, above, below)).otherwise(F.array(pair(F.lit(0).cast("long"), F.lit(0).cast("long"))))
    placed = placed.withColumn("group", F.explode(groups)).select("node", "root", "block", "copies", "group.i", "group.j")
    # Which sets are members goes to all tasks as a filter of bounded size; what it lets through by chance goes in the join.
    bits = 1 << min(FILTER_MOST, max(FILTER_LEAST, (FILTER_BITS * members.count()).bit_length()))
    spot = F.col("node").bitwiseAND(bits - 1) + 1
    maps = members.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("map")).collect()
    flags = np.zeros(bits // 8, np.uint8)
    for r in maps:
        flags[4096 * (r["bucket"] - 1) : 4096 * r["bucket"]] = np.frombuffer(r["map"], np.uint8)
    member = spark.sparkContext.broadcast(flags)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of members, once for each part of the table."""
        met, flags = set(), member.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                out = []
                for t in b.column(0)[lo : lo + 500]:
                    s = shingle_set(t.as_py(), width)
                    node = _signature(s)
                    spot = node & (bits - 1)
                    if flags[spot >> 3] >> (spot & 7) & 1 and len(s) and node not in met:
                        met.add(node)
                        out.append((node, ordered(s).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "items"])

    sets = texts.select("text").mapInArrow(rebuilt, "node long, items binary")

    def join_groups(held: list[tuple]) -> pa.RecordBatch:
        """held: (group, node, items, copies, block) of whole groups."""
        numbers = {g: k for k, g in enumerate(dict.fromkeys(x[0] for x in held))}
        group = np.array([numbers[x[0]] for x in held])
        node, weight, block = (np.array([x[k] for x in held], np.int64) for k in (1, 3, 4))
        raw = [np.frombuffer(x[2], np.uint64) for x in held]
        items, at = np.unique(np.concatenate(raw), return_inverse=True)
        # Ranks in the global order, among the items that are here.
        place = np.empty(len(items), np.int64)
        place[np.lexsort((items, common.value[(items >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))] = np.arange(len(items))
        ranks = np.split(place[at], np.cumsum([len(x) for x in raw])[:-1])
        first = np.array([x[0][1] for x in held])
        second = np.array([x[0][2] for x in held])
        into, walk = np.flatnonzero(block == first), np.flatnonzero(block == second)
        q, s = trie_links([ranks[x] for x in into], [ranks[x] for x in walk], percent, (group[into], group[walk]))
        q, s = walk[q], into[s]
        apart = q != s
        q, s = q[apart], s[apart]
        links = np.bincount(q, weight[s], minlength=len(node)) + np.bincount(s, np.where(first[s] != second[s], weight[q], 0), minlength=len(node))
        member, low = forest(node[q], node[s])
        lookup = dict(zip(member.tolist(), low.tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array([lookup.get(x, x) for x in node.tolist()], pa.int64()), pa.array(links.astype(np.int64))], ["node", "root", "links"])

    def join_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for root, i, j, node, items, copies, block in zip(*columns, strict=True):
                if held and held[-1][0] != (root, i, j) and size > TOGETHER:
                    yield join_groups(held)
                    held, size = [], 0
                if not held or held[-1][0] != (root, i, j) or held[-1][1] != node:
                    held.append(((root, i, j), node, items, copies, block))
                    size += len(items) // 8
        if held:
            yield join_groups(held)

    whole = sets.join(placed, "node").select("root", "i", "j", "node", "items", "copies", "block")
    # Groups are whole in a part and come one after the other, so that a task holds a few of them at a time.
    dealt = whole.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    joined = written(dealt.mapInArrow(join_part, "node long, root long, links long"), "links")
    linked = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = joined.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = reps.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    nodes = written(nodes.select("node", "root", "none", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ngram-classes")
    roots = nodes.groupBy("root").agg(F.min(F.struct("none", "doc_id"))["doc_id"].alias("component_id"), F.count("*").alias("sets"))
    large = hot_keys(roots, "root", "sets", nodes.count())
    found = spread_join(nodes.select("root", "node", "n_links"), roots.drop("sets"), ["root"], F.xxhash64("node"), large)
    found = found.select("node", F.col("root").alias("class"), "component_id", "n_links")
    # A set of thousands of copies is one row of `found`: the documents' side is the one that may be skewed.
    held = rows.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    out = spread_join(held, found, ["node"], F.xxhash64("doc_id", "key") if not hot else F.monotonically_increasing_id(), hot, "left")
    own_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "class", own_id.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and n_links."""
    return _classes(docs, width, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def representatives(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, of several such rows one with the smallest text hash.

    Texts without words are linked with nothing, and stay. Rows of the same doc_id and text stay once, the one whose
    other columns are the smallest.
    """
    found = _classes(docs, width, percent)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    linked = found.filter("class is not null").groupBy("class").agg(F.min(row).alias("row")).select("row.doc_id", "row.key")
    chosen = linked.unionByName(found.filter("class is null").select("doc_id", "key").distinct()).distinct()
    # Keys without nulls: the join then takes the grouped rows as they are dealt, and texts are shuffled once.
    keyed = lambda i: [F.coalesce(i, F.lit(0)).alias("id"), i.isNull().alias("none")]
    chosen = chosen.select(*keyed(F.col("doc_id")), "key")
    rows = docs.select(*keyed(docs["doc_id"].cast("long")), F.xxhash64(docs["text"]).alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    # Equal rows are combined before the shuffle, so that many of them make no large group.
    simple = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one = F.min_by("row", F.struct(*simple)) if simple else F.first("row")
    single = rows.groupBy("id", "none", "key").agg(one.alias("row"))
    kept = single.join(chosen, ["id", "none", "key"], "left_semi")
    return kept.select("row.*")
