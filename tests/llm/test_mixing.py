"""Mixing: targets, permutations and blocks against plain Python."""

import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import mixing
from waymark.llm.common import word_count


def water_filled(sizes, weights, repeats=3):
    """Targets that share sum(sizes) by weight and stop at repeats times a size."""
    targets, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        scale = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * scale > repeats * sizes[i]]
        for i in over or open_:
            targets[i] = float(repeats * sizes[i]) if over else weights[i] * scale
            left -= targets[i] if over else 0
        open_ = [i for i in open_ if i not in over] if over else []
    return targets


def hashed(*values, seed=42):
    """The engine's 64-bit hash of columns of whole numbers (bytes of 4 or 8) and strings; a null leaves it as it is."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def long(x):
    return struct.pack("<q", x)


def whole(x):
    return struct.pack("<i", x)


def permuted(x, n, key):
    if n <= 1:
        return x
    s = math.isqrt(n - 1) + 1
    while True:
        left, right = divmod(x, s)
        for i in range(mixing.ROUNDS):
            left, right = right, (left + hashed(long(right), whole(i), long(key)) % s) % s
        x = left * s + right
        if x < n:
            return x


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 100], [0, 0], [], [7], [1, 500, 1, 900, 2, 0, 40], [1, 1, 1, 1, 10_000]])
def test_targets(spark, sizes):
    totals = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long").repartition(3)
    got = sorted(mixing._targets(totals, mixing.WEIGHTS, 3).collect())
    want = water_filled(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert [r["source_size"] for r in got] == sizes and [r["target"] for r in got] == pytest.approx(want, rel=1e-12)


def test_many_sources_in_order(spark):
    """Weights go by code points over all parts of a sorted table, the null source last."""
    names = [chr(0x20 + i % 90) + chr(0x10000 + i) + "é" for i in range(500)]
    totals = spark.createDataFrame([(n, 100) for n in names] + [(None, 100)], "source string, source_size long").repartition(7)
    got = {r["source"]: r["target"] for r in mixing._targets(totals, mixing.WEIGHTS, 3).collect()}
    order = [*sorted(names, key=lambda s: [ord(c) for c in s]), None]
    assert all(got[s] == pytest.approx(water_filled([100] * 501, [mixing.WEIGHTS[i % 3] for i in range(501)])[i]) for i, s in enumerate(order))


def test_permutations(spark):
    rows = [(x, n, key) for n in (1, 2, 3, 5, 10, 50, 101, 128, 997) for key in (1, -77) for x in range(n)]
    got = spark.createDataFrame(rows, "x long, n long, key long").select("x", "n", "key", mixing.permuted(F.col("x"), F.col("n"), F.col("key")).alias("y")).collect()
    for r in got:
        assert r["y"] == permuted(r["x"], r["n"], r["key"])
    for n, key in {(n, key) for _, n, key in rows}:
        assert sorted(r["y"] for r in got if (r["n"], r["key"]) == (n, key)) == list(range(n))


def test_permutations_are_uniform(spark):
    """Over many keys, each number goes to each place about equally often, and neighbours part."""
    n, keys = 11, 3000
    got = spark.range(n * keys).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("key")).select("x", "key", mixing.permuted(F.col("x"), F.lit(n), F.xxhash64("key")).alias("y")).collect()
    seen = Counter((r["x"], r["y"]) for r in got)
    expected = keys / n
    assert sum((seen[x, y] - expected) ** 2 / expected for x in range(n) for y in range(n)) < 170  # 100 degrees of freedom
    place = {(r["x"], r["key"]): r["y"] for r in got}
    steps = Counter((place[x + 1, k] - place[x, k]) % n for k in range(keys) for x in range(n - 1))
    assert max(steps.values()) < 1.2 * keys * (n - 1) / (n - 1)


def table(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range((i * 37) % 90)) + (" \n" if i % 3 else ""), (None, "b", "a", "b")[i % 4]) for i in range(60)]
    rows += [rows[7], (7, "other words of a repeated id", "b"), (None, "no id at all", "a"), (None, None, "a"), (200, None, None), (201, "", "z"), (300, "long " * 4000, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def replayed(rows, block, shards, seed):
    """The mix, block by block: {(shard, slot): (source, turn, block, [(doc_id, first, last)])} without the shards' draws."""
    import numpy as np

    docs = {}
    for i, t, s in rows:
        docs.setdefault(s, []).append((i, t))
    names = sorted((s for s in docs if s is not None)) + [None] * (None in docs)
    sizes = [sum(len((t or "").split()) for _, t in docs[s]) for s in names]
    targets = water_filled(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    out, at = {}, Counter()
    drawn = []
    for s, n, target in zip(names, sizes, targets, strict=True):
        want = min(3 * n, round(target))
        full = want // n if n else 0
        n_blocks, rest = -(-n // block), want - full * n
        total = full * n_blocks + -(-rest // block)
        counts = np.random.default_rng(xxhash.xxh64_intdigest(repr((seed, s)))).multinomial(total, np.full(shards, 1 / shards))
        k = 0
        for shard, c in enumerate(counts.tolist()):
            drawn += [(shard, s, k + j, n, full, n_blocks, rest) for j in range(c)]
            k += c
    per_shard = Counter(d[0] for d in drawn)
    for shard, s, k, n, full, n_blocks, rest in drawn:
        turn, inside = divmod(k, n_blocks)
        m = n_blocks if turn < full else n // block
        key = hashed(None if s is None else s.encode(), long(turn), whole(seed))
        b = permuted(inside, m, key) if inside < m else inside
        words = min(block, n - b * block) if turn < full else min(block, rest - inside * block, n - b * block)
        slot = permuted(at[shard], per_shard[shard], hashed(whole(shard), whole(seed)))
        at[shard] += 1
        out[shard, slot] = (s, turn, b, words)
    return out


def test_blocks_against_a_replay(spark):
    docs = table(spark)
    rows = [tuple(r) for r in docs.collect()]
    got = [r.asDict(recursive=True) for r in mixing.blocks(docs, block=16, shards=3).collect()]
    want = replayed(rows, 16, 3, 17)
    assert {(r["shard"], r["slot"]): (r["source"], r["turn"], r["block"], len(r["text"].split())) for r in got} == want
    for shard in range(3):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append((t or "").split())
    for r in got:
        assert 0 < len(r["text"].split()) <= 16
        at, words = 0, []
        for p in r["parts"]:
            assert p["at"] == at
            at += p["last"] - p["first"]
            part = r["text"].split()[p["at"] : at]
            assert part in [t[p["first"] : p["last"]] for t in texts[p["doc_id"]]]
            words += part
        assert words == r["text"].split()
    other = mixing.blocks(docs, block=16, shards=3, seed=18).select("shard", "slot", "source", "block").collect()
    assert sorted(map(str, map(tuple, other))) != sorted(str((r["shard"], r["slot"], r["source"], r["block"])) for r in got)


def test_taken_words(spark):
    docs = table(spark)
    clash = docs.selectExpr("*", "1 AS row", "2 AS size", "3 AS _row", "4 AS _copies", "5 AS taken", "6 AS doc", "7 AS block")
    got = mixing.mix(clash).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 3 * got["size"]).all()
    for s, own in got.groupby("source", dropna=False):
        assert (own["source_size"] == own["size"].sum()).all() and abs(own["taken"].sum() - own["target"].iloc[0]) <= 1
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, again[key].values)) == sorted(map(str, got[key].values))
    none = docs.limit(0)
    assert mixing.mix(none).count() == 0 and mixing.blocks(none).count() == 0 and mixing.excerpts(none).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_excerpts_keep_all_columns(spark):
    clash = table(spark).selectExpr("*", "'r' AS row", "'s' AS size", "'x' AS _row", "'c' AS _copies", "'w' AS whole", "'d' AS doc", "'g' AS ranges", "length(text) AS n_chars")
    got = mixing.excerpts(clash, block=16)
    assert got.columns == clash.columns
    target = {r["source"]: r["target"] for r in mixing.mix(clash, block=16).collect()}
    words = {r["source"]: r["sum(n)"] for r in got.withColumn("n", word_count()).groupBy("source").agg({"n": "sum"}).collect()}
    assert all(abs(words.get(s, 0) - target[s]) <= 1 for s in target)
    assert all((r["row"], r["size"], r["_row"], r["_copies"], r["whole"], r["doc"], r["ranges"]) == tuple("rsxcwdg") and r["n_chars"] == len(r["text"]) for r in got.collect())
