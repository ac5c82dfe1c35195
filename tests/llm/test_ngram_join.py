"""The n-gram join and its parts against brute force."""

import random
import re

import numpy as np
import pytest

from waymark.llm import common, components, ngram_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_links(sets):
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(a & b) >= 85 * len(a | b)}


def labels(n, pairs):
    """The smallest member of each one's component."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def test_trie_links():
    rng = random.Random(4)
    for _ in range(30):
        sets = set()
        for _ in range(6):
            base = set(rng.sample(range(80), rng.randint(1, 40)))
            for _ in range(4):
                sets.add(frozenset(base ^ set(rng.sample(range(80), rng.randint(0, 3)))))
        sets = [s for s in sets if s]
        groups = np.array([rng.randint(0, 1) for _ in sets])
        arrays = [np.array(sorted(s), np.int64) for s in sets]
        q, s = ngram_join.trie_links(arrays, arrays, 85, (groups, groups))
        want = {(i, j) for i, j in brute_links(sets) if groups[i] == groups[j]}
        assert sorted(zip(q.tolist(), s.tolist())) == sorted(want)


def test_prefixes_meet():
    rng = random.Random(5)
    for _ in range(200):
        a = set(rng.sample(range(300), rng.randint(1, 60)))
        b = a ^ set(rng.sample(range(300), rng.randint(0, 9)))
        if b and 100 * len(a & b) >= 85 * len(a | b):
            cut = [set(sorted(x)[: ngram_join.prefix_length(len(x))]) for x in (a, b)]
            assert cut[0] & cut[1] and len(a ^ b) <= ngram_join.most_apart(np.array(len(a)), np.array(len(b)))


def test_forest():
    a, b = np.array([5, 3, 9, 9]), np.array([3, 1, 8, 8])
    member, root = components.forest(a, b)
    assert dict(zip(member.tolist(), root.tolist())) == {5: 1, 3: 1, 9: 8}
    assert not len(components.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0])


def test_thinned():
    rng = random.Random(6)
    for _ in range(200):
        size = np.array(sorted(rng.choices(range(1, rng.choice((5, 60, 900))), k=rng.randint(1, 60))))
        kept = size[ngram_join.thinned(size, 85)]
        near = lambda x, ys: any(100 * min(x, y) >= 85 * max(x, y) for y in ys)  # noqa: E731, B023
        for x in range(1, 1000):
            run = sorted([*size.tolist(), x])
            at = run.index(x)
            chains = any(100 * min(run[at], run[k]) >= 85 * max(run[at], run[k]) for k in (at - 1, at + 1) if 0 <= k < len(run))
            if chains:
                assert near(x, kept.tolist())


@pytest.mark.parametrize("most", [2, 5, 17, 10_000])
def test_chunks_join_what_one_pass_joins(most, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRWISE", 6)
    monkeypatch.setattr(ngram_join, "LOCAL", 9)
    rng = random.Random(most)
    for _ in range(20):
        rows = [(rng.choice((1, 1, 1, 2, 3, rng.randint(4, 30))), node, 3 + node % 40, rng.randint(0, 2)) for node in range(rng.randint(1, 120))]
        token, node, size, place = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        want = labels(120, zip(*(x.tolist() for x in ngram_join.prefix_links(token, node, size, place, 85)), strict=True))
        # Combined in two tasks, then in chunks.
        pairs, left = [], []
        half = np.arange(len(token)) % 2
        for part in (0, 1):
            own = np.flatnonzero(half == part)
            stay, (_, a, b) = ngram_join.combined(token[own], node[own], size[own], place[own], 85)
            pairs += list(zip(a.tolist(), b.tolist(), strict=True))
            left.append(np.stack([token, node, size, place])[:, own[stay]])
        table = np.concatenate(left, axis=1)
        table = table[:, np.lexsort((table[2], table[0]))]
        chunks = ngram_join.Chunks(85, most)
        for at in range(0, table.shape[1], 3):
            a, b = chunks.add(table[:, at : at + 3])
            pairs += list(zip(a.tolist(), b.tolist(), strict=True))
        a, b = chunks.add(np.zeros((4, 0), np.int64), True)
        got = labels(120, [*pairs, *zip(a.tolist(), b.tolist(), strict=True)])
        # Chaining joins all that comparing joins, and it is what large groups get.
        assert all(got[i] == got[j] for i in range(120) for j in range(i) if want[i] == want[j])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = common.distinct(rng.integers(0, 1 << 64, rng.integers(1, 700), np.uint64))
        b = common.distinct(np.concatenate([a[rng.random(len(a)) < rng.choice((0, 0.5, 0.95))], rng.integers(0, 1 << 64, rng.integers(0, 300), np.uint64)]))
        assert ngram_join.surely_apart(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))
        assert ngram_join.surely_apart(ngram_join.sketch(a), ngram_join.sketch(a)) == 0
    a, b = (rng.integers(0, 1 << 64, 450, np.uint64) for _ in range(2))
    assert ngram_join.surely_apart(ngram_join.sketch(a), ngram_join.sketch(b)) > ngram_join.most_apart(np.array(450), np.array(450))


def test_linked_sets_meet_at_their_first_shared_shingle():
    rng = random.Random(9)
    sets = []
    for _ in range(12):
        base = set(rng.sample(range(400), rng.randint(1, 60)))
        sets += [base ^ set(rng.sample(range(400), rng.randint(0, 4))) for _ in range(5)]
    sets = [sorted(s) for s in {frozenset(s) for s in sets} if s]
    rows = [(t, k, len(s), i, s[i - 1] if i else 0) for k, s in enumerate(sets) for i, t in enumerate(s[: ngram_join.prefix_length(len(s))])]
    table = np.array(rows, np.int64).T
    table = table[:, np.lexsort((table[2], table[0]))]
    pairs, chains = ngram_join.Chunks(85).pairs(table, True)
    want = {(i, j) for i, j in brute_links([set(s) for s in sets]) if i < j}
    assert want and not chains.shape[1] and want <= set(map(tuple, pairs.T.tolist()))


def test_chance_neighbours_make_no_families(spark, monkeypatch):
    """Each shingle is in two texts, so all texts meet in their prefixes, but no two are near each other."""
    seen = []

    def counted(edges, *more):
        seen.append(edges.count())
        return components.components(edges, *more)

    monkeypatch.setattr(ngram_join, "components", counted)
    block = lambda i, j: " ".join(f"b{min(i, j)}x{max(i, j)}w{k}" for k in range(60))
    texts = [(i, " ".join(block(i, j) for j in range(12) if j != i)) for i in range(12)]
    texts.append((12, texts[3][1] + " more"))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: (3 if i == 12 else i, int(i in (3, 12))) for i in range(13)}
    assert seen[0] == 1


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "SALTS", 4)
    rng = random.Random(7)
    edges = [(5, i) for i in range(100, 400)] + [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(150)] + [(399, 800), (800, 801), (-3, 801)]
    nodes = sorted({x for e in edges for x in e})
    want = labels(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {nodes[i]: nodes[w] for i, w in enumerate(want) if nodes[i] in linked}


def corpus():
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(n)) for n in (3, 4, 5, 12, 30, 30, 80, 200, 400)]
    rows = [(None, "no id of its own words at all"), (None, base[6]), (None, None), (900, None), (901, " \n\t"), (900, None), (902, "One Two"), (903, "one TWO"), (904, "one two three"), (905, "É é"), (906, "é É")]
    i = 0
    for text in base:
        words = text.split()
        for _ in range(14):
            w = list(words)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 6))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            rows.append((i, " ".join(w[rng.choice((0, 0, 0, 1)) :])))
            i += 1
    rows += [(3, base[7]), (3, "other words under an id that is there"), (50, rows[-1][1]), (50, rows[-1][1]), rows[20], rows[20]]
    rows += [(2000 + k, base[8]) for k in range(100)] + [(3000, base[4])] * 90
    rng.shuffle(rows)
    return rows


def brute(rows):
    """n_shingles, component_id and n_links of each row, and the rows' classes."""
    words = [WORD.findall((t or "").encode().lower()) for _, t in rows]
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for w in words]
    distinct = [set(s) for s in {frozenset(s) for s in sets if s}]
    number = {frozenset(s): k for k, s in enumerate(distinct)}
    of = [number.get(frozenset(s)) for s in sets]
    pairs = brute_links(distinct)
    low = labels(len(distinct), pairs)
    copies = [of.count(k) for k in range(len(distinct))]
    ids = {}
    for (i, _), k in zip(rows, of, strict=True):
        if k is not None:
            ids.setdefault(low[k], []).append(i)
    links = [0] * len(distinct)
    for i, j in pairs:
        links[i] += copies[j]
    out = []
    for (i, _), s, k in zip(rows, sets, of, strict=True):
        known = [x for x in ids[low[k]] if x is not None] if k is not None else []
        out.append((i, len(s), i if k is None else min(known, default=None), 0 if k is None else links[k] - 1))
    return out, [None if k is None else low[k] for k in of]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("small", [False, True])
def test_classes(spark, monkeypatch, small):
    rows = corpus()
    if small:
        # Large families in many blocks, hot keys and long shingles on a small table.
        for name, value in (("BLOCK", 500), ("POSTED", 300), ("LOCAL", 20), ("PAIRWISE", 8), ("TOGETHER", 200), ("FRONT", 50)):
            monkeypatch.setattr(ngram_join, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS key", "3 AS n", "4 AS row", "5 AS class", "6 AS salt", "7 AS root")
    got = [tuple(r) for r in ngram_join.classes(docs.repartition(5)).collect()]
    assert order(got) == order(brute(rows)[0])


def test_representatives(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "a" if k % 2 else "b", {"m": k}) for k, r in enumerate(rows)], "doc_id long, text string, _key string, other map<string,int>").selectExpr("*", "1 AS _doc_id", "2 AS row", "3 AS class")
    kept = ngram_join.representatives(docs.repartition(5))
    assert kept.columns == docs.columns
    got = [tuple(r)[:2] for r in kept.collect()]
    found, classes = brute(rows)
    assert len(set(got)) == len(got)
    by_class = {}
    for row, c in zip(rows, classes, strict=True):
        by_class.setdefault(c, set()).add(row)
    empty = by_class.pop(None)
    assert empty <= set(got)
    for own in by_class.values():
        mine = [r for r in got if r in own]
        known = [i for i, _ in own if i is not None]
        assert len(mine) == 1 and mine[0][0] == min(known, default=None)
    assert len(got) == len(empty) + len(by_class)
    # Of equal rows the one of the smallest other columns stays.
    assert {r["_key"] for r in kept.filter("doc_id = 3000").collect()} <= {"a"}


def test_representatives_shuffle_texts_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_classes", lambda docs, width, percent: docs.selectExpr("doc_id", "xxhash64(text) AS key", "doc_id AS class"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(None, "a b"), (None, None), (0, "a b"), (7, "c"), (7, "c")]
        kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
        texts, ids = kept._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].split("\n      +-")
        assert texts.count("Exchange") == 1 and ids.count("Exchange") > 1
        assert order(tuple(r) for r in kept.collect()) == order({*rows})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, row int")
    assert ngram_join.classes(none).count() == 0 and ngram_join.representatives(none).count() == 0 and ngram_join.representatives(none).columns == none.columns
    nulls = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert order(tuple(r) for r in ngram_join.classes(nulls).collect()) == [(1, 0, 1, 0), (2, 0, 2, 0), (None, 0, None, 0)]
    assert ngram_join.representatives(nulls).count() == 3
