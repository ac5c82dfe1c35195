"""Language ID: the field against enumeration, long texts, spans and held-out accuracy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import langid
from waymark.llm.common import pieces_of

EN, DE = ("the", "and", "of", "thing", "where"), ("der", "und", "nicht", "schein", "über")


def small_field():
    rng = random.Random(1)
    texts = [[w.encode() for w in rng.choices(EN, k=60)] for _ in range(20)] + [[w.encode() for w in rng.choices(DE, k=60)] for _ in range(20)]
    return langid.fit(texts, ["en"] * 20 + ["de"] * 20)


def test_forward_backward():
    rng = np.random.default_rng(2)
    potentials, start, moves = rng.normal(size=(2, 4, 3)).astype(np.float32), rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    got = langid.marginals(potentials, lengths, start, moves)
    for s, n in enumerate(lengths):
        mass = np.zeros((n, 3))
        for path in np.ndindex(*(3,) * n):
            weight = math.exp(start[path[0]] + sum(potentials[s, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                mass[i, y] += weight
        assert np.allclose(got[s, :n], mass / mass.sum(axis=1, keepdims=True), atol=1e-4)
    # Segments of one sequence, from the last to the first.
    for segment in (1, 2, 3, 4, 9):
        parts = list(langid.long_marginals(potentials[0], start, moves, segment))
        assert np.allclose(np.concatenate(parts[::-1]), got[0], atol=1e-4)


def test_code_switching():
    crf = small_field()
    shares = crf.shares([[b"the", b"thing", b"and", b"nicht", b"und", b"schein", b"der", "über".encode()], [], [b"where"]], {}, [])
    assert crf.labels == ("de", "en") and abs(shares[0, 0] - 5 / 8) < 0.15 and shares[2, 1] > 0.8 and not shares[1].any()
    assert langid.fit([], []).labels == ()


def test_pieces_and_long_texts():
    rng = random.Random(2)
    text = " ".join(rng.choice(EN if i % 40 < 25 else DE) for i in range(3000)) + " 12 ...\n\n" + "x" * 500 + "\t é"
    raw = text.encode()
    for size in (1, 7, 64, 10_000, 10**6):
        cut = list(pieces_of(raw, size))
        assert b"".join(cut) == raw and [w for p in cut for w in p.split()] == raw.split()
    crf = small_field()
    want = crf.shares([langid.words_of(raw)], {}, [])[0]
    for size in (50, 1000, 10**6):
        assert np.allclose(crf.long_shares(raw, {}, [], size), want, atol=1e-5)
    assert not crf.long_shares(b"12 34 ...", {}, []).any() and not crf.long_shares(b"", {}, []).any()


def test_letters():
    assert [langid.has_letter(s) for s in ("", "12 _-", "²½Ⅷ", "²½ß", "x", "日", "٣")] == [False, False, False, True, True, True, False]


def test_spans(spark):
    crf = small_field()
    text = "The thing, and 12 the thing where of -- nicht der Schein und über nicht! the thing and of the"
    got = langid.spans(spark.createDataFrame([(1, text), (2, None), (3, "..."), (4, "")], "doc_id long, text string"), crf).collect()
    found = {r["doc_id"]: r["spans"] for r in got}
    assert found[2] == found[3] == found[4] == []
    assert [(x["lang"], text[x["start"] : x["end"]]) for x in found[1]] == [("en", "The thing, and 12 the thing where of"), ("de", "nicht der Schein und über nicht!"), ("en", "the thing and of the")]
    assert [x["n_words"] for x in found[1]] == [7, 6, 5] and all(0.5 < x["probability"] <= 1 for x in found[1])
    # The score is what the words' distributions say.
    shares = crf.shares([langid.words_of(text.encode())], {}, [])[0]
    assert abs(shares[1] - 12 / 18) < 0.1


def test_clashing_columns_and_odd_rows(spark):
    rows = [(i, " ".join(random.Random(i).choices(EN if i % 2 else DE, k=30)), "en" if i % 2 else "de") for i in range(40)]
    rows += [(3, "der und nicht", "de"), (3, None, "aa"), (None, "the thing and of", "en"), (50, None, "en"), (51, "", "de"), (52, "12 ... 3", "en"), (53, "the and", None), (4, rows[4][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' AS _text", "'b' AS score", "'c' AS lang_pred", "'d' AS held_out", "'e' AS _found", "'f' AS found")
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[None]["held_out"] is False and by_id[None]["lang_pred"] == "en"
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (50, 51, 52)) and by_id[53]["lang_pred"] == "en"
    # Which of several rows of one id is learned from doesn't depend on their order.
    models = [langid.train(docs.orderBy(F.desc("text")).repartition(n)) for n in (1, 5)]
    assert all(np.array_equal(models[0].weights, m.weights) and np.array_equal(models[0].transitions, m.transitions) for m in models)
    assert models[0].labels == ("de", "en") and langid.train(docs.limit(0)).labels == ()
    kept = langid.predicted(docs, models[0], "_new")
    assert kept.columns == [*docs.columns, "_new"] and all((r["_text"], r["score"], r["found"]) == ("a", "b", "f") for r in kept.collect())
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(d, 400).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
