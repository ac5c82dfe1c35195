"""Each stage on what its predecessor keeps, and on odd rows and columns."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from waymark.llm import mixing  # noqa: E402
from waymark.llm.common import shared_dir, word_count, written  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that the operators use, or once used, for columns of their own.
CLASHES = ("_text", "score", "lang_pred", "_found", "found", "base", "added", "_spans", "_base", "_copies", "_size", "_row", "row", "node", "key", "_key", "_doc_id", "class", "salt", "whole", "cut", "doc", "size", "turn", "held_out")
STAGES = dict(corpus_pipeline.STAGES)


def odd_rows():
    rng = random.Random(4)
    en, de = ("the", "and", "of", "house", "river", "with", "is"), ("der", "und", "nicht", "haus", "fluss", "mit", "ist")
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=rng.randint(20, 60))) + f" {i}.", "en" if i % 2 else "de", ("a", "b", None)[i % 3], 0) for i in range(60)]
    rows += [(i + 100, rows[i][1], *rows[i][2:]) for i in range(0, 20, 2)]  # copies
    rows += [rows[5], rows[5], (7, "another text under an id that is there and with the same river", "en", "a", 1), (None, "no id but of the house and the river it is with", "en", None, 2), (None, rows[9][1], "en", "b", 3)]
    rows += [(200, None, "en", "a", None), (201, "", "de", "a", 0), (202, " \n", None, "b", 2), (203, "12 34 -- 5", "en", "b", 10), (204, 'the house and the river with password = "hunter2hunter2" in it', None, "a", 5)]
    rows += [(300, " ".join(rng.choices(en, k=40_000)) + " token=abcdefgh12345 " + " ".join(rng.choices(en, k=500)), "en", "c", 7), (301, "x" * 300_000 + " the house", "en", "c", 8)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    return docs.select("*", *(F.lit(c).alias(c) for c in CLASHES if c != "n_chars"))


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_on_odd_rows(spark, odd, name):
    """Other columns come through as they are, whatever their names, and no clean document goes without reason."""
    got = STAGES[name](spark, odd, "")
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in CLASHES)
    pairs = {(r["doc_id"], r["text"]) for r in rows}
    before = {r[:2] for r in odd_rows()}
    if name == "language ID":
        assert before - pairs == {(200, None), (201, ""), (202, " \n"), (203, "12 34 -- 5")} and len(rows) == len(odd_rows()) - 4
    if name == "n-gram Jaccard join":
        texts = {t for _, t in before}
        assert {t for _, t in pairs} == texts and len(pairs) == len(rows)
        assert len(rows) == len(texts) and all(i < 100 or i >= 200 for i, _ in pairs if i is not None)
    if name == "secret scans":
        by_id = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(odd_rows()) and by_id[204]["text"] == 'the house and the river with [SECRET]" in it' and by_id[204]["n_chars"] == len(by_id[204]["text"])
        assert "[SECRET]" in by_id[300]["text"] and "abcdefgh12345" not in by_id[300]["text"] and by_id[200]["text"] is None
        assert {p for p in before if p[0] not in (204, 300)} <= pairs
    if name == "source mixing":
        # A text without words is never taken.
        assert {r["doc_id"] for r in rows}.isdisjoint({200, 201, 202}) and all(r["text"] for r in rows)


def test_stages_of_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd.limit(0), "")
        assert got.count() == 0 and (name == "best-fit packing" or got.columns == odd.columns)


def test_stages_of_nulls(spark, odd):
    """Columns of nulls alone don't stop any stage."""
    nulls = odd.limit(8).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema))
    counts = {name: stage(spark, nulls, "").count() for name, stage in corpus_pipeline.STAGES}
    assert counts == {"language ID": 0, "n-gram Jaccard join": 1, "secret scans": 8, "source mixing": 0, "best-fit packing": 8}


def test_run_and_spent_tables(spark):
    """run() is its stages one after the other; tables that nothing reads any more are gone."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = docs
    ids = {name: {r["doc_id"] for r in d.select("doc_id").collect()} for name, d in kept.items()}
    assert len(ids["language ID"]) >= 0.98 * len(ids[""])
    assert ids["n-gram Jaccard join"] < ids["language ID"] and ids["secret scans"] == ids["n-gram Jaccard join"] and ids["source mixing"] <= ids["secret scans"]
    want = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "waymark"
    before = set(folder.iterdir())
    got = corpus_pipeline.run(spark, sf_dir)
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert left == {"source-mixing", "pieces"}
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
    assert {r["doc_id"] for r in got.collect()} == ids["source mixing"]


def test_mixed_words(spark):
    """Each source gives the words of its target, though nearly every document is longer than a block."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10 + 97 * (i % 9))) + " \n", "en", ("a", "b", "c")[i % 3], 0) for i in range(90)]
    docs = spark.createDataFrame([*rows, rows[4], (90, None, "en", "a", None)], DOCS)
    got = written(corpus_pipeline.source_mixing(spark, docs, ""), "test")
    assert got.columns == docs.columns
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    words = {r["source"]: r["sum(n)"] for r in got.withColumn("n", word_count()).groupBy("source").agg({"n": "sum"}).collect()}
    assert words.keys() == target.keys() and all(abs(words[s] - target[s]) <= 1 for s in target)
    # What is cut is a stretch of its document, and n_chars says its length.
    texts = {i: t for i, t, *_ in rows}
    for r in got.collect():
        assert r["text"] in texts[r["doc_id"]] and (r["text"] == texts[r["doc_id"]] or r["n_chars"] == len(r["text"]))
