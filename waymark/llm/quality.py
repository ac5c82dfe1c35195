"""Quality rules: gradient-boosted trees over document statistics, monotonic in those that only ever tell against a text.

The trees learn from `labels` (quality 0 or 1): a sample of at most TRAINING_DOCUMENTS labelled documents, those with
the smallest hashes of their ids. Statistics are those of whole texts.

Defined cases: a null text has no words and so fails the base rules; without labels nothing but the base rules
decides; equal texts give equal results; a document with contrary labels counts as bad; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import distinct, ship, text_bytes, window_hashes, word_hashes

#: The bound of the labelled sample that the trees are fit on.
TRAINING_DOCUMENTS = 6000
#: The least probability of good quality at which a document is kept.
LEAST_QUALITY = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT, REPEATED_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the sign of their effect: -1 where more of it can only lower the score.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "echoes": -1, "distinct": 0, "capitals": -1, "exclamations": -1, "digits": 0, "marks": 0, "line_length": 0}
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Capital letters of two bytes (0xC3 0x80-0x9E).
_WIDE_UPPER = re.compile(rb"\xc3[\x80-\x9e]")


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES."""
    text = text or b""
    h = word_hashes(text)
    n = len(h)
    chars = len(text) - _count(text, _CONTINUED)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= REPEATED_WINDOW:
        w = window_hashes(h, REPEATED_WINDOW)
        order = np.argsort(w)
        same = np.zeros(len(w) + 1, bool)
        np.equal(w[order][1:], w[order][:-1], out=same[1:-1])
        twice = order[same[1:] | same[:-1]]
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + REPEATED_WINDOW, -1)
            repeated = int((edge.cumsum()[:n] > 0).sum())
    word_chars, symbols = chars - _count(text, _SPACES), _count(text, SYMBOLS)
    duplicates = len(lines) - len(set(lines))
    upper = _count(text, _UPPER) + len(_WIDE_UPPER.findall(text))
    letters = max(1, upper + _count(text, _LOWER))
    some, all_chars = max(1, n), max(1, chars)
    values = [
        np.log1p(n), word_chars / some, symbols / all_chars, duplicates / max(1, len(lines)), repeated / some,
        float((h[1:] == h[:-1]).sum()) / some if n > 1 else 0.0, len(distinct(h)) / some, upper / letters,
        text.count(b"!") / all_chars, _count(text, _DIGITS) / all_chars, _count(text, b".,;:?") / all_chars, n / max(1, len(lines)),
    ]
    return [n, word_chars, symbols, duplicates, repeated], values


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> trees.Forest | None:
    """Trees from at most `most` labelled documents, chosen by hashes of their ids; None without any."""
    ship(docs.sparkSession)
    chosen = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py())[1] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("double"), text_bytes())
    rows = sample.mapInArrow(measure, "doc_id long, quality double, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return None
    return trees.fit(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows]), tuple(FEATURES.values()))


def judge(docs: DataFrame, forest: trees.Forest | None, least: float = LEAST_QUALITY) -> DataFrame:
    """For each document: doc_id, COUNTS, base_failed, kept and quality (the trees' probability)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py()) for t in b.column(1)]
            if not found:
                continue
            counts = np.array([c for c, _ in found], np.int64)
            good = shared.value.score(np.array([v for _, v in found])) if shared.value is not None else np.ones(len(found))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
            columns = [b.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (good >= least)), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(score, schema)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge() with trees fit on the labels."""
    return judge(docs, train(docs, labels))
