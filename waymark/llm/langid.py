"""Language identification with a linear-chain conditional random field over words.

A word's potentials add weights of its byte n-grams (those with its edges are the affixes) and of the word itself
(the lexicon). Transitions are learned together with them on sequences that switch between languages, cut from
labelled documents. Forward-backward gives each word's distribution; a document's language is the label with the
largest share of its words, and the score is that share.

Learning uses documents whose crc32(doc_id) mod 3 is not 1 and whose lang is known: a sample of at most
TRAINING_DOCUMENTS of them, those with the smallest hashes of their ids, and of each TRAINING_CHARS characters from
its middle at most. Prediction sees the text alone, all of it.

`spans` gives the runs of words of one language within each document, `predicted` each document's language and score.

Defined cases: a null text, or one without a letter, is `und` with score 0 and has no spans; without labelled documents
all are `und`; a null doc_id is not held out, nor learned from; of rows that share a doc_id one is learned from, that
of the smallest lang and text; labels of equal mass go to the smaller one, so equal texts give equal results; other
columns are ignored, whatever their names (predicted keeps them); very long texts are labelled whole, in segments whose
messages are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, pieces_of, ship, text_bytes

#: The bounds of the labelled sample that the model is fit on.
TRAINING_DOCUMENTS, TRAINING_CHARS = 1500, 40_000
#: Rows of the weight table: n-grams share the first half, words the second.
ROWS = 1 << 17
NGRAMS = (1, 2, 3, 4)
STEPS, BATCH, SPAN = 120, 160, 32
#: Words whose potentials a worker keeps, and words that are decoded at once.
KEPT, CELLS = 250_000, 300_000
#: Texts of more bytes are labelled by themselves, cut into pieces of that size at white space.
LONG = 1_000_000
UNDETERMINED = "und"
_LETTER = re.compile("[A-Za-z]")
_ANY = re.compile(r"[^\x20\x09-\x0D]+")
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and not 9 <= b <= 13 and b != 32)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of letters; a text without a letter has none."""
    s = (text or b"").decode("utf-8", "replace")
    return _cleaned(s) if has_letter(s) else []


def has_letter(s: str) -> bool:
    return bool(_LETTER.search(s)) or (not s.isascii() and any(map(str.isalpha, s)))


def _cleaned(s: str) -> list[bytes]:
    return s.lower().encode().translate(None, _NO_LETTERS).split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table that the words use, and the number of each word's rows."""
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    rows, owners, h = [], [], np.zeros(len(flat), np.uint64)
    for n in NGRAMS:
        ahead = np.zeros(len(flat), np.uint64)
        ahead[: len(flat) - n + 1] = flat[n - 1 :]
        h = mixed(h * np.uint64(257) + ahead + np.uint64(n))
        inside = np.arange(len(flat)) + n <= ends
        rows.append((h[inside] % np.uint64(ROWS // 2)).astype(np.int64))
        owners.append(word[inside])
    whole = np.add.reduceat(mixed(flat + np.uint64(1000) * (np.arange(len(flat)) - (ends - np.repeat(sizes, sizes))).astype(np.uint64)), np.cumsum(sizes) - sizes) if len(words) else np.zeros(0, np.uint64)
    rows.append((mixed(whole) % np.uint64(ROWS // 2)).astype(np.int64) + ROWS // 2)
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owner, minlength=len(words))


def summed(weights: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each word's mean weight over its n-grams: its potentials, as (words, labels)."""
    if not len(counts):
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[rows], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)


def marginals(potentials: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward: each word's distribution over labels, (sequences, words, labels). Lengths are in descending order."""
    n, t, k = potentials.shape
    e, move = np.exp(potentials - potentials.max(axis=2, keepdims=True)), np.exp(transitions).astype(np.float32)
    forward, backward = np.zeros_like(e), np.ones_like(e)
    alive = np.searchsorted(-lengths, -np.arange(t), side="left")
    for i in range(t):
        m = alive[i]
        x = e[:m, i] * (np.exp(start) if i == 0 else forward[:m, i - 1] @ move)
        forward[:m, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        m = alive[i + 1]
        x = (e[:m, i + 1] * backward[:m, i + 1]) @ move.T
        backward[:m, i] = x / x.sum(axis=1, keepdims=True)
    out = forward * backward
    return out / np.maximum(out.sum(axis=2, keepdims=True), 1e-30)


def long_marginals(potentials: np.ndarray, start: np.ndarray, transitions: np.ndarray, segment: int = CELLS) -> Iterator[np.ndarray]:
    """marginals() of one long sequence (words, labels), segment by segment from the last to the first.

    A first walk keeps what goes forward into each segment; the second one computes a segment's messages again.
    """
    move = np.exp(transitions).astype(np.float32)
    cuts = list(range(0, len(potentials), segment))

    def forward(at: int, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = potentials[at : at + segment]
        e = np.exp(p - p.max(axis=1, keepdims=True))
        out = np.empty_like(e)
        for i in range(len(e)):
            x = e[i] * ahead
            out[i] = x / x.sum()
            ahead = out[i] @ move
        return e, out

    ahead, into = np.exp(start).astype(np.float32), []
    for at in cuts:
        into.append(ahead)
        ahead = forward(at, ahead)[1][-1] @ move
    behind = np.ones(len(start), np.float32)
    for at, ahead in zip(reversed(cuts), reversed(into), strict=True):
        e, out = forward(at, ahead)
        for i in range(len(e) - 1, -1, -1):
            out[i] *= behind
            behind = (e[i] * behind) @ move.T
            behind /= behind.sum()
        yield out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


@dataclass(frozen=True)
class Crf:
    labels: tuple[str, ...]
    weights: np.ndarray
    start: np.ndarray
    transitions: np.ndarray

    def _meet(self, words: Iterable[bytes], kept: dict[bytes, int], table: list[np.ndarray]) -> None:
        """Put the potentials of new words into the table."""
        if len(kept) > KEPT:
            kept.clear()
            table.clear()
        new = sorted(set(words).difference(kept))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            kept.update(zip(part, range(len(kept), len(kept) + len(part)), strict=True))
            table.append(summed(self.weights, *features(part)))
        if len(table) > 1:
            table[:] = [np.concatenate(table)]

    def masses(self, docs: list[list[bytes]], kept: dict[bytes, int], table: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(documents, their lengths, distributions of their words) of those with words, the longest first. kept, table: potentials of words met so far."""
        if not self.labels:
            return
        self._meet((w for d in docs for w in d), kept, table)
        order = sorted((i for i, d in enumerate(docs) if d), key=lambda i: -len(docs[i]))
        while order:
            longest = len(docs[order[0]])
            some, order = order[: max(1, CELLS // longest)], order[max(1, CELLS // longest) :]
            lengths = np.array([len(docs[i]) for i in some])
            at = np.zeros((len(some), longest), np.int64)
            for r, i in enumerate(some):
                at[r, : lengths[r]] = np.fromiter(map(kept.__getitem__, docs[i]), np.int64, lengths[r])
            yield some, lengths, marginals(table[0][at], lengths, self.start, self.transitions)

    def shares(self, docs: list[list[bytes]], kept: dict[bytes, int], table: list[np.ndarray]) -> np.ndarray:
        """The share of each label in each document's words."""
        out = np.zeros((len(docs), len(self.labels)))
        for some, lengths, mass in self.masses(docs, kept, table):
            out[some] = np.where((np.arange(mass.shape[1]) < lengths[:, None])[:, :, None], mass, 0).sum(axis=1, dtype=np.float64) / lengths[:, None]
        return out

    def long_masses(self, text: bytes, kept: dict[bytes, int], table: list[np.ndarray], size: int = LONG) -> Iterator[np.ndarray]:
        """Distributions of a long text's words, the last ones first; nothing if it has no letter."""
        held, letters = [], False
        for piece in pieces_of(text, size):
            s = piece.decode("utf-8", "replace")
            letters = letters or has_letter(s)
            words = _cleaned(s)
            if words and self.labels:
                self._meet(words, kept, table)
                held.append(table[0][np.fromiter(map(kept.__getitem__, words), np.int64, len(words))])
        return long_marginals(np.concatenate(held), self.start, self.transitions) if held and letters else iter(())

    def long_shares(self, text: bytes, kept: dict[bytes, int], table: list[np.ndarray], size: int = LONG) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for mass in self.long_masses(text, kept, table, size):
            total += mass.sum(axis=0, dtype=np.float64)
            n += len(mass)
        return total / max(1, n)


def fit(texts: list[list[bytes]], langs: list[str], seed: int = 3) -> Crf:
    """A field fit by stochastic gradients on sequences of SPAN words that are pieced together from several documents."""
    labels = tuple(sorted(set(langs)))
    docs = [(np.array(range(len(d))), labels.index(y), d) for d, y in zip(texts, langs, strict=True) if d]
    k, rng = len(labels), np.random.default_rng(seed)
    weights, start, moves = np.zeros((ROWS, k), np.float32), np.zeros(k), np.zeros((k, k))
    if not docs:
        return Crf((), weights, start, moves)
    by_label = {y: [d for _, z, d in docs if z == y] for y in range(k)}
    held = sorted(y for y in by_label if by_label[y])
    squares, sq_start, sq_moves = np.full((ROWS, k), 1e-4, np.float32), np.full(k, 1e-2), np.full((k, k), 1e-2)
    for _ in range(STEPS):
        words, gold = [], np.zeros((BATCH, SPAN), np.int64)
        for b in range(BATCH):
            at = 0
            while at < SPAN:
                y = held[rng.integers(len(held))]
                d = by_label[y][rng.integers(len(by_label[y]))]
                n = min(SPAN - at, int(rng.integers(6, SPAN + 1)))
                i = int(rng.integers(max(1, len(d) - n + 1)))
                part = (d[i : i + n] * n)[:n]
                words += part
                gold[b, at : at + n] = y
                at += n
        rows, counts = features(words)
        scores = summed(weights, rows, counts).reshape(BATCH, SPAN, k)
        lengths = np.full(BATCH, SPAN)
        p = marginals(scores, lengths, start, moves)
        wrong = p - np.eye(k, dtype=np.float32)[gold]
        # Expected transitions: forward times potential times backward, from the marginals' own recursions.
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        pair = np.zeros((k, k))
        back = np.ones((BATCH, k))
        forward = _forward(e, start, moves)
        for i in range(SPAN - 1, 0, -1):
            joint = forward[:, i - 1, :, None] * np.exp(moves)[None] * (e[:, i] * back)[:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = (e[:, i] * back) @ np.exp(moves).T
            back /= back.sum(axis=1, keepdims=True)
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g = (wrong.reshape(-1, k) / np.sqrt(counts)[:, None] / BATCH).astype(np.float32)
        used, inverse = np.unique(rows, return_inverse=True)
        per_row = np.repeat(g, counts, axis=0)
        grad = np.stack([np.bincount(inverse, per_row[:, c], minlength=len(used)) for c in range(k)], axis=1).astype(np.float32)
        squares[used] += grad**2
        weights[used] -= 0.5 * grad / np.sqrt(squares[used])
        for value, total, gradient in ((start, sq_start, wrong[:, 0].sum(axis=0) / BATCH), (moves, sq_moves, (pair - seen) / BATCH)):
            total += gradient**2
            value -= 0.2 * gradient / np.sqrt(total)
    return Crf(labels, weights, start, moves)


def _forward(e: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    out = np.zeros(e.shape)
    for i in range(e.shape[1]):
        x = e[:, i] * (np.exp(start) if i == 0 else out[:, i - 1] @ np.exp(moves))
        out[:, i] = x / x.sum(axis=1, keepdims=True)
    return out


def held_out() -> Column:
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1, F.lit(False))


def train(docs: DataFrame, most: int = TRAINING_DOCUMENTS, chars: int = TRAINING_CHARS) -> Crf:
    """A model from at most `most` labelled documents that are not held out, chosen by hashes of their ids, and `chars` characters of each."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    middle = F.substring(F.col("text"), F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2).cast("int") + 1), F.lit(chars))
    chosen = known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.struct("lang", middle.cast("binary").alias("text")).alias("row"))
    # A null sorts first, so a row with a text is preferred where a doc_id has several.
    rows = chosen.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("row.text").isNotNull(), F.col("row"))), F.min("row")).alias("row")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([words_of(r["row"]["text"]) for r in rows], [r["row"]["lang"] for r in rows])


def _runs(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are labelled together: 500 texts and LONG bytes at most, or one long text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > at and (i - at >= 500 or size + n > LONG):
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def predicted(docs: DataFrame, model: Crf, name: str) -> DataFrame:
    """docs with a column `name`: a struct of lang and score. Only texts go to Python, all other columns stay where they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf, kept, table = shared.value, {}, []
        for texts in arrays:
            langs, scores = [], []
            raw = texts.to_pylist()
            for a, z in _runs(raw):
                some = raw[a:z]
                if not crf.labels:
                    shares = np.zeros((z - a, 1))
                elif len(some[0] or b"") > LONG:
                    shares = crf.long_shares(some[0], kept, table)[None]
                else:
                    shares = crf.shares([words_of(t) for t in some], kept, table)
                best = shares.argmax(axis=1)
                for s, i in zip(shares, best, strict=True):
                    langs.append(crf.labels[i] if s[i] > 0 else UNDETERMINED)
                    scores.append(min(1.0, float(s[i])))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # So that the optimizer never evaluates it twice.
    found = _arrow(label, "struct<lang:string,score:double>").asNondeterministic()
    return docs.withColumn(name, found(text_bytes()))


def _arrow(run: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str):
    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def identify(docs: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """For each document: doc_id, held_out, lang_pred and score."""
    found = predicted(docs.select("doc_id", "text"), train(docs, most), "found")
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def word_runs(text: bytes | None, crf: Crf, kept: dict[bytes, int], table: list[np.ndarray]) -> list[dict]:
    """Runs of adjacent words of one label: where a run begins and ends (code points), the label, its words and their mean probability."""
    mass = list(crf.long_masses(text or b"", kept, table))
    if not mass:
        return []
    mass = np.concatenate(mass[::-1])
    label = mass.argmax(axis=1)
    # Places of the words: those that hold nothing but signs and digits are no words of the field.
    places = [m.span() for m in _ANY.finditer(text.decode("utf-8", "replace")) if _cleaned(m[0])]
    edges = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    out = []
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(label)], strict=True):
        out.append({"start": places[a][0], "end": places[z - 1][1], "lang": crf.labels[label[a]], "n_words": z - a, "probability": float(mass[a:z, label[a]].mean(dtype=np.float64))})
    return out


SPANS = "array<struct<start:int,end:int,lang:string,n_words:int,probability:double>>"


def spans(docs: DataFrame, model: Crf) -> DataFrame:
    """For each document: doc_id and the spans of its languages, in order of the text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("probability", pa.float64())]))

    def label(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf, kept, table = shared.value, {}, []
        for texts in arrays:
            yield pa.array([word_runs(t.as_py(), crf, kept, table) for t in texts], kind)

    return docs.select("doc_id", _arrow(label, SPANS).asNondeterministic()(text_bytes()).alias("spans"))
