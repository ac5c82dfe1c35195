"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

Lengths are whole numbers up to the sequence length, so what best-fit decreasing does depends on how many pieces of
each length there are and on nothing else. The open bins are kept by remaining capacity in a segment tree; the
tightest capacity that still holds a piece is found in logarithmic time, and a run of equal pieces fills all bins of
that capacity in one move. The plan that results has a bounded number of moves, however many documents there are;
pieces look up their move by length and rank.

`pack` says where each piece of each document stands, `sequences` gives the packed sequences themselves.

Defined cases: null text is an empty document, which is the closing id alone; documents with the same doc_id, or with
none, are packed as documents of their own; pieces of equal length are taken in order of doc_id, piece and row; very
long texts are cut into pieces, nothing of them is left out; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, ship, text_bytes, written

LENGTH = 1024
CLOSING_ID = 2
#: Into so many buckets each length is cut at least to number its pieces, so that no length needs a task of its own;
#: into more of them if a bucket would hold more pieces than this in the mean.
BUCKETS, BUCKET_PIECES = 512, 1_000_000
#: Units of text whose ids a worker keeps.
KEPT = 300_000
#: White space other than single spaces and single line ends: there a unit would cut a pre-token.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_MADE: dict[str, tuple] = {}


class CapacityTree:
    """Segment tree over remaining capacities 0..most: which of them has open bins."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, has: bool) -> None:
        i = self.size + capacity
        self.any[i] = has
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Moves of best-fit decreasing over `counts[length]` pieces: (length, first rank, pieces, first bin, pieces a bin, offset)."""
    tree, open_, moves, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted((n for n, k in counts.items() if k), reverse=True):
        rank, left = 0, counts[length]
        while left:
            c = tree.tightest(length)
            if c is None:
                # A new bin stays the tightest until it is full, so equal pieces open bins one after the other.
                c, first, have = capacity, bins, -(-left // (capacity // length))
                bins += have
            else:
                first, have = open_[c].pop()
                if not open_[c]:
                    del open_[c]
                    tree.set(c, False)
            each = c // length
            used, rest = min(have, left // each), left % each if have > left // each else 0
            done = used * each + rest
            moves.append((length, rank, done, first, each, capacity - c))
            for at, n, remaining in ((first, used, c - each * length), (first + used, int(rest > 0), c - rest * length), (first + used + int(rest > 0), have - used - int(rest > 0), c)):
                if n and remaining:
                    open_.setdefault(remaining, []).append((at, n))
                    tree.set(remaining, True)
            rank, left = rank + done, left - done
    return moves


def tokenizer(path: str) -> tuple:
    """The encoder of a byte-level BPE file of the tokenizers library, the ids of units that it has made so far, the id
    of a line end, and the ids of added tokens with the pattern that finds them.

    The file's merges are its vocabulary in order of ids, so a rank-based encoder gives the ids that the tokenizers
    library gives, in a tenth of its time for words that it has not met (tests compare the two). That library looks
    for added tokens first, and what stands between them is encoded by itself.
    """
    if path not in _MADE:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take in what is around them are not supported")
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocabulary = file["model"]["vocab"]
        # Printable bytes stand for themselves in the file, the others for the characters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t) and t not in added}
        encode = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        found = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        _MADE[path] = (encode, {}, encode("\n")[0], {t: i.to_bytes(4, "little") for t, i in added.items()}, found)
    return _MADE[path]


def unsafe(text: str) -> bool:
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(p in text for p in _PAIRS) or bool(_RARE.search(text))


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each whole text (unsigned 32-bit, little-endian), those of its added tokens among them."""
    _, _, _, added, found = tokenizer(path)
    held = [found.split(t) if found and any(a in t for a in added) else [t] for t in texts]
    # Every second part of a split is an added token.
    plain = iter(_plain_ids([p for h in held for p in h[::2]], path))
    return [b"".join(added[p] if i % 2 else next(plain) for i, p in enumerate(h)) for h in held]


def _plain_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of texts without added tokens.

    A byte-level pre-tokenizer always cuts before a single space and around a single line end between other
    characters, so a text is the sum of such units; most units have been met before. Texts with other white space go
    to the tokenizer whole.
    """
    encode, kept, line_end, _, _ = tokenizer(path)
    cut = [None if unsafe(t) else t.replace("\n", " \n").split(" ") for t in texts]
    if len(kept) > KEPT:
        kept.clear()
    new = {u for c in cut if c for u in c[1:]}.difference(kept)
    # Many units go to the encoder as one text: a line end, which is an id of its own there, parts them.
    lines = [u for u in new if u[:1] == "\n"]
    for units, skip, text in ((lines, 0, "".join(lines)), (rest := list(new.difference(lines)), 1, "\n " + "\n ".join(rest))):
        found = np.array(encode(text) if units else [], "<u4")
        ends = np.flatnonzero(found == line_end)
        if len(ends) != len(units):
            raise ValueError("a single line end is not an id of its own")
        raw = found.tobytes()
        kept.update(zip(units, (raw[4 * a : 4 * z] for a, z in zip((ends + skip).tolist(), [*ends[1:].tolist(), len(found)], strict=True)), strict=True) if units else ())
    # First units have no space before them, and whole texts are seldom met again: neither is kept.
    ids = lambda t: np.array(encode(t), "<u4").tobytes()
    return [ids(t) if c is None else ids(c[0]) + b"".join(map(kept.__getitem__, c[1:])) for t, c in zip(texts, cut, strict=True)]


def pieces_of(ids: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the first piece is the one that may be shorter."""
    n = len(ids) // 4
    first = n if n <= length else (n % length or length)
    at, piece = 0, 0
    while at < n:
        size = first if piece == 0 else length
        yield piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])
        at, piece = at + size, piece + 1


def _batches(texts: list[bytes | None], most: int = 500, most_bytes: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts that are encoded together: of so many texts and bytes, but one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= most or size + len(t or b"") > most_bytes):
            yield at, i
            at, size = i, 0
        size += len(t or b"")
    if at < len(texts):
        yield at, len(texts)


def _packed(docs: DataFrame, vocabulary: str, length: int, keep_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    closing = CLOSING_ID.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in _batches(raw):
                ids = token_ids([(t or b"").decode("utf-8", "replace") for t in raw[a:z]], vocabulary)
                rows = []
                for d, own in zip(doc_ids[a:z], ids, strict=True):
                    own += closing
                    rows += [(d, *p, own[4 * p[1] : 4 * (p[1] + p[2])])[: len(names)] for p in pieces_of(own, length)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    made = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(cut, schema)
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    buckets = max(BUCKETS, -(-made.count() // BUCKET_PIECES))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(buckets)).cast("int"))
    counts = made.groupBy("length", "bucket").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    # At most `length` rows: one for each length of a piece.
    moves = plan_bins({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, length)
    plan = F.broadcast(local_table(spark, moves, "p_length", "first_rank", "pieces", "first_bin", "each", "base"))
    ranked = made.withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    # The plan has a few moves for each length, whatever the number of pieces.
    placed = ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces")))
    at = F.col("rank") - F.col("first_rank")
    return placed.select(*names, (F.col("first_bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """For each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return _packed(docs, vocabulary, length, False)


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (unsigned 32-bit, little-endian) and parts (offset, doc_id, piece, length).

    A sequence holds at most `length` ids, so none is large.
    """
    placed = _packed(docs, vocabulary, length, True)
    held = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("all"))
    whole = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", (F.length(whole) / 4).cast("long").alias("n_tokens"), whole.alias("ids"), F.transform("all", lambda x: x.dropFields("ids")).alias("parts"))
