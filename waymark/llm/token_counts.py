"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a space and a word. A vocabulary of byte strings in order of rank gives each piece a cost that grows
with the logarithm of its rank; a pre-token's tokens are those of its cheapest segmentation (of equal costs, the one
of fewest tokens). The forward cost at a byte depends on the bytes before it alone, so pre-tokens are visited in
order, as a trie's depth-first walk: costs along a shared beginning are kept and only the rest is computed. Each
terminal stores its count, and documents add up the counts of their pre-tokens.

Defined cases: a null text or one without words has no tokens; equal texts have equal counts; every single byte is a
piece, so that any text has a segmentation; other columns are ignored; very long texts are counted whole.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_bytes

#: Terminal counts that a task keeps.
KEPT = 1_000_000
#: Costs are whole millionths of a nat, above so many bits that count the pieces.
_BITS = 32


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], int]:
    """Cost of each piece of a file of base64 strings and ranks, and the length of the longest piece."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}
    return {p: (round(1e6 * math.log(r + 2)) << _BITS) + 1 for p, r in ranks.items()}, max(map(len, ranks))


def terminal_counts(pretokens: Iterable[bytes], costs: dict[bytes, int], longest: int) -> dict[bytes, int]:
    """Number of tokens of each distinct pre-token."""
    out: dict[bytes, int] = {}
    forward, before = [0], b""
    get, mask = costs.get, (1 << _BITS) - 1
    for word in sorted(set(pretokens)):
        # The walk goes back up to where this pre-token leaves the path of the one before.
        most = min(len(word), len(before))
        shared = next((i for i in range(most) if word[i] != before[i]), most)
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best = None
            for start in range(max(0, end - longest), end):
                cost = get(word[start:end])
                if cost is not None and (best is None or forward[start] + cost < best):
                    best = forward[start] + cost
            forward.append(best)
        out[word] = forward[-1] & mask
        before = word
    return out


def count(docs: DataFrame, path: str) -> DataFrame:
    """For each document: doc_id, n_pretokens, n_tokens and n_bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, longest = vocabulary(path)
        kept: dict[bytes, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                words = [t.split() for t in texts]
                if len(kept) > KEPT:
                    kept.clear()
                new = {w for d in words for w in d}.difference(kept)
                found = terminal_counts((b" " + w for w in new), costs, longest)
                kept.update((w[1:], n) for w, n in found.items())
                totals = [sum(map(kept.__getitem__, d)) for d in words]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (list(map(len, words)), totals, list(map(len, texts))))], ["doc_id", "n_pretokens", "n_tokens", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_bytes long")
