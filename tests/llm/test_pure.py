"""Parts without Spark, against brute force."""

import base64
import math
import random

import numpy as np
import pytest

from waymark.llm import html_extract, packing, quality, token_counts, trees
from waymark.llm.common import LONG_WORD, PIECE, distinct, window_hashes, word_hashes


def test_words_are_split_as_in_the_contract():
    assert "a b c\x1cd\te\x0bf".encode().split() == ["a b".encode(), b"c\x1cd", b"e", b"f"]


def test_word_hashes():
    """Equal for the same word wherever it stands, and apart for others."""
    rng = random.Random(1)
    words = [bytes(rng.choices(b"ab\x1c\xc3\xa9", k=rng.randint(1, 9))) for _ in range(4000)] + [b"x" * LONG_WORD, b"x" * (LONG_WORD + 1), b"y" * (PIECE + 5), b"x" * 200]
    rng.shuffle(words)
    space = (b" ", b"\t", b"\n ", b"\x0b", b"\x0c", b"\r\n")
    text = b"".join(rng.choice(space) + w for w in words) + rng.choice((b"", b" "))
    h = word_hashes(text)
    assert text.split() == words and len(h) == len(words)
    alone = {w: int(word_hashes(w)[0]) for w in words}
    assert h.tolist() == [alone[w] for w in words] and len(set(alone.values())) == len(alone)
    assert [len(word_hashes(t)) for t in (b"", b" ", b"a", b" a", b"a ", b" a b ")] == [0, 0, 1, 1, 1, 2]
    seen = {}
    for i in range(len(words) - 3):
        seen.setdefault(tuple(words[i : i + 4]), set()).add(int(window_hashes(h, 4)[i]))
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)
    for n in range(5):
        assert len(window_hashes(h[:n], 4)) == min(n, 1) if n <= 4 else True
    assert window_hashes(h[:2], 4) != window_hashes(h[:3], 4) and distinct(np.array([3, 1, 3], np.uint64)).tolist() == [1, 3] and not len(distinct(h[:0]))


def brute_statistics(s):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


@pytest.mark.parametrize("s", ["", " \n\t", "a b c", "é# ü| <x>\né# ü| <x>\n \n \n", "a b c d e f g h i " * 3, "x " * 30, "a\x0bb\x0cc d e\x85f"])
def test_statistics(s):
    assert quality.statistics(s.encode())[0] == brute_statistics(s)
    assert quality.statistics(None)[0] == [0] * 5


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * rng.random(600) > 0.6).astype(float)
    forest = trees.fit(x, 1 - y, (-1, 0, 0), trees=20, depth=3)
    grid = np.repeat(rng.random((40, 3)), 21, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 21), 40)
    assert (np.diff(forest.score(grid).reshape(40, 21), axis=1) <= 1e-12).all()
    assert ((forest.score(x) > 0.5) == (y == 0)).mean() > 0.85


def test_extraction():
    forest = html_extract.model()
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav><div class='ad'>Buy this now!</div><article><h1>Title &amp; more</h1><p><b>First  para\n graph<br>on<p>Second one, unclosed.</article><div id=comments><p>I like this very much</p></div><footer>&copy; someone</footer>"
    assert html_extract.extracted([page], forest) == ["Title & more\n\nFirst para graph on\n\nSecond one, unclosed."]
    assert html_extract.extracted(["", "<p", "<<<>>>", "<nav>x</nav>"], forest)[0] == ""
    wrong = 0
    for source in html_extract.training_pages(60, seed=99):
        made = html_extract.Page(source)
        want = "\n\n".join(t for _, t in made.blocks if "keepme" in t)
        wrong += html_extract.extracted([source], forest)[0] != want
    assert wrong <= 12


def test_decoding_has_no_contradictions():
    made = html_extract.Page("<div><section><p>a</p><p>b</p></section><aside><p>c</p></aside></div>")
    rng = np.random.default_rng(1)
    for _ in range(50):
        kept = made.decoded(rng.random(len(made.tag)))
        assert all(kept[made.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_token_counts():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b" ab", b"bc", b"cab", b"abca"]
    costs = {p: (round(1e6 * math.log(r + 2)) << 32) + 1 for r, p in enumerate(pieces)}
    rng = random.Random(3)
    words = {b" " + bytes(rng.choices(b"abc", k=rng.randint(0, 9))) for _ in range(300)}

    def best(w):
        if not w:
            return 0
        return min(costs[w[:k]] + best(w[k:]) for k in range(1, min(4, len(w)) + 1) if w[:k] in costs)

    assert token_counts.terminal_counts(words, costs, 4) == {w: best(w) & (2**32 - 1) for w in words}


def test_vocabulary_file(tmp_path):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    costs, longest = token_counts.vocabulary(str(tmp_path / "v"))
    assert len(costs) == 256 and longest == 1


def best_fit(counts, capacity):
    bins = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [b for b in bins if b[0] >= n]
            if fits:
                min(fits, key=lambda b: b[0])[0] -= n
            else:
                bins.append([capacity - n])
    return sorted(capacity - b[0] for b in bins)


def test_bins():
    rng = np.random.default_rng(6)
    for _ in range(40):
        counts = {int(k): int(v) for k, v in enumerate(np.bincount(rng.integers(1, 65, rng.integers(1, 200)))) if v}
        used = {}
        for n, _, pieces, first, each, base in packing.plan_bins(counts, 64):
            for r in range(pieces):
                used.setdefault(first + r // each, []).append((base + r % each * n, n))
        for v in used.values():
            v.sort()
            assert all(at == sum(n for _, n in v[:i]) for i, (at, _) in enumerate(v))
        assert sorted(sum(n for _, n in v) for v in used.values()) == best_fit(counts, 64)


def test_token_ids_are_those_of_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\n", "x\ty z", "a b c", "é à\nß", "it's a's 's don't\n's", " \n", "12 34\n56 ab12 !!\n!", "日本 語\nテキスト", "a\r\nb", "  ", "word " * 50]
    texts += [end, f"{end} x", f"x {end}", f"a {end} b", f"in{end}side a word", f"{end}{end}", f"a\n{end}\nb c\n{end} ", f"  {end}  {end}x", "<|endoftext|", "<|<|endoftext|>|>", end.upper(), f"a b {end} a b " * 9]
    want = [np.array(made.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.token_ids(texts, P.path("byte_bpe_50k.json")) == want
    assert np.array([64, 220, 50256, 275], "<u4").tobytes() in want
    # The same, word by word as they come and again when they have been met.
    for t, ids in zip(texts, want, strict=True):
        assert packing.token_ids([t], P.path("byte_bpe_50k.json")) == [ids]


def test_pieces():
    ids = np.arange(2500, dtype="<u4").tobytes()
    assert [p[:3] for p in packing.pieces_of(ids)] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert [p[:3] for p in packing.pieces_of(ids[: 4 * 2048])] == [(0, 0, 1024), (1, 1024, 1024)]
