"""Secret scans against a scanner in plain Python."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
HEXES, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
NOT = ("example", "placeholder", "sample", "dummy", "changeme", "xxxxxx", "abcdefgh", "0123456789", "12345678")


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def random_looking(run):
    if not re.search("[A-Za-z]", run) or not re.search("[0-9]", run) or any(x in run.lower() for x in NOT) or len(set(run)) == 1:
        return False
    if re.fullmatch(r"(?:/?[A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}", run):
        return False
    kind = "hex" if set(run) <= set(string.hexdigits) else "alnum" if set(run) <= set(ALNUM) else "base64"
    return max(entropy(run[i : i + 20]) for i in range(len(run) - 19)) >= secrets.THRESHOLDS[kind] - 1e-6


def brute(text):
    """Base spans and added ones, as (start, kind, end)."""
    s = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(s) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 32]
    runs = [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(s) if len(m[0]) >= 20 and random_looking(m[0])]
    return sorted(base), [(a, k, z) for a, k, z in runs if not any(x < z and a < y for x, _, y in base)]


def masked(text, spans):
    out, at = "", 0
    for a, _, z in sorted(spans):
        if a > at or at == 0:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def texts():
    rng = random.Random(11)
    of = lambda alphabet, low, high: "".join(rng.choices(alphabet, k=rng.randint(low, high)))
    some = [
        lambda: of(ALNUM + "+/", 18, 60), lambda: of(HEXES, 25, 50), lambda: "AKIA" + of(string.ascii_uppercase + "23", 8, 20), lambda: "token=" + of(ALNUM, 4, 30), lambda: of(ALNUM, 5, 30) + "_api_key=" + of(ALNUM + "+/=", 3, 30),
        lambda: "secret: \"" + of(HEXES, 6, 40), lambda: "é" * rng.randint(1, 4), lambda: "some/path_with/words-in-it12/x", lambda: "word", lambda: "𝄞", lambda: "password", lambda: "AKIA" + of(HEXES, 30, 40) + "AKIA" + of(ALNUM, 20, 30),
    ]
    made = [rng.choice((" ", "", "\n", ".", ",")).join(rng.choice(some)() for _ in range(rng.randint(1, 14))) for _ in range(300)]
    return [None, "", " ", made[0], *made]


def test_all_spans_and_masks(spark):
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (None, "token=abcdefgh9", 1)], "doc_id long, text string, n_chars int")
    # Columns with the names that the operator might use itself.
    clash = docs.selectExpr("*", "'a' AS base", "'b' AS added", "'c' AS _spans", "'d' AS _text", "'e' AS _BASE", "'f' AS spans", "'g' AS _verdict")
    got = {r["doc_id"]: r for r in secrets.scan(clash).collect()}
    out = secrets.redact(clash)
    assert out.columns == clash.columns
    masks = {r["doc_id"]: r for r in out.collect()}
    both = 0
    for i, t, _ in rows:
        base, added = brute(t)
        r = got[i]
        assert r["spans"] == listed(base + added), t
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        want = t if not base + added else masked(t, base + added)
        assert masks[i]["text"] == want and (t is None or masks[i]["n_chars"] == len(want))
        both += bool(base) and bool(added)
    assert both > 20 and got[None]["n_assign"] == 1 and masks[None]["text"] == "[SECRET]"
    assert all((r["base"], r["added"], r["_spans"], r["_text"], r["_BASE"], r["spans"], r["_verdict"]) == tuple("abcdefg") for r in masks.values())


def test_more_spans_than_a_chunk(spark):
    text = " é ".join("0123456789abcdef" * 2 + ("" if i % 2 else " token=abcdefgh9") for i in range(700)) + " " + " ".join("".join(random.Random(i).choices(ALNUM, k=24)) for i in range(300))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    base, added = brute(text)
    assert secrets.scan(docs).first()["spans"] == listed(base + added) and len(base) == 1050 and len(added) > 250
    assert secrets.redact(docs).first()["text"] == masked(text, base + added)


def test_very_long_candidates(spark):
    """Folds cost the same a character however long a candidate is, and no pattern recurses."""
    rng = random.Random(3)
    runs = ["".join(rng.choices(ALNUM + "+/", k=200_000)), "a/" * 100_000 + "1", "a" * 200_000, "9" * 200_000 + "z", "=" * 200_000]
    got = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(got).collect()}
    assert spans == {0: "entropy:0:200000", 1: "", 2: "hex:0:200000", 3: "hex:0:200000", 4: ""}


def test_entropy_windows(spark):
    rng = random.Random(8)
    runs = ["".join(rng.choices("ab12XYcdef+/=-_zZ09"[: rng.randint(2, 19)], k=rng.randint(20, 45))) for _ in range(60)]
    cost = lambda w: sum(secrets.C_LOG_C[n] for n in Counter(w).values())
    got = spark.createDataFrame([(r,) for r in runs], "r string").select("r", secrets.window_cost(F.col("r")).alias("c")).collect()
    assert all(r["c"] == min(cost(r["r"][i : i + secrets.WINDOW]) for i in range(len(r["r"]) - secrets.WINDOW + 1)) for r in got)
    assert secrets.C_LOG_C[8] == round(8e6 * math.log2(8))


@pytest.mark.parametrize("alphabet", [ALNUM, ALNUM + "+/", ALNUM + "_-"])
@pytest.mark.parametrize("size", [20, 24, 32, 40])
def test_random_keys_are_found(alphabet, size):
    """Few random keys stay below the thresholds; the rest of the misses have no digit or look like paths.

    (The scan decides as random_looking does; the tests above compare them.)
    """
    rng = random.Random(size)
    made = ["".join(rng.choices(alphabet, k=size)) for _ in range(2000)]
    low = sum(max(entropy(m[i : i + 20]) for i in range(size - 19)) < secrets.THRESHOLDS["base64"] for m in made)
    assert low <= 0.015 * len(made)
    assert sum(not random_looking(m) for m in made) <= {20: 0.06, 24: 0.035}.get(size, 0.015) * len(made)


def test_columns_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, base int")
    assert secrets.scan(none).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert secrets.scan(none).count() == 0 and secrets.redact(none).columns == none.columns and secrets.redact(none).count() == 0
