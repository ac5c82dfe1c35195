"""Secret scans with DataFrame functions only.

Base kinds are regular expressions. The method adds candidate strings in which a sliding window has a high Shannon
entropy for its character class: one count for each character of the class moves along with the window, and the sum
of c*log2(c) with them, so that a step costs the same whatever the length of the candidate. An allow list suppresses
what is known to be harmless.

Spans count code points, end exclusive. A pattern's matches and the pieces that it splits a text into alternate, so
running sums of their lengths give each match's place without leaving the JVM. All work is linear in the text, but for
running sums, which copy up to CHUNK items for each.

Defined cases: null text counts as empty and has no spans; the digest of no base span is that of the empty string;
equal rows give equal results; other columns are ignored, whatever their names (redact keeps them); very long texts,
candidates of any length and any number of matches are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh

#: Kinds in order of their listing: a pattern, and the group with the shortest length that it must have.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
KEYED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The + of these two with a least length is the same as a least count: a run that is too short has no longer part.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates of the method: whole runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: First and last character of candidates; a window has a count for each code between them.
LOWEST, HIGHEST = "+", "z"
WINDOW = 20
#: Least entropy in bits a character of some window, by class: digits with a-f, digits with letters, those with signs.
#: Of random strings of 20 characters of these classes 1.3%, 0.4% and 0.4% stay below; longer ones have more windows.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.6}
#: Candidates that are no secrets: of letters or digits or signs alone, placeholders, alphabets, paths and identifiers in words.
#: Loops over groups are possessive: others recurse, and long candidates would overflow the stack.
ALLOWED = (r"^[A-Za-z_=+/-]+$", r"^[0-9_=+/-]+$", r"(?i)example|placeholder|sample|dummy|changeme|xxxxxx", r"(?i)abcdefgh|0123456789|12345678", r"^(?:/?[A-Za-z]+[0-9]{0,4}[/_-])++[A-Za-z]*[0-9]{0,4}$", r"^(.)\1+$")
#: c*log2(c) in millionths of a bit, so that sums don't depend on their order.
C_LOG_C = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
MASK = "[SECRET]"
#: Items that a running fold appends to one array before it begins the next one.
CHUNK = 256
SPAN = "struct<start:int,kind:int,end:int>"


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """out(state, item) of each item (of the SQL type `kind`), the state running from `start` by step(state, item)."""
    none = F.array().cast(f"array<{kind}>")
    append = lambda s, x: F.struct(step(s["state"], x).alias("state"), F.array_append(s["made"], out(s["state"], x)).alias("made"))

    def over(all_: Column) -> Column:
        def chunk(s: Column, first: Column) -> Column:
            inner = F.aggregate(F.slice(all_, first, CHUNK), F.struct(s["state"].alias("state"), none.alias("made")), append)
            return bound(inner, lambda i: F.struct(i["state"].alias("state"), F.array_append(s["made"], i["made"]).alias("made")))

        firsts = F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK))
        return F.flatten(F.aggregate(firsts, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("made")), chunk)["made"])

    return bound(items, lambda all_: F.when(F.size(all_) > 0, over(all_)).otherwise(none))


def _places(text: Column, pattern: str, found: Column, kind: int) -> Column:
    """(start, kind, end) of each of `found`, which holds all matches of the pattern in the text."""
    parts = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("n")))
    walk = running(parts, F.lit(0), lambda at, x: at + x["gap"] + x["n"], lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end")), SPAN)
    return F.when(F.size(found) > 0, walk).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_cost(run: Column) -> Column:
    """The least sum of c*log2(c) (millionths) over the counts of any window of WINDOW characters: the highest entropy.

    A window's counts are the characters of a string, one for each character code: a step rewrites two of them.
    """
    base = ord(LOWEST) - 1
    cost = F.array(*map(F.lit, C_LOG_C))
    of = lambda n: F.element_at(cost, n + 1)
    zero = F.lit("\0" * (ord(HIGHEST) - base))
    count = lambda s, slot: F.ascii(F.substring(s["counts"], slot, F.lit(1)))

    def changed(s: Column, slot: Column, by: int) -> Column:
        put = lambda n: F.struct(F.overlay(s["counts"], F.char(n + by), slot).alias("counts"), (s["now"] - of(n) + of(n + by)).alias("now"), s["least"].alias("least"))
        return bound(count(s, slot), put)

    def walk(slots: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left = F.when(i <= WINDOW, s).otherwise(changed(s, F.element_at(slots, F.greatest(F.lit(1), i - WINDOW)), -1))
            both = bound(left, lambda t: changed(t, F.element_at(slots, i), 1))
            return bound(both, lambda t: F.struct(t["counts"], t["now"], F.when(i < WINDOW, t["least"]).otherwise(F.least(t["least"], t["now"])).alias("least")))

        start = F.struct(zero.alias("counts"), F.lit(0).alias("now"), F.lit(C_LOG_C[-1]).alias("least"))
        return F.aggregate(F.sequence(F.lit(1), F.size(slots)), start, step)["least"]

    slots = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.ascii(c) - base)
    return bound(slots, walk)


def is_random(run: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no entry of the allow list suppresses it."""
    most = {k: round((math.log2(WINDOW) - h) * WINDOW * 1e6) for k, h in THRESHOLDS.items()}
    limit = F.when(run.rlike(r"^[0-9a-fA-F]+$"), most["hex"]).when(run.rlike(r"^[0-9A-Za-z]+$"), most["alnum"]).otherwise(most["base64"])
    allowed = run.rlike(ALLOWED[0])
    for pattern in ALLOWED[1:]:
        allowed = allowed | run.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(window_cost(run) <= limit)


def _clear(spans: Column, base: Column) -> Column:
    """The spans that meet no base span; spans come in order and don't meet each other.

    All spans are walked by their starts: a span is hit if a base span before it reaches into it, and the last span
    is hit if a base span begins before its end.
    """
    mark = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: mark(x, 0)), F.transform(spans, lambda x: mark(x, 1))))
    state = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    own = lambda x: x["own"] == 1
    step = lambda s, x: F.struct(F.when(own(x), s["reach"]).otherwise(F.greatest(s["reach"], x["end"])).alias("reach"), F.when(own(x), x["start"]).otherwise(s["start"]).alias("start"), F.when(own(x), x["end"]).otherwise(s["end"]).alias("end"))
    hit = lambda s, x: F.when(own(x) & (s["reach"] > x["start"]), F.struct(x["start"], x["end"])).when(~own(x) & (x["start"] < s["end"]), F.struct(s["start"], s["end"]))
    hits = running(both, state, step, hit, "struct<start:int,end:int>")
    # Starts differ and so do ends, so that each is a set that the hits can be taken from.
    left = lambda h: F.zip_with(F.array_except(F.transform(spans, lambda x: x["start"]), F.transform(h, lambda x: x["start"])), F.array_except(F.transform(spans, lambda x: x["end"]), F.transform(h, lambda x: x["end"])), lambda a, z: F.struct(a.alias("start"), F.lit(3).alias("kind"), z.alias("end")))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), bound(F.filter(hits, lambda x: x.isNotNull()), left)).otherwise(spans)


def _scanned(texts: DataFrame, text: str, base: str, added: str) -> DataFrame:
    """texts with the columns `base` and `added`: arrays of (start, kind, end), sorted. `text` holds no nulls."""
    made = fresh(texts, "assign", "access", "hex", "entropy", "verdict")
    t = F.col(text)
    patterns = dict(zip(("assign", "access", "hex", "entropy"), (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True))
    df = texts.withColumns({made[k]: F.regexp_extract_all(t, F.lit(p), 0) for k, p in patterns.items()})
    # Candidates are judged once, before their places are looked for: hardly any text has one that passes.
    df = df.withColumn(made["verdict"], F.transform(made["entropy"], is_random))
    spans = [_places(t, p, F.col(made[k]), i) for i, (k, p) in enumerate(patterns.items())]
    long_enough = F.transform(made["assign"], lambda m: F.length(F.regexp_replace(m, KEYED, "")) >= LEAST_ASSIGNED)
    chosen = lambda places, flags: F.transform(F.filter(F.arrays_zip(places.alias("p"), flags.alias("ok")), lambda x: x["ok"]), lambda x: x["p"])
    df = df.withColumn(base, F.array_sort(F.concat(chosen(spans[0], long_enough), spans[1], spans[2])))
    some = F.exists(made["verdict"], lambda x: x)
    return df.withColumn(added, F.when(some, bound(chosen(spans[3], F.col(made["verdict"])), lambda s: _clear(s, F.col(base)))).otherwise(F.array().cast(f"array<{SPAN}>"))).drop(*made.values())


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    df = _scanned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "base", "added")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return df.select("doc_id", *map(number, range(3)), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with a mask in place of each stretch that spans cover, and n_chars to match; a text without spans stays."""
    made = fresh(docs, "plain", "base", "added", "spans")
    df = _scanned(docs.withColumn(made["plain"], F.coalesce("text", F.lit(""))), made["plain"], made["base"], made["added"])
    df = df.withColumn(made["spans"], F.array_sort(F.concat(made["base"], made["added"]))).drop(made["base"], made["added"])
    spans, text = F.col(made["spans"]), F.col(made["plain"])
    # What stands between the spans; adjoining and overlapping ones leave nothing between them.
    gap = lambda at, x: F.when((x["start"] > at) | (at == 0), F.struct(at.alias("first"), x["start"].alias("last")))
    gaps = F.filter(running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]), gap, "struct<first:int,last:int>"), lambda x: x.isNotNull())
    tail = F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("first"), F.length(text).alias("last"))
    # Four bytes a character, so that a cut doesn't count its way through the text.
    cut = lambda raw: F.transform(F.concat(gaps, F.array(tail)), lambda g: F.decode(F.substring(raw, 4 * g["first"] + 1, 4 * (g["last"] - g["first"])), "UTF-32"))
    masked = F.array_join(bound(F.encode(text, "UTF-32"), cut), MASK)
    changed = {"text": F.when(F.size(spans) > 0, masked).otherwise(F.col("text"))}
    out = df.withColumn("text", changed["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
