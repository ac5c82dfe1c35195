"""Mixing sources to target weights.

Words are packed into blocks of fixed length, source by source. Each source draws how many of its slots go to each
output shard from a multinomial law, so that its own total is met to the word; slots map to blocks through
pseudorandom index permutations of each source, one for each pass over it, and blocks join the slots by index. Within
a shard one more permutation spreads the sources over the slots.

Permutations are keyed Feistel networks over pairs of numbers below the root of their size; what falls beyond the size
goes round again (cycle walking), which seldom happens, as hardly more pairs than numbers exist.

`parts` is the mix: which words of which document stand where in which slot. `mix` counts them by document, `blocks`
gives the text of each slot, and `excerpts` the documents with the words that the mix takes of them.

Nothing that grows with the corpus or with the number of sources goes to the driver or is broadcast by hint: targets
come from a few aggregates over the table of sources.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; an empty
table gives an empty result; rows that repeat a doc_id (or have none) are documents of their own, in order of their
texts' hashes; very long texts are cut at block ends like all others; other columns are ignored, whatever their names
(excerpts keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bound, local_table, ship, word_count, written

#: Relative weights of the sources in order of code points, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own size.
REPEATS = 3
BLOCK = 128
SHARDS = 64
#: Stretches into which a source is cut at least so that its running totals need no task of its own; more of them if a
#: stretch would hold more rows than this in the mean.
STRETCHES, STRETCH_ROWS = 2048, 1_000_000
#: Slots that one row unfolds to, and slots of a task.
CHUNK, TASK = 16_384, 131_072
#: Rounds of the permutations, and times that a number may go round.
ROUNDS, WALK = 8, 24


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1 takes x; `key` chooses the permutation."""

    def walk(args: Column) -> Column:
        s = args["s"]

        def once(y: Column) -> Column:
            start = F.struct(F.floor(y / s).cast("long").alias("l"), (y % s).alias("r"))
            turn = lambda p, i: F.struct(p["r"].alias("l"), ((p["l"] + F.pmod(F.xxhash64(p["r"], i, args["key"]), s)) % s).alias("r"))
            return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda p: p["l"] * s + p["r"])

        found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), args["x"], lambda y, i: F.when((i > 1) & (y < args["n"]), y).otherwise(once(y)))
        return F.when(args["n"] <= 1, args["x"]).otherwise(found)

    # Where a walk should not end (of which there is no practical chance), the query fails rather than err.
    done = bound(F.struct(x.cast("long").alias("x"), n.cast("long").alias("n"), F.ceil(F.sqrt(n)).cast("long").alias("s"), key.alias("key")), walk)
    return F.when(done < F.greatest(F.lit(1), n), done).otherwise(F.raise_error(F.lit("a permutation did not end")).cast("long"))


def _targets(totals: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """source, source_size and target: sizes shared by weight, at most repeats times a source's size, the excess to the rest."""
    # Ids rise with the order of the sources; a part's first rank follows from the counts of the parts before it.
    ordered = written(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("id", 33).cast("int")
    # One row for each part of a sorted table.
    counts = dict(ordered.groupBy(part.alias("part")).count().collect())
    starts, ahead = [], 0
    for p in sorted(counts):
        starts.append((p, ahead))
        ahead += counts[p]
    ranked = ordered.join(F.broadcast(local_table(ordered.sparkSession, starts, "part", "ahead")), part == F.col("part")).withColumn("rank", F.col("ahead") + F.col("id").bitwiseAND((1 << 33) - 1))
    w, s = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int")), F.col("source_size")
    ranked = ranked.select("source", "source_size", w.alias("weight"))
    # Sources close when their share would pass their limit; the scale of the rest only grows, so closed ones stay so.
    sums = lambda closed: ranked.agg(F.coalesce(F.sum(F.when(closed, s * repeats).otherwise(0)), F.lit(0)), F.coalesce(F.sum(F.when(closed, 0.0).otherwise(F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.sum(closed.cast("long"))).first()
    closed, before = s == 0, -1
    scale = 0.0
    while True:
        taken, open_, total, n = sums(closed)
        if n == before or not open_:
            break
        scale, before = (total - taken) / open_, n
        closed = (s == 0) | (F.col("weight") * F.lit(scale) > s * repeats)
    target = F.when(closed, (s * repeats).cast("double")).otherwise(F.col("weight") * F.lit(scale))
    return ranked.select("source", "source_size", target.alias("target"))


def parts(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, plan, parts): rows has row, source, size and doc (a struct of the columns `keep`), plan a row for each source.

    parts has row, shard, slot, source, turn, block, at, first and last: words first to last (exclusive) of the row
    stand in the slot from its word `at` on; turn is the pass over the source that the slot's block belongs to.
    """
    ship(docs.sparkSession)
    # One pass over the texts; a row key of its own keeps rows that repeat a doc_id apart.
    kept = docs.select(F.struct(*(docs[c] for c in keep)).alias("doc"), F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("text").alias("hash"))
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    stretches = max(STRETCHES, -(-kept.count() // STRETCH_ROWS))
    rows = kept.select("doc_id", "source", "size", "hash", "row").withColumn("stretch", F.pmod(F.xxhash64("doc_id", "hash", F.lit(seed)), F.lit(stretches)).cast("int"))
    by_stretch = rows.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    plan = _targets(by_stretch.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    n = F.col("source_size")
    plan = plan.withColumn("want", F.least(n * repeats, F.rint("target").cast("long"))).withColumn("n_blocks", F.ceil(n / block).cast("long"))
    plan = plan.withColumn("full", F.when(n > 0, F.floor(F.col("want") / n)).otherwise(0).cast("long")).withColumn("partial", F.col("want") - F.col("full") * n)
    plan = written(plan.withColumn("slots", F.col("full") * F.col("n_blocks") + F.ceil(F.col("partial") / block).cast("long")), "mix-plan")
    all_slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, slots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng(xxhash.xxh64_intdigest(repr((seed, source))))
                counts = rng.multinomial(slots, np.full(shards, 1 / shards))
                yield pa.RecordBatch.from_arrays([pa.array([source] * shards, pa.string()), pa.array(range(shards), pa.int32()), pa.array(np.cumsum(counts) - counts), pa.array(counts)], ["source", "shard", "first", "n"])

    drawn = plan.select("source", "slots").mapInArrow(draw, "source string, shard int, first long, n long").filter("n > 0")
    # In a shard the draws stand source by source until its permutation spreads them.
    of_shard = Window.partitionBy("shard")
    drawn = drawn.withColumn("ahead", F.sum("n").over(of_shard.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))).withColumn("n_shard", F.sum("n").over(of_shard))
    drawn = drawn.withColumn("ahead", F.coalesce("ahead", F.lit(0)) - F.col("first"))

    # Where each document's words begin in its source: totals of the stretches before, then a sum within the stretch.
    before = by_stretch.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).select("source", "stretch", F.coalesce("before", F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "stretch").orderBy("doc_id", "hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("r").join(before.hint("merge").alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.stretch") == F.col("b.stretch"))).select("r.row", "r.source", "r.size", (F.col("b.before") + F.col("r.within")).alias("start"))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    pieces = pieces.select("row", "source", "block", F.greatest(F.lit(0), F.col("start") - F.col("block") * block).alias("lo"), F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block).alias("hi"), (F.col("block") * block - F.col("start")).alias("skipped"))

    # Slot k of a source: pass k // n_blocks over it, and the block at the place that the pass's permutation gives.
    slot = drawn.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("s.source", "source_size", "n_blocks", "full", "partial", "shard", "ahead", "n_shard", (F.col("first") + F.col("n") - 1).alias("z"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(CHUNK))).alias("k0"))
    # Slots are few bytes before they unfold, so their number, not their size, says how many tasks they need.
    slot = slot.repartition(1 + all_slots // TASK, "source", "k0").withColumn("k", F.explode(F.sequence("k0", F.least(F.col("z"), F.col("k0") + CHUNK - 1))))
    slot = slot.withColumn("turn", F.floor(F.col("k") / F.col("n_blocks")).cast("long"))
    inside = F.col("k") % F.col("n_blocks")
    # Whole passes permute all blocks and take each word once; the last, partial pass permutes the full blocks, after which
    # a short one comes, and takes blocks in its order until the words are there.
    m = F.when(F.col("turn") < F.col("full"), F.col("n_blocks")).otherwise(F.floor(F.col("source_size") / block))
    slot = slot.withColumn("block", F.when(inside < m, permuted(inside, m, F.xxhash64("source", "turn", F.lit(seed)))).otherwise(inside))
    slot = slot.withColumn("words", F.when(F.col("turn") < F.col("full"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("partial") - inside * block)))
    slot = slot.withColumn("slot", permuted(F.col("k") + F.col("ahead"), F.col("n_shard"), F.xxhash64("shard", F.lit(seed))))
    met = pieces.alias("p").join(slot.hint("merge").alias("k"), F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.block") == F.col("k.block")) & (F.col("p.lo") < F.col("k.words")))
    found = met.select("p.row", "k.shard", "k.slot", "p.source", "k.turn", "p.block", F.col("p.lo").alias("at"), (F.col("p.skipped") + F.col("p.lo")).alias("first"), (F.col("p.skipped") + F.least("p.hi", "k.words")).alias("last"))
    return kept.select("row", "source", "size", "doc"), plan, found


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """For each document: doc_id, size, source, source_size, target (of its source) and taken, the words the mix takes of it."""
    rows, plan, found = parts(docs, block, shards, weights, repeats, seed)
    taken = found.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = rows.alias("r").join(taken.hint("merge").alias("t"), F.col("r.row") == F.col("t.row"), "left").join(plan.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left")
    return out.select("r.doc.doc_id", "r.size", "r.source", F.col("s.source_size"), F.col("s.target"), F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def _cuts(text: Column, ranges: Column) -> Column:
    """For each (first, last) of `ranges`, sorted, those words of the text with the space between them."""
    space = WORD.replace("[^", "[").removesuffix("+")
    words = F.split(F.regexp_replace(text, f"^{space}+", ""), f"(?<={space})(?!{space})", -1)
    # The words are bound, so that a text is split once and not once for each range.
    return bound(words, lambda w: F.transform(ranges, lambda r: F.regexp_replace(F.array_join(F.slice(w, (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int")), ""), f"{space}+$", "")))


def blocks(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """The slots of the mix: shard, slot, source, turn, block, parts (at, doc_id, first, last) and text.

    Slots of a shard are numbered from 0; a source's last slot may be short. Documents follow each other after a line end.
    """
    rows, _, found = parts(docs, block, shards, weights, repeats, seed, ("doc_id", "text"))
    # All ranges of a text are cut at once.
    held = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last", "shard", "slot", "source", "turn", "block", "at"))).alias("ranges"))
    cut = rows.join(held.hint("merge"), "row").select(F.col("doc.doc_id").alias("doc_id"), F.explode(F.arrays_zip("ranges", _cuts(F.col("doc.text"), F.col("ranges")).alias("text"))).alias("x"))
    part = F.struct("x.ranges.at", "doc_id", "x.ranges.first", "x.ranges.last", "x.text")
    slots = cut.groupBy("x.ranges.shard", "x.ranges.slot").agg(*(F.first(f"x.ranges.{c}").alias(c) for c in ("source", "turn", "block")), F.array_sort(F.collect_list(part)).alias("all"))
    return slots.select("shard", "slot", "source", "turn", "block", F.transform("all", lambda p: p.dropFields("text")).alias("parts"), F.array_join(F.transform("all", lambda p: p["text"]), "\n").alias("text"))


def excerpts(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """docs as the mix takes them: a whole row for each pass that takes all its words, else one for each stretch of words taken; n_chars to match."""
    rows, _, found = parts(docs, block, shards, weights, repeats, seed, tuple(docs.columns))
    first, last = F.collect_list("first"), F.collect_list("last")
    # Neighbouring blocks of one pass join to a stretch: a stretch begins where none ends.
    ranges = F.arrays_zip(F.array_sort(F.array_except(first, last)).alias("first"), F.array_sort(F.array_except(last, first)).alias("last"))
    held = found.groupBy("row", "turn").agg(ranges.alias("ranges"))
    out = rows.join(held.hint("merge"), "row")
    whole = F.element_at("ranges", 1)["last"] - F.element_at("ranges", 1)["first"] == F.col("size")
    out = out.withColumn("whole", whole).withColumn("cut", F.explode(F.when(F.col("whole"), F.array("doc.text")).otherwise(_cuts(F.col("doc.text"), F.col("ranges")))))
    changed = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("whole"), F.col("doc.n_chars")).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns))
