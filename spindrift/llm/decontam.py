"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A text is its words (letters and digits, lower case). A seed is the hash of the words that a fixed mask selects from a
few consecutive ones; what the mask leaves out may be anything. Seeds at every position of the benchmark are joined with
those at every position of the documents. The masks for a length are lossless: wherever words of an overlap are replaced, as
many as are tolerated, one of them still selects equal words only (``lossless`` tries every way). Around each hit, all
windows of the overlap's length that hold the seed are compared word by word.

The seeds of a usual benchmark are broadcast, each with the words around it, so that documents are hashed, joined and
verified in the stage that scans them and no text is shuffled. The seeds of larger ones stay where they are: a blocked Bloom
filter of them is broadcast, only document seeds that it lets pass are sent to them, and of the texts only those of the
documents that were hit (by a filter of their ids), so that what is shuffled grows with the hits and not with the words.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import kept_table

#: Benchmarks of up to so many seeds (about 250 bytes each with their surroundings) are broadcast; larger ones are joined by a shuffle.
BROADCAST_SEEDS = 200_000

#: A filter has a block of 1024 bits (some 200 bytes when broadcast) for every 64 keys, and so many blocks at most; with more keys it lets more pass, and loses none.
MOST_BLOCKS = 400_000

#: Spaced masks, as the places they select, heaviest first; two of weight 6 bear two others among 13 words, the last one among 7.
MASKS = (((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8)), ((0, 1, 3, 6, 7),), ((0, 1, 3, 4),))


def lossless(masks: tuple, length: int, others: int) -> bool:
    """Whether, with any ``others`` of ``length`` words replaced, some mask at some place selects none of these."""
    if any(m[-1] >= length for m in masks):
        return False
    places = [frozenset(s + x for x in m) for m in masks for s in range(length - m[-1])]
    return all(any(p.isdisjoint(bad) for p in places) for bad in itertools.combinations(range(length), others))


def masks_for(length: int, others: int) -> tuple:
    """Lossless masks for overlaps of ``length`` words of which ``others`` may be replaced."""
    if math.comb(length, others) <= 20_000:
        for masks in MASKS:
            if lossless(masks, length, others):
                return masks
    # The longest run of equal words is at least this long, wherever the others are.
    return (tuple(range(min(6, -(-(length - others) // (others + 1))))),)


def words(text: Column) -> Column:
    """The hashes of a text's words, in order; none for null."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x))


def _hashes(mask: tuple, size: str = "size(w)") -> str:
    """The seeds of ``w`` under ``mask`` at each position, in order."""
    picked = ", ".join(f"get(w, s + {i})" for i in mask)
    return f"if({size} > {mask[-1]}, transform(sequence(0, {size} - {mask[-1] + 1}), s -> xxhash64({picked}, '{' '.join(map(str, mask))}')), cast(array() as array<bigint>))"


def _benchmark_seeds(items: DataFrame, run: int, replaced: int, lengths: list[int]) -> tuple[DataFrame, list[tuple]]:
    """``seed, mask, item_id, length, before, around`` (the words of all windows that hold the seed, and how many stand before it), and the masks."""
    by_masks: dict[tuple, list[int]] = {}
    for n in lengths:
        by_masks.setdefault(masks_for(n, replaced * n // run), []).append(n)
    every = sorted({m for ms in by_masks for m in ms}) or [MASKS[-1][0]]
    parts = []
    for masks, ns in by_masks.items():
        for m in masks:
            own = items.where(F.col("length").isin(ns)).select("item_id", "w", "length", F.posexplode_outer(F.expr(_hashes(m))).alias("at", "seed"))
            first, last = f"greatest(0, at + {m[-1] + 1} - length)", "least(at, size(w) - length)"
            parts.append(own.select("seed", F.lit(every.index(m)).alias("mask"), "item_id", "length", F.expr(f"at - {first}").alias("before"), F.expr(f"slice(w, {first} + 1, {last} + length - {first})").alias("around")))
    if not parts:
        parts = [items.select(F.lit(0).cast("long").alias("seed"), F.lit(0).alias("mask"), "item_id", "length", F.lit(0).alias("before"), F.col("w").alias("around"))]
    return reduce(DataFrame.unionByName, parts).distinct(), every


def passing(rows: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """``rows`` whose ``seed`` (long) may be one of ``keys``' (distinct, not null): all that are, and some 2 in 1000 of others while blocks suffice.

    A key sets three bits of the one block that it belongs to; blocks are broadcast, and rows are tested where they are. Null seeds don't pass.
    """
    block = F.expr(f"pmod(seed, {min(MOST_BLOCKS, n_keys // 64 + 1)}L)")
    places = [f"cast(shiftrightunsigned(xxhash64(seed, 'block'), {10 * k}) & 1023L as int)" for k in range(3)]
    bits = keys.select(block.alias("_block"), F.explode(F.array(*map(F.expr, places))).alias("p"))
    blocks = bits.groupBy("_block").agg(F.array(*[F.bit_or(F.expr(f"if(shiftright(p, 6) = {i}, shiftleft(1L, p & 63), 0L)")) for i in range(16)]).alias("_bits"))
    held = " and ".join(f"(shiftrightunsigned(_bits[shiftright({p}, 6)], {p} & 63) & 1L) = 1L" for p in places)
    return rows.withColumn("_block", block).join(F.broadcast(blocks), "_block").where(held).select(*rows.columns)


def overlaps(docs: DataFrame, benchmark: DataFrame, run: int = 13, replaced: int = 2, least_words: int = 1) -> DataFrame:
    """``doc_id, item_id, n_same`` for each document and benchmark item that overlap.

    An overlap is ``run`` consecutive words of the item (or all, if it has fewer) of which
    the document holds all but ``replaced`` (in proportion for fewer) at the same shift;
    ``n_same`` is the most equal words in such a run. Items of equal words are compared once,
    under their least item_id. Items of fewer than ``least_words`` words, and those without words, are left out.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).groupBy("w").agg(F.min("item_id").alias("item_id")).where(F.size("w") >= max(1, least_words)).withColumn("length", F.least(F.size("w"), F.lit(run)))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # run of them at most
    seeds, masks = _benchmark_seeds(items, run, replaced, lengths)
    n_seeds = seeds.count()
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    # Outer generators: for others a filter on the array's size is inferred and pushed below, where each word would split the text again.
    hashed = texts.select("doc_id", "w", F.expr(f"concat({', '.join(map(_hashes, masks))})").alias("seeds"))
    # All masks' seeds stand in one array: a mask's begin after those of the masks before it.
    begins = [" + ".join(["0", *[f"greatest(0, size(w) - {m[-1]})" for m in masks[:i]]]) for i in range(len(masks))]
    begin = " ".join(["case mask", *[f"when {i} then {b}" for i, b in enumerate(begins)], "end"])
    if n_seeds <= BROADCAST_SEEDS:
        hits = hashed.select("doc_id", "w", F.posexplode_outer("seeds").alias("at", "seed")).join(F.broadcast(seeds), "seed")
    else:
        every = hashed.select("doc_id", F.posexplode_outer("seeds").alias("at", "seed"))
        found = kept_table(passing(every, seeds.select("seed").distinct(), n_seeds).join(seeds, "seed").drop("seed"), "seed-hits")
        ids = found.select(F.xxhash64("doc_id").alias("seed")).distinct()
        hits = found.join(passing(texts.withColumn("seed", F.xxhash64("doc_id")), ids, ids.count()).drop("seed"), "doc_id")
    met = hits.select("doc_id", "item_id", "length", "around", "w", F.expr(f"at - ({begin}) - before").alias("shift"))
    # Behind a generator the comparison stays out of the join's condition, which would keep the join from being compiled.
    same = met.select("doc_id", "item_id", "length", F.explode_outer(F.array(F.expr("transform(around, (x, k) -> if(shift + k >= 0 and get(w, shift + k) = x, 1, 0))"))).alias("same"))
    best = same.select("doc_id", "item_id", "length", F.explode_outer(F.array(F.expr("array_max(transform(sequence(0, size(same) - length), a -> aggregate(slice(same, a + 1, length), 0, (t, x) -> t + x)))"))).alias("n_same"))
    return best.where(f"n_same >= length - floor({replaced} * length / {run})").groupBy("doc_id", "item_id").agg(F.max("n_same").cast("long").alias("n_same"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """Per row of ``docs``: ``doc_id, contaminated, n_items, n_same`` (most equal words in a run; 0 without overlap).

    Null and empty texts are clean, as is every document if the benchmark is empty. Rows of
    one doc_id share a result; other columns are ignored. Very long texts are compared whole.
    """
    found = overlaps(docs, benchmark, least_words=least_words).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("n_same").alias("n_same"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_same", F.lit(0)).alias("n_same"))
