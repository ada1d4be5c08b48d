"""SimHash near-duplicates: fingerprints of word shingles, joined on pigeonhole blocks.

``near_duplicates`` links by the Hamming distance of one fingerprint; ``near_copies`` proposes pairs by the same means, with
several fingerprints of weighted shingles, and decides by the similarity of whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import components, kept_table

SEED = 42
#: For near copies each text has so many fingerprints; of each, the votes of the VOTERS shingles of least hash count 1, 1/2, 1/3 ...
DRAWS, VOTERS = 20, 8
#: Near copies are compared whole if one fingerprint differs in this many bits at most, and agrees in one of its two halves.
NEAR_BITS, NEAR_PAIRWISE = 3, 8
#: Of so many of its large blocks each text is compared with two leaders.
STARS = 2
#: Pairs of distinct fingerprints are compared one by one in blocks up to this size; larger blocks are linked through hubs, which is as exact.
PAIRWISE = 48
_VOTES_AT_ONCE = 65536


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of ``text``, unsigned.

    Words are maximal runs without ASCII white space after lower-casing A-Z;
    a text of fewer words than ``width`` is one shingle; without words it is 0.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _VOTES_AT_ONCE):
        to = min(n, at + _VOTES_AT_ONCE)
        found = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)), np.uint64, to - at)
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


#: Blocks of 16 bits; two fingerprints within 2 bits agree in two of the four at least, so under one of the masks.
_PARTS = [0xFFFF << 16 * i for i in range(4)]
_MASKS = [_PARTS[i] | _PARTS[j] for i in range(4) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (long column ``fp``) that join all within ``max_bits`` (1 or 2).

    Pigeonhole: each fingerprint goes to a block per mask. Blocks of up to PAIRWISE
    fingerprints are compared pair by pair and verified by Hamming distance.
    In larger blocks two fingerprints within 2 bits have a common neighbour at one
    bit each; all that share such a hub are within 2 bits of each other, so each is
    linked to the hub's smallest: as many links as fingerprints and no pairs, with
    the same components. Within 1 bit one is the other's neighbour, and is found as such.
    """
    if max_bits not in (1, 2):
        raise ValueError("links are exact within 1 or 2 bits")
    masks = _MASKS
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.mask", "k.bits")
    counts = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(counts, ["mask", "bits"])
    few, many = shared.where(F.col("n") <= PAIRWISE), shared.where(F.col("n") > PAIRWISE)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.mask") == F.col("y.mask")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.fp") < F.col("y.fp"))).where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = [F.lit(0).cast("long")] + [F.lit(_signed(1 << i)) for i in range(64)]
    near = many.select("fp").distinct().select("fp", F.explode(F.array(*flips)).alias("flip")).select("fp", "flip", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    if max_bits == 1:
        own = many.select(F.col("fp").alias("hub")).distinct()
        return pairs.unionByName(near.where("flip <> 0").join(own, "hub", "left_semi").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct())
    hubs = near.groupBy("hub").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("of")).where(F.size("of") > 1)  # at most 65 fingerprints reach a hub
    return pairs.unionByName(hubs.select("a", F.explode("of").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """SimHash classes of ``docs`` (``doc_id, text``; other columns are ignored).

    Returns ``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (smallest
    doc_id reachable by links of at most ``max_bits`` differing bits) per row.
    Null and empty texts and texts of white space have fingerprint zero and are
    linked with each other like any other equal fingerprints. Repeated rows come out
    as often as they came in. An empty table gives an empty result. A long text
    is one fingerprint, computed in pieces. Equal fingerprints are reduced to one
    before any join, so that copies cost no pairs.
    """
    fps = kept_table(fingerprints(docs, width), "simhash")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(reps.select("fp"), max_bits), "simhash-cc")
    named = reps.join(found.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = kept_table(named, "simhash-roots")
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(roots, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by the similarity of their shingles
_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 63, DRAWS).astype(np.uint64)[:, None]
_TIMES = (_draw.integers(0, 1 << 63, DRAWS).astype(np.uint64) | np.uint64(1))[:, None]


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles of ``text``; a text of fewer words than ``width`` is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def weighted_fingerprints(found: np.ndarray) -> np.ndarray:
    """DRAWS SimHash fingerprints of a set of shingles, each with its own weights.

    Under each draw shingles have a random order; the first VOTERS vote with weights 1, 1/2, 1/3 ..., others
    with none. Two sets agree in what decides with about the probability of their similarity, so that fingerprints of near copies differ
    in few bits, or none, and those of others in about half.
    """
    order = np.full((DRAWS, VOTERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _VOTES_AT_ONCE):
        order = np.concatenate([order, _mixed((found[None, at : at + _VOTES_AT_ONCE] ^ _XOR) * _TIMES)], axis=1)
        order = np.partition(order, VOTERS - 1, axis=1)[:, :VOTERS]
    first = np.sort(order, axis=1)[:, : len(found)]
    weights = 1.0 / np.arange(1, first.shape[1] + 1)
    bits = np.unpackbits(_mixed(first * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(*first.shape, 8), axis=2, bitorder="little")
    votes = np.einsum("v,dvb->db", weights, bits) > weights.sum() / 2
    return np.packbits(votes, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, k1, k2`` (the set of shingles in 128 bits) and ``fps`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            keys = np.array([[xxhash.xxh64_intdigest(s.tobytes(), i) for i in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            flat = np.concatenate([weighted_fingerprints(s) for s in sets] or [np.empty(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DRAWS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", "k1", "k2", "fps"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, fps array<long>")


def parities(found: np.ndarray) -> np.ndarray:
    """512 bits: whether an odd number of shingles falls on each. Two sets differ in as many shingles at least as these in bits."""
    return np.packbits((np.bincount((found % np.uint64(512)).astype(np.int64), minlength=512) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``node, s, odd``: the set of shingles of each row, and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([parities(x) for x in sets], pa.list_(pa.int64()))], ["node", "s", "odd"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, s array<long>, odd array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct ``a, b`` whose sets have a Jaccard similarity of ``least`` or more."""
    sizes = sets.select("node", F.size("s").alias("n"), "odd")
    sized = pairs.distinct().join(sizes.withColumnsRenamed({"node": "a", "n": "n_a", "odd": "odd_a"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "n_b", "odd": "odd_b"}), "b")
    differ = " + ".join(f"bit_count(odd_a[{i}] ^ odd_b[{i}])" for i in range(8))  # of so many shingles at least one has each
    few = sized.where(f"least(n_a, n_b) >= {least} * greatest(n_a, n_b) and {differ} <= {(1 - least) / (1 + least)} * (n_a + n_b) + 1e-9").select("a", "b", "n_a", "n_b")
    both = few.join(sets.withColumnsRenamed({"node": "a", "s": "s_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "s": "s_b"}), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(common >= least * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _sharing(rows: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` in different ``c`` (of rows ``node, c, s, odd``) among which are all whose sets ``s`` have a similarity of ``least``.

    Such sets share most of their shingles, so in one order of all shingles, the rarest first, they share one of the first
    n - ceil(least n) + 1 of each, and enough is left after the first that they share. What a passage in many texts has in
    common stands last, and makes no pairs.
    """
    sized = rows.select("node", "c", F.size("s").alias("n"), "odd", F.explode("s").alias("t"))
    often = sized.groupBy("t").agg(F.count("*").alias("times"))
    ranked = sized.join(often, "t").groupBy("node", "c", "n", "odd").agg(F.sort_array(F.collect_list(F.struct("times", "t"))).alias("order"))
    first = ranked.select("node", "c", "n", "odd", F.posexplode(F.expr(f"slice(order, 1, cast(n - ceil({least} * n - 1e-9) + 1 as int))")).alias("at", "o")).where("o.times > 1").select("node", "c", "n", "odd", "at", F.col("o.t").alias("t"))
    first = kept_table(first, "copies-rarest")
    # At the first shingle that two sets share, what is left of both must do for the similarity, and their parities mustn't differ in too much.
    differ = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(8))
    enough = f"least(x.n - x.at, y.n - y.at) >= {least / (1 + least)} * (x.n + y.n) - 1e-9"
    return first.alias("x").join(first.alias("y"), F.expr(f"x.t = y.t and x.c < y.c and least(x.n, y.n) >= {least} * greatest(x.n, y.n) and {enough} and {differ} <= {(1 - least) / (1 + least)} * (x.n + y.n) + 1e-9")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _apart(of_node: DataFrame, found: DataFrame) -> DataFrame:
    """``block, node, c`` of the blocks (``node, blocks``) whose texts are in several components ``c``."""
    placed = of_node.join(found, "node", "left").select(F.explode("blocks").alias("block"), "node", F.coalesce("component", "node").alias("c"))
    several = placed.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("block")
    return placed.join(several, "block", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` (the smallest doc_id reachable by links) of each row of ``docs`` (``doc_id, text``).

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more are linked; null and empty
    texts have one set and are linked with each other. Texts of equal sets are reduced to one first. A pair is proposed where one
    of its DRAWS fingerprints agrees in one of two halves (a block) and differs in NEAR_BITS bits at most, and is
    decided by the whole sets; a pair at 0.8 isn't proposed with a probability of about 0.001. In blocks of
    over NEAR_PAIRWISE texts each text is first compared with two leaders of each of STARS of its blocks, and then
    with those in other components that share one of its rarest shingles (``_sharing``): the components are the same as from all pairs.
    Rows of one doc_id should be one row; other columns are ignored; an empty table stays empty.
    """
    made = kept_table(_sketches(docs, width), "copies")
    reps = made.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "fps")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("node"), F.col("r.fps").alias("fps"))
    every = reps.select("node", F.posexplode("fps").alias("draw", "fp"))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("bits")))
    # draw, half and 32 bits make one long: the block.
    keyed = every.select("node", "fp", "draw", F.explode(halves).alias("k")).select("node", "fp", (F.shiftleft((F.col("draw") * 2 + F.col("k.half")).cast("long"), 32) + F.col("k.bits")).alias("block"))
    counts = keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    shared = kept_table(keyed.join(counts, "block"), "copies-shared")
    sets = kept_table(_sets(docs.join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), width), "copies-sets")

    small, large = shared.where(F.col("n") <= NEAR_PAIRWISE).select("block", "node", "fp"), shared.where(F.col("n") > NEAR_PAIRWISE)
    near = f"x.block = y.block and x.node < y.node and bit_count(x.fp ^ y.fp) <= {NEAR_BITS}"
    pairs = small.alias("x").join(small.alias("y"), F.expr(near)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    links = kept_table(_similar(_ordered(pairs), sets, least), "copies-links")
    found = components(links, "copies-cc")
    of_node = kept_table(large.groupBy("node").agg(F.collect_set("block").alias("blocks")), "copies-large")  # at most 2 DRAWS a text
    if of_node.limit(1).count():
        leaders = large.groupBy("block").agg(*[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(2 * STARS)])
        own = kept_table(large.groupBy("node").agg(*[F.min_by("block", F.xxhash64("block", F.lit(turn))).alias(f"b{turn}") for turn in range(STARS)]), "copies-own")
        turns = [own.select("node", F.col(f"b{turn}").alias("block")).join(leaders, "block").select("node", F.explode(F.array(f"l{2 * turn}", f"l{2 * turn + 1}")).alias("leader")) for turn in range(STARS)]
        stars = reduce(DataFrame.unionByName, turns).where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
        links = links.unionByName(kept_table(_similar(_ordered(stars), sets, least), "copies-stars"))
        found = components(links, "copies-cc")
        left = _apart(of_node, found).select("node", "c").distinct()
        rest = _sharing(kept_table(left.join(sets, "node"), "copies-apart"), least)
        more = kept_table(_similar(_ordered(rest), sets, least), "copies-more")
        if more.limit(1).count():
            found = components(links.unionByName(more), "copies-cc")
    roots = reps.select("k1", "k2", "node").join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    return made.select("doc_id", "k1", "k2").join(roots, ["k1", "k2"]).select("doc_id", "component_id")
