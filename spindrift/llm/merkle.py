"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources.

Rows are numbered within their source by range partitions and their counts. Blocks of 16 ** LEVELS consecutive leaves are
hashed by one task each to a block root; block roots are the leaves of the next tree, so that a source of any size is a few rounds.
Proofs come by fractal traversal: a task that walks along a block holds, for each level, the run of nodes
that its leaf is under (the existing subtree) and builds the next one (the desired subtree) by one leaf a step,
so that it emits the leaves' paths one after another from a few runs of nodes. The proof of the block's root, which was
made by the same walk one tree higher, is appended.

All digests are lower-case hexadecimal SHA-256; a node is the digest of its children's, concatenated as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import few, in_order, kept_table

#: Children of a node, and levels of a block: 4096 leaves.
RUN, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.StringType())]))
_ARROW_PATH = pa.struct([("place", pa.int32()), ("siblings", pa.string())])


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Climb:
    """Nodes of the levels up to ``top`` from leaves that come one by one; holds a run a level. ``nodes`` gathers level ``top``."""

    def __init__(self, top: int) -> None:
        self.open: list[list[str]] = [[] for _ in range(top)]
        self.nodes: list[str] = []

    def push(self, node: str, level: int = 0) -> None:
        while level < len(self.open):
            run = self.open[level]
            run.append(node)
            if len(run) < RUN:
                return
            node, level = digest(run), level + 1
            run.clear()
        self.nodes.append(node)

    def finish(self) -> list[str]:
        """The nodes of level ``top``, after the last runs, which may be shorter, have been hashed too."""
        for level, run in enumerate(self.open):
            if run:
                node = digest(run)
                run.clear()
                self.push(node, level + 1)
        return self.nodes


def block_root(leaves: list[str], levels: int) -> str:
    up = Climb(levels)
    for x in leaves:
        up.push(x)
    return up.finish()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[int, str]]]:
    """For each leaf in order its path: on each level its place in the run of at most 16, and the digests of the run's others."""
    n = len(leaves)
    ups = [Climb(k) for k in range(levels)]
    for k, up in enumerate(ups):
        for x in leaves[: RUN ** (k + 1)]:
            up.push(x)
    existing = [up.finish() for up in ups]
    desired = [Climb(k) for k in range(levels)]
    path: list[tuple[int, str]] = [(0, "")] * levels
    for x in range(n):
        for k in range(levels):
            if x % RUN**k == 0:  # the node of this level is another one
                at, run = x // RUN**k % RUN, existing[k]
                path[k] = (at, "".join(run[:at] + run[at + 1 :]))
        yield list(path)
        for k in range(levels):
            ahead = (x // RUN ** (k + 1) + 1) * RUN ** (k + 1) + x % RUN ** (k + 1)
            if ahead < n:
                desired[k].push(leaves[ahead])
            if (x + 1) % RUN ** (k + 1) == 0:
                existing[k] = desired[k].finish()
                desired[k] = Climb(k)


def _levels(n: int) -> int:
    """Levels that a block is raised by: all, or as many as a tree that is one block needs."""
    if n > RUN**LEVELS:
        return LEVELS
    k = 0
    while RUN**k < n:
        k += 1
    return k


def _block() -> Column:
    return F.floor(F.col("i") / RUN**LEVELS)


def _roots(nodes: DataFrame, tag: str) -> DataFrame:
    """``key, i, n, digest`` of the blocks of ``nodes`` (the same columns; ``i`` counts within ``key``, which has ``n``)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        n = t["n"][0].as_py()
        root = block_root(t["digest"].to_pylist(), _levels(n))
        return pa.table({"key": t["key"][:1], "i": pa.array([t["i"][0].as_py() // RUN**LEVELS]), "n": pa.array([-(-n // RUN**LEVELS)]), "digest": pa.array([root])})

    return kept_table(nodes.select("key", "i", "n", "digest").groupBy("key", _block()).applyInArrow(run, "key long, i long, n long, digest string"), tag)


def climb(nodes: DataFrame, tag: str) -> list[DataFrame]:
    """``nodes`` and the trees over its blocks; the last has one node a key."""
    trees = [nodes]
    while trees[-1].where("n > 1").limit(1).count():
        trees.append(_roots(trees[-1], tag))
    return trees


def _paths(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """``nodes`` with ``top`` and ``path``; ``upper`` has ``key, i, top, path`` for each block of ``nodes``."""

    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        over = [(x["place"], x["siblings"]) for x in above["path"][0].as_py()]
        places, siblings, ends = [], [], [0]
        for path in traverse(t["digest"].to_pylist(), _levels(t["n"][0].as_py())):
            for at, others in (*path, *over):
                places.append(at)
                siblings.append(others)
            ends.append(len(places))
        structs = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.string())], fields=list(_ARROW_PATH))
        return t.append_column("top", pa.array([above["top"][0].as_py()] * len(t), pa.string())).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs))

    schema = T.StructType([*nodes.schema.fields, T.StructField("top", T.StringType()), T.StructField("path", _PATH)])
    return nodes.groupBy("key", _block()).cogroup(upper.select("key", "i", "top", "path").groupBy("key", "i")).applyInArrow(run, schema)


def proofs(trees: list[DataFrame], tops: DataFrame, tag: str) -> DataFrame:
    """``trees[0]`` with ``path`` (from leaf to root) and ``top``; ``tops`` has ``key, i, top, path`` of each key's last node (i = 0)."""
    upper = tops
    for k in reversed(range(len(trees) - 1)):
        upper = _paths(trees[k], upper)
        if k:
            upper = kept_table(upper.select("key", "i", "top", "path"), tag)
    return upper if len(trees) > 1 else trees[0].join(tops.select("key", "top", "path"), "key")


def leaf(text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row: of each field ``-`` if it is null, else its length in bytes, a colon and its value. ``text`` stands for the column text."""

    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[part(text if c == "text" and text is not None else F.col(c).cast("string")) for c in fields]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that ``path`` leads to from the digest ``start``."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), s["place"] * 64), acc, F.substr(s["siblings"], s["place"] * 64 + 1)), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, altered, subroot, root, path`` of each row of ``docs``; ``altered`` is the leaf of the row with the text ``tampered`` (null: as it is).

    Within a source leaves stand in order of doc_id (null first); rows of one doc_id in order of their leaves, so repeated rows are
    leaves of their own with paths of their own. Null is a source too, the first. Null fields count as ``-``, empty texts as ``0:``. Only the
    fields of FIELDS count, other columns are ignored. An empty table has no rows and no root. Texts are read once and never shuffled.
    """
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("digest"), F.lit(None).cast("string").alias("altered") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered)).alias("altered"))
    placed = in_order(kept_table(leaves, "merkle-leaves"), ["source", "doc_id", "digest"], "merkle-order")
    sources = placed.groupBy("source").agg(F.min("g").alias("first"), F.count("*").alias("n"))
    sources = kept_table(in_order(sources, ["source"], "merkle-sources", "key"), "merkle-keys")
    keyed = placed.join(few(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    trees = climb(kept_table(keyed.select("key", (F.col("g") - F.col("first")).alias("i"), "n", "digest", "doc_id", "altered"), "merkle-nodes"), "merkle-trees")

    count = sources.count()
    over = climb(trees[-1].select(F.lit(0).cast("long").alias("key"), F.col("key").alias("i"), F.lit(count).cast("long").alias("n"), "digest"), "merkle-top")
    last = over[-1].first() if count else None
    root = F.lit(last["digest"] if last else None).cast("string")
    empty = F.lit([]).cast(_PATH)
    up = proofs(over, over[-1].select("key", F.lit(0).cast("long").alias("i"), root.alias("top"), empty.alias("path")), "merkle-paths")
    tops = up.select(F.col("i").alias("key"), F.lit(0).cast("long").alias("i"), F.col("digest").alias("top"), "path")
    done = proofs(trees, kept_table(tops, "merkle-tops"), "merkle-paths")
    return done.select("doc_id", F.col("digest").alias("leaf"), "altered", F.col("top").alias("subroot"), root.alias("root"), "path")


def verified(made: DataFrame) -> DataFrame:
    """From ``manifest``: ``doc_id, leaf, subroot, root, proof_sha256`` (of the path's digests in order), ``folded_root`` (from the altered leaf where there is one) and ``verified``."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["siblings"]), ""), 256)
    folded = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
