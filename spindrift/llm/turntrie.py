"""The trie of conversation prefixes, by prefix doubling.

Turns are named by dense numbers, equal ones alike; pairs of neighbouring blocks of 1, 2, 4 ... turns are named in one join a
round, so that a block of any power of two has a name after logarithmically many rounds. The first d turns are the blocks of d's binary digits, the
largest first; their name is composed block by block, from the highest digit to the lowest, again in one join a round. Equal prefixes of one
length have equal names then, and a node of the trie is a group of rows.

What is summed over a subtree comes from its members: each node belongs to its smallest member, and the members of a node
own all that is below it. So no round walks along the depth, and a very long conversation is rows like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import dense_names, in_order, kept_table, running_sums
from spindrift.llm.mixture import words

#: Conversations of one block of ids begin like the first of them, by up to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Ids that are joined at once when the ends of a node are digested.
_IDS = 4096


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, j, name, words`` of each turn (from 0) of the rebuilt conversations, and ``conv_id, turns`` of all of them, turnless ones too.

    Conversation c has the first h turns of conversation c - c mod 20, as far as there are, and then its own after its first h, with h = crc32 of c in decimal digits
    mod 4. ``name`` is a dense number of (role, text), told apart by SHA-256; ``words`` are those of the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"), words(text).alias("words"))
    placed = in_order(kept_table(given, "trie-turns"), ["conv_id", "turn", "code"], "trie-order")
    named = kept_table(placed.join(dense_names(placed.select("code"), "trie-codes"), "code").select("conv_id", "g", "name", "words"), "trie-named")

    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    own = named.groupBy("conv_id").agg(F.min("g").alias("first"), F.count("*").alias("n")).withColumn("h", head)
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("first").alias("first_base"))
    convs = own.withColumn("base", base).join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = kept_table(convs.select("conv_id", "base", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "trie-convs")

    place = F.col("g") - F.col("first")
    tails = named.join(convs.select("conv_id", "first", "h", "taken"), "conv_id").where(place >= F.col("h")).select("conv_id", (place - F.col("h") + F.col("taken")).alias("j"), "name", "words")
    firsts = named.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).join(convs.select("conv_id", "first"), "conv_id").select(F.col("conv_id").alias("base"), place.alias("j"), "name", "words").where(F.col("j") < HEADS - 1)
    heads = convs.select("conv_id", "base", "taken").join(firsts, "base").where("j < taken").select("conv_id", "j", "name", "words")
    return kept_table(tails.unionByName(heads), "trie-blocks"), convs.select("conv_id", "turns")


def _named(pairs: DataFrame, tag: str) -> DataFrame:
    """``pairs`` (a table) with the dense ``name`` of its ``lo, hi``."""
    return pairs.join(dense_names(pairs.select("lo", "hi"), f"{tag}-names"), ["lo", "hi"])


def blocks(turns: DataFrame) -> list[DataFrame]:
    """By k, ``conv_id, j, name, words`` of the whole blocks of 2 ** k turns, the j-th of its size; ``words`` are those of its last turn."""
    made = [turns]
    odd = F.col("j") % 2 == 1
    while True:
        now = made[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("lo"), F.max(F.when(odd, F.col("name"))).alias("hi"), F.max(F.when(odd, F.col("words"))).alias("words"))
        pairs = kept_table(now.where("hi is not null"), "trie-pairs")
        if not pairs.limit(1).count():
            return made
        made.append(kept_table(_named(pairs, "trie").select("conv_id", "j", "name", "words"), "trie-blocks"))


def prefixes(sized: list[DataFrame]) -> DataFrame | None:
    """``conv_id, depth, name, words`` of each prefix of a turn or more; names are equal where prefixes of one depth are."""
    done: DataFrame | None = None
    for k in reversed(range(len(sized))):
        last = sized[k].where("j % 2 = 0").select("conv_id", F.shiftleft("j", k).alias("start"), F.shiftleft(F.col("j") + 1, k).alias("depth"), F.col("name").alias("hi"), "words")
        if done is None:
            pairs = last.withColumn("lo", F.lit(-1).cast("long"))
        else:
            before = done.select("conv_id", F.col("depth").alias("start"), F.col("name").alias("lo"))
            pairs = last.join(before, ["conv_id", "start"], "left").withColumn("lo", F.coalesce("lo", F.lit(-1)))
        pairs = kept_table(pairs.select("conv_id", "depth", "lo", "hi", "words"), "trie-composed")
        step = kept_table(_named(pairs, "trie").select("conv_id", "depth", "name", "words"), "trie-prefixes")
        done = step if done is None else done.unionByName(step)
    return done


def ends(prefix: DataFrame) -> DataFrame:
    """``depth, name, ends_sha256`` of ``depth, name, conv_id``: the digest of the decimal ids, ascending and joined by commas.

    Ids are sorted over range partitions. A node of up to 4096 ids within one partition is digested there; of longer ones, and of those that a partition
    may share with its neighbours, texts of 4096 ids are sent on, which one task a node then reads in order with a running digest: SHA-256 can't be split,
    but no task holds more than a few texts.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, seq, ids, first = None, 0, [], True
        out: list[tuple] = []

        def end(last: bool) -> None:
            text = ",".join(ids)
            whole = not (first or last or seq)  # else it may have begun in the partition before, or go on in the next one, or be long
            out.append((*key, part, seq, whole, hashlib.sha256(text.encode()).hexdigest() if whole else text))

        def flushed() -> pa.RecordBatch:
            kinds = {"depth": pa.int64(), "name": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "whole": pa.bool_(), "text": pa.string()}
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
            out.clear()
            return made

        for b in batches:
            for depth, name, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, name) != key:
                    if key is not None:
                        end(False)
                        first = False
                    key, seq, ids = (depth, name), 0, []
                elif len(ids) == _IDS:
                    out.append((*key, part, seq, False, ",".join(ids)))
                    seq, ids = seq + 1, []
                ids.append(str(conv))
            if out:
                yield flushed()
        if key is not None:
            end(True)
            yield flushed()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["depth", "name", "ends_sha256"])

        for b in batches:
            for depth, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, name) != key:
                    if key is not None:
                        yield done()
                    key, state = (depth, name), hashlib.sha256(text.encode())
                else:
                    state.update(("," + text).encode())
        if key is not None:
            yield done()

    keys = ["depth", "name", "conv_id"]
    ordered = prefix.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = kept_table(ordered.mapInArrow(pieces, "depth long, name long, part int, seq long, whole boolean, text string"), "trie-ends")
    rest = made.where("not whole").repartition("depth", "name").sortWithinPartitions("depth", "name", "part", "seq").select("depth", "name", "text")
    return made.where("whole").select("depth", "name", F.col("text").alias("ends_sha256")).unionByName(rest.mapInArrow(joined, "depth long, name long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt ``conversations`` (``conv_id, turn, role, text``), a row each.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (over the
    subtree), ``ends_sha256``. Rows without a conv_id belong to no conversation; turns go up, null first, equal ones by the digest of
    role and text; repeated rows are turns of their own; null or empty roles and texts are empty. A negative id's family begins at the next multiple of
    20 below. Other columns are ignored. An empty table has no nodes, not even a root.
    """
    turns, convs = rebuilt(conversations)
    found = prefixes(blocks(turns))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("words"))
    rows = reduce(DataFrame.unionByName, [x for x in (root, found) if x is not None])
    node = ["depth", "name"]
    groups = rows.groupBy(*node).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("words").alias("w"))
    above = rows.select(F.col("conv_id").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("up"))
    nodes = kept_table(kept_table(groups, "trie-groups").join(above, ["rep", "depth"], "left"), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("up"), F.col("rep").alias("parent_conv_id"))
    counted = nodes.join(children, node, "left").join(parents, ["depth", "up"], "left")
    saved = ((F.col("n") - 1) * F.col("w")).alias("saved")
    counted = kept_table(counted.select(*node, "rep", "n", saved, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "parent_conv_id"), "trie-counted")

    # What a conversation owns, which is all on its own path from some depth on: summed over the members of a node that is the subtree, but for what the node's own conversation has above it.
    owned = counted.groupBy(F.col("rep").alias("conv_id")).agg(F.sum("saved").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    sums = rows.join(kept_table(owned, "trie-owned"), "conv_id").groupBy(*node).agg(F.sum("owned").alias("below"), F.sum("leaves").alias("n_leaves"))
    run = running_sums(counted.select("rep", *node, "saved"), ["rep", "depth"], "saved", "trie-sums")
    start = run.groupBy("rep").agg(F.min("before").alias("start"))
    over = run.join(start, "rep").select(*node, (F.col("before") - F.col("start")).alias("over"))
    last = rows.join(convs.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"])
    done = counted.join(sums, node).join(over, node).join(ends(last), node, "left")
    return done.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("below") - F.col("over")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
