"""Mixing sources to target weights by repeating documents.

Words are summed by source, a source's target comes from its weight, and each document is taken floor(rate) times and once more with the
probability of the rest of the rate, decided by a seeded hash of its doc_id. Sources are ranked by range partitions and
targets found by rounds of sums, so any number of sources will do; what reaches the driver is two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import few, in_order, kept_table

SEED = 42
WEIGHTS, MOST_TIMES = (1, 2, 3), 3
_WIDE = "decimal(38,0)"


def words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space ``text`` has; null and empty ones have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """``source, source_size, weight, target, rate`` of ``source, source_size`` (a row per source, null among them).

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes. A target is at most
    ``most_times`` its source's size; what is over goes to the others by weight, until none is above: each round finds the share of a weight
    from the sources that aren't at their limit, and more reach it. A source without words has the target and the rate 0.
    """
    rank = in_order(by_source.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "mix-sources", "_g")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    ranked = kept_table(rank.select("source", F.col("source_size").cast(_WIDE).alias("s"), F.get(turn, (F.col("_g") % len(weights)).cast("int")).cast(_WIDE).alias("w")), "mix-weights")
    total = int(ranked.agg(F.sum("s")).first()[0] or 0)
    left, weight, limit = total, None, F.col("s") * most_times
    above = F.lit(False)
    while True:
        held = ranked.where(~above).agg(F.sum("w").cast(_WIDE)).first()[0]
        used = ranked.where(above).agg(F.sum(limit).cast(_WIDE)).first()[0]
        held, rest = int(held or 0), total - int(used or 0)
        if (left, weight) == (rest, held) or not held:
            break
        left, weight = rest, held
        above = F.col("w") * F.lit(left).cast(_WIDE) > limit * F.lit(weight).cast(_WIDE)
    share = (F.col("w") * F.lit(left).cast(_WIDE)).cast("double") / F.lit(float(weight or 1))
    target = F.when(above, limit.cast("double")).otherwise(share)
    made = ranked.select("source", F.col("s").cast("long").alias("source_size"), F.col("w").cast("int").alias("weight"), target.alias("target"))
    return made.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def chance(key: Column, seed: int = SEED) -> Column:
    """A number from 0 (inclusive) to 1 from the hash of ``key`` and ``seed``: the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies`` of each row of ``docs`` (``doc_id, source, text``); texts are read once.

    Null and empty texts have no words, whatever is taken of them. A null source is one source, the last, and not the empty one. Rows of one doc_id
    (null too) have one chance: they are taken alike if they are of one source. Other columns are ignored; an empty table stays empty.
    """
    sized = kept_table(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "mix-sizes")
    rates = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    joined = sized.join(few(rates.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor("rate")
    copies = whole + (chance(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy`` from 0, which replaces a column of that name. Texts aren't shuffled while sources are few."""
    sized = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(words(F.col("text"))).alias("source_size"))
    rates = targets(sized, weights, most_times).withColumnRenamed("source", "of")
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "copy"]).alias("doc"))
    joined = packed.join(few(rates), F.col("doc.source").cast("string").eqNullSafe(F.col("of")))
    whole = F.floor("rate")
    times = (whole + (chance(F.col("doc.doc_id"), seed) < F.col("rate") - whole).cast("long")).cast("int")
    return joined.where(times > 0).select("doc", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy")).select("doc.*", "copy")
