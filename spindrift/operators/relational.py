"""Joins with a defined result on repeated keys, deduplication, sets, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that of the greatest ``order``. A maximum with map-side combining, so hot keys don't matter."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def lookup(df: DataFrame, table: DataFrame, key: str, order: str, found: str = "found") -> DataFrame:
    """Left join with one row of ``table`` per key (the last by ``order``) and a flag whether there was one."""
    one = keep_last(table, [key], order).drop(order).withColumn("_hit", F.lit(True))
    return df.join(one, key, "left").withColumn(found, F.col("_hit").isNotNull()).drop("_hit")


def unmatched(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The keys of ``df`` that ``table`` lacks, each once."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().join(table.select(key), key, "left_anti")


def resume(todo: DataFrame, done: DataFrame, key: str, result: Column | None = None) -> DataFrame:
    """What is still to be worked on: rows without a row (or, with ``result``, a filled one) in ``done``."""
    finished = done if result is None else done.where(result.isNotNull())
    return todo.join(finished.select(key), key, "left_anti")


def with_frequency(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each distinct key with how often it occurs and its first ``order``."""
    return df.groupBy(key).agg(F.count("*").alias("frequency"), F.min(order).alias(f"first_{order}"))


def overlap(a: DataFrame, b: DataFrame, key: str, head: int = 100) -> DataFrame:
    """How the first keys of both tables agree: counts, their difference and the share of common keys."""
    x, y = a.select(key).orderBy(key).limit(head), b.select(key).orderBy(key).limit(head)
    common = x.intersect(y).agg(F.count("*").alias("n_common"))
    n = a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b"))).crossJoin(common)
    valid = (F.abs(F.col("n_a") - F.col("n_b")) <= F.greatest(F.lit(1000.0), 0.01 * F.col("n_b"))) & (F.col("n_common") >= 0.8 * F.least(F.lit(head), F.col("n_a"), F.col("n_b")))
    return n.select("n_a", "n_b", "n_common", F.round(F.col("n_common") / F.greatest(F.lit(1), F.least(F.lit(head), F.col("n_a"), F.col("n_b"))), 6).alias("rate"), valid.alias("valid"))


def bind(left: DataFrame, right: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The columns of both, row by row of one ``key``: never by position. Rows of ``left`` stay; a name that both have is taken from ``left``.

    Of several rows of a key in ``right`` the one of least ``order`` is taken, and of equal ones (or without ``order``) that of the least values, column by column.
    """
    more = [c for c in right.columns if c not in left.columns]
    if not more:
        return left
    one = right.groupBy(key).agg(F.min_by(F.struct(*more), F.struct(*([order] if order else []), *more)).alias("_r"))
    return left.join(one, key, "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in more])


def with_default(df: DataFrame, col: str, value) -> DataFrame:  # noqa: ANN001
    """``df`` with ``col``: as it is if there is one, else ``value``."""
    return df if col in df.columns else df.withColumn(col, F.lit(value))
