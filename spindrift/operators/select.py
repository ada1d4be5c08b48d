"""Choosing rows: top n per group, splits, samples, quotas and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import vec
from spindrift.sources.tables import saved, small


def top_n(df: DataFrame, by: str, order: list[Column], n: int | Column) -> DataFrame:
    """The first ``n`` rows of each group; a fixed n is cut before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n)


def row_ids(df: DataFrame, key: str, out: str = "row_id") -> DataFrame:
    """Dense ids from 0 in order of ``key``, without sorting in one task: range partitions are numbered by their counts."""
    spark = df.sparkSession
    ordered = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() % F.lit(1 << 33))
    ordered = saved(ordered, "row-ids")
    counts = sorted((r["_p"], r["n"]) for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row per partition
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    return ordered.join(F.broadcast(spark.createDataFrame(starts, "_p int, _s long")), "_p").withColumn(out, F.col("_s") + F.col("_k")).drop("_p", "_k", "_s")


def _label_ranks(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` with ``_rank`` (from 1) in order of md5 of the key within each label, and the label's ``_n`` rows.

    A label may hold most rows, so ranks are not taken over it: rows are ranked within the 4096 beginnings of their hash, and what comes
    before a beginning is counted. Rows without a label form one of their own. The counts are broadcast while they are few.
    """
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    within = Window.partitionBy(label)
    before = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_lb"), (F.sum("_c").over(within.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(within).alias("_n"))
    joined = hashed.join(small(before, 2_000_000), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_lb")))
    return joined.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))


def stratified(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """``df`` with ``split``: of each label, the ceil(share x n) rows of least md5 of the key are ``train``, the others ``test``. Exact, and the same for any partitioning."""
    return _label_ranks(df, label, key).withColumn("split", F.when(F.col("_rank") <= F.ceil(F.lit(share) * F.col("_n")), "train").otherwise("test")).select(*df.columns, "split")


def folds(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """``df`` with ``fold`` from 0 to ``n`` - 1: each label's rows are dealt in turn by md5 of the key, so that its folds differ by one row at most.

    A label of fewer rows than folds is in the first ones. One pass for all folds.
    """
    return _label_ranks(df, label, key).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(n)).cast("int")).select(*df.columns, "fold")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows by the least md5 of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def quotas(sizes: DataFrame, total: int) -> DataFrame:
    """Rows to take of each ``cluster`` (with ``size``) so that they sum to ``total``.

    Each gets min(size, max(1, floor(total x share))); then, from the largest down, what is missing is added where
    there is room, or what is too much taken where more than one is left. A row per cluster.
    """
    w = Window.orderBy(F.desc("size"), "cluster")
    every = Window.partitionBy()
    base = sizes.withColumn("want", F.least("size", F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("size") / F.sum("size").over(every)))))
    need = base.withColumn("need", F.lit(total) - F.sum("want").over(every))
    room = F.when(F.col("need") > 0, F.col("size") - F.col("want")).otherwise(F.col("want") - 1)
    spread = need.withColumn("room", room).withColumn("before", F.sum("room").over(w) - F.col("room"))
    change = F.least(F.greatest(F.abs("need") - F.col("before"), F.lit(0)), F.col("room"))
    return spread.select("cluster", "size", (F.col("want") + F.signum("need") * change).cast("long").alias("quota"))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """The mean vector of each cluster; sums per place with map-side combining."""
    parts = df.select(cluster, F.posexplode(vec.doubles(F.col(vector))).alias("pos", "x"))
    means = parts.groupBy(cluster, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(df: DataFrame, cluster: str, key: str, vector: str, total: int) -> DataFrame:
    """The rows nearest to their cluster's centroid, as many as its quota; distance to 6 places, ties by key."""
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"))
    near = df.join(small(saved(centroids(df, cluster, vector), "centroids")), cluster).select(F.col(cluster).alias("cluster"), key, F.round(vec.distance(vec.doubles(F.col(vector)), F.col("centroid")), 6).alias("distance"))
    first = top_n(near, "cluster", [F.col("distance"), F.col(key)], total)  # no quota is more; cut before the shuffle
    return first.join(quotas(sizes, total), "cluster").where("rn <= quota").select("cluster", key, "distance", F.col("rn").cast("long").alias("rank"))
