"""Evaluation of predictions and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``label, pred, n``: everything below needs only these few rows."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def accuracy(cm: DataFrame) -> DataFrame:
    return cm.agg(F.round(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("n"))


def _ratio(a: str, b: str):  # noqa: ANN202
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def per_class(cm: DataFrame, levels: list[int]) -> DataFrame:
    """A row per level of ``levels``, also those that never occur: tp, fp, fn, support, precision, recall, f1 (0 where undefined)."""
    grid = cm.sparkSession.createDataFrame([(k,) for k in levels], "level int")
    hit = (F.col("label") == F.col("level"), F.col("pred") == F.col("level"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = F.broadcast(grid).join(cm, hit[0] | hit[1], "left").groupBy("level").agg(n(hit[0] & hit[1]).alias("tp"), n(~hit[0] & hit[1]).alias("fp"), n(hit[0] & ~hit[1]).alias("fn"))
    out = sums.withColumn("support", F.col("tp") + F.col("fn")).withColumn("_p", F.col("tp") + F.col("fp"))
    out = out.withColumn("precision", _ratio("tp", "_p")).withColumn("recall", _ratio("tp", "support"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("_p")


def averages(classes: DataFrame) -> DataFrame:
    """Macro means over the levels and means weighted by support, to 6 places."""
    weighted = lambda c: F.round(F.when(F.sum("support") > 0, F.sum(F.col(c) * F.col("support")) / F.sum("support")).otherwise(0.0), 6)
    return classes.agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k x n_c) for each label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("_n") / (F.col("_k") * F.col("n")), 6).alias("weight"))
