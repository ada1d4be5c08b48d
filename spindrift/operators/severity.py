"""Severity rules, fallback symptom groups and the columns that features leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import hits

# The five severity levels: name, keywords, longest wait.
SEVERITY = (
    (1, "Critical", ("arrest", "unconscious", "critical", "emergency", "cardiac", "stroke"), "Immediate"),
    (2, "Severe", ("severe", "acute", "difficulty", "bleeding", "trauma"), "Immediate"),
    (3, "Moderate", ("pain", "nausea", "vomiting", "fever", "headache"), "15 minutes"),
    (4, "Mild", ("sore", "ache", "discomfort", "concern", "worry"), "30 minutes"),
    (5, "Minor", ("mild", "minor", "routine", "follow up", "check"), "Can be delayed"),
)
# Groups of clusters to fall back on; clusters in none of them are the last one, "Other Symptoms".
FALLBACK_GROUPS = (
    (1, "Cardiovascular Symptoms", (2, 16), 3, 5),
    (2, "Respiratory Symptoms", (5,), 2, 4),
    (3, "Digestive Symptoms", (6,), 2, 4),
    (4, "Neurological Symptoms", (11,), 2, 5),
    (5, "Trauma Related", (7, 8), 2, 4),
    (6, "Substance Related", (0,), 2, 5),
)
OTHER_GROUP = (7, "Other Symptoms", 1, 4)
# The label, later knowledge, identities and redundant columns, none of which may be a feature.
NOT_FEATURES = ("acuity", "outtime", "disposition", "intime", "subject_id", "chiefcomplaint", "chiefcomplaint_clean", "group_id", "severity_confidence", "classification_found", "hour")


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, list(w), t) for k, n, w, t in SEVERITY], "level int, name string, keywords array<string>, wait_time string")


def severity_by_keywords(complaint: Column, default: int = 3) -> Column:
    """The most severe level of which a keyword occurs."""
    return F.coalesce(*[F.when(F.size(hits(complaint, words)) > 0, F.lit(k)) for k, _, words, _ in SEVERITY], F.lit(default))


def fallback_group(cluster: Column) -> Column:
    """Struct of ``group_id, group_name, severity_lo, severity_hi`` of a cluster; null for null."""
    make = lambda k, n, lo, hi: F.struct(F.lit(k).alias("group_id"), F.lit(n).alias("group_name"), F.lit(lo).alias("severity_lo"), F.lit(hi).alias("severity_hi"))
    known = [F.when(cluster.isin(*members), make(k, n, lo, hi)) for k, n, members, lo, hi in FALLBACK_GROUPS]
    return F.coalesce(*known, F.when(cluster.isNotNull(), make(*OTHER_GROUP)))


def typical_symptoms(texts: DataFrame, per_cluster: int = 3, most: int = 8) -> DataFrame:
    """From ``cluster, text, frequency``: each fallback group with its clusters' most frequent texts, at most ``most``."""
    w = Window.partitionBy("cluster").orderBy(F.desc("frequency"), "text")
    best = texts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_cluster).withColumn("g", fallback_group(F.col("cluster")))
    listed = best.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("cluster", "rn", "text"))).alias("t"))
    return listed.select("g.*", F.transform(F.slice("t", 1, most), lambda s: s["text"]).alias("typical_symptoms"))


def features(df: DataFrame, label: str = "acuity") -> list[str]:
    """The columns that may be features: numbers and flags that are neither the label nor excluded."""
    return [n for n, t in df.dtypes if n != label and n not in NOT_FEATURES and t not in ("string", "timestamp", "timestamp_ntz", "date", "binary")]


def expected_rows(df: DataFrame, expected: int = 246_943, tolerance: int = 5_000) -> DataFrame:
    """Row count and whether it is within ``tolerance`` of what is expected."""
    return df.agg(F.count("*").alias("n")).select("n", (F.abs(F.col("n") - expected) <= tolerance).alias("valid"))
