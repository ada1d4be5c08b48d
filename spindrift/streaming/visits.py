"""Visits scored as a stream: the batch expressions on ``readStream``. An extension; the batch engine doesn't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.functions import clean, dates
from spindrift.operators import rules


def scored(visits: DataFrame) -> DataFrame:
    """Vital signs cleaned, period, risk and fallback level; stateless, so it is the same on a stream."""
    cleaned = visits.withColumns({c: clean.in_range(F.col(c), lo, hi) for c, (lo, hi) in clean.CLEAN_RANGES.items()})
    level = rules.fallback(*map(F.col, ("chiefcomplaint", "heartrate", "sbp", "temperature", "o2sat", "pain", "age_at_visit")))
    return cleaned.withColumn("time_period", dates.period(F.col("intime"))).withColumn("risk", rules.vital_risk()["risk"]).withColumn("level", level["level"])


def risk_counts(visits: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Visits per window and risk; windows close when the watermark passes them, and their state goes."""
    timed = scored(visits).withColumn("at", F.col("intime").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "risk").agg(F.count("*").alias("n")).select("w.start", "w.end", "risk", "n")


def run(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str) -> None:
    """Scores all files that are in ``source`` now and not yet scored, and appends them to ``sink``."""
    stream = spark.readStream.schema(schema).parquet(source)
    scored(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
