"""Requests and responses as JSON: parsing, required fields, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a request for a prediction.
REQUEST = "chief_complaint string, age double, gender string, heart_rate double, sbp double, dbp double, temperature double, o2sat double, pain double, arrival_method string, model string"
REQUIRED = ("chief_complaint", "age", "gender", "heart_rate", "sbp", "dbp", "temperature", "o2sat")


def missing_fields(names: list[str]) -> Column:
    """The names of columns that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in names]))


def parse_requests(df: DataFrame, body: str) -> DataFrame:
    """The fields of JSON bodies, with ``missing`` and ``valid``; a body that isn't JSON misses all."""
    rows = df.withColumn("_r", F.from_json(body, REQUEST)).select(*[c for c in df.columns if c != body], "_r.*")
    missing = missing_fields(list(REQUIRED))
    return rows.withColumn("missing", missing).withColumn("valid", F.size("missing") == 0)


def responses(df: DataFrame, out: str = "response") -> DataFrame:
    """``level, confidence, reasons`` of each row as one JSON text beside its key columns."""
    return df.withColumn(out, F.to_json(F.struct("level", "confidence", "reasons")))
