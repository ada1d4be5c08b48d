"""Structured text reports in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_groups(files: DataFrame) -> DataFrame:
    """Symptom groups from reports (``path, content``): a row per numbered heading with its attributes.

    The text is cut before each line that begins with a number and a full stop, so a group is found
    whole within its file, without ordering lines over files.
    """
    parts = files.select("path", F.explode(F.expr(r"split(content, r'\n(?=[ \t]*[0-9]+[.] )')")).alias("block"))
    heads = parts.where(F.col("block").rlike(r"^\s*[0-9]+[.] "))
    field = lambda name: F.trim(F.regexp_extract("block", rf"(?m)^\s*{name}: (.*)$", 1))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit("-?[0-9]+"), 0), lambda x: x.cast("int"))
    return heads.select(
        "path",
        F.regexp_extract("block", r"^\s*([0-9]+)[.] ", 1).cast("int").alias("group_id"),
        F.trim(F.regexp_extract("block", r"^\s*[0-9]+[.] (.*)", 1)).alias("group_name"),
        field("Description").alias("description"),
        numbers(field("Severity range")).alias("severity_range"),
        numbers(field("Included clusters")).alias("included_clusters"),
        F.filter(F.transform(F.split(field("Typical symptoms"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("typical_symptoms"),
    )


def read_groups(spark, path: str) -> DataFrame:  # noqa: ANN001
    return parse_groups(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content")))


def write_lines(df: DataFrame, path: str, title: str) -> None:
    """A small table as a text report: a title, then ``column: value`` pairs per row, in one file."""
    body = df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]).alias("value"))
    df.sparkSession.createDataFrame([(title,)], "value string").unionByName(body).coalesce(1).write.mode("overwrite").text(path)
