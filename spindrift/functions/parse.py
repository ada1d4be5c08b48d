"""What language models and reports say, as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def keyed(text: Column, key: str, default: int) -> Column:
    """The whole number of the last line ``key: n``; the default where there is no such line or no number in it."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?m)^\s*{key}:\s*([^\n:]*)"), 1)
    return F.coalesce(_whole(F.trim(F.element_at(F.when(F.size(found) > 0, found), -1))), F.lit(default))


def group_of(text: Column) -> Column:
    """Group and confidence; if either can't be read, both are the defaults."""
    return F.struct(keyed(text, "Group", 0).alias("group_id"), keyed(text, "Confidence", 1).alias("confidence"))


def severity_of(text: Column) -> Column:
    return F.struct(keyed(text, "Severity", 3).alias("severity"), keyed(text, "Confidence", 1).alias("confidence"))


def level(text: Column, default: int = 3) -> Column:
    """The first digit of 1 to 5 that stands alone."""
    return F.coalesce(_whole(F.regexp_extract(text, r"\b([1-5])\b", 1)), F.lit(default))


def level_strict(text: Column, default: int = 3) -> Column:
    """The digit after ``TRIAGE LEVEL:``."""
    return F.coalesce(_whole(F.regexp_extract(text, r"(?i)TRIAGE LEVEL:\s*([1-5])\b", 1)), F.lit(default))


def fenced(text: Column) -> Column:
    """What a ``json`` fence holds, or the text itself."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)\s*```.*$", ""))
