"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x))


def unit(a: Column) -> Column:
    """Of length one; a zero vector stays as it is. The length is made once, not for each place."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def weighted(text: Column, numbers: Column, text_weight: float = 0.7, number_weight: float = 0.3) -> Column:
    """Both vectors scaled and joined (the query side; index vectors are joined as they are)."""
    return F.concat(F.transform(text, lambda x: x * text_weight), F.transform(numbers, lambda x: x * number_weight))
