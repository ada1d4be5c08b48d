"""Times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: hour and its default when there is no time.
AFTERNOON = 2


def timestamp(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` strictly, else null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def period(ts: Column) -> Column:
    """0 to 3 by hours from 0, 6, 12 and 18 on; without a time 2."""
    h = F.hour(ts)
    return F.coalesce(F.floor(h / 6).cast("int"), F.lit(AFTERNOON))


def period_right_closed(ts: Column) -> Column:
    """The same with the hours 6, 12 and 18 in the earlier period."""
    h = F.hour(ts)
    return F.when(h.isNull(), F.lit(AFTERNOON)).when(h <= 6, 0).when(h <= 12, 1).when(h <= 18, 2).otherwise(3)


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def age_at(anchor_age: Column, anchor_year: Column, ts: Column) -> Column:
    """The age in the year of ``ts`` from an age known for another year."""
    return anchor_age + (F.year(ts) - anchor_year)
