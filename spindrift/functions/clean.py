"""Numbers, maps, ranges and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed ranges outside which a value is a reading error.
CLEAN_RANGES = {"age_at_visit": (0.0, 120.0), "pain": (0.0, 10.0), "temperature": (90.0, 110.0), "heartrate": (30.0, 220.0), "sbp": (50.0, 250.0), "dbp": (30.0, 150.0), "o2sat": (50.0, 100.0)}
# Narrower closed ranges of plausible vital signs.
VALID_RANGES = {"temperature": (95.0, 110.0), "heartrate": (30.0, 250.0), "resprate": (8.0, 40.0), "o2sat": (70.0, 100.0), "sbp": (70.0, 200.0), "dbp": (40.0, 120.0), "pain": (0.0, 10.0), "age": (0.0, 120.0)}
# Defaults for a query without a value and without a trained median.
QUERY_DEFAULTS = {"age_at_visit": 50.0, "heartrate": 80.0, "sbp": 120.0, "dbp": 80.0, "temperature": 98.6, "o2sat": 98.0, "pain": 5.0, "time_period": 1.0}
# Spellings of nothing.
NULL_TOKENS = ("", "unknown", "none", "n/a", "nan")
TRANSPORT = {"ambulance": "ambulance", "walk in": "walk-in", "walk-in": "walk-in", "wheelchair": "wheelchair", "private car": "private", "unknown": "unknown"}
TRANSPORT_UPPER = {"AMBULANCE": "AMBULANCE", "WALK IN": "WALK IN", "WALK-IN": "WALK IN", "WALKIN": "WALK IN", "HELICOPTER": "HELICOPTER", "OTHER": "OTHER", "UNKNOWN": "UNKNOWN"}
GENDER_UPPER = {"M": "Male", "F": "Female", "MALE": "Male", "FEMALE": "Female"}


def number(c: Column) -> Column:
    """A double, or null where there is none; NaN is null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def in_range(c: Column, lo: float, hi: float) -> Column:
    d = number(c)
    return F.when(d.between(lo, hi), d)


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(number(c), F.lit(default))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def gender(c: Column) -> Column:
    g = F.upper(F.trim(c))
    return F.when(g.isin("M", "F"), g)


def gender_word(c: Column) -> Column:
    return F.coalesce(_map(GENDER_UPPER)[F.upper(c)], F.lit("Unknown"))


def without_null_tokens(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NULL_TOKENS), c)


def transport(c: Column) -> Column:
    """Known names mapped, others passed on in lower case."""
    t = F.lower(F.trim(c))
    return F.coalesce(_map(TRANSPORT)[t], t)


def transport_or_walk_in(c: Column) -> Column:
    return F.coalesce(_map(TRANSPORT_UPPER)[F.upper(c)], F.lit("WALK IN"))


def valid_vital(name: Column, value: Column) -> Column:
    """Null is invalid; a name that isn't known is valid with any value."""
    known = F.coalesce(*[F.when(F.lower(name) == n, value.between(lo, hi)) for n, (lo, hi) in VALID_RANGES.items()], F.lit(True))
    return F.when(value.isNull() | F.isnan(value), F.lit(False)).otherwise(known)
