"""Counts, distributions, imputation and outliers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value; null isn't a value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(name))


def distribution(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value and their share of all in percent, to 6 places. The window is over one row per value."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*cols, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


#: Bits of a double that one pass tells apart.
DIGIT = 16


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0 is 0, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digits(df: DataFrame, cols: list[str], open_: dict[str, list[int]], level: int) -> dict[tuple[str, int], list[tuple[int, int, int, int]]]:
    """For each column and open prefix (of ``level`` digits) its next digits in order, each with its rows and its least and greatest key. One pass for all."""
    shift = 64 - DIGIT * (level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            for i, c in enumerate(cols):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                keys = np.sort(_ordered(x))
                if level:
                    keys = keys[np.isin(keys >> np.uint64(shift + DIGIT), np.array(open_[c], np.uint64))]
                if not len(keys):
                    continue
                heads, first, n = np.unique(keys >> np.uint64(shift), return_index=True, return_counts=True)
                for h, lo, hi, m in zip(heads.tolist(), keys[first].tolist(), keys[first + n - 1].tolist(), n.tolist(), strict=True):
                    known = found.setdefault((i, h), [0, lo, hi])
                    known[0] += m
                    known[1], known[2] = min(known[1], lo), max(known[2], hi)
        rows = [(i, h, *v) for (i, h), v in found.items()]
        signed = lambda k: k - (1 << 63)
        for at in range(0, len(rows), 10_000):
            i, h, n, lo, hi = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(map(signed, (x << shift for x in h)), pa.int64()), pa.array(n, pa.int64()), pa.array(map(signed, lo), pa.int64()), pa.array(map(signed, hi), pa.int64())], ["i", "h", "n", "lo", "hi"])

    asked = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    counts = asked.mapInArrow(run, "i int, h long, n long, lo long, hi long").groupBy("i", "h").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    out: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}
    for i, h, n, lo, hi in sorted(zip(*(c.to_pylist() for c in counts.columns), strict=True)):
        head = h + (1 << 63) >> shift
        out.setdefault((cols[i], head >> DIGIT), []).append((head, n, lo + (1 << 63), hi + (1 << 63)))
    return out


def at_places(df: DataFrame, places: dict[str, Callable[[int], list[int]]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column how many values it has (nulls are none) and the values at the ranks (from 0, ascending) that its function gives for that number.

    Radix selection: a double is four digits of 16 bits in an order-keeping form. A pass counts the next digit of the values that share their digits so far with a rank asked for,
    for all columns and ranks at once, and ends where all that are left are equal; four passes are the most. Only counts are sent, a row a digit met.
    """
    cols = list(places)
    found: dict[str, tuple[int, dict[int, float]]] = {c: (0, {}) for c in cols}
    todo: dict[tuple[str, int], list[tuple[int, int]]] = {}  # column and prefix: ranks within it, and as they were asked for
    for level in range(64 // DIGIT):
        groups = _digits(df, [c for c in cols if level == 0 or any(k[0] == c for k in todo)], {c: [p for d, p in todo if d == c] for c in cols}, level)
        if level == 0:
            for c in cols:
                n = sum(g[1] for g in groups.get((c, 0), []))
                found[c] = (n, {})
                todo[c, 0] = [(r, r) for r in sorted(set(places[c](n))) if 0 <= r < n]
        after: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for (c, prefix), ranks in todo.items():
            at = 0
            for head, n, lo, hi in groups.get((c, prefix), []):
                inside = [(r - at, asked) for r, asked in ranks if at <= r < at + n]
                at += n
                if lo == hi:
                    found[c][1].update((asked, _double(lo)) for _, asked in inside)
                elif inside:
                    after[c, head] = inside
        todo = after
        if not todo:
            break
    return found


def at_ranks(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values at ``ranks`` (from 0) of ``col`` in ascending order without nulls; exact."""
    return at_places(df, {col: lambda n: ranks})[col][1]


def quantiles_of(df: DataFrame, shares: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation, in shared passes; null for a column without values."""
    ends = lambda n, own: [k for p in own for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]
    out = {}
    for c, (n, got) in at_places(df, {c: lambda n, own=own: ends(n, own) for c, own in shares.items()}).items():
        out[c] = []
        for p in shares[c]:
            x = (n - 1) * p
            lo, hi = math.floor(x), math.ceil(x)
            out[c].append(None if not n else got[lo] if x == lo else got[lo] * (hi - x) + got[hi] * (x - lo))
    return out


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; null without values."""
    return quantiles_of(df, {col: shares})[col]


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """The most frequent value of each column, the least of ties; counted by value with map-side combining."""
    out = {}
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        out[c] = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).first()["m"]
    return out


def impute(df: DataFrame, strategy: str, cols: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """Null numbers filled by the column's ``median``, ``mean``, ``mode`` (the least of ties) or ``constant``; null text by ''.

    The parameters are a number per column; columns without a value stay null.
    """
    cols = cols or numeric(df)
    if strategy == "median":
        params = {c: q[0] for c, q in quantiles_of(df, dict.fromkeys(cols, [0.5])).items()}
    elif strategy == "mean":
        params = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif strategy == "mode":
        params = modes(df, cols)
    elif strategy == "constant":
        params = dict.fromkeys(cols, fill)
    else:
        raise ValueError(f"no strategy {strategy!r}")
    kinds = dict(df.dtypes)
    return df.select(*[F.coalesce(F.col(c), F.lit(params[c])).alias(c) if c in cols and params[c] is not None else (F.coalesce(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" else F.col(c)) for c in df.columns])


def with_missing_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})


def outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows beyond ``threshold`` interquartile ranges, or population deviations (``zscore``)."""
    if method == "iqr":
        lo, hi = quantiles(df, col, [0.25, 0.75])
        if lo is None:
            return df.limit(0)
        span = (hi - lo) * threshold
        return df.where((F.col(col) < lo - span) | (F.col(col) > hi + span))
    if method == "zscore":
        s = df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
        return df.crossJoin(F.broadcast(s)).where((F.col("_s") > 0) & (F.abs((F.col(col) - F.col("_m")) / F.col("_s")) > threshold)).drop("_m", "_s")
    raise ValueError(f"no outlier method {method!r}")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row per column: n, mean, std (sample), min, quartiles, max, to 6 places."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")).select("s.*")
    plain = stacked.groupBy("name").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    found = quantiles_of(df, dict.fromkeys(cols, [0.25, 0.5, 0.75]))
    rows = df.sparkSession.createDataFrame([(c, *q) for c, q in found.items()], "name string, q1 double, q2 double, q3 double")
    return plain.join(F.broadcast(rows), "name").select("name", "n", "mean", "std", "lo", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")], "hi")


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row per column with its nulls, in one pass."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_null"), F.col("_n").alias("n")) for c in cols])).alias("s")).select("s.*")


def min_max(df: DataFrame, col: str, by: str, out: str) -> DataFrame:
    """``col`` scaled to 0..1 within ``by``; where all are nearly equal, 1 if they are positive, else 0."""
    bounds = df.groupBy(F.col(by).alias("_by")).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))  # a row per group, so that a hot one is no hot task
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi - lo < 1e-9, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(col) - lo) / (hi - lo))
    return df.join(bounds, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, scaled).select(*df.columns, out)
