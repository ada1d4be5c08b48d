"""Exact nearest neighbours from an inverted file: rows lie in cells around centres, and a query reads cells only while they may hold something better.

What a cell can score at most follows from its centre, its radius and its longest vector. A query reads cells in the order of these bounds, a few at first and
then more and more, and stops when its k-th score beats the bound of the next one. Cells are stored in blocks of bounded size,
and the queries that ask for a block meet it in chunks of bounded size, so that neither a crowded cell nor a popular one is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import clusters
from spindrift.operators.select import top_n
from spindrift.sources.tables import saved

#: Cells of an index at most (their centres are broadcast), rows of a block and queries of a chunk, about.
MOST_CELLS, BLOCK, CHUNK = 1024, 8192, 2048
#: Cells that a query reads in the first round; each round reads up to four times as many as all before.
FIRST = 2
#: Scores are rounded to 6 places, so a bound this much below the k-th score may still tie with it.
SLACK = 1e-6


def whole(df: DataFrame) -> DataFrame:
    return df.where("unit is not null and size(unit) > 0 and forall(unit, x -> x is not null and not isnan(x))")


class Best:
    """The ``k`` best rows met so far of each of ``n`` queries, by score to 6 places, ties by least id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def least(self, of: np.ndarray | slice) -> np.ndarray:
        """The k-th score of queries; -inf before there are k."""
        return self.score[of, -1]

    def meet(self, of: np.ndarray, s: np.ndarray, ids: np.ndarray, but: np.ndarray | None = None) -> None:
        """Scores ``s`` of the queries numbered ``of`` with the rows ``ids``; of each query the row with the id in ``but`` is left out."""
        least, last = self.score[of, -1], self.id[of, -1]
        bound = least - 1e-6
        at = s.shape[1] - self.k - 1  # one more than k, as one row may be left out
        if at >= 0 and not np.isfinite(least).all() and np.isfinite(s).all():
            bound = np.maximum(bound, np.partition(s, at, axis=1)[:, at] - 2e-6)  # queries without k rows meet the best of these alone, not all
        q, r = np.nonzero(s >= bound[:, None])
        score, own = np.round(s[q, r], 6), ids[r]
        better = np.isfinite(score) & ((score > least[q]) | ((score == least[q]) & (own < last[q])))
        if but is not None:
            better &= own != but[q]
        self.put(of, q[better], own[better], score[better])

    def put(self, of: np.ndarray, q: np.ndarray, own: np.ndarray, score: np.ndarray) -> None:
        """Rows ``own`` with finite scores, as they are, for the queries ``of[q]``."""
        if not len(q):
            return
        met = np.unique(q)
        every = np.concatenate((np.repeat(met, self.k), q))
        score, own = np.concatenate((self.score[of[met]].ravel(), score)), np.concatenate((self.id[of[met]].ravel(), own))
        order = np.lexsort((own, -score, every))
        starts = np.searchsorted(every[order], met)
        kept = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.score[of[met]], self.id[of[met]] = score[kept].reshape(-1, self.k), own[kept].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and scores."""
        q, at = np.nonzero(np.isfinite(self.score))
        return q, self.id[q, at], self.score[q, at]


def near(found: Best, q: np.ndarray, m: np.ndarray, own: np.ndarray, x: np.ndarray, exclude_self: bool) -> None:
    """The rows ``own, x`` meet all queries ``q, m``, in tiles of bounded size."""
    if m.shape[1] != x.shape[1]:
        raise ValueError(f"queries have {m.shape[1]} places, the index {x.shape[1]}")
    for i in range(0, len(own), 2048):
        for at in range(0, len(q), 512):
            of = np.arange(at, min(at + 512, len(q)))
            found.meet(of, m[of] @ x[i : i + 2048].T, own[i : i + 2048], q[of] if exclude_self else None)


def near_coarsely(found: Best, q: np.ndarray, m: np.ndarray, coarse: np.ndarray, own: np.ndarray, x: np.ndarray, exclude_self: bool) -> None:
    """As ``near``, and as exact: products in single precision (of ``coarse``, which is ``m``) tell what may be among the best, and its scores are made in double."""
    if m.shape[1] != x.shape[1]:
        raise ValueError(f"queries have {m.shape[1]} places, the index {x.shape[1]}")
    with np.errstate(over="ignore", invalid="ignore"):
        longest = [float(np.sqrt((v * v).sum(axis=1).max(initial=0.0))) for v in (m, x)]
    if not longest[0] * longest[1] < 1e30 or max(longest) > 1e30:
        near(found, q, m, own, x, exclude_self)
        return
    off = 1e-6 + (m.shape[1] + 4) * 2**-23 * longest[0] * longest[1] + (m.shape[1] + 4) * 1e-30  # how far a product in single precision is away, twice at least; and what rounding takes
    for i in range(0, len(own), 2048):
        ids, tile = own[i : i + 2048], x[i : i + 2048]
        rows = np.ascontiguousarray(tile.T, np.float32)
        for at in range(0, len(q), 512):
            of = np.arange(at, min(at + 512, len(q)))
            s = coarse[of] @ rows
            bound = found.least(of) - off
            kth = s.shape[1] - found.k - 1  # one more than k, as one row may be left out
            if kth >= 0 and not np.isfinite(bound).all():
                bound = np.maximum(bound, np.partition(s, kth, axis=1)[:, kth] - 2 * off)
            a, b = np.nonzero(s >= np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None])
            for start in range(0, len(a), 1 << 16):
                qs, r = a[start : start + (1 << 16)], b[start : start + (1 << 16)]
                score = np.round(np.einsum("ij,ij->i", m[of[qs]], tile[r]), 6)
                least, last = found.least(of[qs]), found.id[of[qs], -1]
                better = (score > least) | ((score == least) & (ids[r] < last))
                if exclude_self:
                    better &= ids[r] != q[of[qs]]
                found.put(of, qs[better], ids[r][better], score[better])


@dataclass(frozen=True)
class CellIndex:
    """``rows`` (``cell, block, id, unit``, a table) and, by cell, ``centres``, ``radius``, ``longest`` vector and ``blocks``."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    blocks: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What each cell (columns) can score at most for each query (rows)."""
        inner = q @ self.centres.T
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        away = np.sqrt(np.maximum(length**2 - 2 * inner + (self.centres**2).sum(axis=1)[None, :], 0.0))
        nearest = np.maximum(away - self.radius[None, :], 0.0)
        return np.minimum(inner + length * self.radius[None, :], (length**2 + self.longest[None, :] ** 2 - nearest**2) / 2)

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> tuple[DataFrame, int, int]:
        """As ``retrieval.knn``, for any number of queries; and how many pairs of a query and a cell were read, of how many.

        Queries of other dimensions than the index are an error.
        """
        asked = saved(whole(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("unit").cast("array<double>").alias("unit")), "cells-queries")
        n, cells = asked.count(), len(self.centres)
        found, read, start, stop = None, 0, 0, min(FIRST, cells)
        while start < cells and n:
            state = asked.withColumn("least", F.lit(None).cast("double"))
            if found is not None:
                least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
                state = asked.join(least, "query_id", "left")
            pairs = saved(self._pairs(state, start, stop), "cells-pairs")
            met = pairs.count()
            if not met:
                break  # bounds fall, so no query has more to read
            read += met
            more = self._read(pairs, asked, k, exclude_self)
            every = more if found is None else found.unionByName(more)
            found = saved(top_n(every, "query_id", [F.desc("score"), F.col("id")], k).select("query_id", "id", "score"), "cells-found")
            start, stop = stop, min(cells, 4 * stop)
        if found is None:
            found = self.rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
        ranked = top_n(found, "query_id", [F.desc("score"), F.col("id")], k)
        return ranked.select("query_id", "id", "score", F.col("rn").cast("long").alias("rank")), read, n * cells

    def _pairs(self, state: DataFrame, start: int, stop: int) -> DataFrame:
        """``cell, query_id``: for each query the cells from the ``start``-th to the ``stop``-th by bound that its k-th score doesn't beat."""
        shared = state.sparkSession.sparkContext.broadcast(self._bounding())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if q.shape[1] != index.centres.shape[1]:
                    raise ValueError(f"queries have {q.shape[1]} places, the index {index.centres.shape[1]}")
                least = np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(q), 1024):
                    bound = index.bounds(q[at : at + 1024])
                    order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                    open_ = np.take_along_axis(bound, order, axis=1) >= least[at : at + 1024, None] - SLACK
                    rows, columns = np.nonzero(open_)
                    yield pa.RecordBatch.from_arrays([pa.array(order[rows, columns]), pa.array(ids[at : at + 1024][rows])], ["cell", "query_id"])

        return state.select("query_id", "unit", "least").mapInArrow(run, "cell long, query_id long")

    def _bounding(self) -> CellIndex:
        return CellIndex(None, self.centres, self.radius, self.longest, self.blocks)

    def _read(self, pairs: DataFrame, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The best of each block that is asked for, for each of its queries; blocks and chunks of queries meet by number."""
        spark = pairs.sparkSession
        counts = pairs.groupBy("cell").agg(F.count("*").alias("n"))  # a row a cell
        chunks = counts.select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        dealt = pairs.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        blocks = spark.createDataFrame([(i, int(n)) for i, n in enumerate(self.blocks)], "cell long, blocks int")
        sent = dealt.join(asked, "query_id").join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "query_id", "unit")
        stored = self.rows.join(F.broadcast(chunks), "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "unit")

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            kinds = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
            if not a.num_rows or not b.num_rows:
                return kinds.empty_table()
            ids = [t["query_id" if t is a else "id"].to_numpy().astype(np.int64) for t in (a, b)]
            m, x = (t["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, b))
            found = Best(len(m), k)
            near(found, ids[0], m, ids[1], x, exclude_self)
            of, own, score = found.rows()
            return pa.table([ids[0][of], own, score], schema=kinds)

        keys = ["cell", "block", "chunk"]
        return sent.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(compare, "query_id long, id long, score double")


def build(index: DataFrame, cells: int | None = None, seed: int = 42) -> CellIndex:
    """An index of ``id, unit``: about the root of their number of cells (at most MOST_CELLS), around centres fitted on a sample of 10 000 rows; every row is in a cell.

    Vectors that are null or empty or hold nulls or NaN aren't indexed. Rows of one id are all found. Radii are of the rows themselves, so results are exact
    wherever the centres lie; where vectors have no clusters the bounds hold little back and most cells are read.
    """
    rows = saved(whole(index).select(F.col("id").cast("long").alias("id"), F.col("unit").cast("array<double>").alias("unit")), "cells-given")
    n = rows.count()
    wanted = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS)
    sample = clusters.sampled(rows, "id", "unit")
    first = clusters.first_centres(sample, wanted, seed)
    if not len(first):
        return CellIndex(rows.select(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("block"), "id", "unit"), np.zeros((0, 0)), *(np.zeros(0) for _ in range(3)))
    centres = _fitted(sample, first)
    placed = clusters.Centres(centres, 0.0, 0).assign(rows, "unit").select(F.col("cluster").cast("long").alias("cell"), "id", "unit", "distance_to_center")
    placed = saved(placed, "cells-placed")
    length = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda t, x: t + x * x))
    facts = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("distance_to_center").alias("radius"), F.max(length).alias("longest"), F.count("*").alias("n")).collect()}  # a row a cell
    used = sorted(facts)
    numbers = rows.sparkSession.createDataFrame([(c, i, -(-facts[c]["n"] // BLOCK)) for i, c in enumerate(used)], "cell long, number long, blocks int")
    stored = placed.join(F.broadcast(numbers), "cell").select(F.col("number").alias("cell"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "unit")
    radius, longest = (np.array([facts[c][f] for c in used]) * (1 + 1e-9) + 1e-9 for f in ("radius", "longest"))
    return CellIndex(saved(stored, "cells-rows"), centres[used], radius, longest, np.array([-(-facts[c]["n"] // BLOCK) for c in used]))


def _fitted(sample: np.ndarray, centres: np.ndarray, rounds: int = 10) -> np.ndarray:
    """A few of Lloyd's steps on the sample."""
    for _ in range(rounds):
        own = clusters.squared(sample, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres
