"""Truncated singular value decomposition of sparse rows (``id, term, weight``), as of TF-IDF weights.

Subspace iteration from a random start: a block of k + extra columns over the terms is sent through the rows and back (A'A), its columns
are made orthonormal by their small Gram matrix, and after a few rounds the leading axes are found inside the block. No matrix of terms x terms exists
anywhere: a block is terms x (k + extra), and what is decomposed is (k + extra) x (k + extra).

A block over up to MOST_TERMS terms is broadcast, and a round is one pass over the rows; over more terms blocks are tables, and rows stand in pieces
that are sent what the block holds for the terms they have, and send back one sum for each of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.select import row_ids
from spindrift.sources.tables import dropped, saved, scratch, tidy

#: Up to so many terms a block is held by the driver and each task: 48 MB at 30 columns.
MOST_TERMS = 200_000
#: Weights of a piece, about: 12 bytes each, and a vector for each of the piece's terms, in a task.
PIECE = 4_000_000


@dataclass(frozen=True)
class LowRank:
    """``axes`` (``term, axis``: an array of k) and the singular ``values``, largest first."""

    axes: DataFrame
    values: list[float]
    large: _Large | None = None
    fitted: DataFrame | None = None

    def reduce(self, weights: DataFrame, key: str = "id") -> DataFrame:
        """``key, reduced``: rows of ``weights`` along the axes; terms that weren't fitted count nothing, and a row without any known term has no row here.

        A term that many rows hold is a skewed join; sums are combined before they are sent. A model over many terms deals rows to pieces (null keys and weights are left
        out); the rows that it was fitted on stand there already.
        """
        k = len(self.values)
        if self.large is not None:
            pieces = self.large.pieces
            if weights is not self.fitted or key != "id":
                with tidy(weights.sparkSession):
                    rows = saved(_sound(weights.withColumnRenamed(key, "id")), "svd-weights")
                    pieces = _Pieces(rows, rows.count(), self.large.size)
                dropped(rows)
            return pieces.through(self.large.block, self.large.turn, "rows").withColumnRenamed("id", key)
        known = weights.join(self.axes, "term")
        if not k:
            return known.select(key, F.col("axis").alias("reduced"))
        sums = known.groupBy(key).agg(*[F.sum(F.col("weight") * F.get("axis", F.lit(j))).alias(f"c{j}") for j in range(k)])
        return sums.select(key, F.array(*[F.col(f"c{j}") for j in range(k)]).alias("reduced"))


def _normal(term: Column, j: int, seed: int) -> Column:
    """A standard normal number from the hashes of ``term``: the same wherever it is computed."""
    u = [(F.pmod(F.xxhash64(term, F.lit(seed), F.lit(j), F.lit(i)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40) for i in range(2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """What turns a block of this Gram matrix into one of orthonormal columns; directions that it doesn't have become zero."""
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > max(values[-1], 0.0) * 1e-13
    return axes @ np.diag(np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0))


def _signs(lead: np.ndarray) -> np.ndarray:
    """1 or -1 a column, so that each axis has its largest entry positive."""
    return np.where(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])] < 0, -1.0, 1.0) if len(lead) else np.ones(lead.shape[1])


# ---------------------------------------------------------------- a block in memory
def _held_round(rows: DataFrame, block: np.ndarray, back: bool) -> np.ndarray:
    """A'A ``block`` (``back``), or the Gram matrix of A ``block``; ``rows`` has arrays ``t, w``. One pass; tasks send sums of what they have met."""
    n, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        total = np.zeros((n if back else width, width))
        for b in batches:
            t, w = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(t):
                continue
            lengths = np.diff(b.column(0).offsets.to_numpy())
            of = np.repeat(np.arange(len(lengths)), lengths)
            y = np.zeros((len(lengths), width))
            for at in range(0, len(t), 1 << 16):
                part = slice(at, at + (1 << 16))
                np.add.at(y, of[part], w[part, None] * z[t[part]])
            if not back:
                total += y.T @ y
                continue
            for at in range(0, len(t), 1 << 16):
                part = slice(at, at + (1 << 16))
                np.add.at(total, t[part], w[part, None] * y[of[part]])
        met = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(met), 4096):
            own = met[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(total[own, j]) for j in range(width)]], ["i", *(f"c{j}" for j in range(width))])

    cols = [f"c{j}" for j in range(width)]
    sums = rows.select("t", "w").mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols)).groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
    out = np.zeros((n if back else width, width))
    if sums.num_rows:
        out[sums.column(0).to_numpy()] = np.column_stack([sums.column(1 + j).to_numpy() for j in range(width)])
    shared.unpersist()
    return out


def _held(weights: DataFrame, terms: DataFrame, k: int, width: int, rounds: int, seed: int) -> LowRank:
    spark = weights.sparkSession
    numbered = saved(row_ids(terms, "term", "t"), "svd-terms")
    rows = saved(weights.join(numbered, "term").groupBy("id").agg(F.collect_list("t").alias("t"), F.collect_list("weight").alias("w")).select("t", "w"), "svd-rows")
    start = numbered.orderBy("t").select("term", *[_normal(F.col("term"), j, seed).alias(f"c{j}") for j in range(width)]).toArrow()
    names = start.column(0).to_pylist()
    block = np.column_stack([start.column(1 + j).to_numpy() for j in range(width)])
    for _ in range(rounds):
        block = block @ orthonormal(block.T @ block)
        block = _held_round(rows, block, True)
    block = block @ orthonormal(block.T @ block)
    squares, inside = np.linalg.eigh(_held_round(rows, block, False))
    lead = (block @ inside)[:, ::-1][:, :k]
    lead = lead * _signs(lead)
    axes = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "axis": pa.array(list(lead), pa.list_(pa.float64()))}))
    return LowRank(saved(axes, "svd-axes"), [math.sqrt(max(0.0, float(x))) for x in squares[::-1][:k]])


# ---------------------------------------------------------------- a block as a table
def _vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row of ``x`` as the bytes of its numbers in single precision."""
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _gram(block: DataFrame, width: int) -> np.ndarray:
    """The Gram matrix of the vectors ``v``; a task sends one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _vectors(b.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    return _total(block.select("v").mapInArrow(run, "g binary"), width)


def _total(grams: DataFrame, width: int) -> np.ndarray:
    return sum((np.frombuffer(bytes(r["g"]), np.float64).reshape(width, width) for r in grams.collect()), np.zeros((width, width)))


class _Pieces:
    """Rows (``id, term, weight``) dealt by a hash of their id to pieces of about ``size`` weights, each a row of a table: its ids, its terms, and its weights by row.

    What is sent for a piece in a round is a vector for each of its terms, not one for each weight.
    """

    def __init__(self, weights: DataFrame, n: int, size: int) -> None:
        kind = weights.schema["id"].dataType.simpleString()

        def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            ids, terms = (group.column(c).combine_chunks().dictionary_encode() for c in ("id", "term"))
            of, t = ids.indices.to_numpy(), terms.indices.to_numpy().astype(np.int32)
            order = np.argsort(of, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(of)))).astype(np.int32)
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.dictionary, terms.dictionary)]
            numbers = [pa.array([x.tobytes()], pa.binary()) for x in (starts, t[order], group.column("weight").to_numpy()[order])]
            return pa.table([pa.array([key[0].as_py()], pa.int32()), *whole, *numbers], ["b", "ids", "terms", "starts", "t", "w"])

        dealt = weights.select(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("int").alias("b"), "id", "term", "weight")
        self.path = scratch(weights.sparkSession, "svd-pieces")
        self.kind = kind
        packed = dealt.groupBy("b").applyInArrow(pack, f"b int, ids array<{kind}>, terms array<string>, starts binary, t binary, w binary")
        packed.write.partitionBy("b").parquet(self.path)
        self.terms = weights.sparkSession.read.schema("terms array<string>, b int").parquet(self.path).select("b", F.posexplode("terms").alias("place", "term"))

    def through(self, block: DataFrame, turn: np.ndarray, out: str) -> DataFrame:
        """The rows through ``block`` (``term, v``) times the small matrix ``turn``: as ``rows`` (``id, reduced``), as the ``gram`` matrices of pieces, or ``back`` over the terms."""
        path, width = self.path, turn.shape[0]

        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            store, top = pa.fs.FileSystem.from_uri(path)
            piece = pq.read_table(f"{top}/b={key[0].as_py()}", filesystem=store, partitioning=None)
            starts, t = (np.frombuffer(piece.column(c)[0].as_py(), np.int32) for c in ("starts", "t"))
            w = np.frombuffer(piece.column("w")[0].as_py(), np.float64)
            terms = piece.column("terms").combine_chunks().flatten()
            z, known = np.zeros((len(terms), turn.shape[1])), np.zeros(len(terms), bool)
            at = group.column("place").to_numpy()
            z[at], known[at] = _vectors(group.column("v"), width) @ turn, True
            y = _sums(starts, t, w, z)
            if out == "gram":
                return pa.table([pa.array([(y.T @ y).tobytes()], pa.binary())], ["g"])
            if out == "rows":
                some = np.flatnonzero(np.add.reduceat(known[t].astype(np.int64), starts[:-1]))
                ends = pa.array(np.arange(len(some) + 1) * y.shape[1], pa.int32())
                return pa.table([piece.column("ids").combine_chunks().flatten().take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(y[some].ravel()))], ["id", "reduced"])
            order = np.argsort(t, kind="stable")
            of = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
            return pa.table([terms, _bytes(_sums(np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(terms))))), of[order], w[order], y))], ["term", "v"])

        names = {"gram": "g binary", "rows": f"id {self.kind}, reduced array<double>", "back": "term string, v binary"}
        return self.terms.join(block, "term").select("b", "place", "v").groupBy("b").applyInArrow(run, names[out])


def _sums(starts: np.ndarray, at: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each run between ``starts``, none of them empty, the sum of the rows ``at`` of ``x`` by their weights."""
    out = np.zeros((len(starts) - 1, x.shape[1]))
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 15), "right")) - 1)
        part = slice(starts[first], starts[last])
        out[first:last] = np.add.reduceat(w[part, None] * x[at[part]], starts[first:last] - starts[first])
        first = last
    return out


def _added(parts: DataFrame, width: int) -> DataFrame:
    """``term, v`` with the vectors of each term added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, np.zeros(width)
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()  # equal terms stand together
            codes = coded.indices.to_numpy()
            sums = np.add.reduceat(_vectors(b.column(1), width), np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]))
            names = coded.dictionary
            if name is not None and names[0].as_py() == name:
                sums[0] += held
            elif name is not None:
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), _bytes(held[None, :])], ["term", "v"])
            if len(names) > 1:
                yield pa.RecordBatch.from_arrays([names[:-1], _bytes(sums[:-1])], ["term", "v"])
            name, held = names[-1].as_py(), sums[-1]
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), _bytes(held[None, :])], ["term", "v"])

    return parts.repartition("term").sortWithinPartitions("term").mapInArrow(run, "term string, v binary")


def _joined(weights: DataFrame, terms: DataFrame, k: int, width: int, rounds: int, seed: int, size: int) -> LowRank:
    """Vectors are kept and sent in single precision; sums, Gram matrices and axes are in double. The table ``weights`` is deleted once it stands in pieces."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _bytes(np.column_stack([b.column(1 + j).to_numpy() for j in range(width)]))], ["term", "v"])

    pieces = _Pieces(weights, weights.count(), size)
    block = saved(terms.select("term", *[_normal(F.col("term"), j, seed).alias(f"c{j}") for j in range(width)]).mapInArrow(start, "term string, v binary"), "svd-block")
    dropped(weights)
    for _ in range(rounds):
        after = saved(_added(pieces.through(block, orthonormal(_gram(block, width)), "back"), width), "svd-block")
        dropped(block)
        block = after
    turn = orthonormal(_gram(block, width))
    squares, inside = np.linalg.eigh(_total(pieces.through(block, turn, "gram"), width))
    turn = turn @ inside[:, ::-1][:, :k]
    most = _axes(block, turn).agg(*[F.max_by(F.get("axis", F.lit(j)), F.struct(F.abs(F.get("axis", F.lit(j))), F.col("term"))).alias(f"c{j}") for j in range(k)]).first()
    turn = turn * np.array([-1.0 if x is not None and x < 0 else 1.0 for x in most])
    return LowRank(_axes(block, turn), [math.sqrt(max(0.0, float(x))) for x in squares[::-1][:k]], _Large(pieces, block, turn, size))


def _axes(block: DataFrame, turn: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1), turn.shape[0]) @ turn
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["term", "axis"])

    return block.select("term", "v").mapInArrow(run, "term string, axis array<double>")


@dataclass(frozen=True)
class _Large:
    """What a model over many terms keeps: the pieces it was fitted on, and its axes as ``block`` times ``turn``."""

    pieces: _Pieces
    block: DataFrame
    turn: np.ndarray
    size: int


def fit(weights: DataFrame, k: int = 20, extra: int = 10, rounds: int = 5, seed: int = 42, most_terms: int = MOST_TERMS, piece: int = PIECE) -> LowRank:
    """The ``k`` leading right singular vectors of ``id, term, weight`` (uncentred; a row per id and term), and their singular values.

    With at most k + extra terms all directions are in the block and the result is exact; else the error falls with each round by the square of the ratio of
    the singular values behind the block to those asked for. Null ids, terms and weights are left out; without rows there are no axes. Where the rank is
    below k, values beyond it are 0 and their axes zero. Over more than ``most_terms`` terms rows are dealt to pieces of about ``piece`` weights.
    """
    given, spark = weights, weights.sparkSession
    with tidy(spark):
        weights = saved(_sound(weights), "svd-weights")
        terms = weights.select("term").distinct()
        n = terms.count()
        if not n:
            return LowRank(spark.createDataFrame([], "term string, axis array<double>"), [])
        width = min(n, k + extra)
        if n <= most_terms:
            return _held(weights, terms, min(k, n), width, rounds, seed)
        return replace(_joined(weights, terms, min(k, n), width, rounds, seed, piece), fitted=given)


def _sound(weights: DataFrame) -> DataFrame:
    return weights.where("id is not null and term is not null and weight is not null").select("id", "term", F.col("weight").cast("double").alias("weight"))
