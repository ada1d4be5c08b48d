"""Exact cosine links between vectors by PCA-ordered tiled comparison.

Unit vectors are turned to the axes of their second moments, largest first: a
rotation keeps cosines, and puts as much of them as can be in the leading dimensions.
Two tiles are compared by the product of a few leading dimensions; what
the others can add is at most the product of both suffix norms, so pairs whose sum stays
below the threshold are done with, and only rows and columns with a pair left
go on to the next dimensions. What is left at the end is decided in double
precision on the vectors as they came.

Tiles are boxes of cells on the first four axes, split where most vectors lie, and boxes of more than ``tile`` vectors (2048 to 16384) are
cut by a hash. Boxes farther apart than two vectors of the threshold can be are never compared. A tile is a
file in the shared folder: a task takes one and reads its partners from there one by one, so that what is shuffled is in
proportion to the rows, whatever is compared. Its result is a link count per vector and links that span what it found, so nothing
grows with the square of a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import components, kept_table, scratch_path

_STEPS = (16, 32)
#: Boxes that all vectors are dealt to at first, and partners that a task reads for one tile.
BOXES, ROW = 1000, 16


def usable(v: np.ndarray) -> np.ndarray:
    """Which rows are finite and not zero."""
    return np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def close_pairs(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, block: int = 1024, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of ``a`` and ``b`` (unit vectors) with cosine >= threshold, block by block; with ``same``, a is b and each pair comes once."""
    ra, rb = a @ turn, b @ turn
    d = turn.shape[0]
    ends = [s for s in _STEPS if s < d] + [d]
    slack = 1e-9

    def rest(r: np.ndarray) -> list[np.ndarray]:
        tail = np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1]
        return [np.sqrt(tail[:, e]) if e < d else np.zeros(len(r)) for e in ends]

    sa, sb = rest(ra), rest(rb)
    for i in range(0, len(a), block):
        for j in range(i if same else 0, len(b), block):
            rows, cols = np.arange(i, min(i + block, len(a))), np.arange(j, min(j + block, len(b)))
            got, at = np.zeros((len(rows), len(cols))), 0
            for k, end in enumerate(ends):
                got += ra[rows, at:end] @ rb[cols, at:end].T
                at = end
                left = got + sa[k][rows][:, None] * sb[k][cols] >= threshold - slack
                keep_r, keep_c = left.any(axis=1), left.any(axis=0)
                if not keep_r.any():
                    rows = rows[:0]
                    break
                if end < d and keep_r.mean() * keep_c.mean() < 0.5:
                    rows, cols, got = rows[keep_r], cols[keep_c], got[np.ix_(keep_r, keep_c)]
            if not len(rows):
                continue
            x, y = np.nonzero(left if left.shape == (len(rows), len(cols)) else got >= threshold - slack)
            near = np.abs(got[x, y] - threshold) <= slack
            sure = got[x, y] > threshold
            for t in np.nonzero(near)[0]:
                sure[t] = math.fsum(a[rows[x[t]]] * b[cols[y[t]]]) >= threshold
            x, y = rows[x[sure]], cols[y[sure]]
            if same:
                once = x < y
                x, y = x[once], y[once]
            if len(x):
                yield x, y


class _Forest:
    """Joins found links and keeps those that connect something new."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def add(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        out = []
        while True:  # one link per pair of trees at a time, all at once; each round joins two trees at least
            rx, ry = self._roots(x), self._roots(y)
            open_ = rx != ry
            if not open_.any():
                return out
            x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
            hi, lo = np.maximum(rx, ry), np.minimum(rx, ry)
            _, first = np.unique(hi, return_index=True)
            self.parent[hi[first]] = lo[first]
            out += list(zip(x[first].tolist(), y[first].tolist(), strict=True))

    def _roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        self.parent = p
        return p[x]


def links(vectors: DataFrame, threshold: float = 0.95, tile: int | None = None, cell: float = 0.1) -> DataFrame:
    """Components of the rows of ``vectors`` (``vec_id, embedding``) linked by cosine >= ``threshold``.

    Returns ``vec_id, n_links, component_id, kept``. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of each length are compared with each other. Equal vectors are
    compared once and count with all their copies. Repeated rows of a vec_id are separate
    vectors in the counts. An empty table gives an empty result.
    """
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    sound = base.where(F.expr(good))
    sizes = sorted(r["d"] for r in sound.select(F.size("v").alias("d")).distinct().collect())
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return alone
    of_rep = reduce(DataFrame.unionByName, [_linked(sound, d, threshold, tile, cell) for d in sizes])
    linked = base.join(of_rep, "v", "left")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(sound: DataFrame, d: int, threshold: float, tile: int | None, cell: float) -> DataFrame:
    """``v, n_links, component_id`` of the vectors of length ``d`` that have a link or a copy."""
    distinct = kept_table(sound.where(F.size("v") == d).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "vectors")  # written, so that numbers stay

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            u = unit(b.column(0).flatten().to_numpy().reshape(-1, d))
            total += u.T @ u
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    second = np.zeros((d, d))
    for r in distinct.select("v").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d x d numbers
        second[r["i"], r["j"]] = r["s"]
    _, axes = np.linalg.eigh((second + second.T) / 2)
    turn = np.ascontiguousarray(axes[:, ::-1])
    n_axes, base = min(4, d), int(2 / cell) + 4
    places = base ** np.arange(n_axes)

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(b.column("v").flatten().to_numpy().reshape(-1, d))
            c = np.floor(u @ turn[:, :n_axes] / cell).astype(np.int64) + base // 2
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array(c @ places), pa.array([x.tobytes() for x in u], pa.binary())], ["rep", "n", "cell", "u"])

    rows = kept_table(distinct.mapInArrow(cell_of, "rep long, n long, cell long, u binary"), "placed")
    # At most base^4 cells, whatever the number of rows.
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).toArrow()
    cells, sizes = counts["cell"].to_numpy(), counts["n"].to_numpy()
    total = int(sizes.sum())
    tile = tile or min(16384, max(2048, total // 64))
    at = cells[:, None] // places % base
    boxes = _boxes(at, sizes, max(tile, total // BOXES))
    lo, hi = np.array([at[b].min(axis=0) for b in boxes]), np.array([at[b].max(axis=0) for b in boxes])
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    parts = [-(-int(sizes[b].sum()) // tile) for b in boxes]
    first = np.concatenate(([0], np.cumsum(parts)[:-1])).tolist()
    near = []
    for g in range(len(boxes)):
        gap = np.maximum(0, np.maximum(lo[g], lo[g:]) - np.minimum(hi[g], hi[g:]) - 1) * cell
        near += [(first[g], parts[g], first[h], parts[h]) for h in (g + np.nonzero((gap * gap).sum(axis=1) <= reach * reach)[0]).tolist()]
    spark = sound.sparkSession
    where = spark.createDataFrame([(int(cells[i]), parts[g], first[g]) for g, b in enumerate(boxes) for i in b], "cell long, parts long, first long")
    in_tile = rows.join(F.broadcast(where), "cell").select("rep", "n", "u", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("tile"))
    packed = in_tile.groupBy("tile").applyInArrow(_packed, "tile long, reps binary, ns binary, us binary")
    path = scratch_path(spark, "tiles")
    packed.withColumn("file", F.col("tile")).write.partitionBy("file").parquet(path)
    # Pairs of boxes are bounded; their tiles are paired on the executors, ROW partners to a row.
    pairs = spark.createDataFrame(near, "f long, m long, g long, n long").select(F.explode(F.sequence("f", F.expr("f + m - 1"))).alias("a"), "g", "n").select("a", F.explode(F.sequence("g", F.expr("g + n - 1"))).alias("b")).where("a <= b")
    work = pairs.groupBy("a", F.floor(F.col("b") / ROW).alias("r")).agg(F.collect_list("b").alias("bs")).select("a", "bs")
    shared = spark.sparkContext.broadcast(turn)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pa.fs.FileSystem.from_uri(path)

        def tile_of(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            folder = f"{top}/file={k}"
            if store.get_file_info(folder).type == pa.fs.FileType.NotFound:
                return None  # the hash gave it no vector
            t = pq.read_table(folder, filesystem=store, columns=["reps", "ns", "us"], partitioning=None)
            return np.frombuffer(t["reps"][0].as_py(), np.int64), np.frombuffer(t["ns"][0].as_py(), np.int64), np.frombuffer(t["us"][0].as_py()).reshape(-1, d)

        for batch in batches:
            for r in batch.to_pylist():
                left = tile_of(r["a"])
                for k in r["bs"] if left else []:
                    one = k == r["a"]
                    right = left if one else tile_of(k)
                    if right is None:
                        continue
                    reps, ns = [left[0], right[0]], [left[1], right[1]]
                    more, found = [np.zeros(len(x), np.int64) for x in reps], []
                    forest = _Forest(len(reps[0]) if one else len(reps[0]) + len(reps[1]))
                    shift = 0 if one else len(reps[0])
                    every = np.concatenate(reps)
                    for x, y in close_pairs(left[2], right[2], shared.value, threshold, same=one):
                        more[0] += np.bincount(x, ns[1][y], len(reps[0])).astype(np.int64)
                        into = more[0] if one else more[1]
                        into += np.bincount(y, ns[0][x], len(reps[1])).astype(np.int64)
                        found += forest.add(x, y + shift)
                    own = [(reps[s][k], reps[s][k], more[s][k]) for s in ((0,) if one else (0, 1)) for k in np.nonzero(more[s])[0]]
                    out = own + [(every[i], every[j], 0) for i, j in found]
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["a", "b", "n"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = kept_table(work.repartition(tasks, "a", "bs").mapInArrow(compare, "a long, b long, n long"), "links")
    counted = found.where("a = b").groupBy("a").agg(F.sum("n").alias("more")).withColumnsRenamed({"a": "rep"})
    named = components(found.where("a <> b").select("a", "b"), "vectors-cc").withColumnsRenamed({"node": "rep", "component": "root"})
    # The copies of a vector are found again by the vector itself; only vectors with a link or a copy go on.
    placed = distinct.join(counted, "rep", "left").join(named, "rep", "left").where("n > 1 or more is not null").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(least, "root").select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")


def _boxes(at: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """The cells ``at`` in boxes of up to ``most`` vectors (or one cell), each cut across its longest side at the median."""
    out, todo = [], [np.arange(len(at))]
    while todo:
        b = todo.pop()
        wide = np.ptp(at[b], axis=0)
        if sizes[b].sum() <= most or not wide.max():
            out.append(b)
            continue
        k = int(wide.argmax())
        b = b[np.argsort(at[b, k], kind="stable")]
        half = np.searchsorted(np.cumsum(sizes[b]), sizes[b].sum() / 2)
        cut = at[b[half], k]
        left = at[b, k] < cut if (at[b, k] < cut).any() else at[b, k] <= cut  # cells of one place stay together
        todo += [b[~left], b[left]]
    return out


def _packed(table: pa.Table) -> pa.Table:
    """A tile's rows as one row of packed arrays; a tile has a bounded number of rows."""
    order = np.argsort(table["rep"].to_numpy())
    us = b"".join(table["u"].take(pa.array(order)).to_pylist())
    return pa.table({"tile": pa.array([table["tile"][0].as_py()], pa.int64()), "reps": pa.array([table["rep"].to_numpy()[order].astype(np.int64).tobytes()], pa.binary()), "ns": pa.array([table["n"].to_numpy()[order].astype(np.int64).tobytes()], pa.binary()), "us": pa.array([us], pa.binary())})
