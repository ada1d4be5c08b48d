"""k-means with all starts and all numbers of clusters in shared passes, and the Euclidean silhouette.

Centre sets are small; the rows are not. So a pass assigns each row under every set that still moves, and tasks send sums per set and cluster; how
often the rows are read doesn't grow with starts or with the numbers of clusters that are tried. Where tasks can run at the same time, all passes are one
barrier stage: each task keeps its rows in a file of its own and only sums are exchanged, so that Spark reads and sends the rows once.
"""

from __future__ import annotations

import os
import re
import secrets
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import vec
from spindrift.sources.tables import saved

#: Rows that first centres are drawn from, and that a silhouette is taken of.
SAMPLE = 10_000
#: Tasks of a barrier stage at most; the first of them receives the sums of all.
MOST_TASKS = 64
#: So few rows aren't worth tasks that wait for each other: each step is a job.
FEW = 1000


@dataclass(frozen=True)
class Centres:
    """One set of centres and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float
    rounds: int

    def assign(self, df: DataFrame, vector: str) -> DataFrame:
        """``df`` with ``cluster`` (of equal distances the first) and ``distance_to_center``; null without a usable vector."""
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("struct<cluster: int, distance_to_center: double>")
        def nearest(s):  # noqa: ANN001, ANN202
            import pandas as pd

            c = shared.value
            out = pd.DataFrame({"cluster": pd.array([None] * len(s), "Int32"), "distance_to_center": np.full(len(s), np.nan)})
            rows = [i for i, v in enumerate(s) if v is not None and len(v) == c.shape[1]]
            if rows and len(c):
                x = np.array([s.iloc[i] for i in rows], np.float64)
                d = squared(x, c)
                out.loc[rows, "cluster"] = d.argmin(axis=1)
                out.loc[rows, "distance_to_center"] = np.sqrt(((x - c[d.argmin(axis=1)]) ** 2).sum(axis=1))
            return out

        usable = F.when(_usable(vector), vec.doubles(F.col(vector)))
        found = nearest(usable)
        return df.withColumn("_n", found).select(*df.columns, "_n.cluster", F.when(F.col("_n.cluster").isNotNull(), F.col("_n.distance_to_center")).alias("distance_to_center"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0.0)


def _usable(vector: str):  # noqa: ANN202
    return F.col(vector).isNotNull() & F.expr(f"size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x))")


def sampled(df: DataFrame, key: str, vector: str, n: int = SAMPLE) -> np.ndarray:
    """The vectors of the ``n`` rows of least md5 of ``key``: a sampling operator of a stated size."""
    rows = df.where(_usable(vector)).select(vec.doubles(F.col(vector)).alias("v"), F.md5(F.col(key).cast("string")).alias("h"), key).orderBy("h", key).limit(n).select("v").collect()
    return np.array([r["v"] for r in rows], np.float64) if rows else np.zeros((0, 0))


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on the sample; fewer centres where it has fewer distinct vectors."""
    r = np.random.default_rng(seed)
    if not len(sample):
        return sample
    found = [sample[r.integers(len(sample))]]
    near = ((sample - found[0]) ** 2).sum(axis=1)
    while len(found) < k and near.sum() > 0:
        found.append(sample[r.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - found[-1]) ** 2).sum(axis=1))
    return np.array(found)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` (a column of arrays) with each array as the bytes of its doubles: one value a row to decode and send in each pass, not one a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.ascontiguousarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], ["v"])

    return saved(rows.select(F.col(rows.columns[0]).cast("array<double>").alias("v")).mapInArrow(run, "v binary"), "kmeans-packed")


def _add(total: np.ndarray, x: np.ndarray, held: np.ndarray, ends: np.ndarray) -> None:
    """Adds to ``total`` (a row a centre: sums, count, cost) the rows ``x`` under the centres ``held`` of sets that end at ``ends``; of equal distances the first counts."""
    width = held.shape[1]
    lengths = (held * held).sum(axis=1)[None, :]
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        d = lengths - 2 * part @ held.T
        square = (part * part).sum(axis=1)
        member = np.zeros((len(part), len(held)))
        lines = np.arange(len(part))
        for start, stop in zip(np.r_[0, ends[:-1]], ends, strict=True):
            own = start + d[:, start:stop].argmin(axis=1)
            member[lines, own] = 1.0
            total[start, width + 1] += float(np.maximum(square + d[lines, own], 0.0).sum())
        total[:, :width] += member.T @ part
        total[:, width] += member.sum(axis=0)


def _of_sets(total: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    return [(t[:, :-2], t[:, -2], float(t[:, -1].sum())) for t in np.split(total, ends[:-1])]


def _pass(rows: DataFrame, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set its clusters' sums and counts, and the cost; one pass over packed rows for all of them. A task sends one row, of the size of all sets."""
    every = np.concatenate(sets)
    ends = np.cumsum([len(c) for c in sets])
    shared = rows.sparkSession.sparkContext.broadcast((every, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stops = shared.value
        total = np.zeros((len(held), held.shape[1] + 2))
        for b in batches:
            _add(total, np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(b.num_rows, held.shape[1]), held, stops)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros((len(every), every.shape[1] + 2))
    for r in rows.mapInArrow(run, "total binary").collect():
        total += np.frombuffer(bytes(r["total"]), np.float64).reshape(total.shape)
    shared.unpersist()
    return _of_sets(total, ends)


def _steps(sets: list[np.ndarray], iterations: int, tolerance: float, met: Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray, float]]]) -> list[Centres]:
    """Lloyd's steps of all sets, with ``met`` for what the rows say of the sets that still move."""
    now, rounds, done = list(sets), [0] * len(sets), [False] * len(sets)
    costs = [0.0] * len(sets)
    for turn in range(iterations + 1):
        moving = [i for i, d in enumerate(done) if not d]
        if not moving:
            break
        for i, (sums, counts, cost) in zip(moving, met([now[i] for i in moving]), strict=True):
            costs[i] = cost
            after = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now[i])
            if turn == iterations or np.sqrt(((after - now[i]) ** 2).sum(axis=1)).max() < tolerance:
                done[i] = True
            else:
                now[i], rounds[i] = after, turn + 1
    return [Centres(c, cost, n) for c, cost, n in zip(now, costs, rounds, strict=True)]


def slots(sc: SparkContext) -> int:
    """How many tasks surely run at the same time, MOST_TASKS at most; 0 where executors come and go, as a barrier stage can't be had then."""
    conf = sc.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    if local := re.match(r"local\[(\*|\d+)", sc.master):
        cores = os.cpu_count() or 1 if local[1] == "*" else int(local[1])
    elif cluster := re.match(r"local-cluster\[\s*(\d+)\s*,\s*(\d+)", sc.master):
        cores = int(cluster[1]) * int(cluster[2])
    else:
        cores = 1 if sc.master == "local" else (sc._jsc.sc().getExecutorMemoryStatus().size() - 1) * int(conf.get("spark.executor.cores", "1"))
    return min(cores // int(conf.get("spark.task.cpus", "1")), MOST_TASKS)


@contextmanager
def _summed(context: BarrierTaskContext, secret: bytes) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """A function that adds up the arrays of all tasks of a barrier stage, in the order of their numbers, for each of them: by the first task, since a message of the barrier itself takes a second."""
    tasks = context.getTaskInfos()
    if context.partitionId() == 0:
        with Listener(("", 0), backlog=len(tasks), authkey=secret) as door:
            context.allGather(str(door.address[1]))
            met = [door.accept() for _ in tasks[1:]]
            others = [c for _, c in sorted((int(c.recv_bytes()), c) for c in met)]

            def summed(own: np.ndarray) -> np.ndarray:
                for c in others:
                    own = own + np.frombuffer(c.recv_bytes()).reshape(own.shape)
                for c in others:
                    c.send_bytes(own.tobytes())
                return own

            try:
                yield summed
            finally:
                for c in others:
                    c.close()
    else:
        port = int(context.allGather("")[0])
        with Client((tasks[0].address.rsplit(":", 1)[0], port), authkey=secret) as first:
            first.send_bytes(str(context.partitionId()).encode())

            def summed(own: np.ndarray) -> np.ndarray:
                first.send_bytes(own.tobytes())
                return np.frombuffer(first.recv_bytes()).reshape(own.shape)

            yield summed


def _together(rows: DataFrame, sets: list[np.ndarray], iterations: int, tolerance: float, tasks: int) -> list[Centres]:
    """All of Lloyd's steps in one barrier stage. A task reads its rows from its own file, a piece at a time; all tasks are given the same sums, and so make the same steps."""
    shared = rows.sparkSession.sparkContext.broadcast((sets, secrets.token_bytes(32)))
    kind = np.dtype(np.float32 if rows.schema[0].dataType == T.ArrayType(T.FloatType()) else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (first, secret) = BarrierTaskContext.get(), shared.value
        width = first[0].shape[1]
        with tempfile.TemporaryFile() as own, _summed(context, secret) as summed:
            for b in batches:
                flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != b.num_rows * width:
                    raise ValueError(f"not all vectors have {width} places")
                own.write(np.ascontiguousarray(flat, kind).tobytes())

            def met(moving: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
                held, ends = np.concatenate(moving), np.cumsum([len(c) for c in moving])
                total = np.zeros((len(held), width + 2))
                own.seek(0)
                while piece := own.read(8192 * width * kind.itemsize):
                    _add(total, np.frombuffer(piece, kind).reshape(-1, width).astype(np.float64), held, ends)
                return _of_sets(summed(total), ends)

            found = _steps(first, iterations, tolerance, met)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([c.centres.tobytes() for c in found], pa.binary()), pa.array([c.cost for c in found]), pa.array([c.rounds for c in found])], ["centres", "cost", "rounds"])

    dealt = rows if kind == np.float32 else rows.select(F.col(rows.columns[0]).cast("array<double>"))
    found = dealt.repartition(tasks).mapInArrow(run, "centres binary, cost double, rounds long", barrier=True).collect()
    shared.unpersist()
    return [Centres(np.frombuffer(bytes(r["centres"])).reshape(c.shape), r["cost"], r["rounds"]) for r, c in zip(found, sets, strict=True)]


def lloyd(rows: DataFrame, sets: list[np.ndarray], iterations: int = 300, tolerance: float = 1e-4, together: bool = True) -> list[Centres]:
    """Each set of first centres after Lloyd's steps over ``rows`` (a column of arrays), until its centres move by less than ``tolerance`` or ``iterations`` are done.

    A cluster without rows keeps its centre. The cost is that of the centres returned. Without ``slots``, or not ``together``, each step is a job of its own.
    """
    if not sets or not len(sets[0]):
        return [Centres(c, 0.0, 0) for c in sets]
    if together and (tasks := slots(rows.sparkSession.sparkContext)):
        return _together(rows, sets, iterations, tolerance, tasks)
    packed = _packed(rows)
    return _steps(sets, iterations, tolerance, lambda moving: _pass(packed, moving))


def kmeans(df: DataFrame, key: str, vector: str, ks: list[int], starts: int = 10, iterations: int = 300, seed: int = 42) -> dict[int, Centres]:
    """For each number of clusters the best of ``starts`` by cost over all rows; first centres are drawn from a sample of SAMPLE rows.

    Rows whose vector is null, empty or holds null or NaN are left out; with fewer distinct vectors than k there are fewer clusters.
    """
    rows = df.where(_usable(vector)).select(F.col(vector).alias("v"))
    sample = sampled(df, key, vector)
    tried = [(k, first_centres(sample, k, seed + i)) for k in ks for i in range(starts)]
    found = lloyd(rows, [c for _, c in tried], iterations, together=len(sample) > FEW)
    return {k: min((f for (of, _), f in zip(tried, found, strict=True) if of == k), key=lambda f: f.cost) for k in ks}


def silhouette_rows(df: DataFrame, key: str, vector: str, cluster: str, most: int = SAMPLE) -> DataFrame:
    """``key, silhouette`` of each row of the sample of ``most`` rows (of least md5 of ``key``): (b - a) / max(a, b) with a the mean Euclidean distance to the others of its
    cluster and b the least mean distance to another cluster. Alone in its cluster, or without another cluster, a row has 0. Null clusters and vectors are left out.

    The sample is what every row is compared with: it is broadcast, and rows are compared in tiles of 512.
    """
    usable = df.where(_usable(vector) & F.col(cluster).isNotNull()).select(key, vec.doubles(F.col(vector)).alias("v"), F.col(cluster).cast("long").alias("c"))
    sample = saved(usable.withColumn("h", F.md5(F.col(key).cast("string"))).orderBy("h", key).limit(most).drop("h"), "silhouette").repartition(8)
    held = sample.select("v", "c").collect()
    if not held:
        return sample.select(key, F.lit(None).cast("double").alias("silhouette"))
    x, labels = np.array([r["v"] for r in held], np.float64), np.array([r["c"] for r in held])
    names = np.unique(labels)
    member = (labels[:, None] == names[None, :]).astype(np.float64)
    shared = df.sparkSession.sparkContext.broadcast((x, member, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, of, known = shared.value
        sizes = of.sum(axis=0)
        for b in batches:
            if not b.num_rows:
                continue
            own_x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            own = np.searchsorted(known, b.column(2).to_numpy(zero_copy_only=False))
            out = np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 512):
                tile, mine = own_x[at : at + 512], own[at : at + 512]
                d = np.sqrt(squared(tile, every))
                sums, rows = d @ of, np.arange(len(tile))
                a = sums[rows, mine] / np.maximum(sizes[mine] - 1, 1)
                means = sums / sizes
                means[rows, mine] = np.inf
                least = means.min(axis=1)
                value = np.where((sizes[mine] > 1) & np.isfinite(least) & (np.maximum(a, least) > 0), (least - a) / np.where(np.maximum(a, least) > 0, np.maximum(a, least), 1), 0.0)
                out[at : at + 512] = np.where(np.isfinite(value), value, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], [key, "silhouette"])

    return sample.select(key, "v", "c").mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, silhouette double")


def best_k(df: DataFrame, key: str, vector: str, ks: list[int], starts: int = 10, seed: int = 42) -> DataFrame:
    """``k, cost, silhouette``: fitted on all rows, all in the same passes; the silhouette is that of the sample. The best is ``max_by(k, silhouette)``."""
    found = kmeans(df, key, vector, ks, starts, seed=seed)
    sample = saved(df.where(_usable(vector)).select(key, vector).orderBy(F.md5(F.col(key).cast("string")), key).limit(SAMPLE), "silhouette-sample")  # the rows that silhouette_rows takes
    rows = [(k, f.cost, silhouette_rows(f.assign(sample, vector), key, vector, "cluster").agg(F.avg("silhouette")).first()[0]) for k, f in found.items()]
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")
