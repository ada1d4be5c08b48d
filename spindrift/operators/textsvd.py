"""Truncated SVD of the TF-IDF rows of texts, straight from their words.

What ``lowrank.fit`` does to rows of weights, without a row for a posting anywhere: a task counts the words of a batch of texts and keeps them as one chunk, a row of a table with its own
numbers for its terms. Chunks are dealt to pieces of about PIECE weights. Terms are dealt to ranges by a hash; a piece and a range tell each other of their terms by one array, and in a round
by one array of vectors. Terms that one piece alone holds are that piece's own: their vectors are only kept for it. Weights are made of counts and idf whenever a chunk is read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.lowrank import orthonormal
from spindrift.sources.tables import dropped, saved, scratch, tidy

#: Weights of a piece, about; a task holds the vectors of its terms, and reads its chunks one by one.
PIECE = 4_000_000
#: Words of a chunk, about.
CHUNK = 1_000_000
#: Weights that meet vectors at once, and of a run that is by itself.
STEP, LONG = 1 << 12, 48


def _ints(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.int32)


def _single(x: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.float32).reshape(-1, width)


def _row(names: list[str], *values: pa.Array | bytes | int) -> pa.RecordBatch:
    arrays = [v if isinstance(v, pa.Array) else pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values]
    return pa.RecordBatch.from_arrays(arrays, names)


def _whole(x: pa.Array) -> pa.Array:
    """One list of all of ``x``."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _part(path: str, folder: str, columns: list[str]) -> pa.Table:
    store, top = pa.fs.FileSystem.from_uri(path)
    return pq.read_table(f"{top}/{folder}", columns=columns, filesystem=store, partitioning=None)


def _sorted(values: np.ndarray) -> np.ndarray:
    """The places of ``values`` in their order; equal ones in the order of places."""
    both = (values.astype(np.int64) << 32) | np.arange(len(values))
    both.sort()
    return (both & 0xFFFFFFFF).astype(np.int32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
            yield b.slice(start, stop - start)
            start = stop


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk for each batch of ``id`` and words: its ids and terms; by row the terms' numbers (as differences, which are small) and counts; and for each term its rows."""
    number = TaskContext.get().partitionId() << 20
    for b in _cut(batches):
        words = b.column(1)
        coded = words.flatten().dictionary_encode()
        n, codes = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        if not n:
            continue
        every = np.repeat(np.arange(b.num_rows, dtype=np.int64), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * n + codes
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        of, t = np.divmod(every[first], n)
        t, tf = t.astype(np.int32), np.diff(np.r_[first, len(every)]).astype(np.int32)
        starts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)].astype(np.int32)
        numbers = [x.astype(np.int32).tobytes() for x in (starts, np.diff(t, prepend=np.int32(0)), tf, np.bincount(t, minlength=n))]
        yield _row(["b", "n", "ids", "terms", "starts", "t", "tf", "df"], number, len(t), _whole(b.column(0).take(pa.array(of[starts[:-1]]))), _whole(coded.dictionary), *numbers)
        number += 1


def _sums(starts: np.ndarray, at: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each run between ``starts``, none of them empty, the sum in double of the rows ``at`` of ``x`` by their weights. Runs of LONG weights are products, shorter ones are added up together."""
    out, lengths = np.empty((len(starts) - 1, x.shape[1])), np.diff(starts)
    for i in np.flatnonzero(lengths >= LONG):
        part = slice(starts[i], starts[i + 1])
        out[i] = w[part] @ x[at[part]].astype(np.float64)
    short = np.flatnonzero(lengths < LONG)
    some = np.repeat(lengths < LONG, lengths)
    at, w, starts = at[some], w[some], np.r_[0, np.cumsum(lengths[short])]
    first = 0
    while first < len(short):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + STEP, "right")) - 1)
        part = slice(starts[first], starts[last])
        out[short[first:last]] = np.add.reduceat(w[part, None] * x[at[part]], starts[first:last] - starts[first])
        first = last
    return out


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """What was sent to each target of a task, in the order of senders."""
    sent = defaultdict(list)
    for b in batches:
        for to, *rest in zip(*b.columns, strict=True):
            sent[to.as_py()].append((rest[0].as_py(), *rest[1:]))
    for to in sorted(sent):
        yield to, sorted(sent.pop(to), key=lambda x: x[0])


class _Corpus:
    """Chunks, the pieces they are dealt to, and the terms that pieces and ranges share."""

    def __init__(self, words: DataFrame, piece: int) -> None:
        self.spark = spark = words.sparkSession
        self.kind = words.schema["id"].dataType.simpleString()
        self.chunks, self.met, self.by_piece, self.by_range = (scratch(spark, f"svd-{x}") for x in ("chunks", "met", "pieces", "ranges"))
        schema = f"b long, n long, ids array<{self.kind}>, terms array<string>, starts binary, t binary, tf binary, df binary"
        words.mapInArrow(_pack, schema).write.option("compression", "zstd").partitionBy("b").parquet(self.chunks)
        sizes = sorted(((r["n"], r["b"]) for r in spark.read.schema("n long, b long").parquet(self.chunks).collect()), reverse=True)  # a row a chunk
        self.weights = sum(n for n, _ in sizes)
        tasks = spark.sparkContext.defaultParallelism
        least = -(-self.weights // piece)
        self.pieces = max(1, min(len(sizes), -(-max(1, least) // tasks) * tasks), least)
        held, self.dealt = [0] * self.pieces, [[] for _ in range(self.pieces)]
        for n, b in sizes:
            p = min(range(self.pieces), key=lambda i: (held[i], i))
            held[p] += n
            self.dealt[p].append(b)
        self.terms = self._numbered() if sizes else 0

    def _tasks(self) -> DataFrame:
        return self.spark.range(0, self.pieces, 1, self.pieces)

    def _to(self, sent: DataFrame) -> DataFrame:
        return sent.repartitionById(self.pieces, F.col("to").cast("int"))

    def _numbered(self) -> int:
        """Numbers the terms of each piece and of each range; returns how many terms there are."""
        chunks, dealt, n = self.chunks, self.dealt, self.pieces

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in (x.as_py() for b in batches for x in b.column(0)):
                names, counts = [], []
                for c in dealt[p]:
                    chunk = _part(chunks, f"b={c}", ["terms", "df"])
                    names.append(chunk.column("terms").combine_chunks().flatten())
                    counts.append(_ints(chunk.column("df")[0]))
                if not names:
                    continue
                coded = pa.concat_arrays(names).dictionary_encode()
                to = (pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) % n).astype(np.int64)
                order = _sorted(to)
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                of = place[coded.indices.to_numpy()]
                df = np.bincount(of, np.concatenate(counts)).astype(np.int32)
                terms, ends = coded.dictionary.take(pa.array(order)), np.searchsorted(to[order], np.arange(n + 1))
                for c, own in zip(dealt[p], np.split(of, np.cumsum([len(x) for x in names])[:-1]), strict=True):
                    yield _row(["p", "to", "c", "terms", "x"], p, -1, c, pa.nulls(1, pa.list_(pa.string())), own.tobytes())
                for r in range(n):
                    part = slice(ends[r], ends[r + 1])
                    if ends[r] < ends[r + 1]:
                        yield _row(["p", "to", "c", "terms", "x"], p, r, -1, _whole(terms[part]), df[part].tobytes())

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, sent in _by_target(batches):
                coded = pa.concat_arrays([terms.values for _, terms, _ in sent]).dictionary_encode()
                codes = coded.indices.to_numpy()
                df = np.bincount(codes, np.concatenate([_ints(x) for *_, x in sent])).astype(np.int32)
                shared = np.bincount(codes) > 1
                at = np.where(shared, np.cumsum(shared) - 1, -1).astype(np.int32)
                yield _row(["r", "p", "at", "df", "every"], r, -1, b"", b"", len(df))
                for (p, *_), own in zip(sent, np.split(codes, np.cumsum([len(x) for _, x, _ in sent])[:-1]), strict=True):
                    yield _row(["r", "p", "at", "df", "every"], r, p, at[own].tobytes(), df[own].tobytes(), int(shared.sum()))

        self._tasks().mapInArrow(tell, "p long, to long, c long, terms array<string>, x binary").write.partitionBy("p").parquet(self.met)
        told = self.spark.read.schema("to long, c long, terms array<string>, x binary, p long").parquet(self.met).where("to >= 0").select("to", "p", "terms", "x")
        table = saved(self._to(told).mapInArrow(number, "r long, p long, at binary, df binary, every long"), "svd-numbers")
        for key, path in (("p", self.by_piece), ("r", self.by_range)):
            table.where("p >= 0").withColumn("_k", F.col(key)).repartition(self.pieces, "_k").write.partitionBy("_k").parquet(path)
        terms = table.where("p < 0").agg(F.sum("every")).first()[0]
        dropped(table)
        return terms

    def _waves(self) -> list[range]:
        """Pieces that are sent vectors at once: a quarter of all, by whole numbers of tasks."""
        tasks = self.spark.sparkContext.defaultParallelism
        step = -(-max(1, self.pieces // 4) // tasks) * tasks
        return [range(i, min(i + step, self.pieces)) for i in range(0, self.pieces, step)]

    def _sent(self, block: DataFrame | None, width: int, seed: int, wave: range) -> DataFrame:
        """``to, of, v``: for each piece of ``wave`` the vectors of its terms from each range, and its own (from -1)."""
        path, first = self.by_range, block is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.column(0)[i].as_py()
                    if r < 0:
                        if -1 - r in wave:
                            yield _row(["to", "of", "v"], -1 - r, -1, b.column(1)[i].as_py())
                        continue
                    store, top = pa.fs.FileSystem.from_uri(path)
                    if store.get_file_info(f"{top}/_k={r}").type == pa.fs.FileType.NotFound:
                        continue
                    routes = _part(path, f"_k={r}", ["p", "at", "every"])
                    if first:
                        z = np.random.default_rng([seed, 0, r]).standard_normal((routes.column("every")[0].as_py(), width)).astype(np.float32)
                    else:
                        z = _single(b.column(1)[i], width)
                    for p, at, _ in zip(*routes.columns, strict=True):
                        if p.as_py() not in wave:
                            continue
                        at = _ints(at)
                        yield _row(["to", "of", "v"], p.as_py(), r, z[at[at >= 0]].tobytes())

        return (self._tasks() if first else block.select("of", "v")).mapInArrow(run, "to long, of long, v binary")

    def through(self, block: DataFrame | None, turn: np.ndarray, n_docs: int, seed: int, back: bool) -> DataFrame:
        """The rows through ``block`` times ``turn``: ``id, y``, or (``back``) the next block, ``of, v`` and its Gram matrix ``g``; both are tables. Without a block it is a random one.

        A wave of pieces after the other, so that what is shuffled at once is a part of it.
        """
        chunks, met, by_piece, by_range, dealt, n, width = self.chunks, self.met, self.by_piece, self.by_range, self.dealt, self.pieces, turn.shape[0]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p, sent in _by_target(batches):
                routes = sorted(((r.as_py(), _ints(at), _ints(df)) for r, at, df in zip(*_part(by_piece, f"_k={p}", ["r", "at", "df"]).columns, strict=True)), key=lambda x: x[0])
                ends = np.cumsum([0, *(len(at) for _, at, _ in routes)])
                shared = np.concatenate([at for _, at, _ in routes]) >= 0
                idf = np.log((1.0 + n_docs) / (1.0 + np.concatenate([df for *_, df in routes]))) + 1
                z, given = np.empty((len(shared), width), np.float32), dict(sent)
                sent.clear()
                z[~shared] = _single(given.pop(-1), width) if -1 in given else np.random.default_rng([seed, 1, p]).standard_normal((int((~shared).sum()), width))
                for (r, at, _), start, stop in zip(routes, ends, ends[1:], strict=False):
                    z[start:stop][at >= 0] = _single(given.pop(r), width)
                for i in range(0, len(z), STEP):
                    z[i : i + STEP] = z[i : i + STEP] @ turn
                out = np.zeros(z.shape) if back else None
                tell = _part(met, f"p={p}", ["c", "x"])
                places = {c.as_py(): x for c, x in zip(*tell.filter(pc.greater_equal(tell.column("c"), 0)).columns, strict=True)}
                for c in dealt[p]:
                    chunk = _part(chunks, f"b={c}", ["starts", "t", "tf"] + ([] if back else ["ids"]))
                    starts, t, tf = (_ints(chunk.column(x)[0]) for x in ("starts", "t", "tf"))
                    t = np.cumsum(t, dtype=np.int32)
                    place = _ints(places[c])
                    at = place[t]
                    w = tf * idf[at]
                    w /= np.repeat(np.sqrt(np.add.reduceat(w * w, starts[:-1])), np.diff(starts))
                    y = _sums(starts, at, w, z)
                    if not back:
                        ids = chunk.column("ids").combine_chunks().flatten()
                        for i in range(0, len(y), 10_000):
                            yield pa.RecordBatch.from_arrays([ids[i : i + 10_000], pa.array([x.tobytes() for x in y[i : i + 10_000]], pa.binary())], ["id", "y"])
                        continue
                    order = _sorted(t)
                    of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
                    out[place] += _sums(np.r_[0, np.cumsum(np.bincount(t))], of[order], w[order], y)
                if back:
                    del z
                    for (r, at, _), start, stop in zip(routes, ends, ends[1:], strict=False):
                        yield _row(["to", "of", "v"], r, p, out[start:stop][at >= 0].astype(np.float32).tobytes())
                    yield _row(["to", "of", "v"], p % n, -1 - p, out[~shared].astype(np.float32).tobytes())

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, sent in _by_target(batches):
                whole = [(of, v.as_py()) for of, v in sent if of < 0]
                routes = {p.as_py(): (_ints(at), every.as_py()) for p, at, every in zip(*_part(by_range, f"_k={r}", ["p", "at", "every"]).columns, strict=True)} if len(whole) < len(sent) else {}
                if routes:
                    total = np.zeros((next(iter(routes.values()))[1], width))
                    for of, v in sent:
                        if of >= n:
                            total += _single(v, width)
                        elif of >= 0:
                            at = routes[of][0]
                            total[at[at >= 0]] += _single(v, width)
                    whole.append((r, total.astype(np.float32).tobytes()))
                for of, v in whole:
                    x = np.frombuffer(v, np.float32).reshape(-1, width).astype(np.float64)
                    yield _row(["of", "v", "g"], of, v, (x.T @ x).tobytes())

        sent = [self._to(self._sent(block, width, seed, wave)) for wave in self._waves()]
        if not back:
            rows = [saved(x.mapInArrow(meet, f"id {self.kind}, y binary"), "svd-rows") for x in sent]
            return reduce(DataFrame.unionByName, rows)
        after = None
        for x in sent:
            more = x.mapInArrow(meet, "to long, of long, v binary")
            if after is not None:  # what the waves before have added up, from n on
                more = more.unionByName(after.select(F.when(F.col("of") < 0, F.pmod(-1 - F.col("of"), F.lit(n))).otherwise(F.col("of")).alias("to"), F.when(F.col("of") < 0, F.col("of")).otherwise(F.lit(n)).cast("long").alias("of"), "v"))
            made = saved(self._to(more).mapInArrow(add, "of long, v binary, g binary"), "svd-block")
            if after is not None:
                dropped(after)
            after = made
        return after


def _total(grams: DataFrame, width: int) -> np.ndarray:
    return sum((np.frombuffer(bytes(r["g"]), np.float64).reshape(width, width) for r in grams.select("g").collect()), np.zeros((width, width)))


def _each(run: Callable[[np.ndarray], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                yield _row(["g"], run(b.column(0).slice(i, 10_000)))

    return every


def fit(words: DataFrame, n_docs: int, k: int = 20, extra: int = 10, rounds: int = 5, seed: int = 42, piece: int = PIECE) -> tuple[DataFrame, list[float]] | None:
    """``id, reduced`` of each text with words along the ``k`` leading axes, and their singular values; ``words`` has ``id``, none null or repeated, and an array of words.

    A word weighs tf x (ln((1 + n_docs) / (1 + df)) + 1), and a text's weights are of length one. As ``lowrank.fit``: vectors are sent and kept in single precision, sums are in double, and each axis
    has its largest entry positive. Texts without words have no row; without any words at all there is nothing.
    """
    with tidy(words.sparkSession):
        corpus = _Corpus(words, piece)
        if not corpus.terms:
            return None
        width, k = min(corpus.terms, k + extra), min(corpus.terms, k)
        block, turn = None, np.eye(width)
        for _ in range(rounds):
            after = corpus.through(block, turn, n_docs, seed, True)
            if block is not None:
                dropped(block)
            block = after
            turn = orthonormal(_total(block, width))
        rows = corpus.through(block, turn, n_docs, seed, False)

        def gram(y: pa.Array) -> bytes:
            y = np.frombuffer(b"".join(y.to_pylist()), np.float64).reshape(-1, width)
            return (y.T @ y).tobytes()

        squares, inside = np.linalg.eigh(_total(rows.select("y").mapInArrow(_each(gram), "g binary"), width))
        inside = inside[:, ::-1][:, :k]
        axes = turn @ inside

        def lead(v: pa.Array) -> bytes:
            x = np.frombuffer(b"".join(v.to_pylist()), np.float32).reshape(-1, width) @ axes
            return (x[np.abs(x).argmax(axis=0), np.arange(k)] if len(x) else np.zeros(k)).tobytes()

        leads = np.array([np.frombuffer(bytes(r["g"]), np.float64) for r in block.select("v").mapInArrow(_each(lead), "g binary").collect()])
        inside = inside * np.where(leads[np.abs(leads).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        dropped(block)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, width) @ inside
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(y.ravel()))], ["id", "reduced"])

    return rows.mapInArrow(along, f"id {corpus.kind}, reduced array<double>"), [math.sqrt(max(0.0, float(x))) for x in squares[::-1][:k]]


def reduced(docs: DataFrame, key: str, tokens: Column, k: int = 20) -> DataFrame | None:
    """``id, reduced`` of ``docs`` by ``fit``; nothing where a key is null or repeated or there are no words."""
    if not docs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        return None
    made = fit(docs.select(F.col(key).alias("id"), tokens.alias("words")), docs.count(), k)
    return made and made[0]
