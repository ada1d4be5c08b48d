"""Boosted trees for several classes by softmax, on histograms of binned features.

Each feature is cut at quantiles; a pass over the rows adds up gradients and Hessians per class, node, feature and bin, tasks send their
sums only, and the splits of a level are chosen from them for the trees of all classes at once. So a round is one pass a level, whatever the rows are, and what the driver holds is
classes x nodes x features x bins numbers. Margins are written with the rows every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources.tables import saved

#: Rounds whose trees are applied again in each pass before margins are written.
HOLD = 3
#: The margin of each class before the first tree.
START = 0.5


@dataclass
class Tree:
    """Nodes by number, the root first. A row goes left where its feature is at most ``cut`` (nulls and NaN always do); leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        n = len(self.feature)
        for column, fill in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0.0)):
            column += [fill, fill]
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        return n, n + 1

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` (missing is -inf)."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x)]


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A column of arrays of one length as a matrix; null and NaN become -inf."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.where(np.isnan(x), -np.inf, x)


@dataclass
class Boosted:
    """``trees`` by round and class; ``classes`` are the labels in order; ``losses`` the weighted log loss before each round and after the last."""

    classes: list[float]
    width: int
    trees: list[list[Tree]]
    losses: list[float]

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.full((len(x), len(self.classes)), 0.0 if first else START)
        for round_ in self.trees[first:]:
            for k, t in enumerate(round_):
                out[:, k] += t.leaves(x)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """With ``probability`` (by class, summing to 1), ``prediction`` (of ties the first class) and ``confidence``, the greatest probability."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        width = self.width

        @F.pandas_udf("array<double>")
        def probability(s):  # noqa: ANN001, ANN202
            import pandas as pd

            x = np.array([[np.nan if y is None else y for y in v] for v in s], np.float64).reshape(-1, width)
            return pd.Series(list(softmax(shared.value.margins(np.where(np.isnan(x), -np.inf, x)))))

        labels = F.array(*map(F.lit, self.classes))
        out = df.withColumn("probability", probability(as_array(df, features)))
        return out.withColumn("prediction", F.get(labels, (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))).withColumn("confidence", F.array_max("probability"))


def as_array(df: DataFrame, features: str) -> Column:
    return F.col(features).cast("array<double>") if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)


def cut_points(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """For each place of ``features`` up to ``bins`` - 1 cuts at quantiles of what isn't missing, in one aggregate with map-side combining."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    places = rows.select(F.posexplode("features").alias("f", "x")).where("x is not null and not isnan(x)")
    found = places.groupBy("f").agg(F.percentile_approx("x", shares, 10_000).alias("q"), F.max("x").alias("most"))
    out: dict[int, np.ndarray] = {r["f"]: np.unique([x for x in r["q"] if x < r["most"]]) for r in found.collect()}
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    return [np.array(out.get(f, ()), np.float64) for f in range(width)]


def best_splits(g: np.ndarray, h: np.ndarray, smooth: float, least: float) -> list[tuple[float, int, int]]:
    """For each node of ``g, h`` (nodes x features x bins) the gain, feature and bin of its best split; no gain is 0, ties go to the first."""
    if not g.size:
        return [(0.0, 0, 0)] * len(g)
    left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
    all_g, all_h = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - all_g**2 / (all_h + smooth)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
    if not gain.size:
        return [(0.0, 0, 0)] * len(g)
    flat = gain.reshape(len(gain), -1)
    return [(float(flat[i, a]), *map(int, divmod(int(a), gain.shape[2]))) for i, a in enumerate(flat.argmax(axis=1))]


def fit(train: DataFrame, label: str = "label", features: str = "features", weight: str | None = "weight", rounds: int = 20, depth: int = 4, rate: float = 0.1, bins: int = 32, smooth: float = 1.0, least: float = 1.0) -> Boosted:
    """A tree for each class and round, each fitted to the gradients of the log loss of all margins before the round.

    ``smooth`` is added to sums of Hessians, and a child has ``least`` of them. Rows without a label or features are left out; a null or missing weight is 1.
    Features that are null or NaN go left everywhere. A table of one class, or an empty one, gives trees without splits.
    """
    usable = train.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in train.columns else F.lit(1.0)
    rows = saved(usable.select(as_array(train, features).alias("features"), F.col(label).cast("double").alias("label"), w.alias("w")), "boost-rows")
    classes = sorted(r[0] for r in rows.select("label").distinct().limit(1001).collect())
    if len(classes) > 1000:
        raise ValueError(f"{label} has more than 1000 values")
    cuts = cut_points(rows, bins)
    model = Boosted(classes, len(cuts), [], [])
    if not classes:
        return model
    state = _binned(rows, model, cuts)
    held = 0  # trees of the rounds before are in the margins of ``state``
    for done in range(rounds):
        if done - held == HOLD:
            state, held = _written(state, model, held, cuts), done
        _grow(state, model, held, cuts, depth, rate, smooth, least)
    model.losses.append(_sums(state, model, held, cuts, [])[1])
    return model


def _record(model: Boosted) -> np.dtype:
    """A row as one value: the bins of its features, its class, weight and margins."""
    return np.dtype([("x", "u2", (model.width,)), ("y", "u2"), ("w", "f8"), ("m", "f8", (len(model.classes),))])


def _bytes(rows: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.dtype.itemsize
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])], ["r"])


def _rows(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)


def _on_bins(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """``tree`` for rows of bins: a value is at most the b-th cut where its bin is at most b."""
    return Tree(tree.feature, [float(np.searchsorted(cuts[f], c)) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)], tree.left, tree.right, tree.value, tree.cover)


def _binned(rows: DataFrame, model: Boosted, cuts: list[np.ndarray]) -> DataFrame:
    kind, width = _record(model), model.width
    classes = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out, x = np.zeros(b.num_rows, kind), matrix(b.column(0), width) if width else None
            for f, c in enumerate(cuts):
                out["x"][:, f] = np.searchsorted(c, x[:, f], side="left")
            out["y"], out["w"], out["m"] = np.searchsorted(classes, b.column(1).to_numpy(zero_copy_only=False)), b.column(2).to_numpy(zero_copy_only=False), START
            yield _bytes(out)

    return saved(rows.select("features", "label", "w").mapInArrow(run, "r binary"), "boost-bins")


def _later(model: Boosted, held: int, cuts: list[np.ndarray]) -> list[list[Tree]]:
    return [[_on_bins(t, cuts) for t in round_] for round_ in model.trees[held:]]


def _margins(rows: np.ndarray, x: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    m = rows["m"].copy()
    for round_ in trees:
        for c, t in enumerate(round_):
            m[:, c] += t.leaves(x)
    return m


def _written(state: DataFrame, model: Boosted, held: int, cuts: list[np.ndarray]) -> DataFrame:
    kind, shared = _record(model), state.sparkSession.sparkContext.broadcast(_later(model, held, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _rows(b, kind).copy()
            out["m"] = _margins(out, out["x"].astype(np.int64), shared.value)
            yield _bytes(out)

    return saved(state.mapInArrow(run, "r binary"), "boost-margins")


def _sums(state: DataFrame, model: Boosted, held: int, cuts: list[np.ndarray], growing: list[tuple[Tree, list[int]]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """For each class its tree's open nodes' gradients and Hessians (nodes x features x bins), and the log loss of the margins: one pass."""
    width, bins = model.width, max((len(c) for c in cuts), default=0) + 1
    sizes = [len(open_) * width * bins for _, open_ in growing]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    kind = _record(model)
    shared = state.sparkSession.sparkContext.broadcast((_later(model, held, cuts), [(_on_bins(t, cuts), open_) for t, open_ in growing]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, trees = shared.value
        g, h, loss, total = np.zeros(starts[-1]), np.zeros(starts[-1]), 0.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            rows = _rows(b, kind)
            x, own, w = rows["x"].astype(np.int64), rows["y"], rows["w"]
            p = softmax(_margins(rows, x, later))
            loss -= float((w * np.log(np.maximum(p[np.arange(len(p)), own], 1e-300))).sum())
            total += float(w.sum())
            place_of = x + np.arange(width) * bins
            for c, (tree, open_) in enumerate(trees):
                if not width:
                    continue
                place = np.full(len(tree.feature), -1)
                place[open_] = np.arange(len(open_))
                at = place[tree.nodes(x)]
                met = np.flatnonzero(at >= 0)
                if not len(met):
                    continue
                grad, hess = (w * (p[:, c] - (own == c)))[met], np.maximum(w * 2 * p[:, c] * (1 - p[:, c]), 1e-16)[met]
                key = (place_of[met] + (at[met] * (width * bins))[:, None]).ravel()
                g[starts[c] : starts[c + 1]] += np.bincount(key, np.repeat(grad, width), sizes[c])
                h[starts[c] : starts[c + 1]] += np.bincount(key, np.repeat(hess, width), sizes[c])
        met = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((met, [-1, -2]))), pa.array(np.concatenate((g[met], [loss, total]))), pa.array(np.concatenate((h[met], [0.0, 0.0])))], ["i", "g", "h"])

    got = state.mapInArrow(run, "i long, g double, h double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    shared.unpersist()
    i, g, h = (got.column(c).to_numpy() for c in range(3))
    all_g, all_h = np.zeros(starts[-1]), np.zeros(starts[-1])
    real = i >= 0
    all_g[i[real]], all_h[i[real]] = g[real], h[real]
    loss, total = float(g[i == -1].sum()), float(g[i == -2].sum())
    shape = lambda a, c: a[starts[c] : starts[c + 1]].reshape(-1, width, bins)
    return [(shape(all_g, c), shape(all_h, c)) for c in range(len(growing))], loss / total if total else 0.0


def _grow(state: DataFrame, model: Boosted, held: int, cuts: list[np.ndarray], depth: int, rate: float, smooth: float, least: float) -> None:
    """Adds a round of trees, level by level."""
    growing = [(Tree(), [0]) for _ in model.classes]
    for level in range(depth):
        sums, loss = _sums(state, model, held, cuts, growing)
        if not level:
            model.losses.append(loss)
        after = []
        for (tree, open_), (g, h) in zip(growing, sums, strict=True):
            opened = []
            for node, own_g, own_h, (gain, f, b) in zip(open_, g, h, best_splits(g, h, smooth, least), strict=True):
                if model.width:
                    total_g, total_h = float(own_g[0].sum()), float(own_h[0].sum())
                    tree.value[node], tree.cover[node] = -rate * total_g / (total_h + smooth), total_h
                if gain <= 1e-9 or b >= len(cuts[f]):
                    continue
                lo, hi = tree.split(node, f, float(cuts[f][b]))
                for child, part in ((lo, slice(0, b + 1)), (hi, slice(b + 1, None))):
                    total_g, total_h = float(own_g[f, part].sum()), float(own_h[f, part].sum())
                    tree.value[child], tree.cover[child] = -rate * total_g / (total_h + smooth), total_h
                opened += [lo, hi]
            after.append((tree, opened))
        growing = after
        if not any(open_ for _, open_ in growing):
            break
    model.trees.append([tree for tree, _ in growing])
