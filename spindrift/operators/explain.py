"""Shapley values of tree models: how much each feature moves a row's score from the mean, by what the trees know of covers.

A leaf counts for a row as far as the row fits the conditions on its path; a feature that is left out counts by the share of
cover that goes the path's way. For each leaf the values of its features depend on which conditions the row meets only, so they are worked out
once for each set of conditions, and a row is a lookup a leaf: nothing is summed over subsets of features per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.boosting import START, Boosted, Tree, as_array, matrix

#: Features on one path; a lookup has two to this power entries.
MOST_FEATURES = 16


@dataclass
class Leaf:
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray  # by the set of conditions met (bits in order of ``features``), the value of each feature


@dataclass
class Explained:
    """By class: its ``leaves`` and the mean ``base`` that contributions start from."""

    classes: list[float]
    width: int
    leaves: list[list[Leaf]]
    base: list[float]

    def values(self, x: np.ndarray, k: int) -> np.ndarray:
        """Contributions to the score of class ``k``: rows x features."""
        out = np.zeros((len(x), self.width))
        for leaf in self.leaves[k]:
            own = x[:, leaf.features]
            met = ((own > leaf.low) | np.isneginf(leaf.low)) & (own <= leaf.high)
            out[:, leaf.features] += leaf.table[met @ (1 << np.arange(len(leaf.features)))]
        return out

    def contributions(self, df: DataFrame, key: str, names: list[str], features: str = "features", of: str | None = None) -> DataFrame:
        """``key, class, base, feature, value`` of each row and feature, for the class in the column ``of`` or, without it, for every class.

        For each row and class ``base`` and the values add up to its score: margins of boosted trees, probabilities of a forest. A row
        of a class that the model doesn't know has no contributions. Rows of one key come out as often as they went in.
        """
        if len(names) != self.width:
            raise ValueError(f"the model has {self.width} features")
        shared = df.sparkSession.sparkContext.broadcast(self)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column(1), width)
                asked = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                for k, c in enumerate(known.classes):
                    own = np.flatnonzero(asked == c) if of else np.arange(len(x))
                    if not len(own):
                        continue
                    found = known.values(x[own], k)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(np.repeat(own, width))), pa.array(np.full(n * width, c)), pa.array(np.full(n * width, known.base[k])), pa.array(names * n), pa.array(found.ravel())],
                        [key, "class", "base", "feature", "value"])

        rows = df.where(F.col(features).isNotNull()).select(key, as_array(df, features).alias("_x"), (F.col(of).cast("double") if of else F.lit(0.0)).alias("_c"))
        return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, class double, base double, feature string, value double")


def _leaf_table(shares: np.ndarray, value: float) -> np.ndarray:
    """For each set of met conditions the Shapley value of each feature, of the game in which a feature in the coalition counts 1 if met and else 0, and one outside its share."""
    m = len(shares)
    met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(np.float64)
    out = np.zeros((1 << m, m))
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    for f in range(m):
        sums = np.zeros((1 << m, m))  # by size of the coalition of the others
        sums[:, 0] = 1
        for j in range(m):
            if j != f:
                sums = sums * shares[j] + np.column_stack([np.zeros(1 << m), sums[:, :-1]]) * met[:, j : j + 1]
        out[:, f] = value * (met[:, f] - shares[f]) * (sums @ weights)
    return out


def _leaves(tree: Tree, value: list[float]) -> tuple[list[Leaf], float]:
    """The leaves of ``tree`` with these values, and the tree's mean by cover."""
    found, mean = [], 0.0
    todo = [(0, {}, 1.0)]
    while todo:
        node, path, reach = todo.pop()
        f = tree.feature[node]
        if f < 0:
            mean += reach * value[node]
            if path and value[node]:
                if len(path) > MOST_FEATURES:
                    raise ValueError(f"a path has more than {MOST_FEATURES} features")
                order = sorted(path)
                low, high, share = (np.array([path[x][i] for x in order], np.float64) for i in range(3))
                found.append(Leaf(np.array(order), low, high, _leaf_table(share, value[node])))
            continue
        total = tree.cover[tree.left[node]] + tree.cover[tree.right[node]]
        for child, lower in ((tree.left[node], False), (tree.right[node], True)):
            share = tree.cover[child] / total if total else 0.5
            low, high, known = path.get(f, (-np.inf, np.inf, 1.0))
            bounds = (max(low, tree.cut[node]), high) if lower else (low, min(high, tree.cut[node]))
            todo.append((child, {**path, f: (*bounds, known * share)}, reach * share))
    return found, mean


def explain_boosted(model: Boosted) -> Explained:
    """Contributions to the margins."""
    leaves, base = [[] for _ in model.classes], [START for _ in model.classes]
    for round_ in model.trees:
        for k, tree in enumerate(round_):
            more, mean = _leaves(tree, tree.value)
            leaves[k] += more
            base[k] += mean
    return Explained(model.classes, model.width, leaves, base)


def forest_trees(spark: SparkSession, model: RandomForestClassificationModel, folder: str) -> list[tuple[Tree, np.ndarray]]:
    """The trees of a forest and each node's probabilities, as the model itself writes them below ``folder``. Continuous features only."""
    model.write().overwrite().save(folder)
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    out: dict[int, tuple[Tree, list]] = {}
    for r in rows:
        tree, shares = out.setdefault(r["treeID"], (Tree([], [], [], [], [], []), []))
        if r["leftChild"] >= 0 and r["split"]["numCategories"] >= 0:
            raise ValueError("splits by categories aren't explained")
        inner = r["leftChild"] >= 0
        tree.feature.append(r["split"]["featureIndex"] if inner else -1)
        tree.cut.append(r["split"]["leftCategoriesOrThreshold"][0] if inner else 0.0)
        tree.left.append(r["leftChild"])
        tree.right.append(r["rightChild"])
        tree.value.append(0.0)
        total = sum(r["impurityStats"])
        tree.cover.append(total)
        shares.append([x / total if total else 0.0 for x in r["impurityStats"]])
    return [(tree, np.array(shares)) for tree, shares in out.values()]


def explain_forest(spark: SparkSession, model: RandomForestClassificationModel, folder: str) -> Explained:
    """Contributions to the probabilities, the mean of the trees'."""
    trees = forest_trees(spark, model, folder)
    leaves, base = [[] for _ in range(model.numClasses)], [0.0] * model.numClasses
    for tree, shares in trees:
        for k in range(model.numClasses):
            more, mean = _leaves(tree, list(shares[:, k] / len(trees)))
            leaves[k] += more
            base[k] += mean
    return Explained([float(k) for k in range(model.numClasses)], model.numFeatures, leaves, base)
