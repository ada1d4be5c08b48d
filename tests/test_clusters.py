"""k-means in shared passes, the silhouette and even folds against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.operators import clusters, ml, select


def points(seed=2, n=500, d=6):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 4, (5, d))
    return np.array([centres[i % 5] + r.normal(0, 1, d) for i in range(n)])


@pytest.fixture(scope="module")
def rows(spark):
    x = points()
    return x, spark.createDataFrame([(i, [float(v) for v in p], i % 5) for i, p in enumerate(x)] + [(900, None, 0), (901, [], 1), (902, [None] * 6, 1), (903, [float("nan")] * 6, None)], "id long, v array<double>, c int").repartition(6)


def plain_lloyd(x, c, iterations, tolerance=1e-4):
    for turn in range(iterations + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        after = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        if turn == iterations or np.sqrt(((after - c) ** 2).sum(axis=1)).max() < tolerance:
            return c, d.min(axis=1).sum(), turn
        c = after


def test_all_starts_in_shared_passes(rows, monkeypatch):
    x, df = rows
    passes = []
    whole = clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda r, s: passes.append(len(s)) or whole(r, s))
    found = clusters.kmeans(df, "id", "v", [3, 5], starts=4)
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    sets = {k: [plain_lloyd(x, clusters.first_centres(x[order], k, 42 + i), 300) for i in range(4)] for k in (3, 5)}
    for k, f in found.items():
        centres, cost, _ = min(sets[k], key=lambda s: s[1])
        assert np.allclose(f.centres, centres) and abs(f.cost - cost) < 1e-6
    assert passes[0] == 8 and len(passes) == 1 + max(s[2] for k in sets for s in sets[k])  # as many as the slowest start needs, not the sum
    done = {r["id"]: r for r in found[5].assign(df, "v").collect()}
    own = ((x[:, None] - found[5].centres[None]) ** 2).sum(axis=2)
    assert all(done[i]["cluster"] == own[i].argmin() and abs(done[i]["distance_to_center"] - np.sqrt(own[i].min())) < 1e-9 for i in range(500))
    assert all(done[i]["cluster"] is None and done[i]["distance_to_center"] is None for i in (900, 901, 902, 903))


def test_kmeans_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)], "id long, v array<double>")
    found = clusters.kmeans(df, "id", "v", [4], starts=2)[4]
    assert found.centres.shape == (2, 2) and found.cost == 0
    none = clusters.kmeans(df.limit(0), "id", "v", [4], starts=2)[4]
    assert len(none.centres) == 0 and none.assign(df, "v").where("cluster is not null").count() == 0


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(labels):
        same = [j for j in range(len(x)) if labels[j] == c and j != i]
        others = [d[i, labels == o].mean() for o in set(labels) - {c}]
        a, b = d[i, same].mean() if same else None, min(others) if others else None
        out.append(0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return out


def test_silhouette(rows, spark):
    x, df = rows
    labels = np.array([i % 5 if i % 7 else i % 3 for i in range(len(x))])
    labels[11] = 77  # alone
    placed = df.where("id < 500").join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, k int"), "id").unionByName(df.where("id >= 500").withColumn("k", F.lit(1)))
    got = {r["id"]: r["silhouette"] for r in clusters.silhouette_rows(placed, "id", "v", "k").collect()}
    assert got.keys() == set(range(500))
    assert np.allclose([got[i] for i in range(500)], plain_silhouette(x, labels), atol=1e-6)
    assert clusters.silhouette_rows(placed, "id", "v", "k", most=100).count() == 100
    one = clusters.silhouette_rows(placed.withColumn("k", F.lit(1)), "id", "v", "k")
    assert {r["silhouette"] for r in one.collect()} == {0.0}
    assert clusters.silhouette_rows(placed.limit(0), "id", "v", "k").count() == 0


def test_best_k(rows):
    report = clusters.best_k(rows[1], "id", "v", [2, 5, 8], starts=5)
    assert report.agg(F.max_by("k", "silhouette")).first()[0] == 5
    costs = {r["k"]: r["cost"] for r in report.collect()}
    assert costs[2] > costs[5] > costs[8]


def test_folds(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["often"] * 60 + ["seldom"] * 3 + [None])) for i in range(3000)] + [(5000, "once"), (5001, "twice"), (5002, "twice")]
    done = select.folds(spark.createDataFrame(rows, "id long, label string").repartition(7), "label", "id", 3).collect()
    assert len(done) == len(rows)
    counts = collections.Counter((r["label"], r["fold"]) for r in done)
    for label in {x[1] for x in rows}:
        per = [counts[label, f] for f in range(3)]
        assert max(per) - min(per) <= 1
    assert counts["once", 0] == 1 and counts["twice", 0] == counts["twice", 1] == 1
    assert select.folds(spark.createDataFrame([], "id long, label string"), "label", "id", 3).count() == 0


def test_grid_search_with_even_folds(spark):
    rows = [(i, float(i % 10 == 0), [float(i % 10), float(i % 7)]) for i in range(60)]
    df = ml.weighted(ml.with_vector(spark.createDataFrame(rows, "id long, label double, v array<double>"), "v"), "label", "balanced")
    _, report = ml.grid_search(df, grid={"numTrees": [3], "maxDepth": [1, 3]}, key="id")
    got = report.collect()
    assert len(got) == 2 and {r["rank"] for r in got} <= {1, 2} and all(0 < r["mean_f1"] <= 1 for r in got)


def test_kmeans_is_tighter_than_labels_without_clusters(spark, tmp_path):
    from spindrift.plans import QUERIES

    x = np.random.default_rng(0).normal(size=(20_000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(np.arange(len(x), dtype=np.int32) % 10)})).write.parquet(str(tmp_path / "embeddings.parquet"))
    row = QUERIES["kmeans_assign"](spark, str(tmp_path)).first()
    assert (row["n"], row["nearest"], row["tighter"]) == (20_000, True, True)


def test_a_pass_sends_a_row_a_task(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    rows = clusters._packed(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3))
    assert dict(rows.dtypes) == {"v": "binary"}
    sets = [x[:2], x[5:10]]
    for centres, (sums, counts, cost) in zip(sets, clusters._pass(rows, sets), strict=True):
        d = clusters.squared(x, centres)
        own = d.argmin(axis=1)
        assert np.array_equal(counts, np.bincount(own, minlength=len(centres)))
        assert np.allclose(sums, [x[own == i].sum(axis=0) for i in range(len(centres))])
        assert np.isclose(cost, d.min(axis=1).sum())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_steps_are_one_job_over_many_rows(spark, monkeypatch, kind):
    def never(*_):
        raise AssertionError("a job a step")

    monkeypatch.setattr(clusters, "_pass", never)
    x = np.random.default_rng(5).normal(size=(3000, 4))
    x[::3] += 3
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "v": pa.array(list(x), pa.list_(pa.float64()))})).select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    found = clusters.kmeans(df.repartition(5), "id", "v", [2, 4], starts=2)
    for k, f in found.items():
        tried = [plain_lloyd(x, clusters.first_centres(x[order], k, 42 + i), 300) for i in range(2)]
        assert abs(f.cost - min(cost for _, cost, _ in tried)) < 1e-6
        assert any(np.allclose(f.centres, centres) and f.rounds == rounds for centres, _, rounds in tried)
    # Equal distances: the first centre has the row.
    total = np.zeros((4, 6))
    clusters._add(total, x[:10], np.vstack([x[:1], x[:1], x[:2]]), np.array([2, 4]))
    assert total[:, 4].tolist() == [10, 0, *np.bincount(clusters.squared(x[:10], x[:2]).argmin(axis=1), minlength=2)]


def test_best_k_assigns_the_sample_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(400)], "id long, v array<double>")
    seen = []
    plain = clusters.Centres.assign
    monkeypatch.setattr(clusters.Centres, "assign", lambda self, rows, v: seen.append(rows.count()) or plain(self, rows, v))
    monkeypatch.setattr(clusters, "SAMPLE", 50)
    assert clusters.best_k(df, "id", "v", [2, 3], starts=2).count() == 2 and seen == [50, 50]


@pytest.mark.parametrize("name", ["cv_grid", "cv_report", "boosting_grid"])
def test_grids_label_visits_once(spark, monkeypatch, name):
    from spindrift.plans import QUERIES

    seen = []
    monkeypatch.setattr(ml, "grid_search", lambda x, **_: seen.append(x) or [None, x.selectExpr("'p' AS params", "1.0 AS mean_f1")])
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert all("/labelled-" in f for f in seen[0].inputFiles()) and seen[0].count() > 0
