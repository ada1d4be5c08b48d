"""Neighbours from an index by cells against all rows, and what the bounds spare."""

import numpy as np
import pytest

from spindrift.operators import cells, retrieval
from spindrift.operators.cells import Best
from spindrift.plans import QUERIES


def clustered(n=3000, d=8, groups=30, spread=0.05, seed=7):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, d))
    x = middle[np.arange(n) % groups] + r.normal(0, spread, (n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name="id"):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [float("nan")] * x.shape[1]), (9004, [None] * x.shape[1])]
    return spark.createDataFrame(rows + odd, f"{name} long, unit array<double>").repartition(5)


def plain(x, q, k, same):
    s = np.round(x[q] @ x.T, 6)
    out = []
    for row, i in enumerate(q):
        order = [j for j in np.lexsort((np.arange(len(x)), -s[row])) if not same or j != i][:k]
        out += [(int(i), int(j), float(s[row, j]), rank + 1) for rank, j in enumerate(order)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cells_are_exact_and_spare_most(spark):
    x = clustered()
    x[5::40] = x[5]  # many copies: ties go to the least id, also over cells and blocks
    index = frame(spark, x)
    found, read, every = cells.build(index).search(index.where("id % 10 = 0 or id > 9000").withColumnRenamed("id", "query_id"), 7, exclude_self=True)
    assert rows(found) == plain(x, np.arange(0, 3000, 10), 7, True)
    assert every == 300 * 55 and read < 0.15 * every


def test_cells_without_clusters_and_of_any_length(spark, monkeypatch):
    """Vectors with nothing to tell them apart, of lengths other than one, in small blocks and chunks: all is read and all is right."""
    monkeypatch.setattr(cells, "BLOCK", 40)
    monkeypatch.setattr(cells, "CHUNK", 16)
    x = np.random.default_rng(3).normal(size=(600, 12)) * np.linspace(0.1, 3, 600)[:, None]
    index = frame(spark, x)
    found, _, _ = cells.build(index, cells=9).search(index.where("id % 3 = 0 and id < 600").withColumnRenamed("id", "query_id"), 5)
    assert rows(found) == plain(x, np.arange(0, 600, 3), 5, False)


def test_many_queries_go_to_the_cells(spark, monkeypatch):
    x = clustered(400)
    index = frame(spark, x)
    few = rows(retrieval.knn(index.withColumnRenamed("id", "query_id"), index, 3, exclude_self=True))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 10)
    many = retrieval.knn(index.withColumnRenamed("id", "query_id"), index, 3, exclude_self=True)
    assert rows(many) == few == plain(x, np.arange(400), 3, True)
    assert "CartesianProduct" not in many._jdf.queryExecution().toString() and "NestedLoop" not in many._jdf.queryExecution().toString()


def test_cells_of_little(spark):
    index = frame(spark, clustered(3, 4))
    got = cells.build(index.where("id = 1")).search(index.withColumnRenamed("id", "query_id"), 5)[0].collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert cells.build(index.limit(0)).search(index.withColumnRenamed("id", "query_id"), 5)[0].count() == 0
    assert cells.build(index).search(index.limit(0).withColumnRenamed("id", "query_id"), 5)[0].count() == 0
    with pytest.raises(Exception, match="places"):
        cells.build(index).search(frame(spark, clustered(2, 5), "query_id"), 5)[0].collect()


def test_best_keeps_k_over_all_it_meets():
    rng = np.random.default_rng(3)
    q, ids = np.arange(7), rng.permutation(300)
    m, x = rng.integers(-2, 3, (7, 2)).astype(float), rng.integers(-2, 3, (300, 2)).astype(float)  # many ties
    found = cells.Best(7, 4)
    for at in range(0, 300, 13):
        cells.near(found, q, m, ids[at : at + 13], x[at : at + 13], True)
    of, own, score = found.rows()
    s = m @ x.T
    want = [(i, j, -v) for i in q for v, j in sorted((-s[i, r], ids[r]) for r in range(300) if ids[r] != i)[:4]]
    assert list(zip(of, own, score, strict=True)) == want


@pytest.mark.parametrize("but", [None, np.arange(40)])
def test_first_rows_that_queries_meet_are_few(monkeypatch, but):
    rng = np.random.default_rng(4)
    s = np.round(rng.normal(size=(40, 2000)), 2)  # many ties
    ids, put, sent = rng.permutation(2000), Best.put, []
    monkeypatch.setattr(Best, "put", lambda self, of, q, own, score: sent.append(len(q)) or put(self, of, q, own, score))
    found = Best(40, 5)
    found.meet(np.arange(40), s, ids, but)
    for i in range(40):
        want = sorted((-s[i, j], ids[j]) for j in range(2000) if but is None or ids[j] != but[i])[:5]
        assert [(-a, b) for a, b in zip(found.score[i], found.id[i], strict=True)] == want
    assert max(sent) < 40 * 50  # not all 80 000


def test_reranked_neighbours_of_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query_id"] for r in QUERIES["reranked_neighbours"](spark, sf).collect()} == ids


def test_more_queries_than_are_broadcast_read_all_rows(spark, monkeypatch):
    """Nearer to each other than single precision tells apart, and copies; a task's queries come in several lots."""
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 10)
    monkeypatch.setattr(retrieval, "HELD", 1025)
    x = clustered(2600, groups=3, spread=1e-4)
    x[7::50] = x[7]
    index = frame(spark, x)
    got = retrieval.knn(index.withColumnRenamed("id", "query_id"), index, 4, exclude_self=True)
    assert rows(got) == plain(x, np.arange(2600), 4, True)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Join" not in plan


def test_coarse_products_find_what_exact_ones_do():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-3, 1e4, 1e20):
        q, ids = np.arange(60), rng.permutation(3000)
        m, x = rng.normal(size=(60, 16)) * scale, np.repeat(rng.normal(size=(1000, 16)), 3, axis=0) * scale
        a, b = cells.Best(60, 5), cells.Best(60, 5)
        for at in range(0, 3000, 700):
            cells.near(a, q, m, ids[at : at + 700], x[at : at + 700], True)
            cells.near_coarsely(b, q, m, m.astype(np.float32), ids[at : at + 700], x[at : at + 700], True)
        assert np.allclose(a.score, b.score, rtol=1e-9) and (scale > 1 or (a.id == b.id).all())
