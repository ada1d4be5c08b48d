"""Sparse SVD, softmax boosting and contributions of features against plain numpy versions."""

import itertools
import random
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindrift.operators import boosting, explain, lowrank, ml, retrieval, textsvd
from spindrift.plans import QUERIES


# ---------------------------------------------------------------- SVD of sparse rows
def sparse_rows(seed=1, n=60, terms=80):
    r = random.Random(seed)
    rows = {(i, f"t{r.randint(0, terms - 1) if r.random() < 0.7 else i % 4}"): r.uniform(0.1, 2) for i in range(n) for _ in range(12)}
    return [(i, t, w) for (i, t), w in rows.items()]


def dense(rows):
    ids, terms = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    a = np.zeros((len(ids), len(terms)))
    for i, t, w in rows:
        a[ids.index(i), terms.index(t)] = w
    return ids, a


@pytest.mark.parametrize("most", [10, 1000])
def test_sparse_svd(spark, most):
    rows = sparse_rows()
    ids, a = dense(rows)
    extra = [(None, "t0", 1.0), (5, None, 1.0), (5, "t0000", None)]
    weights = spark.createDataFrame(rows + extra, "id long, term string, weight double").repartition(5)
    model = lowrank.fit(weights, 6, extra=14, rounds=8, most_terms=most)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-5)
    got = {r["id"]: np.array(r["reduced"]) for r in model.reduce(weights.where("term <> 't0000'")).collect() if r["id"] is not None}
    made = np.array([got[i] for i in ids])
    assert np.allclose(made.T @ made, np.diag(s[:6] ** 2), atol=1e-2)
    assert np.allclose(made @ made.T, (u[:, :6] * s[:6] ** 2) @ u[:, :6].T, atol=2e-2)
    axes = {r["term"]: r["axis"] for r in model.axes.collect()}
    v = np.array([axes[t] for t in sorted(axes)])
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    assert all(v[np.abs(v[:, j]).argmax(), j] > 0 for j in range(6))


@pytest.mark.parametrize("most", [1, 1000])
def test_sparse_svd_of_low_rank(spark, most):
    """Three distinct rows: values beyond the rank are 0, and new rows with unknown terms are reduced by those they share."""
    rows = [(i, t, 1.0) for i in range(30) for t in ({0: "ab", 1: "bc", 2: "de"}[i % 3])]
    model = lowrank.fit(spark.createDataFrame(rows, "id long, term string, weight double"), 20, most_terms=most)
    s = np.linalg.svd(dense(rows)[1], compute_uv=False)
    assert np.allclose(model.values, s[: len(model.values)], atol=1e-6) and len(model.values) == 5
    new = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "new", 9.0), (2, "new", 1.0)], "id long, term string, weight double")
    got = {r["id"]: r["reduced"] for r in model.reduce(new).collect()}
    assert list(got) == [1] and abs(np.linalg.norm(got[1]) - np.sqrt(2)) < 1e-9
    none = lowrank.fit(new.limit(0))
    assert none.values == [] and none.reduce(new).count() == 0


def test_sparse_svd_sends_a_vector_a_term_of_a_piece(spark):
    """Rows in several pieces: the same as plain SVD, and what is sent grows with the terms of pieces, not with the weights."""
    rows = [(i, f"t{j}", 1.0 + (i * j) % 7) for i in range(60) for j in range(40) if (i + j) % 3]
    a = dense(rows)[1]
    weights = spark.createDataFrame(rows, "id long, term string, weight double").repartition(3)
    model = lowrank.fit(weights, 5, extra=35, rounds=3, most_terms=10, piece=500)
    assert np.allclose(model.values, np.linalg.svd(a, compute_uv=False)[:5], rtol=1e-6)
    sent = model.large.pieces.terms.count()
    assert 40 < sent <= 40 * -(-len(rows) // 500) < len(rows) / 4
    own = {r["id"]: r["reduced"] for r in model.reduce(weights).collect()}
    new = {r["doc"]: r["reduced"] for r in model.reduce(weights.withColumnRenamed("id", "doc"), "doc").collect()}
    assert len(own) == len(new) == 60 and all(np.allclose(own[i], new[i]) for i in own)


def texts(n=90, seed=6):
    """Words of texts: common ones, rare ones, and some that one text alone holds."""
    r = random.Random(seed)
    return [(i * 3, [f"w{min(r.randint(0, 60), r.randint(0, 60))}" for _ in range(r.randint(1, 30))] + [f"own{i}"] * (i % 4)) for i in range(n)]


@pytest.mark.parametrize("piece", [100, 1_000_000])
def test_svd_of_texts(spark, piece, monkeypatch):
    """Chunks in many pieces or few, terms of all pieces and of one: the same as plain SVD of TF-IDF, and nothing is sent for a posting."""
    docs = texts()
    terms = sorted({w for _, words in docs for w in words})
    tf = np.array([[words.count(w) for w in terms] for _, words in docs], float)
    a = tf * (np.log((1.0 + 100) / (1.0 + (tf > 0).sum(axis=0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    made = []
    whole = textsvd._Corpus.through
    monkeypatch.setattr(textsvd._Corpus, "through", lambda self, *rest: made.append(self) or whole(self, *rest))
    df = spark.createDataFrame(docs + [(1, []), (2, None)], "id long, words array<string>").repartition(7)
    rows, values = textsvd.fit(df, 100, 6, extra=24, rounds=8, piece=piece)
    assert np.allclose(values, s[:6], rtol=1e-4)
    got = {r["id"]: r["reduced"] for r in rows.collect()}
    assert sorted(got) == [i for i, _ in docs]
    reduced = np.array([got[i] for i, _ in docs])
    assert np.allclose(reduced @ reduced.T, (u[:, :6] * s[:6] ** 2) @ u[:, :6].T, atol=2e-2)
    assert np.allclose(reduced[:, 0], a @ vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()]), atol=1e-3)
    corpus = made[0]
    assert corpus.terms == len(terms) and corpus.weights == (tf > 0).sum() and (corpus.pieces > 4 if piece == 100 else corpus.pieces == 4)
    sent = [r for wave in corpus._waves() for r in corpus._sent(None, 30, 1, wave).collect()]
    assert sorted(p for wave in corpus._waves() for p in wave) == list(range(corpus.pieces)) and (len(corpus._waves()) > 1 or piece > 100)
    pieces = [set().union(*[{w for w in r["terms"]} for r in spark.read.parquet(corpus.chunks).where(F.col("b").isin(own)).collect()]) for own in corpus.dealt if own]
    shared = [w for w in terms if sum(w in p for p in pieces) > 1]
    assert len(sent) <= corpus.pieces**2 and sum(len(r["v"]) for r in sent) == 120 * sum(w in p for p in pieces for w in shared)


def test_svd_of_texts_with_few_words(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c"]) for i in range(10)], "id long, words array<string>")
    rows, values = textsvd.fit(df, 10)
    assert np.allclose(values, [5**0.5, 5**0.5, 0], atol=1e-5) and all(abs(np.linalg.norm(r["reduced"]) - 1) < 1e-6 for r in rows.collect())
    assert textsvd.fit(df.select("id", F.array().cast("array<string>").alias("words")), 10) is None
    for odd in (df.union(df.limit(1)), df.union(df.limit(1).withColumn("id", F.lit(None).cast("long")))):
        assert textsvd.reduced(odd, "id", F.col("words")) is None
    named = textsvd.reduced(df.withColumn("id", F.concat(F.lit("n"), "id")), "id", F.col("words"), 2)
    assert sorted(r["id"] for r in named.collect()) == [f"n{i}" for i in range(10)]


def test_svd_queries_make_no_rows_of_postings(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "postings", None)
    sf = "/root/testdata/sf0.001"
    values = sorted(r["singular_value"] for r in QUERIES["tfidf_svd_values"](spark, sf).collect())
    rows = np.array([r["reduced"] for r in QUERIES["tfidf_svd_documents"](spark, sf).collect()])
    assert np.allclose(np.sqrt((rows * rows).sum(axis=0))[:2], values[::-1], atol=1e-3)


# ---------------------------------------------------------------- boosting
def boosting_rows(n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(r.randint(0, 9)), r.uniform(0, 1), None if r.random() < 0.1 else r.gauss(0, 1), float("nan") if r.random() < 0.05 else float(r.randint(0, 1)), 7.0]
        y = 5.0 if x[0] > 6 else 2.0 if x[1] + (x[2] or 0) > 0.8 else 1.0
        rows.append((i, x, y, 1.0 + i % 3))
    return rows


def as_matrix(rows):
    x = np.array([[np.nan if v is None else v for v in r[1]] for r in rows])
    return np.where(np.isnan(x), -np.inf, x)


def plain_boost(x, y, w, cuts, rounds, depth, rate=0.1, smooth=1.0, least=1.0):
    classes = sorted(set(y))
    m = np.full((len(x), len(classes)), 0.5)
    losses = []
    own = np.array([classes.index(v) for v in y])

    def loss():
        p = boosting.softmax(m)
        return -(w * np.log(p[np.arange(len(y)), own])).sum() / w.sum()

    def grow(rows, g, h, level, out):
        best = (1e-9, None, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + smooth)
        if level < depth:
            for f, points in enumerate(cuts):
                for c in points:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if h[a].sum() >= least and h[b].sum() >= least:
                        gain = g[a].sum() ** 2 / (h[a].sum() + smooth) + g[b].sum() ** 2 / (h[b].sum() + smooth) - total
                        if gain > best[0] + 1e-9 * abs(gain):
                            best = (gain, f, c)
        if best[1] is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + smooth)
        else:
            grow(rows[x[rows, best[1]] <= best[2]], g, h, level + 1, out)
            grow(rows[x[rows, best[1]] > best[2]], g, h, level + 1, out)

    for _ in range(rounds):
        losses.append(loss())
        p, step = boosting.softmax(m), np.zeros_like(m)
        for k in range(len(classes)):
            grow(np.arange(len(x)), w * (p[:, k] - (own == k)), w * 2 * p[:, k] * (1 - p[:, k]), 0, step[:, k])
        m = m + step
    return m, [*losses, loss()]


@pytest.fixture(scope="module")
def boosted(spark):
    rows = boosting_rows()
    df = spark.createDataFrame([*rows, (-1, None, 1.0, 1.0), (-2, rows[0][1], None, 1.0)], "id long, features array<double>, label double, weight double").repartition(4)
    return rows, df, boosting.fit(df, rounds=10, depth=3)


def test_boosting_equals_a_plain_version(boosted):
    rows, df, model = boosted
    x = as_matrix(rows)
    cuts = boosting.cut_points(df.where("features is not null and label is not null"), 32)
    want, losses = plain_boost(x, [r[2] for r in rows], np.array([r[3] for r in rows]), cuts, 10, 3)
    assert np.allclose(model.margins(x), want, atol=1e-8)
    assert np.allclose(model.losses, losses, atol=1e-9)
    assert all(a > b for a, b in itertools.pairwise(model.losses)) and len(model.trees) == 10  # 8 rounds are held, so margins were written once


def test_boosting_probabilities(boosted):
    rows, df, model = boosted
    done = model.transform(df.where("features is not null")).collect()
    p = np.array([r["probability"] for r in done])
    assert np.allclose(p.sum(axis=1), 1) and p.shape[1] == 3
    assert all(r["prediction"] == [1.0, 2.0, 5.0][int(np.argmax(r["probability"]))] and r["confidence"] == max(r["probability"]) for r in done)
    assert np.mean([r["prediction"] == r["label"] for r in done if r["label"]]) > 0.9
    vectors = df.where("id >= 0 and not exists(features, x -> x is null)").withColumn("v", array_to_vector("features"))
    assert [r["probability"] for r in model.transform(vectors, "v").orderBy("id").collect()] == [r["probability"] for r in sorted(done, key=lambda r: r["id"]) if r["id"] >= 0 and None not in r["features"]]


def test_boosting_of_little(spark):
    schema = "features array<double>, label double"
    one = boosting.fit(spark.createDataFrame([([1.0], 3.0), ([2.0], 3.0)], schema), rounds=2)
    assert one.classes == [3.0] and [r["prediction"] for r in one.transform(spark.createDataFrame([([9.0], 3.0)], schema)).collect()] == [3.0]
    assert boosting.fit(spark.createDataFrame([], schema)).trees == []
    same = boosting.fit(spark.createDataFrame([([1.0], float(i % 2)) for i in range(20)], schema), rounds=3)
    assert all(t.feature == [-1] for r in same.trees for t in r)


# ---------------------------------------------------------------- contributions
def subset_value(tree, value, x, known):
    """A tree's score for a row of which only the features ``known`` are known: covers decide at the others."""

    def at(node):
        f = tree.feature[node]
        if f < 0:
            return value[node]
        lo, hi = tree.left[node], tree.right[node]
        if f in known:
            return at(lo if x[f] <= tree.cut[node] else hi)
        return (tree.cover[lo] * at(lo) + tree.cover[hi] * at(hi)) / (tree.cover[lo] + tree.cover[hi])

    return at(0)


def brute(trees, x, width):
    """``trees``: tree and node values. Over all subsets of features."""
    v = {s: sum(subset_value(t, val, x, s) for t, val in trees) for n in range(width + 1) for s in itertools.combinations(range(width), n)}
    out = []
    for f in range(width):
        rest = [j for j in range(width) if j != f]
        out.append(sum(factorial(len(s)) * factorial(width - len(s) - 1) / factorial(width) * (v[tuple(sorted((*s, f)))] - v[s]) for n in range(width) for s in itertools.combinations(rest, n)))
    return v[()], out


NAMES = ["a", "b", "c", "d", "e"]


def test_contributions_of_boosting(boosted, spark):
    rows, df, model = boosted
    told = explain.explain_boosted(model)
    some = model.transform(df.where("id between 0 and 39"))
    got = told.contributions(some, "id", NAMES).collect()
    assert len(got) == 40 * 3 * 5
    margins = model.margins(as_matrix(rows[:40]))
    by = {}
    for r in got:
        by.setdefault((r["id"], r["class"]), {"base": r["base"]})[r["feature"]] = r["value"]
    for (i, c), v in by.items():
        assert abs(sum(v.values()) - margins[i, model.classes.index(c)]) < 1e-9
    for i in (0, 7, 21):
        for k, c in enumerate(model.classes):
            base, values = brute([(round_[k], round_[k].value) for round_ in model.trees], as_matrix(rows[i : i + 1])[0], 5)
            assert abs(base + 0.5 - by[i, c]["base"]) < 1e-9
            assert np.allclose(values, [by[i, c][n] for n in NAMES], atol=1e-9)
    own = told.contributions(some, "id", NAMES, of="prediction")
    assert own.count() == 40 * 5 and {(r["id"], r["class"]) for r in own.collect()} == {(r["id"], r["prediction"]) for r in some.collect()}
    totals, strongest = ml.contributions(own, "id", 2)
    assert totals.count() == 40 and strongest.groupBy("id").count().where("count <> 2").count() == 0


def test_contributions_of_a_forest(spark, tmp_path):
    rows = [(i, [0.0 if v is None or v != v else v for v in x], {1.0: 0.0, 2.0: 1.0, 5.0: 2.0}[y], w) for i, x, y, w in boosting_rows(200)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, weight double").withColumn("features", array_to_vector("features"))
    model = ml.forest(trees=5, depth=4).fit(df)
    told = explain.explain_forest(spark, model, str(tmp_path / "forest"))
    got = {}
    for r in told.contributions(df, "id", NAMES).collect():
        got.setdefault((r["id"], r["class"]), {"base": r["base"]})[r["feature"]] = r["value"]
    for r in model.transform(df).select("id", F.col("probability")).collect():
        for k in range(3):
            assert abs(sum(got[r["id"], float(k)].values()) - r["probability"][k]) < 1e-9
    trees = explain.forest_trees(spark, model, str(tmp_path / "again"))
    for i in (0, 9):
        base, values = brute([(t, s[:, 1] / len(trees)) for t, s in trees], rows[i][1], 5)
        assert abs(base - got[i, 1.0]["base"]) < 1e-9 and np.allclose(values, [got[i, 1.0][n] for n in NAMES], atol=1e-9)


def test_boosting_bins_its_rows_once(boosted, monkeypatch):
    _, df, model = boosted
    asked, kept = [], boosting.matrix
    tables = []
    whole = boosting.saved
    monkeypatch.setattr(boosting, "saved", lambda x, tag: (tables.append((tag, x.dtypes)), whole(x, tag))[1])
    again = boosting.fit(df, rounds=10, depth=3)
    assert np.allclose(again.losses, model.losses)
    assert [t for t, _ in tables] == ["boost-rows", "boost-bins", "boost-margins", "boost-margins", "boost-margins"]
    assert all(kinds == [("r", "binary")] for tag, kinds in tables if tag != "boost-rows")
