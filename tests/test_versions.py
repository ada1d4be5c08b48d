"""Index versions, resuming in waves, inferred types, quantiles by digits, BM25 by blocks."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import cases, profile, retrieval
from spindrift.sources import tables

CASE = "case_id long, description string, embedding array<double>, age_at_visit double"


def known(spark, texts, ages=None):
    return spark.createDataFrame([(i, t, [float(len(t)), 1.0, float(i)], float((ages or {}).get(i, 30 + i))) for i, t in enumerate(texts)], CASE)


TEXTS = ["chest pain", "fever cough", "ankle injury", "back pain", "seizure"]


# ---------------------------------------------------------------- versions
def descriptions(index):
    return {r["id"]: r["description"] for r in index.cases.collect()}


def test_equal_counts_with_other_contents_rebuild(spark, tmp_path):
    root = str(tmp_path / "index")
    args = ("case_id", "embedding", "description", root)
    first = cases.build_or_load(known(spark, TEXTS), *args)
    at = cases.latest(spark, root)
    assert cases.build_or_load(known(spark, TEXTS).repartition(3), *args).cases.inputFiles() == first.cases.inputFiles()
    assert cases.latest(spark, root) == at  # the same rows in another order are no news
    other = [*TEXTS[:4], "headache"]
    assert descriptions(cases.build_or_load(known(spark, other), *args)) == dict(enumerate(other))
    assert descriptions(first) == dict(enumerate(TEXTS))  # who has the former version still reads it whole
    older = cases.build_or_load(known(spark, other, {2: 99.0}), *args)
    assert 2 in {r["id"] for r in older.cases.collect()} and cases.latest(spark, root) != at
    weighed = cases.build_or_load(known(spark, other, {2: 99.0}), *args, weights=cases.Weights(text=0.1, numbers=0.9))
    assert (weighed.weights.text, weighed.weights.numbers) == (0.1, 0.9)
    mixed = cases.build_or_load(known(spark, other, {2: 99.0}), *args, weights=cases.Weights(text=0.1, numbers=0.9, words=0.5, vectors=0.5))
    assert mixed.cases.inputFiles() == weighed.cases.inputFiles() and mixed.weights.words == 0.5  # these are no part of the vectors
    gone = cases.prune(spark, root)
    assert len(gone) == 3 and descriptions(cases.load(spark, root)) == dict(enumerate(other))


def test_a_loaded_index_is_saved_where_it_came_from(spark, tmp_path):
    root = str(tmp_path / "index")
    cases.build_or_load(known(spark, TEXTS), "case_id", "embedding", "description", root)
    loaded = cases.load(spark, root)
    loaded.with_weights(words=0.9, vectors=0.1).save(root)
    again = cases.load(spark, root)
    assert again.weights.words == 0.9 and descriptions(again) == descriptions(loaded) == dict(enumerate(TEXTS))


def test_a_save_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    cases.build_or_load(known(spark, TEXTS), "case_id", "embedding", "description", root)
    broken = cases.build(known(spark, TEXTS[:2]), "case_id", "embedding", "description")
    object.__setattr__(broken, "lengths", spark.range(1).select(F.raise_error(F.lit("lost")).alias("id")))
    with pytest.raises(Exception, match="lost"):
        broken.save(root)
    assert descriptions(cases.load(spark, root)) == dict(enumerate(TEXTS))
    with pytest.raises(FileNotFoundError):
        cases.load(spark, str(tmp_path / "nothing"))


def test_only_new_texts_are_encoded(spark, tmp_path):
    root, seen = str(tmp_path / "index"), str(tmp_path / "seen")

    def encoder(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    def encoded():
        try:
            return sorted(open(seen).read().split("\n")[:-1])
        except FileNotFoundError:
            return []

    rows = known(spark, TEXTS).drop("embedding")
    args = ("case_id", "embedding", "description", root)
    cases.build_or_load(rows, *args, encoder=encoder, encoder_name="a")
    assert encoded() == sorted(TEXTS)
    more = known(spark, [*TEXTS, "new one", "new one"]).drop("embedding")
    index = cases.build_or_load(more, *args, encoder=encoder, encoder_name="a")
    assert encoded() == sorted([*TEXTS, "new one"]) and index.cases.where("embedding is null").count() == 0
    cases.build_or_load(more, *args, encoder=encoder, encoder_name="a")
    assert len(encoded()) == 6
    cases.build_or_load(more, *args, encoder=encoder, encoder_name="b")
    assert len(encoded()) == 12


def test_overlap_is_enough_if_asked_for(spark, tmp_path):
    root = str(tmp_path / "index")
    args = ("case_id", "embedding", "description", root)
    cases.build_or_load(known(spark, TEXTS), *args)
    assert descriptions(cases.build_or_load(known(spark, [*TEXTS, "more"]), *args, check="overlap")) == dict(enumerate(TEXTS))
    far = known(spark, TEXTS).withColumn("case_id", F.col("case_id") + 100)
    assert set(descriptions(cases.build_or_load(far, *args, check="overlap"))) == set(range(100, 105))


def test_fingerprint(spark):
    schema = "a string, b string"
    told = lambda rows, options=(): cases.fingerprint(spark.createDataFrame(rows, schema).repartition(3), ["a", "b"], options)
    base = [("x", "y"), ("z", None), ("x", "y")]
    assert told(base) == told(base[::-1])
    assert len({told(base), told(base[:2]), told([("x", "y"), (None, "z"), ("x", "y")]), told([("x", "y"), ("z", ""), ("x", "y")]), told(base, 1), told([])}) == 6


# ---------------------------------------------------------------- waves
def test_a_wave_that_dies_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "done")
    todo = spark.createDataFrame([(f"k{i % 50}", i) for i in range(60)] + [(None, 1)], "key string, x int")
    worked, count = [], 0

    def work(rows):
        nonlocal count
        count += 1
        worked.append({r["key"] for r in rows.collect()})
        if count == 2:
            return rows.select("key", F.raise_error(F.lit("stopped")).alias("reply"))
        return rows.select("key", F.concat(F.lit("r:"), "key").alias("reply"))

    with pytest.raises(Exception, match="stopped"):
        tables.resume_into(todo, path, "key", work, waves=4)
    kept = {r["key"] for r in tables.resumed(spark, path).collect()}
    assert kept == worked[0] and kept
    assert tables.resume_into(todo, path, "key", work, waves=4) == 50 - len(kept)
    rows = [tuple(r) for r in tables.resumed(spark, path).collect()]
    assert sorted(rows) == sorted((f"k{i}", f"r:k{i}") for i in range(50))
    assert not worked[0] & set().union(*worked[2:])
    assert tables.resume_into(todo, path, "key", work, waves=4) == 0
    more = todo.unionByName(spark.createDataFrame([("new", 1)], "key string, x int"))
    assert tables.resume_into(more, path, "key", work, waves=4) == 1 and tables.resumed(spark, path).count() == 51


# ---------------------------------------------------------------- types
CSV = """i,i_null,real,exp,flag,flag_null,mixed,none,text,spaces,wide,wide_real,inf
1,1,1.5,1e3,True,TRUE,1,,a, 7,99999999999999999999,99999999999999999999,inf
-2,NA,2,-2.5E-2,false,nan,x,NA,"b, c",8 ,1,0.5,-Infinity
3,3,.5,3,FALSE,False,2,null,,+9,2,1,2
"""


def test_inferred_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    raw = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "a.csv"))
    got = {r["name"]: (r["kind"], r["n_null"], r["n"]) for r in tables.inferred(raw).collect()}
    want = {"i": "integer", "i_null": "real", "real": "real", "exp": "real", "flag": "boolean", "flag_null": "text", "mixed": "text", "none": "null", "text": "text", "spaces": "integer", "wide": "text", "wide_real": "real", "inf": "real"}
    want["wide_real"] = "real"
    assert {n: k for n, (k, _, _) in got.items()} == want
    assert got["i_null"][1:] == (1, 3) and got["none"][1:] == (3, 3)
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {n: {"integer": "bigint", "real": "double", "null": "double", "boolean": "boolean", "text": "string"}[k] for n, k in want.items()}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, -2, 3] and [r["i_null"] for r in rows] == [1.0, None, 3.0] and [r["spaces"] for r in rows] == [7, 8, 9]
    assert [r["flag"] for r in rows] == [True, False, False] and [r["exp"] for r in rows] == [1000.0, -0.025, 3.0]
    assert [r["inf"] for r in rows] == [math.inf, -math.inf, 2.0] and [r["text"] for r in rows] == ["a", "b, c", None]
    empty = tables.inferred(raw.limit(0))
    assert {r["kind"] for r in empty.collect()} == {"null"}


# ---------------------------------------------------------------- quantiles
def test_quantiles_by_digits(spark):
    r = random.Random(3)
    columns = {
        "normal": [r.gauss(0, 1) for _ in range(4000)], "near": [1.0 + k * 2.0**-50 for k in range(4000)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(4000)],
        "few": [float(r.choice([0, 0, 1, 5])) for _ in range(4000)], "odd": [r.choice([math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324]) for _ in range(4000)], "null": [None] * 4000,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = profile.quantiles_of(df, dict.fromkeys(columns, shares))
    for c, x in columns.items():
        if c == "null":
            assert got[c] == [None] * 6
        elif c != "odd":
            assert np.allclose(got[c], np.quantile(x, shares), rtol=1e-13, atol=0)
    ranks = list(range(0, 4000, 131))
    assert profile.at_ranks(df, "odd", ranks) == {k: sorted(columns["odd"])[k] for k in ranks}
    some = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (2.0,)], "x double")
    last = profile.at_ranks(some, "x", [0, 1, 2, 7])
    assert (last[0], last[1]) == (1.0, 2.0) and math.isnan(last[2]) and 7 not in last  # NaN comes last, null isn't there


def test_quantiles_take_few_passes(spark, monkeypatch):
    passes = []
    whole = profile._digits
    monkeypatch.setattr(profile, "_digits", lambda df, cols, open_, level: passes.append(list(cols)) or whole(df, cols, open_, level))
    df = spark.range(5000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") * 0.1).alias("b"), F.lit(3).alias("c"))
    profile.describe(df, ["a", "b", "c"]).collect()
    assert len(passes) <= 4 and passes[0] == ["a", "b", "c"] and "c" not in passes[1]


# ---------------------------------------------------------------- BM25
def plain_bm25(docs, queries, k, k1=1.5, b=0.75, epsilon=0.25):
    n, mean_len = len(docs), np.mean([len(t) for t in docs.values()])
    df = collections.Counter(t for x in docs.values() for t in set(x))
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    mean = np.mean(list(idf.values()))
    idf = {t: epsilon * mean if v < 0 else v for t, v in idf.items()}
    out = []
    for q, terms in queries.items():
        if not terms:
            continue
        scores = []
        for i, x in docs.items():
            tf = collections.Counter(x)
            scores.append((round(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(x) / mean_len)) for t in terms if tf[t]), 5), i))
        out += [(q, i, s) for s, i in sorted(scores, key=lambda s: (-s[0], s[1]))[:k]]
    return out


def test_bm25_by_blocks(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = {i: r.choices(words, [1 / (1 + j) for j in range(60)], k=r.randint(0, 30)) for i in range(400)}
    for i in range(100, 112):
        docs[i] = ["rare", "pair", *docs[i][:5]]
    queries = {1: ["rare", "pair", "w0", "w1"], 2: ["w0", "w0", "w5"], 3: ["nowhere"], 4: [], 5: ["w59", "w58"]}
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc long, tokens array<string>").repartition(4)
    tf, lengths = retrieval.postings(df, "doc", F.col("tokens"))
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "query_id long, term string")
    counted = []
    got = [(x["query_id"], x["id"], x["score"]) for x in retrieval.bm25(asked, tf, lengths, 10, counted=counted).orderBy("query_id", "rank").collect()]
    want = plain_bm25(docs, queries, 10)
    assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want], atol=2e-5)
    assert counted[0] < counted[1]
    assert retrieval.bm25(asked.limit(0), tf, lengths, 10).count() == 0


def test_bm25_makes_no_table_of_pairs(spark, monkeypatch):
    r = random.Random(9)
    docs = {i: r.choices([f"w{j}" for j in range(30)], k=r.randint(5, 25)) for i in range(300)}
    queries = {q: docs[q] for q in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc long, tokens array<string>").repartition(4)
    tf, lengths = retrieval.postings(df, "doc", F.col("tokens"))
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "query_id long, term string")
    sizes, kept = [], retrieval.saved
    monkeypatch.setattr(retrieval, "saved", lambda x, tag: (sizes.append((y := kept(x, tag)).count()), y)[1])
    monkeypatch.setattr(retrieval, "MOST_ASKED", 25)  # in waves
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    monkeypatch.setattr(retrieval, "DENSE", 5)
    got = [(x["query_id"], x["id"], x["score"]) for x in retrieval.bm25(asked, tf, lengths, 5).orderBy("query_id", "rank").collect()]
    want = plain_bm25(docs, queries, 5)
    assert np.allclose([s for *_, s in got], [s for *_, s in want], atol=2e-5)
    assert [q for q, *_ in got] == [q for q, *_ in want]
    assert max(sizes) <= max(len(docs), sum(len(set(x)) for x in queries.values()))


def test_bm25_puts_zero_above_negative(spark):
    docs = [(i, ["a", "b"] if i < 10 else ["c"]) for i in range(13)]
    tf, lengths = retrieval.postings(spark.createDataFrame(docs, "id long, t array<string>"), "id", F.col("t"))
    got = retrieval.bm25(spark.createDataFrame([(1, "a")], "query_id long, term string"), tf, lengths, 2).orderBy("rank").collect()
    assert [(x["id"], x["score"]) for x in got] == [(10, 0.0), (11, 0.0)]
