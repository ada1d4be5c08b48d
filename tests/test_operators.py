"""Operators on small tables: ties, repeats, nulls, empty input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import assemble, cases, cells, evaluate, ml, profile, relational, retrieval, rules, select
from spindrift.schema import RAW_VISIT, load
from spindrift.sources import reports, requests, tables
from spindrift.streaming import visits as stream


def test_lookup_takes_the_last(spark):
    left = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    table = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, v int, o int")
    got = sorted((str(r["k"]), r["v"], r["found"]) for r in relational.lookup(left, table, "k", "o").collect())
    assert got == [("None", None, False), ("a", 2, True), ("a", 2, True), ("b", None, False)]
    assert [r["k"] for r in relational.unmatched(left, table, "k").collect()] == ["b"]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, None), (None, "y"), (3.0, "z"), (1.0, "z")], "a double, s string")
    filled = lambda how, **k: [r["a"] for r in profile.impute(df, how, **k).collect()][2]
    assert filled("median") == 2.0
    assert filled("mean") == 2.0
    assert filled("mode") == 1.0
    assert filled("constant", fill=9.0) == 9.0
    assert profile.impute(df, "mean").where("s is null").count() == 0
    assert profile.impute(df.limit(0), "mean").count() == 0


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(10), 100]], "a double")
    assert [r["a"] for r in profile.outliers(df, "a", "iqr").collect()] == [100.0]
    assert [r["a"] for r in profile.outliers(df, "a", "zscore", 2.5).collect()] == [100.0]
    assert profile.outliers(spark.createDataFrame([(1.0,), (1.0,)], "a double"), "a", "zscore").count() == 0
    with pytest.raises(ValueError, match="method"):
        profile.outliers(df, "a", "other")


def _greedy(sizes, total):
    n = sum(s for _, s in sizes)
    want = {c: min(s, max(1, total * s // n)) for c, s in sizes}
    order = sorted(sizes, key=lambda x: (-x[1], x[0]))
    for c, s in order:
        need = total - sum(want.values())
        want[c] += min(max(need, 0), s - want[c]) - min(max(-need, 0), want[c] - 1)
    return want


def test_quotas_equal_the_greedy_loop(spark):
    r = random.Random(1)
    for _ in range(5):
        sizes = [(i, r.randint(1, 50)) for i in range(r.randint(1, 9))]
        total = r.randint(1, 60)
        got = {x["cluster"]: x["quota"] for x in select.quotas(spark.createDataFrame(sizes, "cluster long, size long"), total).collect()}
        assert got == _greedy(sizes, total)


def test_row_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = select.row_ids(df, "k").collect()
    assert all(r["k"] == r["row_id"] for r in got)
    assert len(got) == 1000


def test_knn_and_fusion(spark):
    index = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(6)], "id long, unit array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, unit array<double>")
    near = retrieval.knn(q, index, 3, exclude_self=True)
    assert [(r["id"], r["score"]) for r in near.orderBy("rank").collect()] == [(3, 1.0), (5, 1.0), (0, 0.6)]
    words = spark.createDataFrame([(1, 0, 5.0, 1), (1, 9, 1.0, 2)], "query_id long, id long, score double, rank long")
    fused = {r["id"]: r["score"] for r in retrieval.fuse(words, near, 5).collect()}
    assert fused == {0: 0.72, 3: 0.7, 5: 0.7, 9: 0.06}
    again = retrieval.retrieve(words, near, 1, reranker=lambda q, t: [len(x) for x in t], texts=spark.createDataFrame([(1, i, "q", "x" * i) for i in range(10)], "query_id long, id long, query_text string, text string"))
    assert [r["id"] for r in again.collect()] == [3]


def test_bm25_idf_floor(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "c"])], "id long, t array<string>")
    tf, lengths = retrieval.postings(docs, "id", F.col("t"))
    got = retrieval.bm25(spark.createDataFrame([(1, "a")], "query_id long, term string"), tf, lengths, 5).collect()
    assert [r["id"] for r in got] == [1, 3, 2]
    assert got[0]["score"] < 0  # a quarter of a negative mean


def test_evaluation(spark):
    cm = evaluate.confusion(spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "y int, p int"), "y", "p")
    rows = {r["level"]: r for r in evaluate.per_class(cm, [1, 2, 3]).collect()}
    assert (rows[1]["precision"], rows[1]["recall"], rows[2]["precision"]) == (1.0, 0.5, 0.5)
    assert (rows[3]["support"], rows[3]["f1"]) == (0, 0.0)
    assert evaluate.accuracy(cm).first()["accuracy"] == 0.666667


def test_features(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("c", 4.0)], "c string, x double")
    assert ml.one_hot(df, "c").columns == ["c", "x", "c_b", "c_c"]
    assert sorted((str(r["c"]), r["k"]) for r in ml.label_encode(df, "c", "k").collect()) == [("None", None), ("a", 0), ("b", 1), ("c", 2)]
    assert ml.scale(df, df, ["x"]).orderBy("x").first()["x"] == pytest.approx(-1.3416407)
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert ml.scale(flat, flat, ["x"]).first()["x"] == 0.0


def test_language_model_hook(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("good",), (None,)], "p string")

    def client(p):
        if p == "bad":
            raise TimeoutError
        return "TRIAGE LEVEL: 2"

    got = sorted((str(r["p"]), r["reply"], r["status"]) for r in ml.with_language_model(df, "p", client).collect())
    assert got == [("None", None, None), ("bad", None, "TimeoutError"), ("good", "TRIAGE LEVEL: 2", "ok"), ("good", "TRIAGE LEVEL: 2", "ok")]
    coded = ml.embed(df, "p", lambda ts: [[float(len(t))] for t in ts]).where("p = 'bad'").first()
    assert coded["embedding"] == [3.0]


def test_csv_and_versions(spark, tmp_path):
    (tmp_path / "v.csv").write_text('subject_id,stay_id,pain,chiefcomplaint\n1,2,NA,"a, ""b"""\n3,x,7,none\n')
    kept = RAW_VISIT.__class__([f for f in RAW_VISIT.fields if f.name in ("subject_id", "stay_id", "pain", "chiefcomplaint")])
    kept.fields.sort(key=lambda f: ["subject_id", "stay_id", "pain", "chiefcomplaint"].index(f.name))
    schema = kept.__class__(kept.fields)
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "v.csv"), schema).collect()]
    assert got == [(1, 2, None, 'a, "b"'), (3, None, "7", "none")]
    root = str(tmp_path / "store")
    tables.publish(spark.range(3), root, "2024-01-01")
    tables.publish(spark.range(5), root, "2024-01-02")
    assert tables.latest(spark, root).count() == 5
    at = f"{root}/t"
    spark.range(4).write.parquet(at)
    tables.replace_table(spark.read.parquet(at).where("id > 1"), at)
    assert spark.read.parquet(at).count() == 2
    done = f"{root}/done"
    assert tables.resume_into(spark.range(3), done, "id", lambda d: d) == 3
    assert tables.resume_into(spark.range(5), done, "id", lambda d: d) == 2


def test_requests_and_reports(spark, tmp_path):
    body = spark.createDataFrame([(1, '{"chief_complaint": "pain", "age": 3}'), (2, "oops")], "id int, body string")
    got = requests.parse_requests(body, "body").orderBy("id").collect()
    assert not got[0]["valid"]
    assert "gender" in got[0]["missing"]
    assert len(got[1]["missing"]) == len(requests.REQUIRED)
    (tmp_path / "r.txt").write_text("x\n1. One thing\nSeverity range: [1, 2]\n\n2. Two\nTypical symptoms: a, b\n")
    groups = reports.read_groups(spark, str(tmp_path / "r.txt")).orderBy("group_id").collect()
    assert [(g["group_id"], g["group_name"], g["severity_range"], g["typical_symptoms"]) for g in groups] == [(1, "One thing", [1, 2], []), (2, "Two", [], ["a", "b"])]


def test_stream_equals_batch(spark, tmp_path):
    from spindrift.schema import visits

    v = visits(spark, "/root/testdata/sf0.001").limit(200)
    source = str(tmp_path / "in")
    v.write.parquet(source)
    stream.run(spark, source, v.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = stream.scored(spark.read.parquet(source))
    assert got.count() == 200
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_filters_and_columns_reach_the_scan(spark):
    from spindrift.plans import QUERIES

    plan = QUERIES["scan_project"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    assert "l_tax" not in plan
    assert load(spark, "/root/testdata/sf0.001", "region").count() == 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_visit_table(spark):
    from spindrift.operators.assemble import visit_table

    triage = spark.createDataFrame([(1, 10, "98.6", "80", "97", "120", "80", "3", 2, " Chest  Pain "), (1, 10, "98.6", "80", "97", "120", "80", "3", 2, " Chest  Pain "), (2, 20, "999", "80", "97", "120", "80", "x", 3, "cough"), (3, 30, "98", "80", "97", "120", "80", None, 3, "n/a")], "subject_id long, stay_id long, temperature string, heartrate string, o2sat string, sbp string, dbp string, pain string, acuity int, chiefcomplaint string")
    stays = spark.createDataFrame([(10, 1, "2180-05-06 19:17:00", "x", "WALK IN", "HOME"), (20, 2, "oops", "x", None, None), (30, 3, "2180-05-06 01:00:00", "x", "Helicopter", None)], "stay_id long, subject_id long, intime string, outtime string, arrival_transport string, disposition string")
    patients = spark.createDataFrame([(1, 50, 2178, "f"), (3, 20, 2180, "M")], "subject_id long, anchor_age int, anchor_year int, gender string")
    got = visit_table(triage, stays, patients).collect()
    assert [(r["subject_id"], r["age_at_visit"], r["gender"], r["chiefcomplaint_clean"], r["arrival_transport"], r["time_period"], r["pain"]) for r in got] == [(1, 52.0, "F", "chest pain", "walk-in", 3, 3.0)]


def test_answers_and_judged(spark):
    import json

    from spindrift.operators.assemble import answers, judged

    good = {"chief_complaint": "Chest pain", "age": 60, "gender": "M", "heart_rate": 80, "sbp": 120, "dbp": 80, "temperature": 98.6, "o2sat": 98}
    got = {r["id"]: json.loads(r["response"]) for r in answers(spark.createDataFrame([(1, json.dumps(good)), (2, "{}")], "id int, body string")).collect()}
    assert (got[1]["level"], got[1]["confidence"]) == (1, 0.85)
    assert "missing: age" in got[2]["reasons"]
    cases = spark.createDataFrame([(1, [1.0, 0.0], "a case", 2), (2, [0.0, 1.0], "another", 4)], "id long, unit array<double>, description string, acuity int")
    queries = spark.createDataFrame([(7, [0.9, 0.1], "a query", 2), (8, [0.0, 1.0], "fails", 3)], "query_id long, unit array<double>, description string, acuity int")

    def client(p):
        if "fails" in p:
            raise TimeoutError
        assert p.startswith("a case\nESI 2")
        return "TRIAGE LEVEL: 2"

    predictions, report = judged(cases, queries, client, k=1)
    assert sorted((r["query_id"], r["level"], r["status"]) for r in predictions.collect()) == [(7, 2, "ok"), (8, None, "TimeoutError")]
    assert {r["level"]: r["f1"] for r in report.collect()}[2] == 1.0


def test_retrieval_over_every_hundredth(spark, tmp_path):
    import numpy as np

    from spindrift.plans import QUERIES

    r, n, sf = np.random.default_rng(8), 350, str(tmp_path)
    e = r.normal(size=(n, 8)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(e)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    word = [f"word{k}" for k in range(60)]
    texts = [" ".join(r.choice(word, 12)) for _ in range(60)]
    asked = [" ".join(r.choice(word, 4)) for _ in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    u = e.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = {q: np.round(u @ u[q], 6) for q in range(0, n, 100)}
    best = {q: sorted((-x, i) for i, x in enumerate(s[q]) if i != q)[:5] for q in s}
    pairs = {(x["query_id"], x["id"]): x["cosine"] for x in QUERIES["cosine_pairs"](spark, sf).collect()}
    assert pairs.keys() == {(i % 4, i) for i in range(n)}
    assert all(abs(x - u[q] @ u[i]) < 2e-6 for (q, i), x in pairs.items())
    got = {(x["query_id"], x["rank"]): x["id"] for x in QUERIES["knn_exact"](spark, sf).collect()}
    assert got == {(q, k + 1): i for q in s for k, (_, i) in enumerate(best[q])}
    stats = {x["query_id"]: x["mean_score"] for x in QUERIES["retrieval_stats"](spark, sf).collect()}
    assert stats.keys() == s.keys()
    assert all(abs(stats[q] + sum(x for x, _ in best[q]) / 5) < 2e-6 for q in s)
    words = {x["query_id"] for x in QUERIES["bm25_topk"](spark, sf).collect()}
    assert words == set(range(len(asked)))  # those that share no word with any text have lists of score 0
    assert {x["query_id"] for x in QUERIES["hybrid_fusion"](spark, sf).collect()} == set(s)


def test_approximate_knn_recall(spark):
    from spindrift.plans import QUERIES

    sf = "/root/testdata/sf0.01"
    index = retrieval.unit_index(load(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), "id", "embedding")
    exact = {(r["query_id"], r["id"]) for r in retrieval.knn(index.where("id % 100 = 0").withColumnRenamed("id", "query_id"), index, 10, exclude_self=True).collect()}
    found = {(r["query_id"], r["id"]) for r in QUERIES["lsh_knn"](spark, sf).collect()}
    assert {q for q, _ in found} == {q for q, _ in exact}
    assert len(found) <= len(exact)
    assert len(found & exact) >= 0.9 * len(exact)


def test_exact_quantiles_are_narrowed_down(spark):
    r = random.Random(3)
    values = [r.choice([r.random(), 0.5, float(r.randint(0, 5))]) for _ in range(3000)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(3)
    known = sorted(v for v in values if v is not None)
    ranks = [0, 1, 700, 1499, 1500, 2998, 2999]
    assert profile.at_ranks(df, "a", ranks) == {k: known[k] for k in ranks}
    assert profile.quantiles(df, "a", [0.0, 0.5, 1.0]) == [known[0], (known[1499] + known[1500]) / 2, known[-1]]
    assert profile.quantiles(df.limit(0), "a", [0.5]) == [None]


def test_knn_is_safe_from_nulls_and_has_no_most(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, None), (901, []), (902, [1.0, None, *[0.0] * 6])]
    index = retrieval.unit_index(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    queries = index.where("id < 60 or id >= 900").withColumnRenamed("id", "query_id")
    plain = [tuple(x) for x in retrieval.knn(queries, index, 4, exclude_self=True).orderBy("query_id", "rank").collect()]
    assert len(plain) == 240
    assert all(plain[4 * i + j][2] >= plain[4 * i + j + 1][2] for i in range(60) for j in range(3))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 10)
    monkeypatch.setattr(cells, "BLOCK", 50)
    assert [tuple(x) for x in retrieval.knn(queries, index, 4, exclude_self=True).orderBy("query_id", "rank").collect()] == plain
    assert retrieval.knn(queries.limit(0), index, 4).count() == 0


def test_bm25_fills_its_lists(spark):
    docs = spark.createDataFrame([(i, ["a"] if i == 3 else ["b"] if i else []) for i in range(5)], "id long, t array<string>")
    tf, lengths = retrieval.postings(docs, "id", F.col("t"))
    asked = spark.createDataFrame([(1, "a"), (2, "zz")], "query_id long, term string")
    got = [(x["query_id"], x["id"], x["score"] > 0, x["rank"]) for x in retrieval.bm25(asked, tf, lengths, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 3, True, 1), (1, 0, False, 2), (1, 1, False, 3), (2, 0, False, 1), (2, 1, False, 2), (2, 2, False, 3)]


def test_case_index_is_saved_whole(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, r.choice(["chest pain", "fever cough", "ankle injury"]) + f" case{i}", [r.gauss(0, 1) for _ in range(4)], float(r.randint(20, 80)), None if i % 5 == 0 else str(r.randint(60, 120)), 1 + i % 5) for i in range(60)]
    known = spark.createDataFrame(rows, "case_id long, description string, embedding array<double>, age_at_visit double, heartrate string, acuity int")
    root = str(tmp_path / "index")
    built = cases.build_or_load(known, "case_id", "embedding", "description", root)
    done, medians = cases.prepared(known)
    assert len(done.first()["numbers"]) == 16
    rates = sorted(float(x[4]) for x in rows if x[4])
    assert medians["heartrate"] == (rates[23] + rates[24]) / 2
    assert medians["sbp"] == 0.0
    assert tuple(built.status().first()) == (True, 60, 20)
    again = cases.build_or_load(known, "case_id", "embedding", "description", root)
    assert (again.medians, again.means, again.weights) == (built.medians, built.means, built.weights)
    queries = known.where("case_id < 6").withColumn("query_id", F.col("case_id"))
    asked = again.vectors(queries, "embedding")
    near = again.retrieve(asked, 3)
    assert {x["query_id"] for x in near.where("rank = 1 and query_id = id and score = 1.0").collect()} == set(range(6))
    assert again.retrieve(asked, 3, use_hybrid=True).where("rank = 1 and query_id = id").count() == 6
    words = again.with_weights(words=1.0, vectors=0.0)
    assert words.retrieve(asked, 3, use_hybrid=True, reranker=lambda q, t: [float(a == b) for a, b in zip(q, t, strict=True)]).where("rank = 1 and query_id = id").count() == 6
    with pytest.raises(ValueError, match="anew"):
        again.with_weights(text=0.5)
    quick = cases.quick_retrieve(queries, known, "case_id", "embedding", "description", root, 3)
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, near.collect()))

    def client(prompt):
        if "case3" in prompt:
            raise TimeoutError
        return "ESI level: 2"

    labels = known.select(F.col("case_id").alias("id"), "acuity")
    predictions, report = assemble.judged_configs(again, labels, asked.select("query_id", "unit", "description", "acuity"), client, lambda q, t: [1.0] * len(q))
    found = {x["config"]: tuple(x)[1:] for x in report.collect()}
    assert set(found) == {"vector_only", "hybrid_only", "hybrid_rerank"}
    assert all(x[0] == 6 and x[2] >= 1 for x in found.values())
    assert predictions.where("error = 1 and level <> 3").count() == 0
    assemble.save_evaluation(report, report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "results")).count() == 3


def test_boosting_grid_and_label_shift(spark):
    from pyspark.ml.functions import array_to_vector

    r = random.Random(7)
    rows = [(1 + int(x > 0) + int(x > 1), [x, r.random()]) for x in (r.gauss(0.5, 1) for _ in range(150))]
    df = ml.shift(spark.createDataFrame(rows, "label int, v array<double>"), "label", -1).withColumn("features", array_to_vector("v")).withColumn("weight", F.lit(1.0))
    model, report = ml.grid_search(df.withColumn("label", F.col("label").cast("double")), grid={"maxIter": [1, 3], "maxDepth": [1, 2]}, folds=2, kind="boosting")
    assert report.count() == 4
    back = ml.shift(model.transform(df).select(F.col("prediction").cast("int").alias("level"), "label"), "level", 1)
    assert {x["level"] for x in back.collect()} <= {1, 2, 3}
    assert back.where("level = label + 1").count() > 100


def test_served_features_are_in_order(spark):
    df = spark.createDataFrame([(None, 3, None, 70, 110, 70, 99, 1, "m", "Other", [1.0, 2.0]), (30, None, 98.0, None, None, None, None, None, None, None, None)], "age int, pain int, temperature double, heart_rate int, sbp int, dbp int, o2sat int, time_period int, gender string, arrival_transport string, svd array<double>")
    got = [x["features"] for x in ml.served_features(df, "svd").collect()]
    assert got[0] == [50, 3, 98.6, 70, 110, 70, 99, 1, 1, 0, 1, 0, 0, 1, 2, *[0] * 18]
    assert got[1] == [30, 0, 98, 80, 120, 80, 98, 2, 0, 0, 0, 0, 1, *[0] * 20]


def test_bind_defaults_flags_and_choice(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id long, c string")
    b = spark.createDataFrame([(2, "q", 5), (1, "r", 6)], "id long, c string, n int")
    assert sorted(map(tuple, relational.bind(a, b, "id").collect())) == [(1, "x", 6), (2, "y", 5), (2, "z", 5)]
    assert relational.with_default(a, "c", "-").columns == relational.with_default(a.drop("c"), "c", "-").columns
    assert [x["c"] for x in relational.with_default(a.drop("c"), "c", "-").collect()] == ["-"] * 3
    flags = spark.createDataFrame([("突然胸痛", 0.1), ("高烧", 0.95), ("高烧", None), (None, 0.7), ("ok", 0.2)], "t string, s double")
    assert [x[0] for x in flags.select(rules.red_flag(F.col("t"), F.col("s"))).collect()] == ["critical", "critical", "urgent", "urgent", "normal"]
    loads = spark.createDataFrame([("fast", 0.5), ("detailed", 0.3), ("detailed", 0.9), (None, 0.1)], "p string, l double")
    assert [x[0] for x in loads.select(rules.model_for(F.col("p"), F.col("l"))).collect()] == ["tfidf_rf", "llama_rag", "tfidf_rf", "llama_rag"]


def test_waits_between_tries(spark):
    import time

    began = time.time()
    df = spark.createDataFrame([("p",)], "prompt string")

    def client(prompt):
        raise OSError

    assert [x["status"] for x in ml.with_language_model(df, "prompt", client, tries=3, delay=0.3).collect()] == ["OSError"]
    assert time.time() - began >= 0.9


def test_approximate_knn_shuffles_no_vectors(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer

    rng = np.random.default_rng(5)
    x = ml.with_vector(spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "id long, v array<double>"), "v").select("id", "features")
    queries = x.where("id % 10 = 0")
    found = ml.approximate_knn(x, queries, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    scaled = Normalizer(inputCol="features", outputCol="_unit")
    model = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="hashes", bucketLength=0.25, numHashTables=6, seed=42).fit(scaled.transform(x))
    pairs = model.approxSimilarityJoin(scaled.transform(queries), scaled.transform(x), float("inf"), "distance").selectExpr("datasetA.id q", "datasetB.id i", "distance d").where("q <> i").collect()
    want = [(q, i) for q in range(0, 400, 10) for _, i in sorted((p["d"], p["i"]) for p in pairs if p["q"] == q)[:5]]
    got = [(r["query_id"], r["id"]) for r in found.orderBy("query_id", "distance", "id").collect()]
    assert got == want
    monkeypatch.setattr(ml, "MOST_QUERIES", 15)
    assert [(r["query_id"], r["id"]) for r in ml.approximate_knn(x, queries, 5).orderBy("query_id", "distance", "id").collect()] == want


def test_quick_cases_builds_one_index(spark, monkeypatch):
    from spindrift.plans import QUERIES

    built, build = [], cases.build
    monkeypatch.setattr(cases, "build", lambda *a, **k: built.append(1) or build(*a, **k))
    assert QUERIES["quick_cases"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(built) == 1


def test_postings_are_counted_in_their_rows(spark):
    """Words are counted without a shuffle, as they are where keys are repeated; rare words' idf comes by a join, as that of frequent ones by a broadcast."""
    texts = {1: ["b", "a", "b", "a", "b"], 2: [], 3: None, 4: ["a"], 5: ["c", "c"]}
    docs = spark.createDataFrame(list(texts.items()), "id long, t array<string>")
    tf, lengths = retrieval.postings(docs, "id", F.col("t"))
    assert sorted((r["id"], r["term"], r["tf"], r["len"]) for r in tf.collect()) == [(1, "a", 2, 5), (1, "b", 3, 5), (4, "a", 1, 1), (5, "c", 2, 2)]
    again = retrieval.postings(docs.union(docs.where("id = 4")), "id", F.col("t"))
    assert sorted((r["id"], r["term"], r["tf"]) for r in again[0].collect()) == [(1, "a", 2), (1, "b", 3), (4, "a", 2), (5, "c", 2)]
    assert sorted((r["id"], r["len"]) for r in lengths.collect()) == sorted((r["id"], r["len"]) for r in again[1].collect())
    n = docs.agg(F.count("*").alias("n"))
    plans = [retrieval.tf_idf_parts(tf, n, most) for most in (10, 1, 0)]
    found = [sorted((r["id"], r["term"], round(r["raw"], 9)) for r in p.collect()) for p in plans]
    assert found[0] == found[1] == found[2] and found[0][0] == (1, "a", round(2 * (math.log(6 / 3) + 1), 9))
