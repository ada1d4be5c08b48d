"""What is written and read again, and hooks into models of the caller's, each over a given table and with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import parse
from spindrift.operators import assemble, cases, evaluate, ml, retrieval
from spindrift.plans.catalogue import ORACLES, big, load, query, visits
from spindrift.plans.models import _cases
from spindrift.plans.retrieve import _KNN_OF_ALL, _knn
from spindrift.plans.texts import _predicted
from spindrift.sources import reports, tables


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::DOUBLE END AS o_custkey, o_totalprice, o_orderstatus = 'F' AS filled, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority || ', \"' || o_orderstatus || '\"' END AS note FROM orders")
def csv_round_trip(spark, sf):
    """Orders as CSV and back, without a schema: whole numbers with nulls come back real, flags boolean, quotes and commas as they were."""
    x = load(spark, sf, "orders").select("o_orderkey", F.expr("if(o_orderkey % 3 > 0, o_custkey, null)").alias("o_custkey"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("filled"),
                                         F.expr("if(o_orderkey % 4 > 0, concat(o_orderpriority, ', \"', o_orderstatus, '\"'), 'N/A')").alias("note"))
    at = tables.scratch(spark, "orders-csv")
    tables.write_csv(x, at)
    return tables.read_csv(spark, at)


@query("SELECT s_suppkey, s_name, 2::BIGINT AS version FROM supplier")
def published_version(spark, sf):
    """Of two versions of a table the one published last."""
    x, at = load(spark, sf, "supplier").select("s_suppkey", "s_name"), tables.scratch(spark, "published")
    for n in (1, 2):
        tables.publish(x.where(f"{n} = 2 or s_suppkey % 2 = 0").withColumn("version", F.lit(n).cast("long")), at, f"2024-01-0{n}")
    return tables.latest(spark, at)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0")
def latest_file(spark, sf):
    """The rows of the latest of three files, by name."""
    x, at = load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), tables.scratch(spark, "parts")
    for n in range(3):
        x.where(f"c_custkey % 3 = {(n + 1) % 3}").coalesce(1).write.parquet(f"{at}/classified_{n}")
    return spark.read.parquet(tables.latest_file(spark, f"{at}/classified_*/*.parquet", by="path"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def replaced_in_place(spark, sf):
    """A table that is overwritten by what is read from it."""
    at = tables.scratch(spark, "replaced")
    load(spark, sf, "supplier").select("s_suppkey", "s_acctbal").write.parquet(at)
    tables.replace_table(spark.read.parquet(at).where("s_acctbal > 0"), at)
    return spark.read.parquet(at)


@query("SELECT 'Customers of ' || o_orderpriority AS line FROM (SELECT min(o_orderpriority) AS o_orderpriority FROM orders) UNION ALL SELECT 'o_orderpriority: ' || o_orderpriority || ', n: ' || count(*) FROM orders GROUP BY o_orderpriority")
def text_report(spark, sf):
    """A small table as lines of text."""
    x, at = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), tables.scratch(spark, "report")
    reports.write_lines(x, at, "Customers of " + x.agg(F.min("o_orderpriority")).first()[0])
    return spark.read.text(at).withColumnRenamed("value", "line")


@query("SELECT o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS done FROM orders")
def resumed_waves(spark, sf):
    """Work on all orders after work on some of them: every key once."""
    x, at = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), tables.scratch(spark, "waves")
    work = lambda rows: rows.select("o_orderkey", F.length("o_orderpriority").cast("long").alias("done"))
    tables.resume_into(x.where("o_orderkey % 5 < 2"), at, "o_orderkey", work, waves=3)
    tables.resume_into(x, at, "o_orderkey", work, waves=3)
    return tables.resumed(spark, at)


@query("SELECT p_partkey, length(p_name)::DOUBLE AS x, length(replace(p_name, ' ', ''))::DOUBLE AS y FROM part")
def embedded_texts(spark, sf):
    """An encoder of the caller's, called once for each distinct text."""
    x = ml.embed(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name", lambda texts: [[len(t), len(t.replace(" ", ""))] for t in texts])
    return x.select("p_partkey", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("""WITH {V} SELECT stay_id, CASE WHEN chiefcomplaint IS NULL THEN NULL WHEN chiefcomplaint LIKE '%pain%' THEN 'TimeoutError' ELSE 'ok' END AS status,
CASE WHEN chiefcomplaint NOT LIKE '%pain%' THEN 1 + length(chiefcomplaint) % 5 END AS level FROM visits""")
def language_model_replies(spark, sf):
    """A client that fails on some prompts: a failure is no answer."""

    def client(prompt):
        if "pain" in prompt:
            raise TimeoutError
        return f"ESI level: {1 + len(prompt) % 5}"

    told = ml.with_language_model(visits(spark, sf).select("stay_id", "chiefcomplaint"), "chiefcomplaint", client, tries=2)
    return told.select("stay_id", "status", big(F.when(F.col("status") == "ok", parse.level(F.col("reply")))).alias("level"))


@query(f"WITH {_KNN_OF_ALL}, again AS (SELECT query_id, k.id, CAST(-abs(a.label - b.label) AS DOUBLE) AS score FROM knn k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.id WHERE rank <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM again) SELECT query_id, id, score FROM r WHERE rn <= 3")
def reranked_neighbours(spark, sf):
    """Ten neighbours of every vector scored anew by a scorer of the caller's, and three of them kept."""
    labels = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"))
    near = _knn(spark, sf, 10, 1).select("query_id", "id").join(labels, "id").join(labels.withColumnsRenamed({"id": "query_id", "text": "query_text"}), "query_id")
    return retrieval.rerank(near, lambda q, t: [-abs(float(a) - float(b)) for a, b in zip(q, t, strict=True)], 3).select("query_id", "id", "score")


@query(ORACLES["case_retrieve"])
def quick_cases(spark, sf):
    """The nearest cases in one call."""
    rows = _cases(spark, sf)
    asked = rows.where("case_id % 100 = 0").withColumn("query_id", F.col("case_id"))
    return cases.quick_retrieve(asked, rows, "case_id", "embedding", "description", tables.scratch(spark, "quick"), 5, build_options={"numbers": ("age_at_visit",)})


@query("""WITH c AS (SELECT o_custkey AS id, o_orderkey AS feature, o_totalprice - 150000 AS value FROM orders)
SELECT id, round(sum(greatest(value, 0)), 4) AS positive, round(sum(least(value, 0)), 4) AS negative, round(sum(value), 4) AS net, arg_max(feature, (abs(value), -feature)) AS strongest FROM c GROUP BY id""")
def contribution_totals(spark, sf):
    """What customers' orders add to and take from a round figure, and the one that counts most."""
    x = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("feature"), (F.col("o_totalprice") - 150000).alias("value"))
    totals, strongest = ml.contributions(x, "id", 1)
    return totals.join(strongest.select("id", F.col("feature").alias("strongest")), "id").select("id", *[F.round(c, 4).alias(c) for c in ("positive", "negative", "net")], "strongest")


@query("WITH {V} SELECT stay_id, CASE acuity WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 8.0::DOUBLE WHEN 3 THEN 3.0::DOUBLE WHEN 4 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM visits")
def level_weights(spark, sf):
    """The weights of a stated table."""
    return ml.weighted(visits(spark, sf), "acuity", ml.LEVEL_WEIGHTS).select("stay_id", "weight")


@query(ORACLES["eval_per_class"])
def saved_evaluation(spark, sf):
    """An evaluation's table by level as it stands in its CSV file."""
    c = evaluate.per_class(_predicted(spark, sf), [1, 2, 3, 4, 5])
    rounded = c.select("level", "tp", "fp", "fn", "support", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])
    at = tables.scratch(spark, "evaluation")
    assemble.save_evaluation(rounded, rounded, at)
    back = tables.read_csv(spark, f"{at}/performance_report")
    return back.select(*[big(x).alias(x) for x in ("level", "tp", "fp", "fn", "support")], *[F.col(x).cast("double").alias(x) for x in ("precision", "recall", "f1")])
