"""Joins, aggregations, windows, selection and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import dates, text
from spindrift.operators import profile, relational, select
from spindrift.plans.catalogue import big, load, query, visits


@query("SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, r.n_same FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n_same FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_suppkey) r ON l.l_orderkey = r.l_orderkey AND l.l_suppkey = r.l_suppkey WHERE l.l_quantity > 45")
def left_join_two_key(spark, sf):
    x = load(spark, sf, "lineitem")
    back = x.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n_same"))
    return x.where("l_quantity > 45").join(back, ["l_orderkey", "l_suppkey"], "left").select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "n_same")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_join_chain(spark, sf):
    o, c, n = (load(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@query("WITH one AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT d.doc_id, CAST(one.quality AS BIGINT) AS quality, one.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN one USING (doc_id)")
def lookup_join_found(spark, sf):
    labels = load(spark, sf, "labels").select("doc_id", "quality", F.col("quality").alias("_o"))
    return relational.lookup(load(spark, sf, "documents").select("doc_id"), labels, "doc_id", "_o").select("doc_id", big("quality").alias("quality"), "found")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_missing(spark, sf):
    return relational.unmatched(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id")


@query("""WITH g(group_id, group_name, clusters) AS (VALUES (1, 'first', [0, 1, 2]), (2, 'second', [2, 3, 5]), (3, 'third', [7])),
m AS (SELECT c AS label, max(group_id) AS group_id FROM (SELECT group_id, unnest(clusters) AS c FROM g) GROUP BY c)
SELECT vec_id, CAST(coalesce(m.group_id, 0) AS BIGINT) AS group_id, coalesce(g.group_name, 'Unclassified') AS group_name FROM embeddings e LEFT JOIN m ON e.label = m.label LEFT JOIN g ON g.group_id = m.group_id""")
def explode_lookup(spark, sf):
    groups = spark.createDataFrame([(1, "first", [0, 1, 2]), (2, "second", [2, 3, 5]), (3, "third", [7])], "group_id int, group_name string, clusters array<int>")
    by_cluster = relational.keep_last(groups.select("group_id", "group_name", F.explode("clusters").alias("label")).withColumn("_o", F.col("group_id")), ["label"], "_o").drop("_o")
    return load(spark, sf, "embeddings").join(F.broadcast(by_cluster), "label", "left").select("vec_id", big(F.coalesce("group_id", F.lit(0))).alias("group_id"), F.coalesce("group_name", F.lit("Unclassified")).alias("group_name"))


@query("SELECT md5(text) AS text_md5, count(*) AS frequency, min(doc_id) AS first_doc_id FROM documents GROUP BY text")
def dedup_frequency(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return relational.with_frequency(docs, "text_md5", "doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark, sf):
    return profile.value_counts(load(spark, sf, "documents"), "lang")


@query("SELECT CASE CAST(floor(hour(ts) / 6) AS INT) WHEN 0 THEN 'Night (0-6AM)' WHEN 1 THEN 'Morning (6AM-12PM)' WHEN 2 THEN 'Afternoon (12PM-6PM)' ELSE 'Evening (6PM-12AM)' END AS period, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1")
def dist_percent(spark, sf):
    names = F.element_at(F.array(*map(F.lit, text.PERIODS)), dates.period(F.col("ts")) + 1)
    return profile.distribution(load(spark, sf, "events").select(names.alias("period")), "period")


@query("SELECT event_type, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2")
def group_size_multi(spark, sf):
    return load(spark, sf, "events").groupBy("event_type", big(F.hour("ts")).alias("h")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(label AS BIGINT) AS label, count(*) AS n, array_to_string(list_sort(list(vec_id))[1:3], ',') AS first3, round(avg(vec_id), 2) AS mean_id, round(stddev_samp(vec_id), 2) AS std_id FROM embeddings GROUP BY label""")
def group_profile(spark, sf):
    x = load(spark, sf, "embeddings").select("vec_id", big("label").alias("label"))
    first = select.top_n(x, "label", [F.col("vec_id")], 3).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("vec_id")).cast("array<string>"), ",").alias("first3"))
    stats = x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("vec_id"), 2).alias("mean_id"), F.round(F.stddev_samp("vec_id"), 2).alias("std_id"))
    return stats.join(first, "label").select("label", "n", "first3", "mean_id", "std_id")


@query("SELECT count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents")
def count_distinct(spark, sf):
    d = load(spark, sf, "documents").select(F.xxhash64("text").alias("a"), F.sha2("text", 256).alias("t"), "source", "lang")
    return d.agg(F.count_distinct("t").alias("n_texts"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"))


@query("SELECT count(*) AS n, count(l.doc_id) AS n_found, count(*) FILTER (l.doc_id IS NULL) AS n_missing, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def found_rate(spark, sf):
    found = F.col("found")
    labels = load(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("_o"), "quality")
    x = relational.lookup(load(spark, sf, "documents").select("doc_id"), labels, "doc_id", "_o")
    return x.agg(F.count("*").alias("n"), F.count_if(found).alias("n_found"), F.count_if(~found).alias("n_missing"), F.round(F.count_if(found) / F.count("*"), 6).alias("rate"))


@query("SELECT event_type AS status, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def error_stats(spark, sf):
    d = profile.distribution(load(spark, sf, "events").select(F.col("event_type").alias("status")), "status")
    total = d.agg(F.sum("n").alias("t"))
    return d.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("t"), 6).alias("rate"))


@query("SELECT event_type, arg_max(event_id, ts) AS latest_id, max(ts) AS latest FROM events GROUP BY event_type")
def latest_pointer(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.max_by("event_id", "ts").alias("latest_id"), F.max("ts").alias("latest"))


@query("SELECT p_type, arg_max(p_brand, s) AS best, arg_min(p_brand, s) AS worst FROM (SELECT p_type, p_brand, {'p': avg(p_retailprice), 'b': p_brand} AS s FROM part GROUP BY 1, 2) GROUP BY p_type")
def argmax_group(spark, sf):
    means = load(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("p")).withColumn("s", F.struct("p", "p_brand"))
    return means.groupBy("p_type").agg(F.max_by("p_brand", "s").alias("best"), F.min_by("p_brand", "s").alias("worst"))


@query("SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n, round((sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def class_weights(spark, sf):
    from spindrift.operators.evaluate import class_weights as weights

    return weights(load(spark, sf, "labels").select(big("quality").alias("quality")), "quality")


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_keep_first(spark, sf):
    docs = load(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "source").withColumn("_o", F.col("doc_id"))
    return relational.keep_first(docs, ["text_md5"], "_o").select("text_md5", "doc_id", "source")


@query("SELECT o_orderpriority, o_orderkey, rn AS rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 30")
def topn_per_group(spark, sf):
    x = select.top_n(load(spark, sf, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 30)
    return x.select("o_orderpriority", "o_orderkey", big("rn").alias("rank"))


@query("SELECT l_id, row_number() OVER (ORDER BY l_id) - 1 AS row_id FROM (SELECT l_orderkey * 10 + l_linenumber AS l_id FROM lineitem GROUP BY 1)")
def row_ids(spark, sf):
    keys = load(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_id")).distinct()
    return select.row_ids(keys, "l_id", "row_id").select("l_id", "row_id")


@query("""WITH {V}, r AS (SELECT stay_id, acuity, row_number() OVER (PARTITION BY acuity ORDER BY md5(CAST(stay_id AS VARCHAR)), stay_id) AS rn, count(*) OVER (PARTITION BY acuity) AS n FROM visits)
SELECT stay_id, CAST(acuity AS BIGINT) AS acuity, CASE WHEN rn <= ceil(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, sf):
    return select.stratified(visits(spark, sf).select("stay_id", big("acuity").alias("acuity")), "acuity", "stay_id", 0.8)


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark, sf):
    return select.hash_sample(load(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT md5(text) AS text_md5, count(*) AS frequency, min(doc_id) AS first_doc_id FROM documents GROUP BY text ORDER BY frequency DESC, first_doc_id LIMIT 5")
def topk_frequency(spark, sf):
    return dedup_frequency(spark, sf).orderBy(F.desc("frequency"), "first_doc_id").limit(5)


_QUOTA = """s AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1),
b AS (SELECT *, least(size, greatest(1, floor(100 * size / sum(size) OVER ()))) AS want FROM s),
d AS (SELECT *, 100 - sum(want) OVER () AS need FROM b),
r AS (SELECT *, CASE WHEN need > 0 THEN size - want ELSE want - 1 END AS room FROM d),
p AS (SELECT *, sum(room) OVER (ORDER BY size DESC, cluster) - room AS before FROM r),
quota AS (SELECT cluster, size, CAST(want + sign(need) * least(greatest(abs(need) - before, 0), room) AS BIGINT) AS quota FROM p)"""


@query(f"WITH {_QUOTA} SELECT CAST(cluster AS BIGINT) AS cluster, size, quota FROM quota")
def allocate_quota(spark, sf):
    sizes = load(spark, sf, "embeddings").groupBy(big("label").alias("cluster")).agg(F.count("*").alias("size"))
    return select.quotas(sizes, 100)


@query(f"""WITH {_QUOTA}, e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2), t AS (SELECT vec_id, e.label, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY 1, 2),
k AS (SELECT t.label, vec_id, distance, quota, row_number() OVER (PARTITION BY t.label ORDER BY distance, vec_id) AS rank FROM t JOIN quota ON t.label = quota.cluster)
SELECT CAST(label AS BIGINT) AS cluster, vec_id, distance, rank FROM k WHERE rank <= quota""")
def representatives(spark, sf):
    return select.representatives(load(spark, sf, "embeddings"), "label", "vec_id", "embedding", 100).withColumn("cluster", big("cluster"))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(pos - 1 AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def centroid(spark, sf):
    c = select.centroids(load(spark, sf, "embeddings"), "label", "embedding")
    return c.select(big("label").alias("label"), F.posexplode("centroid").alias("pos", "m")).select("label", big("pos").alias("pos"), F.round("m", 6).alias("mean"))


@query("SELECT c_custkey AS k, c_nationkey::BIGINT AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_nationkey::BIGINT, 'supplier' FROM supplier")
def union_all(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), big("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return c.unionByName(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), big("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(load(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()).distinct()


@query("""WITH a AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100), b AS (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 100), n AS (SELECT (SELECT count(*) FROM documents) AS n_a, (SELECT count(*) FROM labels) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_common)
SELECT n_a, n_b, n_common, round(n_common / greatest(1, least(100, n_a, n_b))::DOUBLE, 6) AS rate, abs(n_a - n_b) <= greatest(1000.0::DOUBLE, 0.01 * n_b) AND n_common >= 0.8 * least(100, n_a, n_b) AS valid FROM n""")
def cache_overlap(spark, sf):
    return relational.overlap(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti(spark, sf):
    done = load(spark, sf, "labels").withColumn("result", F.when(F.col("quality") == 1, F.lit("done")))
    return relational.resume(load(spark, sf, "documents").select("doc_id"), done, "doc_id", F.col("result"))
