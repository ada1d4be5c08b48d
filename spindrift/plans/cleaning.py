"""Scans, projections, predicates, cleaning, imputation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import clean, dates, text
from spindrift.operators import profile, rules
from spindrift.plans.catalogue import big, load, query, visits
from spindrift.sources import tables

VITALS = ["age_at_visit", "pain", "temperature", "heartrate", "sbp", "dbp", "o2sat"]


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 10")
def scan_project(spark, sf):
    x = load(spark, sf, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return x.select("l_orderkey", big("l_linenumber").alias("l_linenumber"), "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_head(spark, sf):
    return load(spark, sf, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS x0 FROM embeddings")
def embedding_scan(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", big("label").alias("label"), big(F.size("embedding")).alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"))


@query("WITH d AS (SELECT doc_id, quality = 1 AS good FROM labels) SELECT doc_id FROM d WHERE good")
def filter_flag(spark, sf):
    return load(spark, sf, "labels").withColumn("good", F.col("quality") == 1).where("good").select("doc_id")


@query("WITH {V} SELECT stay_id, chiefcomplaint FROM visits WHERE trim(chiefcomplaint) <> ''")
def filter_nonblank(spark, sf):
    return visits(spark, sf).where(F.trim("chiefcomplaint") != "").select("stay_id", "chiefcomplaint")


@query("WITH {V} SELECT stay_id, subject_id FROM visits WHERE age_at_visit IS NOT NULL AND pain IS NOT NULL AND temperature IS NOT NULL AND heartrate IS NOT NULL AND sbp IS NOT NULL AND o2sat IS NOT NULL AND chiefcomplaint IS NOT NULL")
def dropna_required(spark, sf):
    return visits(spark, sf).na.drop(subset=["age_at_visit", "pain", "temperature", "heartrate", "sbp", "o2sat", "chiefcomplaint"]).select("stay_id", "subject_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", big("l_linenumber").alias("l_linenumber")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_limit(spark, sf):
    return load(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CASE WHEN TRY_CAST(regexp_extract(props, '\"k\": *([^,}]*)', 1) AS DOUBLE) BETWEEN 10 AND 80 THEN TRY_CAST(regexp_extract(props, '\"k\": *([^,}]*)', 1) AS DOUBLE) END AS k FROM events")
def clean_numeric(spark, sf):
    return load(spark, sf, "events").select("event_id", clean.in_range(F.regexp_extract("props", r'"k": *([^,}]*)', 1), 10, 80).alias("k"))


_RANGES = ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in clean.CLEAN_RANGES.items())


@query(f"WITH {{V}} SELECT stay_id, {_RANGES} FROM visits")
def clean_vitals(spark, sf):
    return visits(spark, sf).select("stay_id", *[clean.in_range(F.col(c), lo, hi).alias(c) for c, (lo, hi) in clean.CLEAN_RANGES.items()])


@query("WITH {V} SELECT stay_id, CASE WHEN upper(trim(gender)) IN ('M', 'F') THEN upper(trim(gender)) END AS gender FROM visits")
def map_gender(spark, sf):
    return visits(spark, sf).select("stay_id", clean.gender(F.col("gender")).alias("gender"))


@query("""WITH {V}, t AS (SELECT stay_id, lower(trim(arrival_transport)) AS t FROM visits)
SELECT stay_id, CASE t WHEN 'walk in' THEN 'walk-in' WHEN 'private car' THEN 'private' ELSE t END AS arrival_transport FROM t""")
def map_passthrough(spark, sf):
    return visits(spark, sf).select("stay_id", clean.transport(F.col("arrival_transport")).alias("arrival_transport"))


@query("""WITH {V} SELECT stay_id, CASE upper(gender) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' WHEN 'MALE' THEN 'Male' WHEN 'FEMALE' THEN 'Female' ELSE 'Unknown' END AS gender,
CASE upper(arrival_transport) WHEN 'AMBULANCE' THEN 'AMBULANCE' WHEN 'HELICOPTER' THEN 'HELICOPTER' WHEN 'OTHER' THEN 'OTHER' WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'WALK IN' END AS arrival_transport FROM visits""")
def map_default(spark, sf):
    return visits(spark, sf).select("stay_id", clean.gender_word(F.col("gender")).alias("gender"), clean.transport_or_walk_in(F.col("arrival_transport")).alias("arrival_transport"))


@query("WITH {V} SELECT stay_id, CASE WHEN lower(trim(chiefcomplaint)) NOT IN ('', 'unknown', 'none', 'n/a', 'nan') THEN chiefcomplaint END AS chiefcomplaint FROM visits")
def null_tokens(spark, sf):
    return visits(spark, sf).select("stay_id", clean.without_null_tokens(F.col("chiefcomplaint")).alias("chiefcomplaint"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1.0) AS v FROM events")
def safe_cast(spark, sf):
    return load(spark, sf, "events").select("event_id", clean.number_or(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("value").cast("string")), -1.0).alias("v"))


_VALID = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v FROM visits" for c in ("temperature", "heartrate", "o2sat", "sbp", "dbp", "pain"))


@query(f"""WITH {{V}}, long AS ({_VALID} UNION ALL SELECT 'other' AS name, pain AS v FROM visits)
SELECT name, count(*) AS n, CAST(sum(CASE WHEN v IS NULL THEN 0 WHEN name = 'temperature' THEN CAST(v BETWEEN 95 AND 110 AS INT) WHEN name = 'heartrate' THEN CAST(v BETWEEN 30 AND 250 AS INT)
 WHEN name = 'o2sat' THEN CAST(v BETWEEN 70 AND 100 AS INT) WHEN name = 'sbp' THEN CAST(v BETWEEN 70 AND 200 AS INT) WHEN name = 'dbp' THEN CAST(v BETWEEN 40 AND 120 AS INT) WHEN name = 'pain' THEN CAST(v BETWEEN 0 AND 10 AS INT) ELSE 1 END) AS BIGINT) AS n_valid
FROM long GROUP BY name""")
def validate_vitals(spark, sf):
    names = ["temperature", "heartrate", "o2sat", "sbp", "dbp", "pain"]
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names] + [F.struct(F.lit("other").alias("name"), F.col("pain").alias("v"))]
    long = visits(spark, sf).select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return long.groupBy("name").agg(F.count("*").alias("n"), F.count_if(clean.valid_vital(F.col("name"), F.col("v"))).alias("n_valid"))


@query("SELECT o_orderkey, CAST(20 + o_custkey % 60 + (year(o_orderdate) - (1990 + o_custkey % 5)) AS BIGINT) AS age FROM orders")
def derive_age(spark, sf):
    x = load(spark, sf, "orders")
    return x.select("o_orderkey", big(dates.age_at(20 + F.col("o_custkey") % 60, 1990 + F.col("o_custkey") % 5, F.col("o_orderdate"))).alias("age"))


@query("SELECT c_custkey AS subject_id, c_name AS patient, c_acctbal FROM customer")
def rename_map(spark, sf):
    names = {"c_custkey": "subject_id", "c_name": "patient", "missing": "never"}
    return load(spark, sf, "customer").withColumnsRenamed(names).select("subject_id", "patient", "c_acctbal")


@query("""WITH {V} SELECT stay_id, concat_ws(',', CASE WHEN pain IS NULL THEN 'pain' END, CASE WHEN o2sat IS NULL THEN 'o2sat' END, CASE WHEN gender IS NULL THEN 'gender' END, CASE WHEN chiefcomplaint IS NULL OR trim(chiefcomplaint) = '' THEN 'chiefcomplaint' END) AS missing,
pain IS NOT NULL AND o2sat IS NOT NULL AND gender IS NOT NULL AND chiefcomplaint IS NOT NULL AND trim(chiefcomplaint) <> '' AS valid FROM visits""")
def request_validate(spark, sf):
    from spindrift.sources.requests import missing_fields

    missing = missing_fields(["pain", "o2sat", "gender", "chiefcomplaint"])
    return visits(spark, sf).select("stay_id", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("valid"))


_MEDIAN = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM visits)) AS {c}, CAST({c} IS NULL AS INT)::BIGINT AS {c}_missing" for c in ("pain", "o2sat"))


@query(f"WITH {{V}} SELECT stay_id, {_MEDIAN} FROM visits")
def impute_median(spark, sf):
    x = profile.with_missing_flags(visits(spark, sf).select("stay_id", "pain", "o2sat"), ["pain", "o2sat"])
    done = profile.impute(x, "median", ["pain", "o2sat"])
    return done.select("stay_id", "pain", big("pain_missing").alias("pain_missing"), "o2sat", big("o2sat_missing").alias("o2sat_missing"))


@query("WITH {V} SELECT stay_id, round(coalesce(pain, (SELECT avg(pain) FROM visits)), 6) AS pain, round(coalesce(o2sat, (SELECT avg(o2sat) FROM visits)), 6) AS o2sat FROM visits")
def impute_mean(spark, sf):
    done = profile.impute(visits(spark, sf).select("stay_id", "pain", "o2sat"), "mean", ["pain", "o2sat"])
    return done.select("stay_id", F.round("pain", 6).alias("pain"), F.round("o2sat", 6).alias("o2sat"))


@query("""WITH {V}, p AS (SELECT pain FROM visits WHERE pain IS NOT NULL GROUP BY pain ORDER BY count(*) DESC, pain LIMIT 1), o AS (SELECT o2sat FROM visits WHERE o2sat IS NOT NULL GROUP BY o2sat ORDER BY count(*) DESC, o2sat LIMIT 1)
SELECT stay_id, coalesce(pain, (SELECT pain FROM p)) AS pain, coalesce(o2sat, (SELECT o2sat FROM o)) AS o2sat, coalesce(gender, '') AS gender FROM visits""")
def impute_mode(spark, sf):
    return profile.impute(visits(spark, sf).select("stay_id", "pain", "o2sat", "gender"), "mode", ["pain", "o2sat"])


@query("WITH {V} SELECT stay_id, coalesce(pain, 5.0) AS pain, coalesce(o2sat, 98.0) AS o2sat FROM visits")
def impute_default(spark, sf):
    return visits(spark, sf).select("stay_id", *[clean.number_or(F.col(c), clean.QUERY_DEFAULTS[c]).alias(c) for c in ("pain", "o2sat")])


_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n FROM visits" for c in [*VITALS, "gender", "chiefcomplaint"])


@query(f"WITH {{V}} {_NULLS}")
def null_profile(spark, sf):
    return profile.null_profile(visits(spark, sf), [*VITALS, "gender", "chiefcomplaint"])


@query("WITH {V}, q AS (SELECT quantile_cont(heartrate, 0.25) AS a, quantile_cont(heartrate, 0.75) AS b FROM visits) SELECT stay_id, heartrate FROM visits, q WHERE heartrate < a - 1.5 * (b - a) OR heartrate > b + 1.5 * (b - a)")
def outlier_iqr(spark, sf):
    return profile.outliers(visits(spark, sf).select("stay_id", "heartrate"), "heartrate", "iqr", 1.5)


@query("WITH {V}, s AS (SELECT avg(sbp) AS m, stddev_pop(sbp) AS d FROM visits) SELECT stay_id, sbp FROM visits, s WHERE abs((sbp - m) / d) > 2.5")
def outlier_zscore(spark, sf):
    return profile.outliers(visits(spark, sf).select("stay_id", "sbp"), "sbp", "zscore", 2.5)


_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS lo, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS hi FROM visits" for c in VITALS)


@query(f"WITH {{V}} {_DESCRIBE}")
def describe_stats(spark, sf):
    return profile.describe(visits(spark, sf), VITALS)


@query("SELECT event_id, CAST(floor(hour(ts) / 6) AS BIGINT) AS time_period FROM events")
def time_period(spark, sf):
    return load(spark, sf, "events").select("event_id", big(dates.period(F.col("ts"))).alias("time_period"))


@query("SELECT event_id, CAST(CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2 ELSE 3 END AS BIGINT) AS time_period FROM events")
def time_period_cut(spark, sf):
    return load(spark, sf, "events").select("event_id", big(dates.period_right_closed(F.col("ts"))).alias("time_period"))


@query("SELECT event_id, strftime(ts, '%H:%M') AS at FROM events")
def time_format(spark, sf):
    return load(spark, sf, "events").select("event_id", dates.clock(F.col("ts")).alias("at"))


@query("SELECT event_id, CASE CAST(floor(hour(ts) / 6) AS INT) WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.1::DOUBLE ELSE 1.3::DOUBLE END AS factor FROM events")
def period_factor(spark, sf):
    return load(spark, sf, "events").select("event_id", rules.period_factor(dates.period(F.col("ts"))).alias("factor"))


@query("WITH {V} SELECT stay_id, CASE WHEN length(chiefcomplaint) > 20 THEN substr(chiefcomplaint, 1, 17) || '...' ELSE chiefcomplaint END AS short FROM visits")
def redact_truncate(spark, sf):
    return visits(spark, sf).select("stay_id", text.redact(F.col("chiefcomplaint"), 20).alias("short"))


_DIRTY = {"o_orderkey": "CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE CAST(o_orderkey AS STRING) END", "o_custkey": "CAST(o_custkey AS STRING)", "o_totalprice": "CAST(o_totalprice AS STRING)",
          "o_flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END", "o_mixed": "CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE 'true' END", "o_none": "CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE '' END", "o_status": "o_orderstatus"}


@query("WITH d AS (SELECT " + ", ".join(f"{x.replace('STRING', 'VARCHAR')} AS {c}" for c, x in _DIRTY.items()) + " FROM orders) SELECT 'o_orderkey' AS name, CASE WHEN count(*) FILTER (o_orderkey = 'NA') > 0 THEN 'real' ELSE 'integer' END AS kind, count(*) FILTER (o_orderkey = 'NA') AS n_null, count(*) AS n FROM d"
       + "".join(f" UNION ALL SELECT '{c}', '{k}', {n}, count(*) FROM d" for c, k, n in (("o_custkey", "integer", 0), ("o_totalprice", "real", 0), ("o_flag", "boolean", 0), ("o_mixed", "text", 0), ("o_none", "null", "count(*)"), ("o_status", "text", 0))))
def infer_types(spark, sf):
    """The types of orders as they would stand in a CSV file, some cells being null tokens."""
    return tables.inferred(load(spark, sf, "orders").selectExpr(*[f"{x} AS {c}" for c, x in _DIRTY.items()]))
