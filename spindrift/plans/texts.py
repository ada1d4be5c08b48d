"""Text, keywords, parsing, rules and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import dates, parse, text
from spindrift.operators import evaluate, rules, severity
from spindrift.plans.catalogue import ORACLES, big, load, query, visits
from spindrift.sources import reports, requests

_EN = "lang = 'en'"


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents")
def text_normalize(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '([!?.]){2,}', '\\1', 'g')) AS h FROM documents")
def text_clean(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("h"))


def _expand(c: str) -> str:
    for p, r in text.ABBREVIATIONS:
        c = f"regexp_replace({c}, '{p}', '{r.replace('$1', chr(92) + '1')}', 'gi')"
    return c


@query(f"WITH {{V}} SELECT stay_id, coalesce({_expand('chiefcomplaint')}, '') AS complaint FROM visits")
def abbrev_expand(spark, sf):
    return visits(spark, sf).select("stay_id", text.expand_abbreviations(F.col("chiefcomplaint")).alias("complaint"))


@query(f"WITH {{V}} SELECT stay_id, regexp_replace(trim(regexp_replace(lower(coalesce({_expand('chiefcomplaint')}, '')), '\\s+', ' ', 'g')), '([!?.]){{2,}}', '\\1', 'g') AS complaint FROM visits")
def text_pipeline(spark, sf):
    return visits(spark, sf).select("stay_id", text.complaint(F.col("chiefcomplaint")).alias("complaint"))


def _replaced(c: str, table: tuple) -> str:
    for a, b in table:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"WITH {{V}} SELECT stay_id, {_replaced('lower(chiefcomplaint)', text.LITERALS)} AS literal, {_replaced(chr(39) + 'Pain in L arm, R leg and LUQ area ' + chr(39) + ' || chiefcomplaint', text.LOCATIONS)} AS located FROM visits")
def literal_replace(spark, sf):
    return visits(spark, sf).select("stay_id", text.expand_literals(F.col("chiefcomplaint")).alias("literal"), text.locations(F.concat(F.lit("Pain in L arm, R leg and LUQ area "), F.col("chiefcomplaint"))).alias("located"))


_BASES = "CASE " + " ".join(f"WHEN contains(w, '{b}') THEN '{b}'" for b in text.KEYWORD_BASES) + " ELSE w END"


@query(f"""WITH w AS (SELECT doc_id, i, trim(w) AS w FROM (SELECT doc_id, unnest(string_split(replace(lower(replace(text, ' ', ', ')), '，', ','), ',')) AS w, generate_subscripts(string_split(replace(lower(replace(text, ' ', ', ')), '，', ','), ','), 1) AS i FROM documents)),
r AS (SELECT doc_id, i, regexp_replace({_BASES}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g') AS k FROM w WHERE length(w) > 1),
f AS (SELECT doc_id, k, min(i) AS i FROM r GROUP BY doc_id, k), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
SELECT d.doc_id, md5(coalesce(string_agg(n.k, ', ' ORDER BY n.i), '')) AS h FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND rn <= 5 GROUP BY d.doc_id""")
def keyword_clean(spark, sf):
    raw = F.replace(F.col("text"), F.lit(" "), F.lit(", "))
    return load(spark, sf, "documents").select("doc_id", F.md5(text.keywords(raw)).alias("h"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS h FROM t""")
def tokenize(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", big(F.size("w")).alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("h"))


_HITS = ", ".join(f"CASE WHEN contains(lower(chiefcomplaint), '{p}') THEN '{p}' END" for p in rules.CRITICAL_SYMPTOMS)


@query(f"WITH {{V}} SELECT stay_id, concat_ws(',', {_HITS}) AS hits FROM visits")
def keyword_hits(spark, sf):
    return visits(spark, sf).select("stay_id", F.array_join(rules.critical_symptoms(F.col("chiefcomplaint")), ",").alias("hits"))


@query("""WITH {V} SELECT stay_id, chiefcomplaint FROM visits WHERE length(chiefcomplaint) <> 1 AND NOT regexp_full_match(chiefcomplaint, '[\\s\\-."''\\\\?]*')""")
def junk_filter(spark, sf):
    c = F.col("chiefcomplaint")
    return visits(spark, sf).where((F.length(c) != 1) & ~c.rlike(r"""^[\s\-."'\\?]*$""")).select("stay_id", "chiefcomplaint")


@query("""WITH {V}, t AS (SELECT stay_id, coalesce(chiefcomplaint, 'Unknown') AS c, coalesce(gender, 'Unknown') AS g, arrival_transport AS a, CAST(floor(hour(intime) / 6) AS INT) AS p, acuity,
CAST(CAST(age_at_visit AS BIGINT) AS VARCHAR) AS age, CAST(CAST(heartrate AS BIGINT) AS VARCHAR) AS hr, CAST(CAST(sbp AS BIGINT) AS VARCHAR) AS s, CAST(CAST(dbp AS BIGINT) AS VARCHAR) AS b, CAST(CAST(floor(temperature) AS BIGINT) AS VARCHAR) AS t, coalesce(CAST(CAST(o2sat AS BIGINT) AS VARCHAR), 'Unknown') AS o, coalesce(CAST(CAST(pain AS BIGINT) AS VARCHAR), 'Unknown') AS pain FROM visits)
SELECT stay_id, md5(concat_ws(chr(10), 'Chief Complaint: ' || c, 'Age: ' || age || ' years', 'Gender: ' || g, 'Vital Signs:', '- Heart Rate: ' || hr || ' bpm', '- Blood Pressure: ' || s || '/' || b || ' mmHg', '- Temperature: ' || t || ' °F', '- Oxygen Saturation: ' || o || '%', '- Pain Score: ' || pain || '/10',
'Arrival Method: ' || a, 'Arrival Time Period: ' || CASE p WHEN 0 THEN 'Night (0-6AM)' WHEN 1 THEN 'Morning (6AM-12PM)' WHEN 2 THEN 'Afternoon (12PM-6PM)' ELSE 'Evening (6PM-12AM)' END, 'Actual Triage Level: ESI ' || acuity)) AS h FROM t""")
def describe_row(spark, sf):
    x = visits(spark, sf).withColumn("time_period", dates.period(F.col("intime")))
    x = x.withColumns({c: F.floor(c) for c in ("age_at_visit", "heartrate", "sbp", "dbp", "o2sat", "pain", "temperature")})
    return x.select("stay_id", F.md5(text.describe_case(with_label=True)).alias("h"))


_REPLIES = "(1, 'Group: 4' || chr(10) || 'Confidence: 3'), (2, 'Severity: 2'), (3, 'no idea'), (4, 'Group: x' || chr(10) || 'Group: 7'), (5, NULL), (6, '  Confidence:  5  ')"


@query(f"""WITH r(id, t) AS (VALUES {_REPLIES}), k AS (SELECT id, regexp_extract_all(t, '(?m)^\\s*Group:\\s*([^\\n:]*)', 1) AS g, regexp_extract_all(t, '(?m)^\\s*Confidence:\\s*([^\\n:]*)', 1) AS c, regexp_extract_all(t, '(?m)^\\s*Severity:\\s*([^\\n:]*)', 1) AS s FROM r)
SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(TRY_CAST(trim(g[-1]) AS INT), 0) AS BIGINT) AS group_id, CAST(coalesce(TRY_CAST(trim(c[-1]) AS INT), 1) AS BIGINT) AS confidence, CAST(coalesce(TRY_CAST(trim(s[-1]) AS INT), 3) AS BIGINT) AS severity FROM k""")
def parse_kv(spark, sf):
    r = spark.createDataFrame([(1, "Group: 4\nConfidence: 3"), (2, "Severity: 2"), (3, "no idea"), (4, "Group: x\nGroup: 7"), (5, None), (6, "  Confidence:  5  ")], "id long, t string")
    g, s = parse.group_of(F.col("t")), parse.severity_of(F.col("t"))
    return r.select("id", big(g["group_id"]).alias("group_id"), big(g["confidence"]).alias("confidence"), big(s["severity"]).alias("severity"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TRIAGE LEVEL: ' || (event_id % 6) WHEN 1 THEN 'I say ' || (event_id % 9) || ' of 5' WHEN 2 THEN 'none' END AS t FROM events)
SELECT event_id, CAST(coalesce(TRY_CAST(regexp_extract(t, '\\b([1-5])\\b', 1) AS INT), 3) AS BIGINT) AS level FROM r""")
def parse_level(spark, sf):
    e = F.col("event_id")
    t = F.when(e % 4 == 0, F.concat(F.lit("TRIAGE LEVEL: "), (e % 6).cast("string"))).when(e % 4 == 1, F.concat(F.lit("I say "), (e % 9).cast("string"), F.lit(" of 5"))).when(e % 4 == 2, F.lit("none"))
    return load(spark, sf, "events").select("event_id", big(parse.level(t)).alias("level"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN event_id % 3 = 1 THEN props ELSE 'oops' END AS t FROM events)
SELECT event_id, coalesce(TRY_CAST(regexp_extract(t, '"k": *([0-9]+)', 1) AS BIGINT), -1) AS k FROM r""")
def json_extract(spark, sf):
    e, p = F.col("event_id"), F.col("props")
    t = F.when(e % 3 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e % 3 == 1, p).otherwise("oops")
    return load(spark, sf, "events").select("event_id", F.coalesce(F.from_json(parse.fenced(t), "k long")["k"], F.lit(-1).cast("long")).alias("k"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS group_id, n_name AS group_name,
'seen in ' || n_name AS description, CAST(n_nationkey % 3 + 1 AS BIGINT) AS severity_lo, CAST(n_nationkey % 3 + 3 AS BIGINT) AS severity_hi, n_nationkey || ',' || 10 * n_nationkey AS clusters, lower(n_name) || ',' || 'k' || n_nationkey AS symptoms FROM nation""")
def report_parse(spark, sf):
    """A report a region, with a numbered group for each of its nations, written as text and read back."""
    n = load(spark, sf, "nation")
    within = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    key = F.col("n_nationkey").cast("string")
    low, high = (F.col("n_nationkey") % 3 + i for i in (1, 3))
    lines = F.concat_ws("\n", F.concat(F.row_number().over(within).cast("string"), F.lit(". "), "n_name"), F.concat(F.lit("Description: seen in "), "n_name"), F.format_string("Severity range: [%d, %d]", low, high),
                        F.concat(F.lit("Included clusters: ["), key, F.lit(", "), (F.col("n_nationkey") * 10).cast("string"), F.lit("]")), F.concat(F.lit("Typical symptoms: "), F.lower("n_name"), F.lit(", k"), key))
    blocks = n.select(F.col("n_regionkey").cast("string").alias("path"), "n_nationkey", lines.alias("block"))
    files = blocks.groupBy("path").agg(F.concat(F.lit("Groups\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "block"))), lambda s: s["block"]), "\n\n")).alias("content"))
    g = reports.parse_groups(files)
    return g.select("path", big("group_id").alias("group_id"), "group_name", "description", big(F.col("severity_range")[0]).alias("severity_lo"), big(F.col("severity_range")[1]).alias("severity_hi"), F.array_join(F.col("included_clusters").cast("array<string>"), ",").alias("clusters"), F.array_join("typical_symptoms", ",").alias("symptoms"))


@query("""WITH {V}, __FALLBACK__ SELECT stay_id, '{"level":' || level || ',"confidence":' || CASE level WHEN 1 THEN '0.85' WHEN 2 THEN '0.75' WHEN 3 THEN '0.7' ELSE '0.8' END || ',"reasons":["' || CASE level __NAMES__ END || '"]}' AS response FROM scored""")
def response_json(spark, sf):
    x = visits(spark, sf).select("stay_id", _fallback().alias("f")).select("stay_id", "f.level", "f.confidence", F.array(rules.level_name(F.col("f.level"))).alias("reasons"))
    return requests.responses(x).select("stay_id", "response")


# ---------------------------------------------------------------- rules
_IN = lambda c, ranges: "(" + " OR ".join(f"coalesce({c} BETWEEN {lo} AND {hi}, false)" for lo, hi in ranges) + ")"
_CRIT = {c: _IN(c, r) for c, _, r in rules.CRITICAL}
_CONC = {c: _IN(c, rules.CONCERNING[c]) for c in _CRIT}
_so_far = []
_CONC_SQL = []
for _c, _n, _ in rules.CRITICAL:
    _so_far.append(_CRIT[_c])
    _CONC_SQL.append(f"CASE WHEN NOT ({' OR '.join(_so_far)}) AND {_CONC[_c]} THEN '{_n}' END")
_CRIT_SQL = [f"CASE WHEN {_CRIT[c]} THEN '{n}' END" for c, n, _ in rules.CRITICAL]
_RISK = f"risked AS (SELECT *, concat_ws(',', {', '.join(_CRIT_SQL)}) AS critical, concat_ws(',', {', '.join(_CONC_SQL)}) AS concerning FROM visits), risk AS (SELECT *, CASE WHEN critical <> '' THEN 'critical' WHEN concerning <> '' THEN 'concerning' ELSE 'normal' END AS risk FROM risked)"
_N_SYMPTOMS = " + ".join(f"CAST(coalesce(contains(lower(chiefcomplaint), '{p}'), false) AS INT)" for p in rules.CRITICAL_SYMPTOMS)
_LEVEL = f"lv AS (SELECT *, CASE WHEN risk = 'critical' OR ns > 1 THEN 1 WHEN ns > 0 OR risk = 'concerning' THEN 2 ELSE 3 END AS first FROM (SELECT *, {_N_SYMPTOMS} AS ns FROM risk)), recommended AS (SELECT *, CASE WHEN first > 2 AND (age_at_visit < 2 OR age_at_visit > 80 OR coalesce(pain >= 8, false)) THEN 2 ELSE first END AS level FROM lv)"
_any = lambda ps: " OR ".join(f"contains(lower(coalesce(chiefcomplaint, '')), '{p}')" for p in ps)
_FALLBACK = f"""sc AS (SELECT *, CAST(heartrate > 100 OR heartrate < 60 AS INT) + CAST(sbp < 90 OR sbp > 180 AS INT) + CAST(temperature > 100.4 AS INT) + CAST(coalesce(o2sat, 98) < 95 AS INT) + CAST(coalesce(pain, 5) > 7 AS INT) AS score FROM visits),
scored AS (SELECT *, CASE WHEN {_any(rules.FALLBACK_CRITICAL)} OR score >= 3 THEN 1 WHEN {_any(rules.FALLBACK_SEVERE)} OR score >= 2 OR age_at_visit > 65 THEN 2 WHEN score >= 1 OR coalesce(pain, 5) > 5 THEN 3 ELSE 4 END AS level FROM sc)"""


def _fallback():
    return rules.fallback(*map(F.col, ("chiefcomplaint", "heartrate", "sbp", "temperature", "o2sat", "pain", "age_at_visit")))


@query(f"WITH {{V}}, {_RISK} SELECT stay_id, risk, critical, concerning FROM risk")
def vital_risk(spark, sf):
    return visits(spark, sf).select("stay_id", rules.vital_risk().alias("r")).select("stay_id", "r.risk", F.array_join("r.critical", ",").alias("critical"), F.array_join("r.concerning", ",").alias("concerning"))


@query(f"""WITH {{V}}, {_RISK}, {_LEVEL} SELECT stay_id, CAST(level AS BIGINT) AS level, CASE WHEN first = 1 THEN 'critical vital signs or several critical symptoms' WHEN first = 2 AND ns > 0 THEN 'a critical symptom' WHEN first = 2 THEN 'concerning vital signs'
WHEN age_at_visit < 2 OR age_at_visit > 80 THEN 'age' WHEN pain >= 8 THEN 'severe pain' ELSE '' END AS reasons FROM recommended""")
def recommend_level(spark, sf):
    x = visits(spark, sf).withColumn("risk", rules.vital_risk()["risk"]).withColumn("ns", F.size(rules.critical_symptoms(F.col("chiefcomplaint"))))
    r = x.select("stay_id", rules.recommended_level(F.col("risk"), F.col("ns"), F.col("age_at_visit"), F.col("pain")).alias("r"))
    return r.select("stay_id", big("r.level").alias("level"), F.array_join("r.reasons", "; ").alias("reasons"))


@query(f"WITH {{V}}, {_FALLBACK} SELECT stay_id, CAST(level AS BIGINT) AS level, CASE level WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.75::DOUBLE WHEN 3 THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM scored")
def fallback_score(spark, sf):
    return visits(spark, sf).select("stay_id", _fallback().alias("f")).select("stay_id", big("f.level").alias("level"), "f.confidence")


@query("WITH {V} SELECT stay_id, CASE WHEN age_at_visit IS NULL THEN 'unknown' WHEN age_at_visit < 18 THEN 'pediatric' WHEN age_at_visit < 65 THEN 'adult' ELSE 'elderly' END AS band FROM visits")
def age_band(spark, sf):
    return visits(spark, sf).select("stay_id", rules.age_band(F.col("age_at_visit")).alias("band"))


@query("""WITH {V} SELECT stay_id, CAST(least(10, 5 + 2 * CAST(coalesce(pain > 7, false) AS INT) + CAST(age_at_visit < 18 OR age_at_visit > 80 AS INT) + CAST(heartrate < 50 OR heartrate > 120 AS INT) + CAST(sbp < 90 OR sbp > 160 AS INT) + CAST(hour(intime) < 6 AS INT)) AS BIGINT) AS k FROM visits""")
def adaptive_k(spark, sf):
    x = visits(spark, sf)
    return x.select("stay_id", big(rules.adaptive_k(5, F.col("pain"), F.col("age_at_visit"), F.col("heartrate"), F.col("sbp"), dates.period(F.col("intime")))).alias("k"))


@query(f"""WITH {{V}}, {_RISK}, clean AS (SELECT *, CAST(floor(hour(intime) / 6) AS BIGINT) AS time_period FROM risk WHERE temperature BETWEEN 90 AND 110 AND heartrate BETWEEN 30 AND 220 AND sbp BETWEEN 50 AND 250)
SELECT risk, time_period, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM clean GROUP BY 1, 2""")
def risk_by_period(spark, sf):
    from spindrift.functions import clean
    from spindrift.operators import profile

    x = visits(spark, sf)
    for c in ("temperature", "heartrate", "sbp"):
        x = x.where(clean.in_range(F.col(c), *clean.CLEAN_RANGES[c]).isNotNull())
    x = x.select(rules.vital_risk()["risk"].alias("risk"), big(dates.period(F.col("intime"))).alias("time_period"))
    return profile.distribution(x, "risk", "time_period")


# ---------------------------------------------------------------- evaluation
_CM = "cm AS (SELECT acuity AS label, level AS pred, count(*) AS n FROM scored GROUP BY 1, 2)"
_PER = f"""{_CM}, g AS (SELECT unnest(range(1, 6)) AS level), c AS (SELECT g.level, coalesce(sum(n) FILTER (label = level AND pred = level), 0) AS tp, coalesce(sum(n) FILTER (label <> level AND pred = level), 0) AS fp, coalesce(sum(n) FILTER (label = level AND pred <> level), 0) AS fn FROM g LEFT JOIN cm ON true GROUP BY 1),
p AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM p)"""


def _predicted(spark, sf):
    return evaluate.confusion(visits(spark, sf).select("acuity", _fallback()["level"].alias("pred")), "acuity", "pred")


@query(f"WITH {{V}}, {_FALLBACK}, {_CM} SELECT CAST(label AS BIGINT) AS label, CAST(pred AS BIGINT) AS pred, n FROM cm")
def confusion_matrix(spark, sf):
    return _predicted(spark, sf).select(big("label").alias("label"), big("pred").alias("pred"), "n")


@query(f"WITH {{V}}, {_FALLBACK} SELECT round(avg(CAST(level = acuity AS INT)), 6) AS accuracy, count(*) AS n FROM scored")
def eval_accuracy(spark, sf):
    return evaluate.accuracy(_predicted(spark, sf))


@query(f"WITH {{V}}, {_FALLBACK}, {_PER} SELECT level, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def eval_per_class(spark, sf):
    c = evaluate.per_class(_predicted(spark, sf), [1, 2, 3, 4, 5])
    return c.select(big("level").alias("level"), *[big(x).alias(x) for x in ("tp", "fp", "fn", "support")], *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(f"""WITH {{V}}, {_FALLBACK}, {_PER} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def eval_macro_weighted(spark, sf):
    return evaluate.averages(evaluate.per_class(_predicted(spark, sf), [1, 2, 3, 4, 5]))


# ---------------------------------------------------------------- severity rules and fallback groups
_SEVERITY = "CASE " + " ".join(f"WHEN {_any(words)} THEN {k}" for k, _, words, _ in severity.SEVERITY) + " ELSE 3 END"


@query(f"WITH {{V}} SELECT stay_id, CAST({_SEVERITY} AS BIGINT) AS severity FROM visits")
def severity_keywords(spark, sf):
    return visits(spark, sf).select("stay_id", big(severity.severity_by_keywords(F.col("chiefcomplaint"))).alias("severity"))


@query("""WITH g AS (SELECT vec_id, label, CASE WHEN label IN (2, 16) THEN 1 WHEN label = 5 THEN 2 WHEN label = 6 THEN 3 WHEN label = 11 THEN 4 WHEN label IN (7, 8) THEN 5 WHEN label = 0 THEN 6 ELSE 7 END AS group_id FROM embeddings)
SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS n, count(DISTINCT label) AS n_clusters FROM g GROUP BY 1""")
def fallback_groups(spark, sf):
    g = load(spark, sf, "embeddings").withColumn("g", severity.fallback_group(F.col("label")))
    return g.groupBy(big("g.group_id").alias("group_id")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_clusters"))


@query("""WITH {V}, c AS (SELECT CAST(acuity AS BIGINT) AS cluster, chiefcomplaint AS text, count(*) AS frequency FROM visits WHERE chiefcomplaint IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, text) AS rn FROM c),
g AS (SELECT *, CASE WHEN cluster = 2 THEN 1 WHEN cluster = 5 THEN 2 ELSE 7 END AS group_id, row_number() OVER (PARTITION BY CASE WHEN cluster = 2 THEN 1 WHEN cluster = 5 THEN 2 ELSE 7 END ORDER BY cluster, rn) AS o FROM k WHERE rn <= 3)
SELECT CAST(group_id AS BIGINT) AS group_id, string_agg(text, '|' ORDER BY o) AS symptoms FROM g WHERE o <= 8 GROUP BY 1""")
def group_symptoms(spark, sf):
    texts = visits(spark, sf).where("chiefcomplaint is not null").groupBy(big("acuity").alias("cluster"), F.col("chiefcomplaint").alias("text")).agg(F.count("*").alias("frequency"))
    return severity.typical_symptoms(texts).select(big("group_id").alias("group_id"), F.array_join("typical_symptoms", "|").alias("symptoms"))


@query("WITH {V} SELECT count(*) AS n, abs(count(*) - 246943) <= 5000 AS valid FROM visits")
def training_rows_check(spark, sf):
    return severity.expected_rows(visits(spark, sf))


@query("SELECT event_id, CASE CAST(floor(hour(ts) / 6) AS INT) WHEN 0 THEN 'Limited staffing, patient may delay care' WHEN 1 THEN 'Normal staffing levels' WHEN 2 THEN 'Peak hours, higher volume' ELSE 'Higher acuity, weekend effects' END AS note FROM events")
def period_notes(spark, sf):
    return load(spark, sf, "events").select("event_id", rules.period_note(dates.period(F.col("ts"))).alias("note"))


@query("WITH {V}, n(level, name) AS (VALUES (1, 'Critical'), (2, 'Emergent'), (3, 'Urgent'), (4, 'Less Urgent'), (5, 'Non-urgent')) SELECT n.name, count(*) AS n FROM visits JOIN n ON acuity = n.level GROUP BY 1")
def level_names(spark, sf):
    x = visits(spark, sf).join(F.broadcast(rules.level_table(spark)), F.col("acuity") == F.col("level"))
    return x.groupBy("name").agg(F.count("*").alias("n"))


# What stands further up than the texts it is made of.
ORACLES["response_json"] = ORACLES["response_json"].replace("__FALLBACK__", _FALLBACK).replace("__NAMES__", " ".join(f"WHEN {i} THEN '{n}'" for i, n, _ in rules.LEVELS))
