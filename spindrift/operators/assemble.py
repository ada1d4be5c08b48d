"""The three pipelines: raw tables to a clean visit table, requests to answers, and evaluation with retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import clean, dates, parse, text
from spindrift.operators import cases, evaluate, ml, relational, retrieval, rules
from spindrift.sources import requests, tables

REQUIRED = ("age_at_visit", "temperature", "heartrate", "sbp", "o2sat", "chiefcomplaint", "acuity")


def visit_table(triage: DataFrame, stays: DataFrame, patients: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Triage joined with stays (two keys) and patients, ages derived, every column cleaned, repeats and incomplete rows dropped.

    A stay or patient that occurs more than once counts with its greatest ``intime`` or ``anchor_year``, so no visit is multiplied.
    """
    stays = relational.keep_last(stays.select("stay_id", "subject_id", "intime", "outtime", "arrival_transport", "disposition").withColumn("_o", F.col("intime").cast("string")), ["stay_id", "subject_id"], "_o").drop("_o")
    patients = relational.keep_last(patients.select("subject_id", "anchor_age", "anchor_year", "gender").withColumn("_o", F.col("anchor_year")), ["subject_id"], "_o").drop("_o")
    joined = triage.join(stays, ["stay_id", "subject_id"], "left").join(patients, "subject_id", "left")
    joined = joined.withColumn("intime", F.col("intime").try_cast("timestamp_ntz")).withColumn("age_at_visit", dates.age_at(F.col("anchor_age"), F.col("anchor_year"), F.col("intime")))
    out = joined.withColumns({c: clean.in_range(F.col(c).cast("string"), lo, hi) for c, (lo, hi) in clean.CLEAN_RANGES.items()})
    out = out.withColumns({"gender": clean.gender(F.col("gender")), "chiefcomplaint": clean.without_null_tokens(F.col("chiefcomplaint")), "arrival_transport": clean.transport(F.col("arrival_transport"))})
    out = out.withColumn("chiefcomplaint_clean", text.normalize(F.col("chiefcomplaint"))).withColumn("time_period", dates.period(F.col("intime")))
    return out.drop("anchor_age", "anchor_year").distinct().na.drop(subset=list(required))


def answers(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON requests to JSON responses by the rules: the fallback level where a request is valid, else what it lacks."""
    r = requests.parse_requests(bodies, body)
    level = rules.fallback(*map(F.col, ("chief_complaint", "heart_rate", "sbp", "temperature", "o2sat", "pain", "age")))
    scored = r.withColumn("_f", level).withColumn("level", F.when(F.col("valid"), F.col("_f.level"))).withColumn("confidence", F.when(F.col("valid"), F.col("_f.confidence")))
    return requests.responses(scored.withColumn("reasons", F.when(F.col("valid"), F.array(rules.level_name(F.col("level")))).otherwise(F.transform("missing", lambda m: F.concat(F.lit("missing: "), m))))).drop("_f")


def judged(known: DataFrame, queries: DataFrame, client: Callable[[str], str], k: int = 5, levels: tuple[int, ...] = (1, 2, 3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """Queries judged by a language model that is shown similar cases; predictions and the per-level report.

    ``known``: ``id, unit, description, acuity``; ``queries``: ``query_id, unit, description, acuity``. The label of a query
    is never part of its prompt. Calls that fail have a status and no prediction, and are left out of the report.
    """
    near = retrieval.knn(queries.select("query_id", "unit"), known.select("id", "unit"), k).join(known.select("id", F.concat_ws("\n", "description", F.concat(F.lit("ESI "), F.col("acuity").cast("string"))).alias("case")), "id")
    shown = near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "case"))), lambda s: s["case"]), "\n\n").alias("cases"))
    asked = queries.join(shown, "query_id", "left").withColumn("prompt", F.concat(F.coalesce(F.concat("cases", F.lit("\n\n")), F.lit("")), text.prompt(F.col("description"))))
    told = ml.with_language_model(asked.select("query_id", "acuity", "prompt"), "prompt", client)
    predictions = told.select("query_id", "acuity", F.when(F.col("status") == "ok", parse.level(F.col("reply"))).alias("level"), "status")
    report = evaluate.per_class(evaluate.confusion(predictions.where("level is not null"), "acuity", "level"), list(levels))
    return predictions, report


# The ways of retrieving that are compared.
CONFIGS = {"vector_only": (False, False), "hybrid_only": (True, False), "hybrid_rerank": (True, True)}


def judged_configs(index: cases.CaseIndex, labels: DataFrame, queries: DataFrame, client: Callable[[str], str], reranker=None, k: int = 5, fallback: int = 3, configs: dict[str, tuple[bool, bool]] = CONFIGS) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Queries judged under each configuration of retrieval: predictions, and per ``config`` its accuracy.

    ``labels``: ``id, acuity`` of the index's cases; ``queries``: ``query_id, unit, description, acuity``. A call that fails counts as
    an error and as ``fallback``. Without ``reranker`` a configuration that asks for one is the same without it.
    """
    asked = None
    for name, (hybrid, again) in configs.items():
        near = index.retrieve(queries, k, hybrid, reranker if again else None)
        shown = near.join(index.cases.select("id", "description").join(labels, "id").select("id", F.concat_ws("\n", "description", F.concat(F.lit("ESI "), F.col("acuity").cast("string"))).alias("case")), "id")
        lists = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "case"))), lambda s: s["case"]), "\n\n").alias("cases"))
        part = queries.select("query_id", "description", "acuity").join(lists, "query_id", "left").withColumn("config", F.lit(name))
        asked = part if asked is None else asked.unionByName(part)
    asked = asked.withColumn("prompt", F.concat(F.coalesce(F.concat("cases", F.lit("\n\n")), F.lit("")), text.prompt(F.col("description"))))
    told = ml.with_language_model(asked.select("config", "query_id", "acuity", "prompt"), "prompt", client)
    failed = (F.col("status") != "ok") | parse.level(F.col("reply")).isNull()
    predictions = told.select("config", "query_id", "acuity", F.when(failed, F.lit(fallback)).otherwise(parse.level(F.col("reply"))).alias("level"), failed.cast("int").alias("error"))
    report = predictions.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg((F.col("acuity") == F.col("level")).cast("double")), 6).alias("accuracy"), F.sum("error").alias("errors"))
    return predictions, report


def save_evaluation(report: DataFrame, per_class: DataFrame, path: str) -> None:
    """An evaluation's sinks below ``path``: the report as JSON lines, and the table per level as CSV."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/results")
    tables.write_csv(per_class.coalesce(1), f"{path}/performance_report")
