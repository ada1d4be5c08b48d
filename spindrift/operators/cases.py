"""The case index: prepared cases, what they were scaled with, their vectors and postings, saved and loaded together."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text, vec
from spindrift.operators import ml, profile, relational, retrieval
from spindrift.sources.tables import saved

#: The numbers of a case, in order; each is followed, after all of them, by whether it was missing.
NUMBERS = ("age_at_visit", "temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain")


@dataclass(frozen=True)
class Weights:
    """How much texts count against numbers in a vector, and words against vectors in a mixed list."""

    text: float = 0.7
    numbers: float = 0.3
    words: float = 0.3
    vectors: float = 0.7


def prepared(cases: DataFrame, medians: dict[str, float] | None = None, numbers: tuple[str, ...] = NUMBERS) -> tuple[DataFrame, dict[str, float]]:
    """``cases`` with the array ``numbers``: each number as such or its median, then for each 1.0 if it was missing; and the medians.

    What is no number counts as missing, a column that isn't there as missing in all rows; the median of nothing is 0.
    Queries are prepared with the medians of the index.
    """
    cast = cases.withColumns({c: F.col(c).try_cast("double") if c in cases.columns else F.lit(None).cast("double") for c in numbers})
    if medians is None:
        medians = {c: q[0] or 0.0 for c, q in profile.quantiles_of(cast, dict.fromkeys(numbers, [0.5])).items()}
    filled = [F.coalesce(F.col(c), F.lit(float(medians[c]))) for c in numbers]
    return cast.withColumn("numbers", F.array(*filled, *[F.col(c).isNull().cast("double") for c in numbers])), medians


@dataclass(frozen=True)
class CaseIndex:
    """``cases`` (``id, description, unit``), ``postings`` and ``lengths`` of their words, and what queries are prepared with."""

    cases: DataFrame
    postings: DataFrame
    lengths: DataFrame
    medians: dict[str, float]
    means: list[float]
    deviations: list[float]
    weights: Weights = Weights()

    def with_weights(self, **changed: float) -> CaseIndex:
        """The index with other weights between words and vectors; those inside its vectors are fixed when it is built."""
        if {"text", "numbers"} & changed.keys():
            raise ValueError("vectors hold these weights; build the index anew")
        return replace(self, weights=replace(self.weights, **changed))

    def vectors(self, rows: DataFrame, embedding: str) -> DataFrame:
        """``rows`` with ``unit``: embedding and scaled numbers, weighted, of length one."""
        done, _ = prepared(rows, self.medians, tuple(self.medians))
        return done.withColumn("unit", _unit(F.col(embedding), self.means, self.deviations, self.weights))

    def status(self) -> DataFrame:
        """One row: ``initialized, total_cases, feature_dimension``."""
        return self.cases.agg(F.lit(True).alias("initialized"), F.count("*").alias("total_cases"), F.coalesce(F.max(F.size("unit")), F.lit(0)).cast("long").alias("feature_dimension"))

    def retrieve(self, queries: DataFrame, k: int = 5, use_hybrid: bool = False, reranker=None) -> DataFrame:  # noqa: ANN001
        """The ``k`` nearest cases of each query (``query_id, unit, description``): by vectors, mixed with words, or scored anew."""
        wide = 2 * k
        near = retrieval.knn(queries.select("query_id", "unit"), self.cases.select("id", "unit"), wide)
        if use_hybrid:
            asked = queries.select("query_id", F.explode(text.tokens(F.col("description"))).alias("term"))
            found = retrieval.fuse(retrieval.bm25(asked, self.postings, self.lengths, wide), near, wide if reranker else k, self.weights.words, self.weights.vectors)
        else:
            found = near.where(F.col("rank") <= (wide if reranker else k))
        if reranker is None:
            return found
        texts = found.join(queries.select("query_id", F.col("description").alias("query_text")), "query_id").join(self.cases.select("id", F.col("description").alias("text")), "id")
        return retrieval.rerank(texts.drop("score", "rank"), reranker, k).withColumn("rank", F.col("rn").cast("long")).select("query_id", "id", "score", "rank")

    def save(self, root: str, digest: str = "") -> str:
        """The index as a new version below ``root``; its tables and parameters are written first, and then the one row that makes it the latest.

        Who loads meanwhile gets the former version whole; versions stay until ``prune``. Returns the version.
        """
        spark = self.cases.sparkSession
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        at = f"{root}/versions/{version}"
        for name in ("cases", "postings", "lengths"):
            getattr(self, name).write.parquet(f"{at}/{name}")
        w = self.weights
        row = (dict(self.medians), list(self.means), list(self.deviations), [w.text, w.numbers, w.words, w.vectors], list(self.medians), spark.read.parquet(f"{at}/cases").count(), digest)
        spark.createDataFrame([row], "medians map<string,double>, means array<double>, deviations array<double>, weights array<double>, numbers array<string>, n long, digest string").coalesce(1).write.parquet(f"{at}/parameters")
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/latest")
        return version


def _unit(embedding: Column, means: list[float], deviations: list[float], w: Weights) -> Column:
    scaled = F.transform(F.col("numbers"), lambda x, i: (x - F.get(F.array(*map(F.lit, means)), i)) / F.get(F.array(*map(F.lit, deviations)), i))
    return vec.unit(F.concat(F.transform(vec.doubles(embedding), lambda x: x * w.text), F.transform(scaled, lambda x: x * w.numbers)))


def build(cases: DataFrame, key: str, embedding: str, description: str, numbers: tuple[str, ...] = NUMBERS, weights: Weights = Weights()) -> CaseIndex:
    """An index of ``cases``: ``key``, the text ``description``, its ``embedding`` and the ``numbers``.

    A number that doesn't vary is divided by 1. Cases without an embedding have no unit and are found by their words alone.
    """
    done, medians = prepared(cases, None, numbers)
    n = 2 * len(numbers)
    row = done.agg(*[f(F.get("numbers", F.lit(i))).alias(f"{name}{i}") for i in range(n) for name, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    means, deviations = [row[f"m{i}"] or 0.0 for i in range(n)], [row[f"d{i}"] or 1.0 for i in range(n)]
    table = done.select(F.col(key).alias("id"), F.col(description).alias("description"), _unit(F.col(embedding), means, deviations, weights).alias("unit"), vec.doubles(F.col(embedding)).alias("embedding"))
    tf, lengths = retrieval.postings(done, key, text.tokens(F.col(description)))
    return CaseIndex(table, tf, lengths, medians, means, deviations, weights)


def fingerprint(cases: DataFrame, columns: list[str], options: object) -> str:
    """A digest of the rows' ``columns`` in any order, and of ``options``: the number of rows and sums of two hashes of each, so repeated rows count.

    Null and empty differ, and so do equal values in different columns. A column that isn't there counts as null.
    """
    cells = [x for c in columns for x in ((F.col(c).isNull(), F.col(c)) if c in cases.columns else (F.lit(True), F.lit(None).cast("string")))]
    sums = [F.sum(F.xxhash64(*cells, F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    row = cases.agg(F.count("*").alias("n"), *sums).first()
    return hashlib.sha256(repr((columns, options, row["n"], str(row["s0"]), str(row["s1"]))).encode()).hexdigest()


def latest(spark: SparkSession, root: str) -> str | None:
    """The folder of the version saved last below ``root``; null without one."""
    try:
        found = spark.read.schema("version string").parquet(f"{root}/latest").agg(F.max("version").alias("v")).first()["v"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found and f"{root}/versions/{found}"


def prune(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes versions but the ``keep`` saved last; for a time when nobody reads older ones. Returns what is gone."""
    rows = spark.read.schema("version string").parquet(f"{root}/latest").select("version").distinct().orderBy(F.desc("version")).collect()
    gone = [r["version"] for r in rows[max(1, keep) :]]
    for version in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def _load(spark: SparkSession, at: str) -> CaseIndex:
    p = spark.read.parquet(f"{at}/parameters").first()
    tables = [spark.read.parquet(f"{at}/{name}") for name in ("cases", "postings", "lengths")]
    return CaseIndex(*tables, {c: p["medians"][c] for c in p["numbers"]}, list(p["means"]), list(p["deviations"]), Weights(*p["weights"]))


def load(spark: SparkSession, root: str) -> CaseIndex:
    """The version saved last."""
    at = latest(spark, root)
    if at is None:
        raise FileNotFoundError(f"no index below {root}")
    return _load(spark, at)


def build_or_load(cases: DataFrame, key: str, embedding: str, description: str, root: str, rebuild: bool = False, check: str = "exact", encoder=None, encoder_name: str = "", **options) -> CaseIndex:  # noqa: ANN001, ANN003
    """The index below ``root`` if it is of these cases and options, else one that is built and saved there as a new version.

    ``exact`` compares digests of all rows' key, description, numbers and embedding and of the options. ``overlap`` is content with about as many cases, of whose
    first keys four fifths agree (``relational.overlap``), and with equal weights. With ``encoder`` (texts to vectors), cases have no column ``embedding`` yet: texts that the former
    version holds, encoded under the same ``encoder_name``, keep their vectors, and only the others are encoded.
    """
    spark = cases.sparkSession
    numbers, weights = tuple(options.get("numbers", NUMBERS)), options.get("weights", Weights())
    columns = [key, description, *([] if encoder else [embedding]), *numbers]
    settings = (key, description, weights.text, weights.numbers, encoder_name if encoder else None)
    digest = fingerprint(cases, columns, settings)
    at = None if rebuild else latest(spark, root)
    if at is not None:
        known = spark.read.parquet(f"{at}/parameters").first()
        same = known["digest"].split("|")[0] == digest
        if not same and check == "overlap" and Weights(*known["weights"]).text == weights.text and Weights(*known["weights"]).numbers == weights.numbers:
            same = relational.overlap(cases.select(F.col(key).alias("id")), spark.read.parquet(f"{at}/cases"), "id").first()["valid"]
        if same:
            found = _load(spark, at)
            return replace(found, weights=replace(weights, text=found.weights.text, numbers=found.weights.numbers))
    if encoder:
        cases = _encoded(cases, embedding, description, encoder, at if at is not None and known["digest"].partition("|")[2] == encoder_name else None)
    build(cases, key, embedding, description, **options).save(root, f"{digest}|{encoder_name}")
    return load(spark, root)


def _encoded(cases: DataFrame, embedding: str, description: str, encoder, at: str | None) -> DataFrame:  # noqa: ANN001
    """``cases`` with ``embedding``: as the version ``at`` has it for the same text, else from ``encoder``, once a text."""
    texts = cases.where(F.col(description).isNotNull()).select(F.col(description).alias("_text")).distinct()
    if at is not None:
        old = cases.sparkSession.read.parquet(f"{at}/cases").where("description is not null and embedding is not null").groupBy(F.col("description").alias("_text")).agg(F.first("embedding").alias("_e"))
        known = texts.join(old, "_text")
        texts = texts.join(old, "_text", "left_anti")
    fresh = ml.embed(texts, "_text", encoder, "_e").select("_text", vec.doubles(F.col("_e")).alias("_e"))
    every = saved(fresh if at is None else known.unionByName(fresh), "case-embeddings")
    return cases.drop(embedding).join(every, F.col(description) == F.col("_text"), "left").withColumn(embedding, F.col("_e")).drop("_text", "_e")


def quick_retrieve(queries: DataFrame, cases: DataFrame, key: str, embedding: str, description: str, root: str, k: int = 5, build_options: dict | None = None, **options) -> DataFrame:  # noqa: ANN003
    """The ``k`` nearest ``cases`` of each of ``queries`` (``query_id``, and the columns of a case) in one call; ``build_options`` go to ``build_or_load``."""
    index = build_or_load(cases, key, embedding, description, root, **(build_options or {}))
    return index.retrieve(index.vectors(queries, embedding).withColumn("description", F.col(description)), k, **options)
