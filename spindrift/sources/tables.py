"""Files in and out: CSV with null tokens, atomic overwrites, latest pointers, checks of cached indexes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a CSV reader of the usual kind takes as null.
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, nulls: tuple[str, ...] = CSV_NULLS) -> DataFrame:
    """A CSV file with a header. All is read as text, and ``nulls`` become null. With a ``schema`` what can't be cast becomes null too; without, types are inferred (``inferred``)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is None:
        return typed(reader.csv(path), nulls=nulls)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = reader.schema(text).csv(path)
    return raw.select(*[(_kept(f.name, nulls) if isinstance(f.dataType, T.StringType) else _kept(f.name, nulls).try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def _kept(col: str, nulls: tuple[str, ...]) -> Column:
    return F.when(~F.col(f"`{col}`").isin(*nulls), F.col(f"`{col}`"))


# What a whole cell must look like. Digits may have a sign and spaces around them.
_WHOLE, _REAL = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE, _TRUE, _FALSE = r"(?i)^\s*[+-]?inf(inity)?\s*$", ("True", "TRUE", "true"), ("False", "FALSE", "false")


def inferred(raw: DataFrame, nulls: tuple[str, ...] = CSV_NULLS) -> DataFrame:
    """A row per text column of ``raw``: ``name, kind, n_null, n``, in one pass; ``kind`` is null, integer, real, boolean or text.

    The kinds are a lattice that rows are folded into, each task by itself: null is below all; integer below real, text above all. Whole numbers of 64 bits are integer, and real where
    nulls are among them; whole numbers beyond are text, unless a fraction or an exponent makes the column real anyway. Booleans without nulls are boolean, with nulls text; anything else mixed is text.
    """
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    aggs = []
    for i, c in enumerate(raw.columns):
        x = _kept(c, nulls)
        whole = x.rlike(_WHOLE)
        aggs += [F.count(x).alias(f"n{i}"), every(whole).alias(f"w{i}"), every(~whole | F.trim(x).try_cast("long").isNotNull()).alias(f"l{i}"), every(x.rlike(_REAL) | x.rlike(_INFINITE)).alias(f"r{i}"), every(x.isin(*_TRUE, *_FALSE)).alias(f"b{i}")]
    row = raw.agg(F.count("*").alias("n"), *aggs)

    def kind(i: int) -> Column:
        n, nulls_ = F.col(f"n{i}"), F.col("n") - F.col(f"n{i}")
        return (F.when(n == 0, "null").when(F.col(f"b{i}"), F.when(nulls_ == 0, "boolean").otherwise("text")).when(F.col(f"w{i}"), F.when(~F.col(f"l{i}"), "text").when(nulls_ == 0, "integer").otherwise("real"))
                .when(F.col(f"r{i}"), "real").otherwise("text"))

    cells = [F.struct(F.lit(c).alias("name"), kind(i).alias("kind"), (F.col("n") - F.col(f"n{i}")).alias("n_null"), F.col("n").alias("n")) for i, c in enumerate(raw.columns)]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*") if cells else row.select(F.lit("").alias("name"), F.lit("").alias("kind"), F.col("n").alias("n_null"), "n").limit(0)


def typed(raw: DataFrame, nulls: tuple[str, ...] = CSV_NULLS) -> DataFrame:
    """The text columns of ``raw`` in the types that are inferred: a null column becomes real, without values."""
    kinds = {r["name"]: r["kind"] for r in inferred(raw, nulls).collect()}  # a row a column
    made = []
    for c in raw.columns:
        x = _kept(c, nulls)
        if kinds[c] in ("integer", "null", "real"):
            sign = F.when(F.trim(x).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
            x = F.trim(x).try_cast("long") if kinds[c] == "integer" else F.when(x.rlike(_INFINITE), sign).otherwise(F.trim(x).try_cast("double"))
        elif kinds[c] == "boolean":
            x = x.isin(*_TRUE)
        made.append(x.alias(c))
    return raw.select(*made)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a table that ``df`` may itself be read from: written aside, then renamed; the former one stays as ``.before``."""
    spark = df.sparkSession
    jvm = spark._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.next", f"{path}.before"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.next")
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    fs.rename(new, at)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Without that setting a temporary folder is used in one process, and an error raised elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        scratch.local = root = getattr(scratch, "local", None) or "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return f"{root.rstrip('/')}/spindrift/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``: computed once, for later steps to read as often as they like, and safe from lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``saved`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is deleted when the query ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` with a hint to broadcast it if it has up to ``most`` rows; beyond, the join is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def latest_file(spark: SparkSession, pattern: str, by: str = "modificationTime") -> str | None:
    """The path of the latest file under ``pattern`` by time, or by name with ``by='path'``."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max_by("path", by).alias("p")).first()["p"]


def publish(df: DataFrame, root: str, stamp: str, note: dict[str, str] | None = None) -> str:
    """Writes a version below ``root`` and then a row of metadata that makes it the latest."""
    path = f"{root}/data/{stamp}"
    df.write.parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(stamp, path, note or {})], "stamp string, path string, note map<string,string>").write.mode("append").parquet(f"{root}/versions")
    return path


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The version that was published last."""
    path = spark.read.parquet(f"{root}/versions").agg(F.max_by("path", "stamp").alias("p")).first()["p"]
    return spark.read.parquet(path)


def resume_into(todo: DataFrame, path: str, key: str, work, waves: int = 16) -> int:  # noqa: ANN001
    """Brings the table at ``path`` up to ``work(rows still to do)`` for all rows of ``todo``; returns how many rows there were to do.

    Rows are dealt to ``waves`` by a hash of the key, and each wave is a partition of the table that is replaced as a whole when its work is done: what is finished stays if
    the job dies in a later one. A wave's results are kept in the shared folder before its partition is replaced by them and what it held before, so two runs at once may
    do work twice, but no key comes out twice. ``work`` keeps the column ``key``; rows whose key is null or repeated are worked on once, one row a key.
    """
    spark = todo.sparkSession
    wave = F.pmod(F.xxhash64(F.col(key)), F.lit(waves)).cast("int")
    known = _present(spark, path)
    rest = todo.where(F.col(key).isNotNull()).dropDuplicates([key])
    if known is not None:
        rest = rest.join(known.select(key).distinct(), key, "left_anti")
    rest = saved(rest.withColumn("_wave", wave), "resume-todo")
    sizes = {r["_wave"]: r["n"] for r in rest.groupBy("_wave").agg(F.count("*").alias("n")).collect()}  # a row a wave
    for w in sorted(sizes):
        made = saved(work(rest.where(F.col("_wave") == w).drop("_wave")).withColumn("wave", F.lit(w)), "resume-wave")
        before = _present(spark, path)
        if before is not None:
            kept = before.where(F.col("wave") == w).join(made.select(key).distinct(), key, "left_anti")
            made = saved(kept.select(*made.columns).unionByName(made), "resume-whole")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("wave").parquet(path)
    return sum(sizes.values())


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def resumed(spark: SparkSession, path: str) -> DataFrame:
    """What ``resume_into`` has finished so far."""
    return spark.read.parquet(path).drop("wave")


def examples(spark: SparkSession) -> DataFrame:
    """Sample requests as a constant table."""
    rows = [("chest pain", 65.0, "M", 110.0, 150.0, 90.0, 98.6, 94.0, 8.0), ("fever and cough", 30.0, "F", 95.0, 118.0, 76.0, 101.2, 97.0, 3.0), ("ankle injury", 22.0, "M", 78.0, 122.0, 80.0, 98.4, 99.0, 5.0)]
    return spark.createDataFrame(rows, "chief_complaint string, age double, gender string, heart_rate double, sbp double, dbp double, temperature double, o2sat double, pain double")
