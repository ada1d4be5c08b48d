"""What the operators of this folder share: table access, shared scratch tables, components."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_shipped: set[str] = set()
#: Rows and bytes of a batch that goes to Python, where the session leaves them at their defaults: whole texts are long, and each is in memory several times.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once in an application, wherever it is installed; batches of texts are made small."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    for name, usual, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, usual) in (usual, "64MB", "64m"):
            spark.conf.set(name, str(ours))
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    at = os.path.join(tempfile.mkdtemp(prefix="spindrift-"), "spindrift.zip")
    Path(at).write_bytes(packed.getvalue())
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; the package is sent along for operators in Python."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a temporary folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return made


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/spindrift/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and that table's path.

    Cuts the lineage, so a lost executor costs the tasks it ran and no more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept_table(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def table_bytes(docs: DataFrame) -> int:
    """The bytes of ``text`` in ``docs``."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def planned_bytes(docs: DataFrame) -> int:
    """About the bytes of ``docs`` as the planner knows them; where it doesn't, those of ``text``."""
    told = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 56 else table_bytes(docs)


def bucketed_table(df: DataFrame, key: str, tag: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder in ``buckets`` buckets, so that joins and groups by ``key`` don't send it again.

    With more buckets than shuffle partitions rows are first sent to their buckets, or each task would write a file for each of them.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(least, buckets), 100_000)
    if buckets > least:
        df = df.repartition(buckets, key)
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", scratch_path(spark, tag)).saveAsTable(name)
    return spark.table(name)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has the long columns ``a`` and ``b`` in either order; loops and
    repeats do no harm. Returns ``node, component`` (the smallest node
    reachable) for each node that has an edge to another. The number of edges
    never grows and O(log n) rounds are usual. Every neighbour list is only
    reduced to its minimum, with map-side combining, and joined back, so that a
    hub with a third of all edges is a skewed join that AQE splits. Each round is
    a table in the shared folder; the last but one is deleted.
    """
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(ordered, tag)
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after, new_path = written(small, tag)
        drop_path(spark, path)
        now, path = after, new_path
        seen = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _offset(made: DataFrame, out: str) -> DataFrame:
    """``made`` (a table, with ``_m`` from monotonically_increasing_id) with dense ids ``out`` from 0; a number per partition goes to the driver."""
    spark = made.sparkSession
    part = F.shiftrightunsigned("_m", 33).cast("int")
    counts = sorted((r["_p"], r["n"]) for r in made.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    found = spark.createDataFrame(starts, "_p int, _s long")
    return made.join(F.broadcast(found), part == F.col("_p")).withColumn(out, F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_s")


def in_order(df: DataFrame, keys: list, tag: str, out: str = "g") -> DataFrame:
    """``df`` with dense ids ``out`` from 0 in ascending order of ``keys``, null first: range partitions sorted by themselves and numbered by their counts."""
    return _offset(kept_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), tag), out)


def dense_names(df: DataFrame, tag: str, out: str = "name") -> DataFrame:
    """The distinct rows of ``df``, each with a dense id ``out`` from 0, in no order; equal rows are made one before they are sent."""
    return _offset(kept_table(df.distinct().withColumn("_m", F.monotonically_increasing_id()), tag), out)


def running_sums(df: DataFrame, keys: list[str], value: str, tag: str, out: str = "before") -> DataFrame:
    """``df`` with ``out``: the sum of the long ``value`` over all rows before, in ascending order of ``keys``.

    Sums run within sorted range partitions and start from what the partitions before add up to, so no task sees all rows.
    """
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            x = b.column(b.schema.names.index(value)).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(x)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums - x), pa.array(np.full(len(x), part, np.int32))], [*b.schema.names, "_r", "_p"])

    schema = T.StructType([*df.schema.fields, T.StructField("_r", T.LongType()), T.StructField("_p", T.IntegerType())])
    made = kept_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), tag)
    starts, at = [], 0
    for r in sorted(made.groupBy("_p").agg(F.sum(value).alias("n")).collect()):
        starts.append((r["_p"], at))
        at += r["n"]
    return made.join(F.broadcast(spark.createDataFrame(starts, "_p int, _s long")), "_p").withColumn(out, F.col("_s") + F.col("_r")).drop("_p", "_s", "_r")


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` with a hint to broadcast it if it has up to ``most`` rows; beyond, the join is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
