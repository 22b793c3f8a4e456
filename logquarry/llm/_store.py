"""Tables in the folder that the driver and all executors share, to cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local: list[str] = []


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="logquarry-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as a shared table and read back: later steps never compute it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, what is written sends its rows to Python workers by so many at most.

    An executor's JVM holds up to three times the bytes of a batch for each task, the worker up to twice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    if not 0 < int(kept) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def few(keys: DataFrame, most: int = 250_000) -> DataFrame:
    """A written table of keys, marked for broadcast if it has at most so many rows: then what it joins is not shuffled."""
    return F.broadcast(keys) if keys.count() <= most else keys


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def private(docs: DataFrame, n: int) -> list[str]:
    """n column names that docs does not have, whatever the case."""
    taken, out, i = {c.lower() for c in docs.columns}, [], 0
    while len(out) < n:
        if f"_p{i}" not in taken:
            out.append(f"_p{i}")
        i += 1
    return out


def key_of(doc_id: str) -> Column:
    """The id as a join key: null is the smallest."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a join key per distinct row: _d (id, null as the smallest) and _t (text hash)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        key_of("doc_id").alias("_d"),
    ).withColumn("_t", F.xxhash64("text"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
