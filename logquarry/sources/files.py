"""Log files as lines(file, line_no, raw)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoLogFiles(Exception):
    """A directory without any log file."""


def read_lines(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Lines of a file, or of the *.log files of a directory, numbered from 0 within each file.

    Lines end with \\n; one \\r before it is dropped.  Numbers come from the splits of each file:
    only the line counts of the splits are summed up, no file has to pass through one task."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        reader = reader.option("pathGlobFilter", glob or "*.log")
    raw = reader.text(path)
    if not raw.inputFiles():
        raise NoLogFiles(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r\\z", "").alias("raw"))
    from pyspark.sql import Window

    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = splits.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")).select("file", "at", "first", "before")
    return rows.join(before, ["file", "at"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "raw")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local folder on a local master only."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        top = tempfile.gettempdir()
    return f"{top}/quarry-{name}-{uuid.uuid4().hex}"


def event_lines(events: DataFrame) -> DataFrame:
    """The events table rendered as log lines of one file, numbered by event."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.concat(F.lit("svc-"), F.col("user_id") % 7), F.col("event_id"), F.lit("user"), F.col("user_id"), F.lit("action"), F.col("event_type"), F.lit("value"), F.floor(F.col("value") * 100).cast("long"), F.lit("k"), F.get_json_object("props", "$.k"))
    return events.select(F.lit("events.log").alias("file"), F.col("event_id").alias("line_no"), line.alias("raw"))


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of each document's text, each document a file."""
    return documents.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "raw"))
