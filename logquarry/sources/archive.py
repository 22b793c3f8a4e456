"""Columnar log archives: a directory of Parquet tables that restores every line exactly.

    entries         one row per file: lines, bytes, sum of crc32 over lines with their numbers, chunks, size of a chunk
    header_schema   inferred header fields        templates   event templates in use
    column_profile  statistics and encoding       dictionaries   values by code
    lines           header and variables of matched lines, sorted by file, chunk, template
    failed          lines kept verbatim: `load` (too few tokens), `match` (no exact template)

Lines with equal templates lie together, so Parquet's own dictionary, delta and page
encodings work on columns of one meaning.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining, profile

CODECS = {"zstd": "zstd", "gzip": "gzip", "none": "uncompressed"}
TABLES = ("entries", "header_schema", "templates", "column_profile", "dictionaries", "lines", "failed")


class UnsupportedBackend(ValueError):
    """A compression backend that this engine does not have."""


def codec(backend: str) -> str:
    if backend == "lzma":
        raise UnsupportedBackend("lzma is not available for archives; use zstd, gzip or none")
    if backend not in CODECS:
        raise UnsupportedBackend(f"unknown backend {backend!r}; use one of {', '.join(CODECS)}")
    return CODECS[backend]


def _line_crc():
    """Of a line and its number, so that lines that change places change the sum."""
    return F.crc32(F.concat(F.col("line_no").cast("string"), F.lit(":"), F.col("raw")))


def chunk_of(line_no, chunk_lines: int):
    return F.floor(line_no / chunk_lines)


def tables(lines: DataFrame, chunk_lines: int = 100_000, options: dict | None = None) -> dict[str, DataFrame]:
    """The archive's tables, computed but not written."""
    model = mining.train(lines, **(options or {}))
    matched = mining.gated(mining.match(lines, model)).withColumn("chunk", chunk_of(F.col("line_no"), chunk_lines)).persist()
    good = matched.where("exact")
    columns = profile.long_columns(good.select("file", "line_no", "eid", "header", "vars"))
    profiles = profile.profile(columns)
    words = columns.join(profiles.where("encoding = 'dict'").select(*profile.KEY), profile.KEY, "left_semi")
    used = good.select("file", F.col("eid").alias("tid")).distinct()
    return {
        "entries": matched.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("raw") + 1).alias("n_bytes"), F.sum(_line_crc()).alias("checksum"), F.countDistinct("chunk").alias("n_chunks")).withColumn("chunk_lines", F.lit(chunk_lines)),
        "header_schema": profile.header_schema(lines),
        "templates": model.templates.join(used, ["file", "tid"], "left_semi"),
        "column_profile": profiles,
        "dictionaries": profile.dictionaries(words),
        "lines": good.select("file", "chunk", F.col("eid").alias("tid"), "line_no", "header", "vars"),
        "failed": matched.where("not exact").select("file", "chunk", "line_no", F.when(F.col("eid") < 0, "load").otherwise("match").alias("kind"), "raw"),
    }


def write(lines: DataFrame, path: str, backend: str = "zstd", level: int = 6, chunk_lines: int = 100_000, overwrite: bool = False, options: dict | None = None) -> None:
    compression = codec(backend)
    for name, df in tables(lines, chunk_lines, options).items():
        if name in ("lines", "failed"):
            df = df.repartitionByRange("file", "chunk", *(["tid"] if name == "lines" else [])).sortWithinPartitions("file", "chunk", *(["tid"] if name == "lines" else []), "line_no")
        writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression)
        if compression == "zstd":
            writer = writer.option("parquet.compression.codec.zstd.level", str(level))
        writer.parquet(f"{path}/{name}")


def open_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def restore(archive: dict[str, DataFrame]) -> DataFrame:
    """lines(file, line_no, raw) of the archive, those kept verbatim included."""
    templates = archive["templates"].withColumnRenamed("tokens", "template")
    good = archive["lines"].join(templates, ["file", "tid"]).select("file", "line_no", mining.rebuilt().alias("raw"))
    return good.unionByName(archive["failed"].select("file", "line_no", "raw"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return restore(open_tables(spark, path))


def find(spark: SparkSession, path: str) -> list[str]:
    """The archives at path: itself, or those of a folder (not of folders below), in order of their names."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    holds = lambda p: any(fs.exists(of(f"{p}/{x}")) for x in ("entries", "containers"))
    if holds(path) or not fs.getFileStatus(of(path)).isDirectory():
        return [path]
    inside = sorted(f.getPath().toString() for f in fs.listStatus(of(path)))
    return [p for p in inside if holds(p) or p.endswith(".logz")]


def open_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an archive of tables, a table of containers or a container file."""
    from . import container

    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(of(f"{path}/entries")):
        return read(spark, path)
    return container.decode(container.read(spark, path))


def listing(archive: dict[str, DataFrame]) -> DataFrame:
    return archive["entries"].select("file", "n_lines", "n_bytes", "n_chunks")


def verify(archive: dict[str, DataFrame]) -> DataFrame:
    """Per entry whether the restored lines have the recorded number, bytes and checksum."""
    now = restore(archive).groupBy("file").agg(F.count(F.lit(1)).alias("l"), F.sum(F.octet_length("raw") + 1).alias("b"), F.sum(_line_crc()).alias("c"))
    both = archive["entries"].join(now, "file", "left")
    return both.select("file", "n_lines", "n_bytes", "checksum", F.coalesce((F.col("l") == F.col("n_lines")) & (F.col("b") == F.col("n_bytes")) & (F.col("c") == F.col("checksum")), F.lit(False)).alias("ok"))


def common_folder(lines: DataFrame) -> str:
    """The deepest folder that holds all files, with its slash; empty if there is none."""
    low, high = lines.agg(F.min("file"), F.max("file")).first()
    if low is None:
        return ""
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[: low.rfind("/", 0, n if low != high else len(low)) + 1]


def entries(lines: DataFrame) -> DataFrame:
    """lines with entry: the file's path below the common folder."""
    return lines.withColumn("entry", F.coalesce(F.substring("file", len(common_folder(lines)) + 1, 2**31 - 1), F.lit("_")))


def to_text(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Every file below path, at its place under the common folder, its lines in order.

    Tasks write ranges of (entry, line number).  A file that lies in one range is moved to its
    name; one that spans several becomes a folder of that name with its ranges in order."""
    spark = lines.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(path)):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(fs_path(path), True)
    raw = f"{path}/_parts"
    ordered = entries(lines).repartitionByRange("entry", "line_no").sortWithinPartitions("entry", "line_no")
    ordered.select("entry", F.col("raw").alias("value")).write.partitionBy("entry").text(raw)
    for folder in fs.listStatus(fs_path(raw)):
        name = folder.getPath().getName()
        if not name.startswith("entry="):
            continue
        entry = unquote(name.removeprefix("entry="))
        parts = sorted(p.getPath().getName() for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-"))
        to = fs_path(f"{path}/{entry}")
        fs.mkdirs(to.getParent() if len(parts) == 1 else to)
        for p in parts:
            if not fs.rename(fs_path(folder.getPath(), p), to if len(parts) == 1 else fs_path(to, p)):
                raise OSError(f"{to} cannot be written")
    fs.delete(fs_path(raw), True)
