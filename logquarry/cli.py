"""python -m logquarry [compress|decompress|list|test] ...: archives of log files."""

from __future__ import annotations

import argparse
import sys

from . import __doc__ as about


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logquarry", description=about)
    p.add_argument("command", choices=["compress", "c", "decompress", "d", "list", "l", "test", "t"])
    p.add_argument("paths", nargs="+")
    p.add_argument("-o", "--output", help="archive or folder to write; default: the input with or without .quarry")
    p.add_argument("-c", "--stdout", action="store_true", help="decompress to standard output")
    p.add_argument("-k", "--keep", action="store_true", default=True, help="keep the input (always)")
    p.add_argument("-f", "--force", action="store_true", help="overwrite the output")
    p.add_argument("-r", "--recursive", action="store_true", help="look into folders below")
    p.add_argument("--level", type=int, default=6, help="compression level, 1 to 9")
    p.add_argument("--backend", default="zstd", help="zstd, gzip or none")
    p.add_argument("--no-backend", action="store_true")
    p.add_argument("--chunk-lines", type=int, default=100_000)
    p.add_argument("--window", type=int, default=20)
    p.add_argument("--container", action="store_true", help="write byte containers, a blob per chunk, instead of tables")
    p.add_argument("-j", "--jobs", type=int, default=0, help="partitions of a shuffle; default: the session's")
    p.add_argument("--verify", action="store_true", default=True, help="read the archive back (the default)")
    p.add_argument("--no-verify", action="store_true", help="do not read the archive back")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--version", action="version", version="logquarry 0.1")
    return p


def options(argv: list[str] | None = None) -> argparse.Namespace:
    o = parser().parse_args(argv)
    o.level = min(9, max(1, o.level))
    o.chunk_lines, o.window = max(100, o.chunk_lines), max(2, o.window)
    o.backend = "none" if o.no_backend else o.backend
    o.command = {"c": "compress", "d": "decompress", "l": "list", "t": "test"}.get(o.command, o.command)
    return o


def _tables(spark, path: str) -> bool:
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(of(f"{path}/entries"))


def _listing(spark, path: str):
    """(file, n_lines, n_bytes) of an archive, in order of the files."""
    from pyspark.sql import functions as F

    from .sources import archive, container

    if _tables(spark, path):
        rows = archive.listing(archive.open_tables(spark, path))
    else:
        rows = container.listing(container.read(spark, path)).groupBy("file").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))
    return rows.orderBy("file")


def _damaged(spark, path: str, lines=None) -> list[str]:
    """Files that an archive of tables does not restore as recorded; of containers, which raise when a
    checksum differs, those whose lines are not those given, or not as many as recorded."""
    from pyspark.sql import functions as F

    from .sources import archive, container

    if _tables(spark, path):
        return [r["file"] for r in archive.verify(archive.open_tables(spark, path)).where("not ok").orderBy("file").collect()]
    of = lambda df: df.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(archive._line_crc()).alias("c"))
    back = of(archive.open_lines(spark, path))
    if lines is None:
        known = container.listing(container.read(spark, path)).groupBy("file").agg(F.sum("n_lines").alias("n"))
        bad = known.join(back.drop("c"), ["file", "n"], "left_anti")
    else:
        bad = of(lines).join(back, ["file", "n", "c"], "left_anti")
    return [r["file"] for r in bad.select("file").orderBy("file").collect()]


def main(argv: list[str] | None = None, spark=None) -> int:
    o = options(argv)
    from pyspark.sql import SparkSession

    from .sources import archive, container, files

    spark = spark or SparkSession.builder.appName("logquarry").getOrCreate()
    say = (lambda *a: None) if o.quiet else (lambda *a: print(*a, file=sys.stderr))
    if o.jobs > 0:
        spark.conf.set("spark.sql.shuffle.partitions", str(o.jobs))
    try:
        paths = [(p, p) for p in o.paths]
        if o.command != "compress":  # a folder of archives stands for all of them, in order of their names
            paths = [(p, a) for p in o.paths for a in archive.find(spark, p)]
        for given, path in paths:
            if o.command == "compress":
                to = o.output or path.rstrip("/") + ".quarry"
                lines = files.read_lines(spark, path, o.recursive)
                if o.container:
                    container.write(lines, to, o.backend, o.level, o.chunk_lines, overwrite=o.force, window=o.window)
                else:
                    archive.write(lines, to, o.backend, o.level, o.chunk_lines, o.force)
                if not o.no_verify and (bad := _damaged(spark, to, lines)):
                    raise RuntimeError(f"{to} does not restore {bad[0]}")
                if o.verbose:
                    for r in _listing(spark, to).toLocalIterator():
                        say(f"{r['file']}  {r['n_lines']} lines  {r['n_bytes']} bytes")
            elif o.command == "decompress" and o.stdout:
                for r in archive.open_lines(spark, path).orderBy("file", "line_no").toLocalIterator():
                    sys.stdout.write(r["raw"] + "\n")
            elif o.command == "decompress":
                to = o.output or given.removesuffix(".quarry") + ".lines"
                if path != given:
                    to += "/" + path.rstrip("/").rpartition("/")[2].removesuffix(".quarry")
                archive.to_text(archive.open_lines(spark, path), to, o.force)
                if o.verbose:
                    say(f"{path} -> {to}")
            elif o.command == "list":
                for r in _listing(spark, path).toLocalIterator():
                    print(f"{r['file']}  {r['n_lines']} lines  {r['n_bytes']} bytes")
            else:
                n, bad = _listing(spark, path).count(), _damaged(spark, path)
                say(f"{n} entries, {len(bad)} damaged")
                if bad:
                    return 1
    except Exception as e:  # noqa: BLE001
        print(f"logquarry: {e}".splitlines()[0], file=sys.stderr)
        return 1
    return 0
