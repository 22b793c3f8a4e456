"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions only.

A line's key is the stripped, A-Z-lowered line; keys of `min_length` code points found in
`min_docs` documents or more are boilerplate, and stay only in the document with the largest
id that holds them.

Documents arrive in batches, largest ids first.  A batch is reduced to one row per key (its
documents there and its largest id) before any shuffle of rows, then merge-anti-joined with
the sorted runs: a key that no run holds has its largest document in this batch and enters
the batch's own run with it; a key that some run holds enters with its count alone.  When
`fanout` runs stand on a level they are merged to one run of the next, counts added.  The
runs' merge at the end yields the boilerplate keys.

Keys are compared by two independent 64-bit hashes.  Looking up the lines is salted: keys
held by more than one in `hot` of all (document, key) pairs, so at most `hot` keys, are
broadcast; the lines they match spread evenly over the join of the others.

A null or empty text is one empty line.  Rows that repeat count each as a document, and all
rows with the largest id keep the line.  A null id is the smallest.  An empty table yields
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n long, owner long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def _hashed(lines: Column, min_length: int) -> Column:
    """Of each line, (position, hash, hash) if its key is long enough."""
    found = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    long = F.filter(found, lambda x: F.length(x["key"]) >= min_length)
    return F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))


class Runs:
    """Sorted runs of (key hash, documents, largest document) on levels, in the shared folder."""

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _add(self, run: DataFrame, level: int) -> None:
        path = _store.scratch(self.spark, f"run{level}")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(merged(self._read(old)), level + 1)
            for p in old:
                _store.drop(self.spark, p)

    def all(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self._read(paths) if paths else None

    def take(self, batch: DataFrame) -> None:
        """Merge-anti-joins a batch of (h1, h2, n, owner) with the runs and adds its run."""
        held = self.all()
        if held is not None:
            keys = held.select("h1", "h2").hint("merge")
            fresh = batch.join(keys, ["h1", "h2"], "left_anti")
            again = batch.join(keys, ["h1", "h2"], "left_semi").withColumn("owner", F.lit(None).cast("long"))
            batch = fresh.unionByName(again)
        self._add(batch.select("h1", "h2", "n", "owner"), 0)


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))


def boilerplate(docs: DataFrame, min_length: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, n, owner) of every key in at least min_docs documents; docs: see keyed()."""
    spark = docs.sparkSession
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    runs = Runs(spark, fanout)
    if rows:
        low, high = low or 0, high or 0
        share = (F.lit(float(high)) - F.col("doc_id").cast("double")) * F.lit(batches / (high - low + 1))
        number = F.coalesce(F.least(F.floor(share), F.lit(batches - 1)), F.lit(batches - 1)).cast("int")
        keys = docs.select("_d", number.alias("batch"), F.explode(F.array_distinct(F.transform(_hashed(F.split("text", "\n", -1), min_length), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("k"))
        reduced = keys.groupBy("batch", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("owner"))
        path = _store.scratch(spark, "batches")
        reduced.write.partitionBy("batch").parquet(path)
        arrived = spark.read.schema(RUN + ", batch int").parquet(path)
        for b in range(batches):
            runs.take(arrived.where(F.col("batch") == b).drop("batch"))
        _store.drop(spark, path)
    held = runs.all()
    if held is None:
        return spark.createDataFrame([], RUN)
    return merged(held).where(F.col("n") >= min_docs)


def _places(docs: DataFrame, keys: DataFrame, min_length: int, hot: int) -> DataFrame:
    """(_d, _t, positions) of the lines to drop."""
    lines = docs.select("_d", "_t", F.explode(_hashed(F.split("text", "\n", -1), min_length)).alias("l")).select("_d", "_t", "l.pos", "l.h1", "l.h2")
    total = keys.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") > max(total / hot, 1000)
    top = F.broadcast(keys.where(many).select("h1", "h2", F.col("owner").alias("own1")))
    rest = keys.where(~many).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("owner").alias("own2"))
    seen = lines.join(top, ["h1", "h2"], "left")
    spread = seen.withColumn("k1", F.when(F.col("own1").isNull(), F.col("h1")).otherwise(F.xxhash64("_d", "_t", "pos"))).withColumn("k2", F.when(F.col("own1").isNull(), F.col("h2")).otherwise(F.lit(0)))
    found = spread.join(rest, ["k1", "k2"], "left").withColumn("owner", F.coalesce("own1", "own2"))
    return found.where(F.col("owner") != F.col("_d")).groupBy("_d", "_t").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def _deduped(docs: DataFrame, carried: list[str], min_length: int, min_docs: int, batches: int, fanout: int, hot: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, text and _o, a struct of the carried columns (and a filler)."""
    own = _store.keyed(docs)
    keys = _store.written(boilerplate(own, min_length, min_docs, batches, fanout), "boilerplate")
    drops = _places(own, keys, min_length, hot)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _store.key_of("doc_id").alias("_d"), F.struct(F.lit(0), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried))).alias("_o")).withColumn("_t", F.xxhash64("text"))
    none = F.array().cast("array<int>")
    both = own.join(drops, ["_d", "_t"], "left").select("doc_id", "_o", F.split("text", "\n", -1).alias("lines"), F.coalesce("drops", none).alias("drops"))
    begin = F.concat(F.array(F.lit(0)), F.transform("drops", lambda x: x + 1))
    end = F.concat(F.col("drops"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(F.col("lines"), a + 1, b - a)))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"), "_o")


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, hot: int = 2000) -> DataFrame:
    """doc_id, n_lines, n_dropped and text: each document without its boilerplate lines."""
    return _deduped(docs, [], min_length, min_docs, batches, fanout, hot).drop("_o")


def rewrite(docs: DataFrame, min_length: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, hot: int = 2000) -> DataFrame:
    """The documents with their texts deduplicated by line and n_chars to match, if they have it.

    A null text stays null."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = _deduped(docs, [*others, "text"], min_length, min_docs, batches, fanout, hot)
    was = F.col("_o")[f"c{len(others)}"]
    text = F.when(was.isNotNull(), F.col("text"))
    found = {c: F.col("_o")[f"c{i}"] for i, c in enumerate(others)} | {"text": text}
    if "n_chars" in docs.columns:
        found["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(found[c].alias(c) for c in docs.columns))
