"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Each round points the larger neighbours (large star), then the smaller ones (small star)
    of every node at its least neighbour.  Stars are centred on ever smaller nodes, so the
    number of rounds is about the logarithm of the longest path.  Every round is written to
    the shared folder; ends when a round changes nothing."""
    spark = edges.sparkSession
    now = _store.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:  # each round but the last shortens the paths
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state:
            break
        state = sign
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b")))
        now = _store.written(small.distinct(), "edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(roots.join(now, roots["node"] == now["a"], "left_anti").select("node", F.col("node").alias("component")))
