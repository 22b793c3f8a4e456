"""Event sequences: windows of events, TF x sigmoid-IDF vectors, clustering and balanced samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


@dataclass
class Sampling:
    window: int = 20
    rate: float = 0.1
    candidates: int = 50
    threshold: float = 5.0
    seed: int = 42
    rounds: int = 200
    #: Points clustered on the driver at once, whatever the rate; all points are still assigned.
    most: int = 2000


def windows(events: DataFrame, length: int = 20) -> DataFrame:
    """(file, win, eids): tumbling windows of events in line order."""
    w = events.groupBy("file", F.floor(F.col("line_no") / length).alias("win")).agg(F.array_sort(F.collect_list(F.struct("line_no", "eid"))).alias("e"))
    return w.select("file", "win", F.col("e.eid").alias("eids"))


def term_counts(seqs: DataFrame) -> DataFrame:
    """(file, win, eid, tf) of the events that are not negative."""
    return seqs.select("file", "win", F.explode("eids").alias("eid")).where("eid >= 0").groupBy("file", "win", "eid").agg(F.count(F.lit(1)).alias("tf"))


def weights(counts: DataFrame, seqs: DataFrame) -> DataFrame:
    """(file, eid, idf, weight): weight is the logistic of idf less its mean over all ids up to the largest, unused ones as 0."""
    n = seqs.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("file", "eid").agg(F.count(F.lit(1)).alias("df")).join(n, "file")
    idf = df.withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)))
    mean = idf.groupBy("file").agg((F.sum("idf") / (F.max("eid") + 1)).alias("mean"))
    return idf.join(mean, "file").select("file", "eid", "idf", (1 / (1 + F.exp(F.col("mean") - F.col("idf")))).alias("weight"))


def vectors(seqs: DataFrame) -> DataFrame:
    """(file, win, eid, x): the non-zero coordinates of each window."""
    counts = term_counts(seqs)
    return counts.join(weights(counts, seqs), ["file", "eid"]).select("file", "win", "eid", (F.col("tf") * F.col("weight")).alias("x"))


def distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, d: s + d))


def nearest(points: DataFrame, centers: DataFrame, threshold: float) -> DataFrame:
    """points (id, v) with the nearest of few centres (c, center) closer than threshold, ties to the first.

    centers is the model (at most a few thousand rows), sent to every task."""
    known = centers.agg(F.sort_array(F.collect_list(F.struct("c", "center"))).alias("_known"))  # one row
    away = F.transform("_known", lambda k: F.struct(distance("v", k["center"]).alias("d"), k["c"].alias("c")))
    both = points.join(F.broadcast(known)).select("id", F.array_min(F.filter(away, lambda x: x["d"] < threshold)).alias("m"))
    return both.where("m is not null").select("id", F.col("m.c").alias("c"), F.col("m.d").alias("d"))


def complete_linkage(x: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters by merging the closest pair (largest distance between members) while within threshold."""
    n = len(x)
    far = np.zeros((n, n))
    for i in range(0, n, 16):  # a few rows at a time: the differences of all would take the number of dimensions times as much
        far[i : i + 16] = np.sqrt(((x[i : i + 16, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    far[np.tril_indices(n)] = np.inf
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    while len(members) > 1:
        i, j = np.unravel_index(np.argmin(far), far.shape)
        if not far[i, j] <= threshold:
            break
        rows = lambda k: np.where(np.arange(n) < k, far[:, k], far[k, :])
        both = np.maximum(rows(i), rows(j))
        both[[i, j]] = np.inf
        members[i] += members.pop(j)
        far[j, :] = far[:, j] = np.inf
        far[:i, i], far[i, i + 1 :] = both[:i], both[i + 1 :]
    return sorted(members.values(), key=lambda m: (-len(m), m[0]))


def cluster(points: DataFrame, options: Sampling) -> tuple[DataFrame, DataFrame | None]:
    """(assigned (id, c), centers): samples of bounded size are clustered on the driver, the rest is
    assigned to the nearest centre in parallel; rounds go on while more than a sample is left."""
    spark, centers, left, n = points.sparkSession, [], points, points.count()
    size = min(max(int(n * options.rate), options.candidates), n, options.most)
    table, idle = None, 0
    while idle <= options.rounds:
        rest = left.count()
        if rest <= max(size, 1):
            break
        sample = left.orderBy(F.xxhash64(F.lit(options.seed + len(centers) + idle), "id")).limit(size).collect()
        x = np.array([r["v"] for r in sample], float)
        new = [x[m].mean(axis=0) for m in complete_linkage(x, options.threshold) if len(m) >= 3]
        if not new:
            idle += 1
            continue
        centers += new
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "c int, center array<double>")
        found = nearest(points, table, options.threshold)
        after = points.join(found, "id", "left_anti")
        idle += after.count() == rest
        left = after
    if table is None:
        return spark.createDataFrame([], "id long, c int"), None
    return nearest(points, table, options.threshold).select("id", "c"), table


def balanced(assigned: DataFrame, options: Sampling) -> DataFrame:
    """ceil(candidates / clusters) ids of each cluster, at random but repeatable."""
    k = max(1, assigned.select("c").distinct().count())
    w = Window.partitionBy("c").orderBy(F.xxhash64(F.lit(options.seed), "id"), "id")
    return assigned.withColumn("i", F.row_number().over(w)).where(F.col("i") <= -(-options.candidates // k)).select("id", "c")


def dense(seqs: DataFrame) -> DataFrame:
    """points (id, v, file, win) of one file's windows: a coordinate per event id up to the largest; ids number the windows."""
    cells = vectors(seqs)
    width = cells.agg(F.max("eid")).first()[0]
    slots = F.sequence(F.lit(0), F.lit(int(width or 0)))
    own = cells.groupBy("file", "win").agg(F.map_from_entries(F.collect_list(F.struct("eid", "x"))).alias("m"))
    every = seqs.select("file", "win").join(own, ["file", "win"], "left")
    at = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))
    v = F.when(F.col("m").isNull(), F.transform(slots, lambda i: F.lit(0.0))).otherwise(F.transform(slots, at))
    return every.select(F.col("win").alias("id"), v.alias("v"), "file", "win")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sample(events: DataFrame, options: Sampling) -> DataFrame:
    """(win, c): a balanced sample of the windows of one file's events (file, line_no, eid), c the cluster.

    Without any cluster, one window at random but repeatable, its c null."""
    seqs = _written(windows(events, options.window), "windows")
    points = _written(dense(seqs), "points")  # every round of clustering reads them
    assigned, centers = cluster(points.select("id", "v"), options)
    if centers is None:
        one = points.orderBy(F.xxhash64(F.lit(options.seed), "id"), "id").limit(1)
        return one.select("win", F.lit(None).cast("int").alias("c"))
    return balanced(assigned, options).select(F.col("id").alias("win"), "c")
