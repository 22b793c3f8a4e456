"""Delimiter patterns: the longest common subsequence of a column's delimiter strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import delimiters, split_by


def common_subsequence(a: str, b: str) -> str:
    """A longest common subsequence; of several the one that prefers to shorten b, then a, from the end."""
    width = len(b) + 1
    best = [[0] * width for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        above, row = best[i - 1], best[i]
        for j, y in enumerate(b, 1):
            row[j] = above[j - 1] + 1 if x == y else max(above[j], row[j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def fold(skeletons: list[str]) -> str:
    """Ordered fold over a column; nothing once one delimiter or less is common to several rows."""
    if not skeletons:
        return ""
    common = skeletons[0]
    for s in skeletons[1:]:
        common = common_subsequence(common, s)
        if len(common) <= 1:
            return ""
    return common


def column_patterns(columns: DataFrame, key: list[str]) -> DataFrame:
    """(key, pattern) of every column.  Runs of equal skeletons fold to one, so only those travel:
    a column costs a task its changes of skeleton, not its rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy("line_no")
    marked = columns.withColumn("s", delimiters(F.col("value"))).withColumn("p", F.lag("s").over(w)).withColumn("i", F.row_number().over(w))
    runs = marked.where(F.col("p").isNull() | (F.col("p") != F.col("s")) | (F.col("i") == 2)).select(*key, "line_no", "s")
    fields = {f.name: f.dataType for f in columns.schema}
    schema = ", ".join(f"{k} {fields[k].simpleString()}" for k in key) + ", pattern string"

    def one(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*names, fold(pdf.sort_values("line_no")["s"].tolist())]], columns=[*key, "pattern"])

    return runs.groupBy(*key).applyInPandas(one, schema)


def splits(columns: DataFrame, pattern: str, key: list[str]) -> DataFrame:
    """Whether a literal pattern splits every row of a column into equally many parts, more than one."""
    n = F.size(F.filter(split_by(F.col("value"), pattern), lambda x: x != ""))
    return columns.groupBy(*key).agg(F.min(n).alias("low"), F.max(n).alias("high")).select(*key, ((F.col("low") == F.col("high")) & (F.col("low") > 1)).alias("splits"), F.col("low").alias("parts"))


def _parts():
    """Parts of a value between occurrences of its column's literal pattern, empty ones dropped."""
    own = F.split(F.col("value"), F.concat(F.lit("\\Q"), F.col("pattern"), F.lit("\\E")), F.lit(-1))
    return F.filter(own, lambda x: x != "")


def analyse(columns: DataFrame, key: list[str], below: float = 0.5, least: int = 3) -> DataFrame:
    """(key, n, n_distinct, pattern, verdict, parts) of the columns of at least three rows.

    `dict` if less than half of the values are distinct; else `pattern` if the common delimiters, more
    than one, split every row into equally many parts, more than one; else `none`.  Only columns that
    are no dictionaries are folded to a pattern."""
    counts = columns.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("c")).groupBy(*key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct")).where(F.col("n") >= least)
    many = F.col("n_distinct") / F.col("n") >= below
    wide = columns.join(counts.where(many).select(*key), key, "left_semi")
    known = column_patterns(wide, key).where(F.length("pattern") > 1)
    sizes = wide.join(known, key).groupBy(*key, "pattern").agg(F.min(F.size(_parts())).alias("low"), F.max(F.size(_parts())).alias("high"))
    splits = sizes.where((F.col("low") == F.col("high")) & (F.col("low") > 1)).select(*key, "pattern", F.col("low").alias("parts"))
    verdict = F.when(~many, "dict").when(F.col("pattern").isNotNull(), "pattern").otherwise("none")
    return counts.join(splits, key, "left").select(*key, "n", "n_distinct", F.coalesce("pattern", F.lit("")).alias("pattern"), verdict.alias("verdict"), F.coalesce("parts", F.lit(1)).alias("parts"))


def subfields(columns: DataFrame, analysed: DataFrame, key: list[str]) -> DataFrame:
    """(key, sub, line_no, value): the parts of the columns whose verdict is `pattern`, a column each."""
    known = analysed.where("verdict = 'pattern'").select(*key, "pattern")
    return columns.join(known, key).select(*key, "line_no", F.posexplode(_parts()).alias("sub", "value"))
