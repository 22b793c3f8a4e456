"""A corpus pipeline of five stages, each read from the table that the one before wrote.

Quality rules drop the documents they reject; line deduplication rewrites the texts; the
n-gram Jaccard join keeps the first document of each component; decontamination drops the
contaminated documents; packing lays out what is left in training sequences.  Every stage
but the last returns the columns of documents.

A null text is rejected by the first stage, as is an empty one; very long texts pass whole.
Rows that repeat are judged each, and one of them stays after the Jaccard join; of rows with
one id and different texts each goes by its own text.  Ties between linked documents go to the
least id, then the least text hash.  An empty table yields no rows at every stage.  Extra
columns travel with their rows, whatever their names; packing returns its own columns.

All stages run on the same executors, whose memory earlier stages have filled: stages that send
texts to Python workers do so in small batches, and write what the workers return before the
session's own size of batches is set again.  The Jaccard join makes its blocks of whole batches
and keeps the session's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logquarry.llm import decontam, jaccard, linededup, packing, quality
from logquarry.llm._store import scratch, small_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.rewrite(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return written(packing.pack(docs), "packed")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("packing", sequence_packing),
]

#: A language model and token ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
