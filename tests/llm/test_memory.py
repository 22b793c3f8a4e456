"""What a worker holds at most."""

import pickle
import random
import tracemalloc

import corpus_pipeline
import pyarrow as pa

from pyspark.sql import functions as F

from logquarry.llm import decontam, jaccard, quality


def corpus(size):
    draw = random.Random(2)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 9))) for _ in range(5000)]
    texts, held = [], 0
    while held < size:
        texts.append(" ".join(draw.choices(words, k=200)))
        held += len(texts[-1])
    return texts


def test_quality_holds_little_beside_its_batch():
    texts = corpus(4 << 20)
    langs = pa.array(["en"] * len(texts))
    counted = pa.Table.from_batches(quality._counter(iter([pa.RecordBatch.from_arrays([langs, pa.array(texts)], names=["lang", "text"])])))

    class Blob:
        g = counted["g"].to_numpy()
        order = g.argsort()
        value = pickle.dumps({"en": (g[order], quality._probabilities(g[order], counted["n"].to_numpy()[order], 5))})

    twice = pa.array([*texts[:7], *texts[:1], *texts[7:]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(twice))), pa.array(["en"] * len(twice)), twice], names=["doc_id", "lang", "text"])
    tracemalloc.start()
    try:
        scores = [x for b in quality._judge(Blob)(iter([batch])) for x in b.column(b.schema.get_field_index("log_perplexity")).to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert scores[0] == scores[7] and all(x > 0 for x in scores)
    assert most < 100 << 20, most


def test_decontamination_holds_little_beside_its_batch():
    texts = pa.array(corpus(4 << 20))

    class Block:
        value = pickle.dumps(decontam.Windows([("i", texts[0].as_py())], decontam.WIDTH))

    keys = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([keys, keys, keys, texts], names=["doc_id", "_d", "_t", "text"])
    tracemalloc.start()
    try:
        sizes = [x for b in decontam._scanner(Block)(iter([batch])) for x in b.column(3).to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(sizes) == {200}
    assert most < 60 << 20, most


def test_few_rejected_rows_move_no_text(spark, odd, benchmark_table):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100)  # a size the rejected keys exceed
    try:
        check_plans(odd, benchmark_table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def check_plans(odd, benchmark_table):
    for left in (quality.keep(odd), jaccard.keep_one(odd), decontam.remove(odd.withColumn("x", F.lit(1)), benchmark_table)):
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_decontamination_has_one_worker_a_task(odd, benchmark_table):
    plan = decontam.contamination(odd, benchmark_table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pipeline_sends_small_batches(spark, monkeypatch):
    def sizes(docs, *_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["rows"])

        return docs.mapInArrow(run, "rows long")

    def now(docs, *_):
        return [r["rows"] for r in sizes(docs).collect()]

    for module, name, f in ((quality, "keep", now), (decontam, "remove", now), (jaccard, "keep_one", now), (corpus_pipeline.packing, "pack", sizes)):
        monkeypatch.setattr(module, name, f)
    docs = spark.range(4500, numPartitions=1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.decontamination):
        assert stage(spark, docs, "/root/testdata/sf0.001") == [1000] * 4 + [500]
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept
    packed = corpus_pipeline.sequence_packing(spark, docs, "")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept
    assert sorted(r["rows"] for r in packed.collect()) == [500] + [1000] * 4  # though read after the stage
    assert corpus_pipeline.ngram_jaccard(spark, docs, "") == [4500]
