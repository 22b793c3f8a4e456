"""The corpus pipeline against plain versions of its stages, one after another."""

import brute
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r for r, (_, kept) in zip(docs, brute.quality(docs), strict=True) if kept]
    texts = [(d, t) for (d, _, _), (_, _, _, t) in zip(docs, brute.kept_lines([(d, t) for d, t, _ in docs]), strict=True)]
    texts = [x for x, (d, n, c) in zip(texts, brute.jaccard(texts), strict=True) if d == c or not n]
    texts = [x for x, r in zip(texts, brute.contamination(texts, bench), strict=True) if not r[-1]]
    want = {d: (len(ids), brute.crc(ids)) for (d, _), ids in zip(texts, brute.tokens([t for _, t in texts], 0), strict=True)}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == {d: n for d, (n, _) in want.items()}
    by_doc = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == by_doc.get(r["doc_id"], 0)
        by_doc[r["doc_id"]] = r["start"] + r["length"]
    assert by_doc == {d: n for d, (n, _) in want.items()}


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
