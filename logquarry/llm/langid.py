"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is made of a bounded sample of its
labelled rows: at most `sample_docs` rows drawn by hash, whole texts as long as they fit in
`dictionary_bytes` (a text that does not fit in what is left is passed over).  A text of any
length is compressed whole, once as it is and once lower-cased, with every dictionary; the
smallest result names the language.  The score is the share of the runner-up's bytes that the
winner saves, mapped to 0..1; margins under `min_margin` are marked rejected, the best guess
still given.  Of equal results the first language name wins, with score 0.

Texts that are null or without a letter are `und` with score 0.  Rows that repeat are
predicted each, and alike.  Without any labelled row every text is `und`; a table without rows
yields none.  Only doc_id, text and lang are read, whatever else there is.  A very long text
takes some five times its size of memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = 256, dictionary_bytes: int = 112 << 10) -> dict[str, bytes]:
    """A dictionary per language, from a bounded sample of the labelled rows of docs."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= dictionary_bytes))
    # four times as many as needed, by hash, so the window gets about as many rows at any size
    share = labelled.groupBy("lang").agg((F.lit(4.0 * sample_docs) / F.count(F.lit(1))).alias("share"))
    rows = labelled.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang")  # one row per language
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text", "h")
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= sample_docs).orderBy("lang", "i").collect()  # at most sample_docs a language
    out: dict[str, bytes] = {}
    for r in sample:
        text = r["text"].encode() + b"\n"
        if len(out.get(r["lang"], b"")) + len(text) <= dictionary_bytes + 1:
            out[r["lang"]] = out.get(r["lang"], b"") + text
    return out


def _predictor(blob, min_margin: float, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        known: dict[str, bytes] = pickle.loads(blob.value)
        langs = sorted(known)
        packers = []
        for x in langs:
            made = zstd.ZstdCompressionDict(known[x], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            params = zstd.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=23)
            packers.append(zstd.ZstdCompressor(dict_data=made, compression_params=params))
        for batch in batches:
            pred, score, rejected = [], [], []
            for text in batch.column(2):
                s = text.as_py() or ""
                if not langs or not any(map(str.isalpha, s)):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                raw = s.encode()
                raw = raw + b"\n" + raw.lower()  # bytes are coarse for short texts; matches of a repeated text are not
                sizes = np.array([len(p.compress(raw)) for p in packers], float)
                best = int(np.argmin(sizes))
                rest = np.delete(sizes, best)
                margin = 1.0 if not len(rest) else float((rest.min() - sizes[best]) / rest.min())
                pred.append(langs[best]), score.append(min(1.0, max(0.0, margin))), rejected.append(margin < min_margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[x.split()[0] for x in RESULT.split(", ")])

    return _text.tidy(run)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01, level: int = 3) -> DataFrame:
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(dictionaries))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_predictor(blob, min_margin, level), RESULT)


def cross_check(docs: DataFrame, **options) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all."""
    return identify(docs, learn(docs.where(~held_out(F.col("doc_id")))), **options)
