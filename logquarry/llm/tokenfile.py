"""Token files: ids in Simple-8b words, in ascending document order, with offsets per block.

A file (one shard) is a range of document ids.  It holds blocks of whole documents; a block
is one row of a Parquet file that Spark writes and commits, so any store that Spark can write
to serves, and a lost executor leaves nothing half done:

    shard, block     place in the corpus
    n_ids            ids in the block
    documents        ids of its documents, ascending
    sizes            ids of each document
    offsets          for every 256th word, the number of the first id it holds
    words            little-endian 64-bit words, 4 bits of selector and 60 of payload

A selector packs a fixed count of ids of a fixed width in one word, first id in the lowest
bits.  Selector 15 is the escape: the id has more than 60 bits and fills the next word.

`fetch` reads chosen documents: it takes the blocks that hold them, and in a block only the
words from the offset before a document to its end.

Documents of one id stand in the order of their texts' hashes.  Null texts are empty documents
(the end id alone); a null id comes first; rows that repeat are stored each; an empty table
makes a file set without blocks, which reads back as no rows.  Other columns are not read.  A
very long text is one document of one block, which must fit a worker some thirty times.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store, _text

# Ids per word by selector, and their width in bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
STEP = 256
BLOCK_IDS = 1 << 18
#: Parts of words whose ids a worker keeps, in each of two generations.
REMEMBERED = 400_000

BLOCKS = "shard long, block long, n_ids long, documents array<long>, sizes array<long>, offsets array<long>, words binary"


def _chain(after: np.ndarray) -> np.ndarray:
    """The places 0, after[0], after[after[0]] ... before the end, len(after).

    Places of one stretch of 64 lead to the next stretch; the few entries of stretches are
    followed one by one, and then all stretches at once."""
    n = len(after)
    size = 64 * -(-n // 64)
    kind = np.int32 if size < 1 << 31 else np.int64
    to = np.concatenate([after, np.full(size - n + 1, size)]).astype(kind)
    to[to == n] = size
    stop = (np.arange(size + 1, dtype=kind) | 63) + 1
    stop[size] = size
    leave = to.copy()
    for _ in range(6):  # at most 64 steps of one or more within a stretch
        leave = np.where(leave < stop, leave[leave], leave)
    heads, at = [], 0
    while at < size:
        heads.append(at)
        at = leave.item(at)
    now, found = np.array(heads, np.int64), []
    end = stop[now] if len(now) else now
    while len(now):
        found.append(now)
        now = to[now]
        keep = now < end
        now, end = now[keep], end[keep]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids: each word takes as many of the next ids as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8")
    width = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(float))[1].astype(np.uint8)  # exact: both halves have 32 bits
    if ids.max() >> np.uint64(32):
        high = np.frexp((ids >> np.uint64(32)).astype(float))[1].astype(np.uint8)
        width = np.where(high > 0, high + np.uint8(32), width)
    huge = width > 60
    width = np.minimum(width, 60)
    # the selector at each place, from the widest ids of the next 1, 2, 3 ... ids
    choice = np.full(n, len(COUNTS) - 1, np.uint8)
    reach, widest = 1, width
    open_ = ~huge
    for s in range(len(COUNTS) - 2, -1, -1):
        while reach < COUNTS[s]:
            more = min(reach, COUNTS[s] - reach)
            if len(widest) <= more:
                widest = widest[:0]
                break
            widest = np.maximum(widest[:-more], widest[more:])
            reach += more
        if not len(widest):
            break
        fits = (widest <= WIDTHS[s]) & open_[: len(widest)]
        if not fits.any():
            break  # more ids of fewer bits fit even less
        choice[: len(fits)][fits] = s
    step = np.array(COUNTS, np.int64)[choice]
    if huge.any():  # no word but the escape may hold one
        choice[huge] = ESCAPE
        step[huge] = 1
    places = _chain(np.minimum(np.arange(n) + step, n))
    picked = choice[places].astype(np.uint64)
    word = picked << np.uint64(60)
    for s, (count, bits) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero(picked == s)
        if len(own):
            rows = ids[places[own][:, None] + np.arange(count)]
            word[own] |= np.bitwise_or.reduce(rows << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    long = np.flatnonzero(picked == ESCAPE)
    if len(long):
        word = np.insert(word, long + 1, ids[places[long]])
    return word.astype("<u8")


def _layout(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selector of each word (255: raw payload of the escape before it) and the ids it holds."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    for i in np.flatnonzero(selector == ESCAPE):  # a payload may look like a selector: settle in order
        if selector[i] == ESCAPE:
            selector[i + 1 : i + 2] = 255
    held = np.zeros(256, np.int64)
    held[: len(COUNTS)], held[255] = COUNTS, 1
    return selector, held[selector]


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words, all words of a selector at a time."""
    words = np.asarray(words, np.uint64)
    selector, held = _layout(words)
    begin = np.concatenate([[0], np.cumsum(held)])
    out = np.zeros(begin[-1], np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero(selector == s)
        if len(own):
            low = np.uint64((1 << bits) - 1)
            out[begin[own][:, None] + np.arange(count)] = words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits)) & low
    own = np.flatnonzero(selector == 255)
    out[begin[own]] = words[own]
    return out


def block_offsets(words: np.ndarray) -> np.ndarray:
    _, held = _layout(np.asarray(words, np.uint64))
    return np.concatenate([[0], np.cumsum(held)])[:-1][::STEP]


def part(words: np.ndarray, offsets: np.ndarray, first: int, stop: int) -> np.ndarray:
    """The ids number first to stop of a block, from the words that can hold them."""
    a = max(0, int(np.searchsorted(offsets, first, "right")) - 1)
    while a and words[a * STEP - 1] >> np.uint64(60) == ESCAPE:
        a -= 1  # an offset's word may be an escape's payload; after another word it is none
    b = int(np.searchsorted(offsets, stop, "left"))
    ids = decode(words[a * STEP : b * STEP + 1])  # one more, lest an escape ends the words
    return ids[first - int(offsets[a]) : stop - int(offsets[a])]


def _writer(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder as shared_encoder

        encoder, shard, block = shared_encoder(path, REMEMBERED), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, docs, parts
            ids = np.concatenate(parts)
            words = encode(ids)
            row = [shard, block, len(ids), docs, [len(x) for x in parts], block_offsets(words).tolist(), words.tobytes()]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            block, docs, parts = block + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, ids, at in encoder.batches(texts):
                ids = np.insert(ids.astype(np.uint32), at[1:], end_id)
                at = at + np.arange(len(at))
                for i in range(len(at) - 1):
                    docs.append(names[first + i])
                    parts.append(ids[at[i] : at[i + 1]])
                    held += at[i + 1] - at[i]
                    if held >= BLOCK_IDS:
                        yield flush()
                        held = 0
        if docs:
            yield flush()

    return _text.tidy(run, keeps=True)


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, shards: int | None = None) -> None:
    """Encodes all documents to the file set at path; shards (files) hold ascending ranges of ids."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, tie = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = narrow.repartitionByRange(shards or _store.parts(docs.sparkSession), first).sortWithinPartitions(first, tie)
    dealt.select("doc_id", "text").mapInArrow(_writer(tokenizer, end_id), BLOCKS).write.option("compression", "none").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, docs, sizes, words in zip(*(batch.column(i) for i in range(5)), strict=True):
            ids = decode(np.frombuffer(words.as_buffer(), "<u8")).astype("<u4")
            size = sizes.values.to_numpy()
            at = np.concatenate([[0], np.cumsum(size)])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(size)
            yield pa.RecordBatch.from_arrays(
                [docs.values.cast(pa.int64()), pa.array(np.full(n, shard.as_py())), pa.array(np.full(n, block.as_py())), pa.array(at[:-1]), pa.array(size), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "block", "local", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file set: where its ids start in the corpus, their number and checksum."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))  # as many rows as files
    before = shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))
    inner = sizes.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("inner"))
    places = inner.join(before, "shard").select("shard", "block", (F.col("before") + F.col("inner")).alias("first"))
    docs = blocks.select("shard", "block", "documents", "sizes", "words").mapInArrow(_text.tidy(_reader), "doc_id long, shard long, block long, local long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents asked for, a row for each that is stored."""
    wanted = np.unique(np.array(doc_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, offsets, words in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, starts = np.frombuffer(words.as_buffer(), "<u8"), offsets.values.to_numpy()
                at = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
                own = [i for i, d in enumerate(docs.as_py()) if d is not None and wanted[min(np.searchsorted(wanted, d), len(wanted) - 1)] == d]
                found = [part(raw, starts, int(at[i]), int(at[i + 1])).astype(np.int64) for i in own]
                yield pa.RecordBatch.from_arrays([docs.values.take(pa.array(own, pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    low, high = int(wanted[0]), int(wanted[-1])
    near = blocks.where((F.coalesce(F.try_element_at("documents", F.lit(-1)), F.lit(low)) >= low) & (F.coalesce(F.try_element_at("documents", F.lit(1)), F.lit(low)) <= high))
    return near.select("documents", "sizes", "offsets", "words").mapInArrow(_text.tidy(run), "doc_id long, ids array<long>")
