"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all documents.

Texts are normalised (A-Z lowered, words of ASCII letters, digits and anything beyond ASCII).
Each 13 consecutive words of a benchmark item are a window; an item with fewer words is one
window.  Document windows of the same lengths are hashed by Rabin-Karp, screened with a
bitmap, looked up in the sorted hashes, and every hit is verified word by word.

The benchmark travels in blocks of at most `block_bytes` of normalised text, each broadcast
on its own; with several blocks the hits of a document are merged after one shuffle by
document.  Null texts have no words; items without words match nothing; a null item id reads
as the empty string; repeated items count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

WIDTH = 13
#: Bytes of normalised benchmark text sent to the workers at once, some twenty times that in memory.
BLOCK_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "doc_id long, _d long, _t long, n_words long, starts array<long>, ends array<long>, items array<string>"


class Windows:
    """The windows of a block of items: sorted hashes, and what stands behind each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        data, at = _text.utf8(pa.array([t for _, t in items], pa.string()))
        data = _text.LOWER[data]
        start, end, first = _text.words(data, at, _text.ALPHANUMERIC)
        hashes = _text.word_hashes(data, start, end)
        raw = data.tobytes()
        found: dict[tuple[int, int], dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        counts = np.diff(first)
        for n in {min(width, int(c)) for c in counts if c}:
            places, keys = _text.windows(hashes, first, n)
            owner = np.searchsorted(first, places, "right") - 1
            for p, k, o in zip(places.tolist(), keys.tolist(), owner.tolist(), strict=True):
                if counts[o] == n or n == width:
                    found[n, k][b" ".join(raw[s:e] for s, e in zip(start[p : p + n], end[p : p + n], strict=True))].add(items[o][0])
        self.by_size = {}
        for n in {n for n, _ in found}:
            keys = np.array(sorted(k for m, k in found if m == n), np.uint64)
            bitmap = np.zeros(1 << 18, bool)
            bitmap[keys & np.uint64((1 << 18) - 1)] = True
            self.by_size[n] = (keys, bitmap, [{b: frozenset(i) for b, i in found[n, int(k)].items()} for k in keys])

    def scan(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, frozenset]]]:
        """Words per document, and the verified hits: document, first word, words, items."""
        data = _text.LOWER[data]
        start, end, first = _text.words(data, at, _text.ALPHANUMERIC)
        hashes, raw, hits = _text.word_hashes(data, start, end), None, []
        for n, (keys, bitmap, texts) in self.by_size.items():
            places, found = _text.windows(hashes, first, n)
            near = np.flatnonzero(bitmap[found & np.uint64((1 << 18) - 1)])
            if not len(near):
                continue
            at_key = np.minimum(np.searchsorted(keys, found[near]), len(keys) - 1)
            same = keys[at_key] == found[near]
            near, at_key = near[same], at_key[same]
            owner = np.searchsorted(first, places[near], "right") - 1
            raw = raw or data.tobytes()
            for p, k, o in zip(places[near].tolist(), at_key.tolist(), owner.tolist(), strict=True):
                said = b" ".join([raw[s:e] for s, e in zip(start[p : p + n].tolist(), end[p : p + n].tolist(), strict=True)])
                if (items := texts[k].get(said)) is not None:
                    hits.append((o, p - int(first[o]), n, items))
        return np.diff(first), hits


def _spans(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digest(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    hit = sum(b - a for a, b in spans)
    return hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n_words


def _scanner(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Windows = pickle.loads(block.value)
        for batch in batches:
            texts = batch.column(3)
            n_words, spans, items = [], [], []
            for _, data, at in _text.slices(texts, _text.SMALL_SLICE_BYTES):
                sizes, hits = known.scan(data, at)
                own, names = defaultdict(list), defaultdict(set)
                for o, p, n, i in hits:
                    own[o].append((p, p + n))
                    names[o] |= i
                n_words += sizes.tolist()
                spans += [_spans(own[i]) if i in own else [] for i in range(len(sizes))]
                items += [sorted(names[i]) if i in names else [] for i in range(len(sizes))]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()), pa.array([[a for a, _ in s] for s in spans], longs), pa.array([[b for _, b in s] for s in spans], longs), pa.array(items, pa.list_(pa.string()))],
                names=[x.split()[0] for x in HITS.split(", ")],
            )

    return _text.tidy(run)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, n_words, starts, ends, items = (batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6))
        rows = [_digest(n, _spans([(a, b) for x, y in zip(s, e, strict=True) for a, b in zip(x, y, strict=True)]), {i for part in own for i in part}) for n, s, e, own in zip(n_words, starts, ends, items, strict=True)]
        hit, count, sha, bad = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), batch.column(1), batch.column(2)], names=[x.split()[0] for x in RESULT.split(", ")] + ["_d", "_t"])


def _judge(block):
    """Scan and digests of an only block in one pass: a second pass would hold a second worker for each task."""
    scan = _scanner(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for b in scan(batches):
                each = pa.array(range(len(b) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.ListArray.from_arrays(each, c) for c in b.columns[4:])], names=b.schema.names)

        yield from _finish(found())

    return run


def _blocks(items: Iterator, block_bytes: int) -> Iterator[list]:
    block, size = [], 0
    for row in items:
        block.append((row["item"], row["text"]))
        size += len(row["text"]) * 4
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sent(benchmark: DataFrame, width: int, block_bytes: int) -> list:
    """A broadcast of windows for each block of the benchmark, at least one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    send = lambda block: benchmark.sparkSession.sparkContext.broadcast(pickle.dumps(Windows(block, width)))
    return [send(block) for block in _blocks(items.toLocalIterator(), block_bytes)] or [send([])]


def _keyed(docs: DataFrame) -> DataFrame:
    return _store.keyed(docs).select("doc_id", "_d", "_t", "text")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Per block of the benchmark, each document's words, hit spans (in words) and items."""
    return [_keyed(docs).mapInArrow(_scanner(block), HITS) for block in _sent(benchmark, width, block_bytes)]


def _contamination(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> DataFrame:
    blocks = _sent(benchmark, width, block_bytes)
    if len(blocks) == 1:
        return _keyed(docs).mapInArrow(_judge(blocks[0]), RESULT + ", _d long, _t long")
    found = [_keyed(docs).mapInArrow(_scanner(block), HITS) for block in blocks]
    keys = ["doc_id", "_d", "_t", "n_words"]
    # rows that repeat are numbered within each block alike only by their number, so count and restore them
    each = [f.groupBy(*keys).agg(F.first("starts").alias("s"), F.first("ends").alias("e"), F.first("items").alias("i"), F.count(F.lit(1)).alias("n")) for f in found]
    every = each[0]
    for f in each[1:]:
        every = every.unionByName(f)
    merged = every.groupBy(*keys).agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"), F.collect_list("i").alias("items"), F.max("n").alias("n"))
    again = merged.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*keys, "starts", "ends", "items")
    return again.mapInArrow(_text.tidy(_finish), RESULT + ", _d long, _t long")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words hit, items found, and whether a twentieth or more is hit."""
    return _contamination(docs, benchmark, width, block_bytes).drop("_d", "_t")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns: each row by its own text."""
    d, t = _store.private(docs, 2)
    bad = _contamination(docs, benchmark, width, block_bytes).where("contaminated").select(F.col("_d").alias(d), F.col("_t").alias(t))
    bad = _store.few(_store.written(bad, "contaminated"))
    marked = docs.withColumns({d: _store.key_of("doc_id"), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    return marked.join(bad, [d, t], "left_anti").select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the words that any benchmark window covers, with all their columns.

    Each run of hit words goes with what stands between its words; the rest of the text stays as it is."""
    found = hits(docs, benchmark, width, block_bytes)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    d, t, s, e = _store.private(docs, 4)
    spans = every.where(F.size("starts") > 0).groupBy("_d", "_t").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("s"))
    spans = spans.select(F.col("_d").alias(d), F.col("_t").alias(t), F.col("s.starts").alias(s), F.col("s.ends").alias(e))
    marked = docs.withColumns({d: _store.key_of("doc_id"), t: F.xxhash64(F.coalesce("text", F.lit("")))}).join(spans, [d, t], "left").drop(d, t)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = (batch.column(batch.schema.get_field_index(c)) for c in ("text", s, e))
            out = []
            for text, a, b in zip(texts, starts.to_pylist(), ends.to_pylist(), strict=True):
                raw = text.as_py()
                if a:
                    data = np.frombuffer(raw.encode(), np.uint8)
                    begin, stop, _ = _text.words(_text.LOWER[data], np.array([0, len(data)]), _text.ALPHANUMERIC)
                    left, here = [], 0
                    for x, y in _spans(list(zip(a, b, strict=True))):
                        left.append(data[here : begin[x]].tobytes())
                        here = int(stop[y - 1])
                    raw = (b"".join(left) + data[here:].tobytes()).decode()
                out.append(raw)
            columns = [batch.column(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.select(*docs.columns, s, e).mapInArrow(_text.tidy(run), docs.schema)
