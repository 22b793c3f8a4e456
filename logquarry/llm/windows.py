"""Substring deduplication by counted Rabin-Karp hashes of word windows.

Every window of `width` consecutive words is hashed; a word is removed if a window over it
has the same words as one that starts earlier (smaller id, or the same document and an
earlier start).

1. Tasks hash blocks of documents.  Within a block only the earliest window of a hash goes
   on; the others are repeats already.  So a passage that a third of all rows hold costs one
   entry a block.  Entries travel packed, by hash range ("bucket"): 7 bytes of the hash and
   about one byte of place, with the ids of only the documents they stand in.
2. Each bucket finds the hashes that several blocks hold and marks all but the earliest.
3. Marks return to their block, which turns them into word intervals of its documents.
4. The intervals meet the texts by document, and the words under them go.

The number of buckets follows the bytes of text, so a bucket stays near `bucket_bytes`.
Hashes have 56 bits and the bucket's, at least 60 together; a chance meeting of two windows
among n is about n * n / 2**(57 + bucket bits).

Null texts have no words.  Rows with the same id count as one place: neither precedes the
other.  An empty table yields no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

U = np.uint64
WIDTH = 20
BLOCK_BYTES = 8 << 20
PACKED = "bucket long, block long, kind int, entries binary, places binary, documents binary"
MARKED = "block long, marks binary, documents binary"
SPANS = "_d long, _t int, starts array<int>, ends array<int>"


def pack_places(x: np.ndarray) -> bytes:
    """Ascending numbers as byte deltas; 255 means 255 more and go on."""
    d = np.diff(x, prepend=0)
    out = np.full(int((d // 255).sum()) + len(d), 255, np.uint8)
    out[np.cumsum(d // 255 + 1) - 1] = d % 255
    return out.tobytes()


def unpack_places(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _seven(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 7)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :7] = raw
    return wide.view("<u8").ravel()


def _table(d: np.ndarray, t: np.ndarray, first: np.ndarray) -> bytes:
    """A block's documents: id, tag of the text, number of the first word."""
    return zlib.compress(np.diff(d, prepend=0).astype("<i8").tobytes() + t.astype("<i4").tobytes() + np.diff(first).astype("<i4").tobytes(), 1)


def _untable(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(b)
    n = len(raw) // 16
    d = np.cumsum(np.frombuffer(raw[: 8 * n], "<i8"))
    t = np.frombuffer(raw[8 * n : 12 * n], "<i4")
    return d, t, np.concatenate([[0], np.cumsum(np.frombuffer(raw[12 * n :], "<i4"), dtype=np.int64)])


def _lean(d: np.ndarray, first: np.ndarray) -> bytes:
    """What a bucket needs of documents: id and number of the first word."""
    return zlib.compress(np.diff(d, prepend=0).astype("<i8").tobytes() + np.diff(first, prepend=0).astype("<i4").tobytes(), 1)


def _unlean(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(b)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw[: 8 * n], "<i8")), np.cumsum(np.frombuffer(raw[8 * n :], "<i4"), dtype=np.int64)


def _hasher(width: int, bits: int):
    def block(d: np.ndarray, t: np.ndarray, texts: pa.Array):
        hashes, place, sizes, base = [], [], [], 0
        for _, data, at in _text.slices(texts):
            start, end, first = _text.words(data, at, _text.SPACE_SEPARATED)
            p, h = _text.windows(_text.word_hashes(data, start, end), first, width)
            hashes.append(h), place.append(p + base), sizes.append(np.diff(first))
            base += len(start)
        h, p = np.concatenate(hashes), np.concatenate(place)
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        order = np.argsort(h, kind="stable")
        sorted_ = h[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(h) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
        later, ahead = order[~new], order[lead[~new]]
        o, a = (np.searchsorted(first, p[x], "right") - 1 for x in (later, ahead))
        later = later[(d[o] > d[a]) | ((d[o] == d[a]) & (p[later] - first[o] > p[ahead] - first[a]))]
        return h, p, order[new], np.sort(p[later]), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            batch = batch.take(pa.array(order))
            _, at = _text.utf8(batch.column(2))
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
                part = batch.slice(i, j - i)
                d, t = part.column(0).to_numpy(), (part.column(1).to_numpy() & 0x7FFFFFFF).astype(np.int32)
                h, p, firsts, repeats, first = block(d, t, part.column(2))
                table = _table(d, t, first)
                top = (h[firsts] >> U(64 - bits)).astype(np.int64)
                order = np.lexsort([p[firsts], top])
                edge = np.searchsorted(top[order], np.arange((1 << bits) + 1))
                rows = []
                for b in range(1 << bits):
                    own = firsts[order[edge[b] : edge[b + 1]]]
                    if len(own):
                        held = np.unique(np.searchsorted(first, p[own], "right") - 1)
                        rows.append((b, number, 0, _seven(h[own]), pack_places(p[own]), _lean(d[held], first[held])))
                if len(d):  # the block's own table travels once
                    rows.append((int(first[-1] + d[0]) % (1 << bits), number, 1, b"", pack_places(repeats), table))
                for k in range(0, len(rows), 16):
                    cols = list(zip(*rows[k : k + 16], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3], strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])
                number += 1
                i = j

    return _text.tidy(run)


def _bucket(table: pa.Table) -> pa.Table:
    """Marks of one bucket: the places, in each block, of windows that started earlier elsewhere."""
    kind = table["kind"].to_pylist()
    blocks, entries, places, docs = (table[c].to_pylist() for c in ("block", "entries", "places", "documents"))
    out: dict[int, list] = {}
    real = [i for i, k in enumerate(kind) if k == 0]
    if real:
        h = np.concatenate([_eight(entries[i]) for i in real])
        p = np.concatenate([unpack_places(places[i]) for i in real])
        source = np.repeat(np.arange(len(real)), [len(entries[i]) // 7 for i in real])
        order = np.argsort(h)
        s = h[order]
        equal = s[1:] == s[:-1]
        many = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
        d, start = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
        src = source[many]
        by_source = np.argsort(src, kind="stable")
        edge = np.searchsorted(src[by_source], np.arange(len(real) + 1))
        for k, i in enumerate(real):
            own = by_source[edge[k] : edge[k + 1]]
            if len(own):
                ids, first = _unlean(docs[i])
                o = np.searchsorted(first, p[many[own]], "right") - 1
                d[own], start[own] = ids[o], p[many[own]] - first[o]
        order = np.lexsort([start, d, h[many]])
        g = h[many][order]
        new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))] if len(g) else order
        late = (d[order] != d[lead]) | (start[order] != start[lead])
        marked = many[order[late]]
        src = source[marked]
        for k in np.unique(src):
            i = real[k]
            out.setdefault(blocks[i], [np.zeros(0, np.int64), b""])
            out[blocks[i]][0] = np.concatenate([out[blocks[i]][0], p[marked[src == k]]])
    for i, k in enumerate(kind):
        if k == 1:
            have = out.setdefault(blocks[i], [np.zeros(0, np.int64), b""])
            have[1] = docs[i]
            have[0] = np.concatenate([have[0], unpack_places(places[i])])
    rows = [(b, pack_places(np.unique(m)), t) for b, (m, t) in out.items()]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "marks": pa.array([r[1] for r in rows], pa.binary()), "documents": pa.array([r[2] for r in rows], pa.binary())})


def _spans(width: int):
    def run(table: pa.Table) -> pa.Table:
        d, t, first = _untable(next(x for x in table["documents"].to_pylist() if x))
        marks = np.unique(np.concatenate([unpack_places(x) for x in table["marks"].to_pylist()]))
        apart = np.arange(len(first))  # one place between documents keeps their intervals apart
        marks = marks + np.searchsorted(first, marks, "right") - 1
        start, end = _text.merge_intervals(marks, marks + width)
        o = np.searchsorted(first + apart, start, "right") - 1
        start, end = start - o, end - o
        docs = np.unique(o)
        a, b = np.searchsorted(o, docs, "left"), np.searchsorted(o, docs, "right")
        lists = pa.list_(pa.int32())
        return pa.table({"_d": pa.array(d[docs]), "_t": pa.array(t[docs]), "starts": pa.array([(start[x:y] - first[k]).tolist() for x, y, k in zip(a, b, docs, strict=True)], lists), "ends": pa.array([(end[x:y] - first[k]).tolist() for x, y, k in zip(a, b, docs, strict=True)], lists)})

    return run


def kept_texts(data: np.ndarray, at: np.ndarray, removed) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, words removed and the kept words joined by one space, of each document.

    removed(i) gives the word intervals to remove from document i."""
    start, end, first = _text.words(data, at, _text.SPACE_SEPARATED)
    gone = np.zeros(len(start) + 1, np.int32)
    for i in range(len(at) - 1):
        for a, b in removed(i):
            gone[first[i] + a] += 1
            gone[first[i] + b] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    s, e = start[keep], end[keep]
    size = e - s + 1
    out_end = np.cumsum(size)
    place = np.arange(out_end[-1] if len(out_end) else 0) + np.repeat(s - (out_end - size), size)
    out = data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else data
    out[out_end - 1] = 32
    left = np.concatenate([[0], np.cumsum(keep)])[first]
    edge = np.concatenate([[0], out_end])[left]
    raw = out.tobytes()
    return np.diff(first), np.diff(first) - np.diff(left), [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _remover(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, removed, sha, kept = [], [], [], []
            for i, data, at in _text.slices(batch.column(1)):
                a, b, texts = kept_texts(data, at, lambda k, i=i: zip(starts[i + k] or (), ends[i + k] or (), strict=True))
                n.append(a), removed.append(b)
                sha += [hashlib.sha256(x).hexdigest() for x in texts]
                kept += texts if with_text else []
            whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            cols = [batch.column(0), whole(n), whole(removed), pa.array(sha, pa.string())] + [pa.array(kept, pa.binary()).cast(pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    return _text.tidy(run)


def dedup_windows(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """One row per document: words, words removed, digest of what is kept (and the text itself)."""
    own = _store.keyed(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(1.5 * size / bucket_bytes).bit_length())
    packed = own.select("_d", "_t", "text").mapInArrow(_hasher(width, bits), PACKED)
    marks = packed.groupBy("bucket").applyInArrow(_bucket, MARKED)
    spans = marks.groupBy("block").applyInArrow(_spans(width), SPANS)
    # rows that repeat have spans in several places
    spans = spans.groupBy("_d", "_t").agg(F.collect_list(F.struct("starts", "ends")).alias("s")).select("_d", F.col("_t").alias("_s"), F.flatten("s.starts").alias("starts"), F.flatten("s.ends").alias("ends"))
    tagged = own.select("doc_id", "text", "_d", F.col("_t").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_s"))
    both = tagged.join(spans, ["_d", "_s"], "left").select("doc_id", "text", "starts", "ends")
    return both.mapInArrow(_remover(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
