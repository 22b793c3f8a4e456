"""Exact removal of byte strings that occur more than once, by enhanced suffix arrays.

A byte goes if a string of `width` bytes over it also starts anywhere else.

1. Every window of `width` bytes is owned by one anchor: the gram of `gram` bytes inside it
   with the least hash (the leftmost of ties).  Equal windows have equal anchors at the same
   place, and an anchor gram that occurs once owns no repeat.  Tasks send each distinct
   anchor of a block once, packed, to the bucket of its hash; buckets tell blocks which
   anchors occur again, and how often.
2. Of anchors that do, the windows owned (the bytes from the first to the last) travel as one
   context, keyed by anchor.  Equal contexts of a batch travel once; the copies are repeats
   already, and only their merged spans travel, a row a document.  Anchors with more than `warm` occurrences send contexts of eight windows keyed
   by anchor, place and what the eight share; those with more than `hot` send single windows,
   keyed by their content.  So no key gathers what grows with a hot group, beyond one entry
   a task.
3. A bucket builds the enhanced suffix array of its contexts: suffixes by prefix doubling on
   integer ranks, and their common prefixes.  Suffixes that share `width` bytes stand together;
   a stand whose members all have the same byte to the left lies inside a longer repeat and is
   left out.  Over the others a stack scan of the common-prefix interval tree yields the maximal
   repeats: the intervals whose occurrences differ in the byte to the left (or begin their
   context), with all occurrences, not just neighbours.  A context ends `width` - 1 bytes after
   its last window, so a repeat of many anchors comes in overlapping parts.
4. The occurrences return to the texts by document, and the bytes under them go.

`maximal_repeats` is the same for whole texts of one group.

Null texts are empty.  Rows that repeat are repeats of one another.  A null id is the smallest.
An empty table yields no rows.  Other columns are not read.  A very long text passes in one
piece through a worker, in some fifty times its size of memory.
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
from .windows import BLOCK_BYTES, _eight, _seven, _table, _untable, pack_places, unpack_places

U = np.uint64
WIDTH, GRAM = 200, 64
PACKED = "bucket long, block long, kind int, entries binary, places binary, counts binary, documents binary"
REPLY = "block long, kind int, marks binary, classes binary, documents binary"
FLAGS = "_d long, _t int, anchors array<int>, classes array<int>"
CONTEXT = "bucket long, kind int, key long, _d long, _t int, place int, owned int, context binary"
SPANS = "_d long, _t int, starts array<int>, ends array<int>"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive numbers."""
    n = len(x) - w + 1
    wide = np.concatenate([x, np.full(-len(x) % w, x[-1], x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, width: int, gram: int):
    """Of each anchor: place, hash, first and last start of the windows it owns, document."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, np.zeros(0, U), none, none, none
    place, h = _text.grams(data, at, gram)
    if not len(place):
        return none, np.zeros(0, U), none, none, none
    key = np.full(len(data), np.iinfo(np.uint64).max, U)
    key[place] = (h >> U(32) << U(32)) | place.astype(U)
    full = np.zeros(len(data), U)
    full[place] = h
    least = (sliding_min(key, width - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    start = np.flatnonzero(room >= width)
    start = start[start < len(least)]
    own = least[start]
    if not len(start):
        return none, np.zeros(0, U), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(start)) - 1
    a = own[new]
    return a, full[a], start[new], start[last], np.searchsorted(at, a, "right") - 1


def _anchorer(width: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            _, at = _text.utf8(batch.column(2))
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
                part = batch.slice(i, j - i)
                hashes, sizes = [], []
                for _, data, own in _text.slices(part.column(2)):
                    _, h, _, _, doc = anchors(data, own, width, gram)
                    hashes.append(h), sizes.append(np.bincount(doc, minlength=len(own) - 1))
                first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                unique, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                if len(unique):
                    top = (unique >> U(64 - bits)).astype(np.int64)
                    edge = np.searchsorted(top, np.arange((1 << bits) + 1))
                    few = np.minimum(counts, 255).astype(np.uint8)
                    rows = [(b, number, 0, _seven(unique[x:y]), pack_places(np.arange(x, y)), few[x:y].tobytes(), b"") for b, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x]
                    d, t = part.column(0).to_numpy(), (part.column(1).to_numpy() & 0x7FFFFFFF).astype(np.int32)
                    rows.append((int(top[0] + number) % (1 << bits), number, 1, zlib.compress(inverse.astype("<i4").tobytes(), 1), b"", b"", _table(d, t, first)))
                    for k in range(0, len(rows), 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows[k : k + 16], strict=True), kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])
                number += 1
                i = j

    return _text.tidy(run)


def _bucket(warm: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        kind, blocks, entries, places, counts, docs = (table[c].to_pylist() for c in ("kind", "block", "entries", "places", "counts", "documents"))
        rows = [(blocks[i], 1, entries[i], b"", docs[i]) for i, k in enumerate(kind) if k == 1]
        real = [i for i, k in enumerate(kind) if k == 0]
        if real:
            h = np.concatenate([_eight(entries[i]) for i in real])
            c = np.concatenate([np.frombuffer(counts[i], np.uint8) for i in real]).astype(np.int64)
            sizes = [len(counts[i]) for i in real]
            order = np.argsort(h)
            s = h[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total = np.zeros(len(h), np.int64)
            total[order] = np.repeat(np.add.reduceat(c[order], new), np.diff(np.append(new, len(s))))
            level = (total > warm).astype(np.uint8) + (total > hot)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for k, i in enumerate(real):
                own = total[edge[k] : edge[k + 1]] > 1
                if own.any():
                    rows.append((blocks[i], 0, pack_places(unpack_places(places[i])[own]), level[edge[k] : edge[k + 1]][own].tobytes(), b""))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(x, k) for x, k in zip(cols, [pa.int64(), pa.int32(), *[pa.binary()] * 3], strict=True)], names=[x.split()[0] for x in REPLY.split(", ")])

    return run


def _flags(table: pa.Table) -> pa.Table:
    """Repeated anchors of each document of a block, by their number in the document."""
    level, inverse, docs = {}, None, None
    for kind, marks, classes, own in zip(*(table[c].to_pylist() for c in ("kind", "marks", "classes", "documents")), strict=True):
        if kind == 1:
            inverse, docs = np.frombuffer(zlib.decompress(marks), "<i4"), own
        else:
            level.update(zip(unpack_places(marks).tolist(), classes, strict=True))
    d, t, first = _untable(docs)
    class_of = np.full(int(inverse.max(initial=-1)) + 1, 255, np.uint8)
    class_of[list(level)] = list(level.values())
    which = class_of[inverse]
    flagged = np.flatnonzero(which < 255)
    owner = np.searchsorted(first, flagged, "right") - 1
    rows = np.unique(owner)
    a, b = np.searchsorted(owner, rows, "left"), np.searchsorted(owner, rows, "right")
    ints = pa.list_(pa.int32())
    return pa.table({"_d": pa.array(d[rows]), "_t": pa.array(t[rows]), "anchors": pa.array([(flagged[x:y] - first[k]).tolist() for x, y, k in zip(a, b, rows, strict=True)], ints), "classes": pa.array([which[flagged[x:y]].tolist() for x, y in zip(a, b, strict=True)], ints)})


def _contexts(width: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            ids, tags, flags, classes = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            seen: dict[tuple[int, bytes], int] = {}
            rows: list[list] = []
            copies: dict[tuple[int, int], list[int]] = {}
            for i, data, at in _text.slices(batch.column(2)):
                place, h, low, high, doc = anchors(data, at, width, gram)
                raw, first = data.tobytes(), np.searchsorted(doc, np.arange(len(at)))
                for k in range(len(at) - 1):
                    base, d, t = int(at[k]), ids[i + k], tags[i + k]
                    for number, level in zip(flags[i + k], classes[i + k], strict=True):
                        x = int(first[k]) + number
                        lo, hi, a, name = int(low[x]), int(high[x]), int(place[x]), int(h[x])
                        s = lo
                        while s <= hi:
                            if level == 0:
                                e, key = hi, name
                            elif level == 1:  # eights counted from the anchor, alike in every occurrence
                                eight = (a - s) // 8
                                last = a - 8 * eight
                                e, key = min(hi, last), hash_bytes(raw[last : last - 7 + width], name ^ eight)
                            else:
                                e, key = s, hash_bytes(raw[s : s + width], name)
                            context = raw[s : e + width]
                            if (key, context) in seen:
                                own = copies.setdefault((d, t), [])
                                if own and own[-2] <= s - base <= own[-1]:
                                    own[-1] = max(own[-1], e - base + width)
                                else:
                                    own += (s - base, e - base + width)
                                rows[seen[key, context]][1] = 2  # the one that travels is a repeat too
                            else:
                                seen[key, context] = len(rows)
                                rows.append([key, 0, key, d, t, s - base, e - s + 1, context])
                            s = e + 1
            # a document's copies bring their spans instead of contexts: any bucket can pass them on
            rows += [[n + d, 1, 0, d, t, 0, 0, np.array(own, "<i4").tobytes()] for n, ((d, t), own) in enumerate(copies.items())]
            for r in rows:
                r[0] &= (1 << bits) - 1
                r[2] = r[2] - (1 << 64) if r[2] >= 1 << 63 else r[2]
            for k in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows[k : k + (1 << 14)], strict=True), kinds, strict=True)], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return _text.tidy(run)


def hash_bytes(b: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8, key=(seed & (1 << 64) - 1).to_bytes(8, "little")).digest(), "little")


def depth_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of all suffixes by their first `depth` bytes, by prefix doubling."""

    def dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
        return rank

    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    have = min(8, depth)
    for i in range(have):
        key = key << U(8) | wide[i : n + i]
    rank = dense(key)
    while have < depth:
        ahead = min(have, depth - have)
        later = np.concatenate([rank[ahead:], np.zeros(min(ahead, n), np.int64)])[:n]
        rank = dense(rank.astype(U) << U(32) | later.astype(U))
        have += ahead
    return rank


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and, for each entry, the prefix it has in common with the one before."""
    raw = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    n = len(raw)
    rank, have = raw, 1
    while True:
        later = np.concatenate([rank[have:], np.zeros(min(have, n), np.int64)])[:n]
        order = np.lexsort([later, rank])
        changed = (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], changed]))
        rank, have = fresh, 2 * have
        if n == 0 or rank.max() == n or have > n:
            break
    common, k = np.zeros(n, np.int64), 0
    for i in range(n):  # the text's order: each prefix is at most one byte shorter than the last
        r = int(rank[i]) - 1
        if r == 0:
            k = 0
            continue
        j = int(order[r - 1])
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        common[r] = k
        k = max(0, k - 1)
    return order, common


def interval_tree(order: list[int], common: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last + 1) of every interval of the suffix array whose suffixes share `length` >= least
    bytes, no longer prefix is shared by all, and the bytes to the left differ.

    common: of each suffix with the one before it.  left: the byte to the left, or a number of its
    own where there is none.  An open interval knows the one byte to the left of all it holds so
    far, or None once there are two; closing it passes that on to the interval around it."""
    stack: list[list] = []  # [length, first, left]
    mixed = object()
    for i in range(1, len(order) + 1):
        c = common[i] if i < len(order) else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > c:
            length, first, seen = stack.pop()
            byte = byte if seen is None or seen == byte else mixed
            if byte is mixed and length >= least:
                yield length, first, i
        if stack and stack[-1][0] == c:
            top = stack[-1]
            top[2] = byte if top[2] is None or top[2] == byte else mixed
        elif c:
            stack.append([c, first, byte])


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, place), ...]) of every maximal repeat of at least `least` bytes.

    A repeat is a common-prefix interval of the suffix array of all texts; it is maximal if
    its occurrences differ in the byte to the left, too (or one begins its text)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = b"\x00".join([*texts, b""]) if texts else b""
    order, common = suffix_array(joined)
    number = np.searchsorted(ends, order, "right")
    room = ends[number] - 1 - order  # a repeat ends with its text
    if len(common):
        common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    begin = [0, *ends.tolist()]
    begins = set(begin)
    left = [joined[p - 1] if p not in begins else -1 - p for p in order.tolist()]
    out = []
    for length, a, b in interval_tree(order.tolist(), common.tolist(), left, least):
        places = [(int(np.searchsorted(ends, p, "right")), p) for p in order[a:b].tolist()]
        out.append((length, sorted((t, p - begin[t]) for t, p in places)))
    return out


def context_repeats(data: np.ndarray, at: np.ndarray, owned: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(length, starts) of the maximal repeats of at least width bytes among the owned starts of contexts."""
    rank = depth_ranks(data, width)
    row = np.repeat(np.arange(len(owned)), owned)
    start = at[row] + np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned)
    order = np.argsort(rank[start], kind="stable")
    start, row = start[order], row[order]
    r = rank[start]
    same = r[1:] == r[:-1]
    stand = np.cumsum(np.concatenate([[1], ~same])) if len(r) else r
    left = np.where(start > at[row], data[start - 1].astype(np.int64), -1 - start) if len(start) else start
    # stands of one suffix, and those whose members all have the same byte to the left, hold no maximal repeat
    new = np.flatnonzero(np.concatenate([[True], ~same])) if len(r) else r
    size = np.diff(np.append(new, len(r)))
    low, high = (f.reduceat(left, new) if len(new) else new for f in (np.minimum, np.maximum))
    keep = np.repeat((size > 1) & (low != high), size)
    start, row, stand, left = start[keep], row[keep], stand[keep], left[keep]
    if not len(start):
        return []
    # within a stand, by what follows: contexts end at most len - width bytes later
    room = at[row + 1] - start
    more = int(room.max()) - width
    tail = np.zeros((len(start), max(0, -(-more // 8))), U)
    wide = np.concatenate([data, np.zeros(more + 16, np.uint8)])
    for k in range(more):
        byte = np.where(width + k < room, wide[start + width + k].astype(U) + U(1), U(0))  # 0: the context is over
        if k % 7 == 0 and k // 7 >= tail.shape[1]:
            tail = np.concatenate([tail, np.zeros((len(start), 1), U)], axis=1)
        tail[:, k // 7] = tail[:, k // 7] << U(9) | byte
    order = np.lexsort([*tail.T[::-1], stand])
    start, row, stand, left, room = (x[order] for x in (start, row, stand, left, room))
    common = np.zeros(len(start), np.int64)
    if len(start) > 1:
        both = np.flatnonzero(stand[1:] == stand[:-1]) + 1
        length, open_ = np.full(len(both), width), np.arange(len(both))
        most = np.minimum(room[both], room[both - 1])
        while len(open_):
            i = both[open_]
            equal = (length[open_] < most[open_]) & (wide[start[i] + length[open_]] == wide[start[i - 1] + length[open_]])
            open_ = open_[equal]
            length[open_] += 1
        common[both] = length
    return [(n, start[a:b]) for n, a, b in interval_tree(start.tolist(), common.tolist(), left.tolist(), width)]


def _distinct(rows: np.ndarray, key: np.ndarray, contexts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows to build suffix arrays of, by key, and rows whose context another has as well.

    Of equal contexts one is enough, and an anchor with a single context has no more repeats:
    two equal windows of one context would have two anchors."""
    data, at = _text.utf8(contexts)
    place = np.arange(len(rows))
    h = _text.span_hash(_text.prefix(data.astype(U) + U(1), _text._BYTE), at[:-1], at[1:], _text._BYTE) if len(data) else np.zeros(len(rows), U)
    order = np.lexsort([h, key])
    k, h = key[order], h[order]
    same = (k[1:] == k[:-1]) & (h[1:] == h[:-1])
    twin = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(rows) else np.zeros(0, bool)
    first = np.concatenate([[True], ~same]) if len(rows) else twin
    one = order[first]
    k = key[one]
    several = k[1:] == k[:-1]
    keep = np.concatenate([[False], several]) | np.concatenate([several, [False]]) if len(one) else np.zeros(0, bool)
    return rows[place[one[keep]]], rows[order[twin]]


def _intervals(width: int, most: int = 4 << 20):
    def run(table: pa.Table) -> pa.Table:
        kind, key = table["kind"].to_numpy(), table["key"].to_numpy()
        d, t = table["_d"].to_numpy(), table["_t"].to_numpy()
        place, owned = table["place"].to_numpy().astype(np.int64), table["owned"].to_numpy().astype(np.int64)
        out = []
        whole = np.flatnonzero(kind == 2)  # met their copy already
        real = np.flatnonzero(kind != 1)
        texts = table["context"].combine_chunks() if isinstance(table["context"], pa.ChunkedArray) else table["context"]
        real, twins = _distinct(real, key[real], texts.take(pa.array(real)))
        whole = np.unique(np.concatenate([whole, twins]))
        out.append((whole, place[whole], place[whole] + owned[whole] - 1 + width))
        copies = np.flatnonzero(kind == 1)
        raw, at = _text.utf8(texts.take(pa.array(copies)))
        pairs = np.frombuffer(raw.tobytes(), "<i4").astype(np.int64).reshape(-1, 2)
        out.append((np.repeat(copies, np.diff(at) // 8), pairs[:, 0], pairs[:, 1]))
        i = 0
        while i < len(real):
            j, size = i, 0
            while j < len(real) and (size < most or key[real[j]] == key[real[j - 1]]):
                size += owned[real[j]] + width - 1
                j += 1
            rows = real[i:j]
            data, at = _text.utf8(texts.take(pa.array(rows)))
            for length, starts in context_repeats(data, at, owned[rows], width):
                row = np.searchsorted(at, starts, "right") - 1
                first = place[rows[row]] + starts - at[row]
                out.append((rows[row], first, first + length))
            i = j
        rows, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort([a, t[rows], d[rows]])
        rows, a, b = rows[order], a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (d[rows][1:] != d[rows][:-1]) | (t[rows][1:] != t[rows][:-1])])) if len(rows) else np.zeros(0, int)
        stop = np.append(new[1:], len(rows)) if len(rows) else new
        merged = [_text.merge_intervals(a[x:y], b[x:y]) for x, y in zip(new, stop, strict=True)]
        ints = pa.list_(pa.int32())
        return pa.table({"_d": pa.array(d[rows[new]], pa.int64()), "_t": pa.array(t[rows[new]], pa.int32()), "starts": pa.array([x.tolist() for x, _ in merged], ints), "ends": pa.array([y.tolist() for _, y in merged], ints)})

    return run


def _remover(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, sha, kept = [], [], [], [], []
            for text, s, e in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                a, b = _text.merge_intervals(np.array(s or [], np.int64), np.array(e or [], np.int64))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(raw)), removed.append(len(raw) - len(left)), spans.append(len(a))
                sha.append(hashlib.sha256(left).hexdigest())
                kept += [left] * with_text
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())] + [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return _text.tidy(run)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket_bytes: int = 8 << 20, warm: int = 4096, hot: int = 65536, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, digest of the rest (and the bytes)."""
    own = _store.keyed(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(1.5 * size / bucket_bytes).bit_length())
    tagged = own.select("doc_id", "text", "_d", F.col("_t").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_s"))
    packed = own.select("_d", "_t", "text").mapInArrow(_anchorer(width, gram, bits), PACKED)
    flags = packed.groupBy("bucket").applyInArrow(_bucket(warm, hot), REPLY).groupBy("block").applyInArrow(_flags, FLAGS)
    flags = flags.dropDuplicates(["_d", "_t"]).withColumnRenamed("_t", "_s")
    flagged = tagged.join(flags, ["_d", "_s"]).select("_d", F.col("_s"), "text", "anchors", "classes")
    contexts = flagged.mapInArrow(_contexts(width, gram, bits), CONTEXT)
    spans = contexts.groupBy("bucket").applyInArrow(_intervals(width), SPANS)
    spans = spans.groupBy("_d", "_t").agg(F.collect_list(F.struct("starts", "ends")).alias("s")).select("_d", F.col("_t").alias("_s"), F.flatten("s.starts").alias("starts"), F.flatten("s.ends").alias("ends"))
    both = tagged.join(spans, ["_d", "_s"], "left").select("doc_id", "text", "starts", "ends")
    return both.mapInArrow(_remover(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
