"""Exact n-gram Jaccard self-join with PartEnum signatures, and the classes it links.

A document is the set of its distinct `width`-word shingles.  Sets link when the common part
is at least `percent` hundredths of the union; the largest symmetric difference of two linked
sets, the smaller of at most r shingles, is then k(r) = floor(r / 4) at 80 %.

Sizes fall into bands (s <= r, ratio 1.35).  A set takes part in the band of its own size,
and as a guest in each lower band whose largest set it could still link with.  A band divides
the shingle domain by hash into n1 rows of four parts; at least m = n1 - k // 3 rows differ in
at most two shingles, so two of the four parts are equal.  Each row gives six signatures, the
content of each two parts (as a sum of hashes).  Small differences k use one row of k + 2
parts.  Linked sets of a band share a non-empty signature unless m or more rows of one of
them have an empty one; only such a set also gives its empty ones.

1. Tasks work in blocks: equal sets are one, signatures travel packed to the bucket of their
   hash, about 5 bytes each and 8 for the set.  A signature that `local_hot` or more sets of a
   block have is sent on as plain rows that spread over all tasks, with one entry to its bucket.
   A block sends at most one packet to a bucket and none without an entry, so what travels
   follows the signatures, however many buckets there are.
2. Buckets pair the least set of every signature with each other one (stars, never all pairs),
   counted, and yield (signature, set) where three sets or more have it.  Signatures that were
   hot in a block go through a shuffle for that.
3. Sketches,
   a lower bound of the difference that never rejects a link, screen all stars.  Of each set,
   the star with most common signatures is checked first; then all others whose ends are still
   in different components.  A check counts common shingles exactly.
4. What is left are pairs of one signature without its least set and in different components.
   They never become rows: a task that holds a signature's sets screens them by size and
   sketch and names the sets that have a possible partner; with those sets' shingles it then
   checks them, skips pairs that its links have joined by then, and yields the links of a
   spanning forest.  That screening is the one step whose work grows with the square of the
   sets that share a signature and lie in different components.
5. Sets carry their component back to all documents.

Sets and shingles are compared by 64 and 48 bits of hashes: with n different sets, two are
mistaken for one with odds of about n * n / 2**65.  Without words, or with a null text, a set
is empty and links with nothing.  Rows that repeat have equal sets and so one component.  A
null id is the smallest, and shows as null.  An empty table yields no rows.  Very long texts
are one set like any other; a text must fit a worker, with some twenty times its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store, _text
from .components import components
from .windows import pack_places, unpack_places

U = np.uint64
WIDTH, PERCENT = 5, 80
PACKED = "bucket long, kind int, entries binary, places binary, sets binary"
FOUND = "kind int, sig long, set long, n int, _d long, _t long, sketch binary"
LOW = 32
BLOCK_BYTES = 4 << 20
BINS = 256
#: Up to so large a difference a single row of parts serves.
FEW = 6
#: (signature, set) rows of one pivot that a task takes together.
BIN_ROWS = 20_000
#: Sets whose rows (24 bytes each) may be broadcast to find their texts; more are found by a shuffled join.
BROADCAST_SETS = 1_000_000
NONE = -(2**63)


def sets_of(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all documents of a slice, by document and ascending, and where each one's start."""
    data = _text.LOWER[data]
    start, end, first = _text.words(data, at, _text.SPACE_SEPARATED)
    hashes, counts = _text.word_hashes(data, start, end), np.diff(first)
    docs, keys = [], []
    for n in range(1, width + 1):  # of fewer words than that, all are one shingle
        own = counts >= n if n == width else counts == n
        if own.any():
            place, h = _text.windows(hashes, first, n)
            doc = np.searchsorted(first, place, "right") - 1
            docs.append(doc[own[doc]])
            keys.append(h[own[doc]] ^ U(n if n < width else 0))
    if not docs:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort([key, doc])
    doc, key = doc[order], key[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    return key[new], np.searchsorted(doc[new], np.arange(len(at)))


def set_ids(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(keys, dtype=U)])
    return _text.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def picked(keys: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the given numbers, one after another, and where each starts."""
    n = at[which + 1] - at[which]
    edge = np.concatenate([[0], np.cumsum(n)])
    return keys[np.arange(edge[-1]) + np.repeat(at[which] - edge[:-1], n)], edge


def sketches_of(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingles per hash bin, at most 255.  Two sets differ at least by what their sketches do."""
    place = np.repeat(np.arange(len(at) - 1), np.diff(at)) * BINS + (_text.mix(keys) >> U(56)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=(len(at) - 1) * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def pack_set(shingles: np.ndarray) -> bytes:
    """Sorted distinct shingles by the upper 48 bits of their hashes."""
    return np.ascontiguousarray(shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack_set(b) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def short(sig: np.ndarray, bits: int) -> np.ndarray:
    """A signature as buckets know it: its bucket and LOW bits more.  A chance meeting costs a check."""
    return (sig >> U(64 - bits)) << U(LOW) | sig & U((1 << LOW) - 1)


def bands(largest: int) -> list[int]:
    out = [4]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * 1.35)))
    return out


def signatures(keys: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets, with the band and row mixed in, and the set of each."""
    sizes = np.diff(at)
    limits = np.array(bands(int(sizes.max(initial=0))), np.int64)
    spread = _text.mix(keys)
    own, who, out = np.searchsorted(limits, sizes, "left"), [], []
    for r in range(len(limits)):
        which = np.flatnonzero((own >= r) & (sizes > 0) & (percent * sizes <= 100 * limits[r]))  # its own, or it is a guest
        k = int((100 - percent) * (limits[r] + limits[r] * 100 / percent) / (100 + percent) + 1e-9)
        if k == 0 or not len(which):
            continue  # only equal sets, and those are one already
        if k <= FEW:
            n1, n2, m = 1, k + 2, 1
        else:
            m = 1 + k // 24
            n1, n2 = k // 3 + m, 4
        size = n1 * n2
        i, j = np.triu_indices(n2, 1)
        name = np.arange(n1 * len(i), dtype=U).reshape(n1, -1) + U(int(limits[r]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        name = _text.mix(name)
        for x in range(0, len(which), max(1, (1 << 18) // size)):
            some = which[x : x + max(1, (1 << 18) // size)]
            own_spread, edge = picked(spread, at, some)
            part = np.repeat(np.arange(len(some)) * size, np.diff(edge)) + ((own_spread >> U(8)) % U(size)).astype(np.int64)
            held, low, high = (np.bincount(part, w, len(some) * size) for w in (None, own_spread & U(0xFFFFFFFF), own_spread >> U(32)))
            held = held.reshape(-1, n1, n2)
            sums = (low.astype(U) + (high.astype(U) << U(32))).reshape(-1, n1, n2)
            empty = held[:, :, i] + held[:, :, j] == 0
            sig = _text.mix((sums[:, :, i] + sums[:, :, j]) ^ name)
            keep = ~empty | (empty.any(axis=2).sum(axis=1) >= m)[:, None, None]
            out.append(sig[keep])
            who.append(np.repeat(some, keep.sum(axis=(1, 2))))
    return (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, U), np.zeros(0, np.int64))


def _signer(width: int, percent: int, bits: int, local_hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, [pa.int64(), pa.int32(), *[pa.binary()] * 3], strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        def block(d, t, texts):
            ids, sizes, known, sigs, owners, sketches = [], [], {}, [], [], []
            for _, data, at in _text.slices(texts, _text.SMALL_SLICE_BYTES):
                keys, edge = sets_of(data, at, width)
                own, size = set_ids(keys, edge), np.diff(edge)
                ids.append(own), sizes.append(size)
                fresh = [i for i, x in enumerate(own.tolist()) if size[i] and x not in known and known.setdefault(x, (len(known), int(size[i])))]
                if fresh:
                    place = np.array([known[x][0] for x in own[fresh].tolist()])
                    keys, edge = picked(keys, edge, np.array(fresh))
                    sig, who = signatures(keys, edge, percent)
                    sigs.append(sig), owners.append(place[who]), sketches.append(sketches_of(keys, edge))
            table = np.array([[i, n] for i, (_, n) in known.items()], "<i8").reshape(-1, 2)
            yield (abs(hash((int(d[0]), len(d)))) % (1 << bits), 2, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), d.astype("<i8").tobytes() + t.astype("<i8").tobytes())
            if not sigs:
                return
            sketches = np.concatenate(sketches)
            for i in range(0, len(table), 256):
                yield (abs(hash((int(d[0]), i))) % (1 << bits), 3, zlib.compress(sketches[i : i + 256].tobytes(), 1), b"", table[i : i + 256].tobytes())
            names = np.ascontiguousarray(table[:, 0])
            who, sig = np.concatenate(owners), np.concatenate(sigs)
            del sigs, owners, sketches
            order = np.argsort(sig)
            s = sig[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
            reps = np.diff(np.append(new, len(s)))
            hot = np.repeat(reps >= local_hot, reps)
            if hot.any():
                own = order[hot]
                for i in range(0, len(own), 1 << 14):
                    x = own[i : i + (1 << 14)]
                    yield (int(sig[x[-1]] & U(0x7FFFFFFF)) + int(d[0]) & (1 << bits) - 1, 1, short(sig[x], bits).astype("<u8").tobytes(), b"", names[who[x]].tobytes())
                first = np.zeros(len(s), bool)
                first[new] = True
                order = order[~hot | first]
                hot = hot[~hot | first]
            top = (sig[order] >> U(64 - bits)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]])) if len(top) else np.zeros(1, int)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                # places: twice the set's number, plus one where the signature is hot here
                place = 2 * who[order[a:b]] + hot[a:b]
                by = np.argsort(place, kind="stable")
                place = place[by]
                sets, place2 = np.unique(place >> 1, return_inverse=True)
                low = sig[order[a:b][by]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8]
                yield (int(top[a]), 0, np.ascontiguousarray(low).tobytes(), pack_places(2 * place2 + (place & 1)), names[sets].tobytes())

        for batch in batches:
            _, at = _text.utf8(batch.column(2))
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
                part, rows = batch.slice(i, j - i), []
                for row in block(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)):
                    rows.append(row)
                    if len(rows) == 16:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)
                i = j

    return _text.tidy(run)


def _bucket(bits: int):
    def run(table: pa.Table) -> pa.Table:
        kind, entries, places, sets = (table[c].to_pylist() for c in ("kind", "entries", "places", "sets"))
        bucket = table["bucket"][0].as_py()
        rows = []

        def add(k, sig, ids, n, d=None, t=None, sketches=None):
            none = np.zeros(len(ids), np.int64)
            cols = [pa.array(np.full(len(ids), k, np.int32)), pa.array(sig), pa.array(ids), pa.array(n.astype(np.int32)), pa.array(none if d is None else d), pa.array(none if t is None else t), pa.array(sketches or [None] * len(ids), pa.binary())]
            rows.append(pa.table(cols, names=[x.split()[0] for x in FOUND.split(", ")]))

        real = [i for i, k in enumerate(kind) if k == 0]
        if real:
            low = np.frombuffer(b"".join([entries[i] for i in real]), np.uint8).reshape(-1, LOW // 8)
            sig = np.full(len(low), U(bucket) << U(LOW), U)
            for i in range(LOW // 8):
                sig |= low[:, i].astype(U) << U(8 * i)
            who, hot = [], []
            for i in real:
                place = unpack_places(places[i])
                who.append(np.frombuffer(sets[i], "<i8")[place >> 1]), hot.append(place & 1)
            who, hot = np.concatenate(who), np.concatenate(hot).astype(bool)
            order = np.lexsort([who, sig])
            s, p, h = sig[order], who[order], hot[order]
            once = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
            lead = np.flatnonzero(once)
            h = np.add.reduceat(h, lead) > 0
            s, p = s[once], p[once]
            lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            many = np.diff(np.append(lead, len(s)))
            h = np.repeat(np.add.reduceat(h, lead) > 0, many)  # may have more sets among the plain rows
            none = np.zeros(len(s), np.int64)
            add(1, s[h].view(np.int64), p[h], none[h])
            whole = ~h & np.repeat(many > 2, many)
            add(0, s[whole].view(np.int64), p[whole], none[whole])
            pair = ~h & np.repeat(many > 1, many)
            pair[lead] = False
            a, b = np.repeat(p[lead], many)[pair], p[pair]
            order = np.lexsort([b, a])
            a, b = a[order], b[order]
            lead = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else none[:0]
            add(4, a[lead], b[lead], np.diff(np.append(lead, len(a))))
        for i, k in enumerate(kind):
            if k == 1:
                p = np.frombuffer(sets[i], "<i8")
                add(1, np.frombuffer(entries[i], "<u8").view(np.int64), p, np.zeros(len(p), int))
            elif k == 2:
                ids, n = np.frombuffer(entries[i], "<i8"), np.frombuffer(places[i], "<i8")
                d, t = np.split(np.frombuffer(sets[i], "<i8"), 2)
                add(2, np.zeros(len(ids), np.int64), ids, n, d, t)
            elif k == 3:
                own, raw = np.frombuffer(sets[i], "<i8").reshape(-1, 2), zlib.decompress(entries[i])
                add(3, np.zeros(len(own), np.int64), own[:, 0], own[:, 1], sketches=[raw[x : x + BINS] for x in range(0, len(raw), BINS)])
        return pa.concat_tables(rows) if rows else pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in FOUND.split(", ")]).empty_table()

    return run


def _shingler(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, at in _text.slices(batch.column(1), _text.SMALL_SLICE_BYTES):
                keys, edge = sets_of(data, at, width)
                own = [pack_set(keys[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(own)), pa.array(own, pa.binary())], names=["set", "shingles"])

    return _text.tidy(run)


def linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two non-empty sets of ascending numbers have enough in common."""
    if len(u) > len(v):
        u, v = v, u
    common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def _checker(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = []
            for p, q in zip(x, y, strict=True):
                keep.append(linked(unpack_set(p.as_buffer()), unpack_set(q.as_buffer()), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return _text.tidy(run)


def _screen(percent: int):
    """Drops pairs whose sketches alone differ by more than linked sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c, n, m, x, y = batch.columns
            u, v = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in (x, y))
            least = np.abs(u - v).sum(axis=1)
            mask = pa.array(least * (100 + percent) <= (100 - percent) * (n.to_numpy().astype(np.int64) + m.to_numpy()))
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask), c.filter(mask)], names=["a", "b", "c"])

    return _text.tidy(run)


def possible_pairs(n: np.ndarray, comp: np.ndarray, sketches: np.ndarray, groups: Iterator[np.ndarray], percent: int, step: int = 64):
    """(numbers, numbers) of the pairs of a group that stand in different components and whose sizes and sketches allow a link.

    n ascends; a group lists numbers in ascending order, so each set meets only those of sizes it
    could link with.  The group's largest component's own sets never meet."""
    for own in groups:
        names, counts = np.unique(comp[own], return_counts=True)
        if len(names) < 2:
            continue
        main = comp[own] == names[np.argmax(counts)]
        others, size = np.flatnonzero(~main), n[own]
        for i in range(0, len(others), step):
            rows = others[i : i + step]
            first = int(np.searchsorted(size, -(-percent * size[rows[0]] // 100), "left"))
            last = int(np.searchsorted(size, 100 * size[rows[-1]] // percent, "right"))
            for j in range(first, last, 1024):
                cols = np.arange(j, min(j + 1024, last))
                cols = cols[main[cols] | (cols > rows[0])]
                u, v = own[rows], own[cols]
                near = (comp[u, None] != comp[None, v]) & (main[None, cols] | (rows[:, None] < cols[None, :]))
                p, q = np.nonzero(near)
                for x in range(0, len(p), 1 << 14):
                    a, b = u[p[x : x + (1 << 14)]], v[q[x : x + (1 << 14)]]
                    least = np.abs(sketches[a].astype(np.int16) - sketches[b]).sum(axis=1)
                    ok = least * (100 + percent) <= (100 - percent) * (n[a] + n[b])
                    if ok.any():
                        yield a[ok], b[ok]


def _members(left: pa.Table, info: pa.Table):
    """A bin's sets by size, and the groups (of numbers of sets) that share a signature, each once."""
    n, ids, comp = (info[c].to_numpy() for c in ("n", "set", "component"))
    by = np.lexsort([ids, n])
    n, ids, comp = n[by].astype(np.int64), ids[by], comp[by]
    sketches = np.frombuffer(b"".join(info["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[by]
    order = np.argsort(ids)
    number = order[np.searchsorted(ids[order], left["set"].to_numpy())]
    sig = left["sig"].to_numpy()
    order = np.lexsort([number, sig])
    sig, number = sig[order], number[order]
    edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, int)
    if (np.diff(edge).astype(float) ** 2).sum() > float(len(ids)) ** 2:
        groups = [np.arange(len(ids))]  # cheaper, and all pairs of the signatures are among them
    else:
        groups = [np.frombuffer(x, np.int64) for x in {number[a:b].tobytes(): 0 for a, b in zip(edge[:-1], edge[1:], strict=True)}]
    return by, n, ids, comp, sketches, groups


def _possible(percent: int):
    """The sets of a bin that have a possible partner in it."""

    def run(left: pa.Table, info: pa.Table) -> pa.Table:
        if not len(left) or not len(info):
            return pa.table({"bin": pa.array([], pa.int64()), "set": pa.array([], pa.int64())})
        _, n, ids, comp, sketches, groups = _members(left, info)
        found = np.zeros(len(ids), bool)
        for a, b in possible_pairs(n, comp, sketches, groups, percent):
            found[a] = found[b] = True
        return pa.table({"bin": pa.array(np.full(int(found.sum()), left["bin"][0].as_py()), pa.int64()), "set": pa.array(ids[found])})

    return run


def _forest(percent: int):
    """Links between the components of a bin, none that its others imply."""

    def run(left: pa.Table, info: pa.Table) -> pa.Table:
        links = []
        if len(left) and len(info):
            by, n, ids, comp, sketches, groups = _members(left, info)
            shingles = info["shingles"].combine_chunks() if isinstance(info["shingles"], pa.ChunkedArray) else info["shingles"]
            _, label = np.unique(comp, return_inverse=True)
            open_: dict[int, np.ndarray] = {}

            def shingles_of(i: int) -> np.ndarray:
                if len(open_) > 4096:
                    open_.clear()
                if i not in open_:
                    open_[i] = unpack_set(shingles[int(by[i])].as_buffer())
                return open_[i]

            for p, q in possible_pairs(n, comp, sketches, groups, percent):
                while len(p):
                    apart = label[p] != label[q]
                    p, q = p[apart], q[apart]
                    for i, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                        if linked(shingles_of(a), shingles_of(b), percent):
                            links.append((int(ids[a]), int(ids[b])))
                            label[label == label[b]] = label[a]
                            p, q = p[i + 1 :], q[i + 1 :]
                            break
                    else:
                        break
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 0]), "b": pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 1])})

    return run


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bucket_bytes: int = 8 << 20, local_hot: int = 8, bin_rows: int = BIN_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, components): one row (_d, _t, set, n) per document, linked pairs (a, b) of
    different sets that connect every component, and (node, component) of those sets."""
    own = _store.keyed(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(1.5 * size / bucket_bytes).bit_length())
    packed = own.select("_d", "_t", "text").mapInArrow(_signer(width, percent, bits, local_hot), PACKED)
    found = _store.written(packed.groupBy("bucket").applyInArrow(_bucket(bits), FOUND), "found")
    classes = found.where("kind = 2").select("_d", "_t", "set", "n")
    hot = _store.written(found.where("kind = 1").select("sig", "set").distinct(), "hot")
    members = found.where("kind = 0").select("sig", "set").unionByName(hot)
    sets = _store.written(found.where("kind = 3").select("set", "n", "sketch").dropDuplicates(["set"]), "sets")

    def shingled(needed: DataFrame) -> DataFrame:
        """(set, shingles) of the sets needed, from one of their texts."""
        places = _store.written(classes.join(needed.distinct(), "set", "left_semi").groupBy("set").agg(F.min(F.struct("_d", "_t")).alias("r")).select("set", "r._d", "r._t"), "needed")
        small = places.count() <= BROADCAST_SETS
        texts = own.select("_d", "_t", "text").join(F.broadcast(places) if small else places, ["_d", "_t"]).select("set", "text")
        return _store.written(texts.mapInArrow(_shingler(width), "set long, shingles binary").dropDuplicates(["set"]), "shingles")

    def checked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that link, by their texts' shingles."""
        shingles = shingled(pairs.select(F.col("a").alias("set")).union(pairs.select("b")))
        x = shingles.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
        y = shingles.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return _store.written(both.mapInArrow(_checker(percent), "a long, b long"), "links")

    least = hot.groupBy("sig").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("many")).where("many > 1").select("sig", "a")
    stars = hot.withColumnRenamed("set", "b").join(least, "sig").where("a <> b").select("a", "b", F.lit(1).alias("c"))
    stars = stars.unionByName(found.where("kind = 4").select(F.col("sig").alias("a"), F.col("set").alias("b"), F.col("n").alias("c")))
    met = stars.groupBy("a", "b").agg(F.sum("c").alias("c"))
    met = met.join(sets.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    met = met.join(sets.select(F.col("set").alias("a"), "n", F.col("sketch").alias("x")), "a")
    met = met.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b", "c", "n", "m", "x", "y")
    met = _store.written(met.mapInArrow(_screen(percent), "a long, b long, c long"), "met")
    star = met.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    links = checked(star)
    comp = components(links)

    # the other stars whose ends are still apart
    other = met.join(star, ["a", "b"], "left_anti").select("a", "b")
    other = other.join(comp.toDF("b", "y"), "b", "left").join(comp.toDF("a", "x"), "a", "left")
    other = _store.written(other.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b"), "other")
    if not other.isEmpty():
        links = links.unionByName(checked(other))
        comp = components(links)

    # the pairs of a signature without its least set, in bins of about bin_rows rows
    placed = members.join(comp.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    open_ = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("set").alias("pivot"), F.count(F.lit(1)).alias("many")).where("x <> y and many > 2")
    many = open_.groupBy("pivot").agg(F.ceil(F.sum("many") / bin_rows).alias("salts"))
    bins = open_.join(many, "pivot").select("sig", "pivot", F.xxhash64("pivot", F.pmod("sig", "salts")).alias("bin"))
    left = _store.written(placed.join(bins, "sig").where("set <> pivot").select("bin", "sig", "set", "component"), "left")
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  new names for the same table's columns
    info = fresh(left.select("bin", "set", "component").distinct()).join(sets, "set")
    possible = _store.written(left.select("bin", "sig", "set").groupBy("bin").cogroup(fresh(info).groupBy("bin")).applyInArrow(_possible(percent), "bin long, set long"), "possible")
    if possible.isEmpty():
        return classes, links, comp
    info = info.join(possible, ["bin", "set"], "left_semi").join(shingled(possible.select("set")), "set")
    some = left.select("bin", "sig", "set").join(possible, ["bin", "set"], "left_semi")
    more = _store.written(some.groupBy("bin").cogroup(fresh(info).groupBy("bin")).applyInArrow(_forest(percent), "a long, b long"), "more")
    # the components so far stand for the links that made them
    return classes, links.unionByName(more), components(comp.toDF("a", "b").unionByName(more))


def _placed(docs: DataFrame, **options) -> DataFrame:
    """(_d, _t, n, component) of each document; without words, component is null."""
    classes, _, comp = link(docs, **options)
    both = classes.join(comp.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    return _store.written(both.select("_d", "_t", "n", F.when(F.col("n") > 0, F.col("component")).alias("component")), "placed")


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """One row per document: its set's size and the least id of its component."""
    both = _placed(docs, width=width, percent=percent, **options)
    least = both.where("n > 0").groupBy("component").agg(F.min("_d").alias("least"))
    out = both.join(least, "component", "left").withColumn("least", F.coalesce("least", "_d"))
    real = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return out.select(real("_d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("least").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all its columns: the one with the least id, of such the
    least text hash, of rows that repeat any one.  Documents without words all stay."""
    both = _placed(docs, **options)
    linked = both.where("component is not null")
    first = linked.groupBy("component").agg(F.min(F.struct("_d", "_t")).alias("r")).select("r._d", "r._t").withColumn("first", F.lit(True))
    spare = linked.join(first, ["_d", "_t"], "left").groupBy("_d", "_t").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("rows")).where("first is null or rows > 1")
    spare = _store.written(spare, "spare")
    d, t, again, number = _store.private(docs, 4)
    marked = docs.withColumns({d: _store.key_of("doc_id"), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    gone = spare.where("first is null").select(F.col("_d").alias(d), F.col("_t").alias(t))
    kept = marked.join(_store.few(gone), [d, t], "left_anti")
    twice = spare.where("first").select(F.col("_d").alias(d), F.col("_t").alias(t), F.lit(True).alias(again))
    if not twice.isEmpty():  # rows that repeat: few keys, each with rows of one id and text
        kept = kept.join(_store.few(twice), [d, t], "left")
        one = kept.where(F.col(again)).withColumn(number, F.row_number().over(Window.partitionBy(d, t).orderBy(d))).where(F.col(number) == 1)
        kept = kept.where(F.col(again).isNull()).select(*docs.columns).unionByName(one.select(*docs.columns))
    return kept.select(*docs.columns)
