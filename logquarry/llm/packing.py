"""Packing of documents into training sequences by multiway number partitioning.

Each task packs its own documents: no shuffle, and no group that grows with the data.
Every document is its ids followed by an end id.  Runs of `capacity` ids become sequences of
their own.  What is left is cut into pieces of at most `max_piece` ids; groups of pieces are
spread over windows by Karmarkar-Karp differencing: two partial partitions with the largest
spreads are merged, the heavy windows of one with the light windows of the other, until one
partition is left.  It starts with the fewest windows that could hold the pieces, and takes
one window more whenever the fullest is over capacity.

Null texts are empty and yield the end id alone.  Rows that repeat are packed each.  An empty
table yields no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the numbers of `sizes` dealt to k windows of nearly equal sums.

    A partial partition lists only its windows in use, heaviest first; a window is
    (sum, numbers), where numbers is one number or a pair of such."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = len(a) + len(b) - k
        if shared <= 0:
            merged = a + b
        else:  # the lightest of a meet the lightest of b crosswise: heavy with light
            own = len(a) - shared
            merged = a[:own] + b[: len(b) - shared] + [(x + y, (p, q)) for (x, p), (y, q) in zip(a[own:], b[len(b) - shared :][::-1], strict=True)]
        merged.sort(key=itemgetter(0), reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, fresh, merged))
        fresh += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        stack, flat = [tree], []
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                flat.append(t)
        out.append(flat)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows from the lower bound on for which differencing stays within capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        dealt = differencing(sizes, k)
        if max((sum(sizes[i] for i in w) for w in dealt), default=0) <= capacity:
            return dealt
        k += 1


def packer(path: str | None, capacity: int, max_piece: int, group: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder as shared_encoder

        encoder = shared_encoder(path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        whole: list[tuple] = []
        rest: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (7 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def dealt(rows: list[tuple]) -> list[tuple]:
            nonlocal number
            out = []
            for w in windows([r[2] for r in rows], capacity):
                offset = 0
                for i in w:
                    out.append((*rows[i][:5], number, offset, *rows[i][5:]))
                    offset += rows[i][2]
                number += 1
            return out

        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text"))
            for first, ids, at in encoder.batches(texts, 2 * _text.SLICE_BYTES):
                ids = np.insert(ids.astype("<u4"), at[1:], end_id)
                at = at + np.arange(len(at))
                for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), first):
                    full = (b - a) // capacity * capacity
                    cuts = [*range(0, full, capacity), *range(full, b - a, max_piece)]
                    for x, y in zip(cuts, [*cuts[1:], b - a], strict=True):
                        piece = ids[a + x : a + y]
                        r = (names[row], x, y - x, zlib.crc32(piece), b - a, *([piece.tolist()] if with_ids else []))
                        if x < full:
                            whole.append((*r[:5], number, 0, *r[5:]))
                            number += 1
                        else:
                            rest.append(r)
                    while len(rest) >= group:
                        whole += dealt(rest[:group])
                        rest = rest[group:]
                del ids
                _text.release()  # else what the allocators keep grows with the task
                if len(whole) > 20_000:
                    yield flush(whole)
                    whole = []
        yield flush(whole + dealt(rest))

    return _text.tidy(run, keeps=True)


def pack(docs: DataFrame, capacity: int = 1024, max_piece: int = 256, group: int = 1024, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document and place there, and its sequence and place there.

    with_ids adds the piece's ids.  capacity is the ids of a sequence, group the pieces dealt
    together (it bounds the padding to about one window in group * max_piece / capacity)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(packer(tokenizer, capacity, max_piece, group, end_id, with_ids), SCHEMA + ", ids array<long>" * with_ids)
