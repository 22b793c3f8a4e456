"""Vectorised byte-level text kernels: word boundaries and rolling hashes with numpy.

All hashes are polynomials modulo 2**64 taken from prefix sums, then mixed, so the hash of
any span costs two look-ups.  Texts are handled in slices of bounded size; one document is
never split.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BYTE = U(0xD6E8FEB86659FD93)
_SEQ = U(0xC2B2AE3D27D4EB4F)

#: Bytes of text handled at once; arrays of eight bytes per byte of text stay near 16 MB.
SLICE_BYTES = 2 << 20
#: The same where some hundred bytes are held for each byte of text.
SMALL_SLICE_BYTES = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (base, inverse))
        if size <= SLICE_BYTES + (1 << 16):
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it


def release() -> None:
    """Gives memory that is free in this worker back to the machine; workers outlive their tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What a task may leave for the next one of its kind; tasks of other kinds drop it.
kept: dict = {}


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A task's function that ends by releasing what it used."""

    def inner(batches: Iterator) -> Iterator:
        from logquarry.llm import _text

        if not keeps and _text.kept:
            _text.kept.clear()
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(29)
    return x


def mask(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    table = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
    table[list(inside if inside is not None else outside)] = inside is not None
    return table


#: Words are runs of anything but ASCII white space.
SPACE_SEPARATED = mask(outside=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALPHANUMERIC = mask(inside=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each starts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, data, offsets) of consecutive groups of whole documents of bounded size."""
    data, at = utf8(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word's number of each document."""
    m = kind[data]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edges = at[(at > 0) & (at < len(m))]
    first[edges] = m[edges]
    last[edges - 1] = m[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    up, _ = powers(base, len(values))
    return np.concatenate([np.zeros(1, U), np.cumsum(values * up)])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    _, down = powers(base, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _ODD)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix(data.astype(U) + U(1), _BYTE), start, end, _BYTE)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word and Rabin-Karp hash of every run of n words of one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    room = np.zeros(len(hashes), np.int64)
    sizes = np.diff(first)
    room = np.repeat(first[1:], sizes) - np.arange(len(hashes))
    start = np.flatnonzero(room >= n)
    return start, span_hash(prefix(hashes, _SEQ), start, start + n, _SEQ)


def grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and Rabin-Karp hash of every run of n bytes of one document."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    start = np.flatnonzero(room >= n)
    return start, span_hash(prefix(data.astype(U) + U(1), _BYTE), start, start + n, _BYTE)


def merge_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given half-open intervals; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]


def covered(n: int, start: np.ndarray, width: int) -> np.ndarray:
    """Whether each of n places lies within a window of the given width from one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
