"""Byte-level integer and column coding for interchange: zigzag, LEB128, delta and raw columns."""

from __future__ import annotations

import re

import numpy as np

# Fixed values of the container format.
MAGIC, WRAPPER, VERSION = b"LOGZ", b"ZZST", 1
BACKENDS = {"none": 0, "gzip": 1, "zstd": 2, "lzma": 3}
RAW, NUMERIC, DELTA, DICTIONARY = 0, 1, 2, 3


class Truncated(ValueError):
    """The bytes end inside a value."""


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(z: int) -> int:
    return -(z + 1 >> 1) if z & 1 else z >> 1


def uvarint(n: int) -> bytes:
    groups = [n >> s & 0x7F for s in range(0, max(1, n.bit_length()), 7)]
    return bytes([g | 0x80 for g in groups[:-1]] + groups[-1:])


def varint(n: int) -> bytes:
    return uvarint(zigzag(n))


def uvarints(values: np.ndarray) -> bytes:
    """The LEB128 forms of many unsigned numbers, one after another."""
    z = np.asarray(values, np.uint64)
    if not len(z):
        return b""
    width = max(1, -(-int(z.max()).bit_length() // 7))
    rest = z[:, None] >> (np.arange(width, dtype=np.uint64) * np.uint64(7))
    more = np.zeros(rest.shape, bool)
    more[:, :-1] = rest[:, 1:] > 0
    groups = (rest & np.uint64(0x7F)).astype(np.uint8) | (more.astype(np.uint8) << 7)
    kept = np.ones(rest.shape, bool)
    kept[:, 1:] = rest[:, 1:] > 0
    return groups[kept].tobytes()


def varints(values: np.ndarray) -> bytes:
    n = np.asarray(values, np.int64)
    return uvarints(((n << 1) ^ (n >> 63)).view(np.uint64))


def fixed(n: int, size: int) -> bytes:
    return n.to_bytes(size, "little")


class Cursor:
    """Reads values one after another; raises Truncated where the bytes end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def uvarint(self) -> int:
        value = shift = 0
        while (b := self.take(1)[0]) & 0x80:
            value |= (b & 0x7F) << shift
            shift += 7
            if shift > 63:
                raise ValueError("a varint of more than ten bytes")
        return value | b << shift

    def varint(self) -> int:
        return unzigzag(self.uvarint())

    def uvarints(self, n: int) -> np.ndarray:
        """The next n unsigned numbers."""
        if n <= 0:
            return np.zeros(0, np.uint64)
        window = np.frombuffer(self.data, np.uint8, min(10 * n, len(self.data) - self.at), self.at)
        ends = np.flatnonzero(window < 0x80)[:n]
        if len(ends) < n:
            raise Truncated(f"{n} numbers at {self.at} of {len(self.data)}")
        starts = np.concatenate([[0], ends[:-1] + 1])
        if (ends - starts > 9).any():
            raise ValueError("a varint of more than ten bytes")
        used = window[: ends[-1] + 1].astype(np.uint64)
        place = np.arange(len(used)) - np.repeat(starts, ends - starts + 1)
        self.at += len(used)
        return np.bitwise_or.reduceat((used & np.uint64(0x7F)) << (place * 7).astype(np.uint64), starts)

    def varints(self, n: int) -> np.ndarray:
        z = self.uvarints(n)
        return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)

    def fixed(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def short_string(self) -> str:
        return self.take(self.fixed(2)).decode()


def short_string(s: str) -> bytes:
    raw = s.encode()
    if len(raw) > 0xFFFF:
        raise ValueError("a string of more than 65535 bytes")
    return len(raw).to_bytes(2, "little") + raw


CANONICAL = re.compile(r"(0|-?[1-9][0-9]*)\Z")


def _weighted_entropy(numbers: np.ndarray) -> float:
    known, counts = np.unique(numbers, return_counts=True)
    share = counts / len(numbers)
    weight = np.where(known <= 0, 1.0, np.maximum(1.0, np.log2(np.maximum(known, 0).astype(float) + 1)))
    return float(-(weight * share * np.log2(share)).sum())


def choose(values: list[str]) -> int:
    """The kind of a column by the rule of the column profile: differences of canonical whole numbers
    that weigh no more than the numbers, none below -1; a dictionary if less than half is distinct; else raw."""
    if len(values) < 3:
        return RAW
    known = set(values)
    if all(CANONICAL.match(v) and -1 <= int(v) < 2**63 - 1 for v in known):
        numbers = np.array([int(v) for v in values], np.int64)
        steps = np.diff(numbers, prepend=0)
        if steps.min() >= -1 and _weighted_entropy(steps) <= _weighted_entropy(numbers) + 1e-9:
            return DELTA
    return DICTIONARY if len(known) / len(values) < 0.5 else RAW


def column(values: list[str], kind: int, codes: list[int] | None = None) -> bytes:
    """An encoded column: the kind, then its body."""
    out = [bytes([kind]), uvarint(len(values))]
    if kind == DELTA:
        out += [uvarint(len(values)), varints(np.diff(np.array([int(v) for v in values], np.int64), prepend=np.int64(0)))]
    elif kind == DICTIONARY:
        out.append(varints(np.array(() if codes is None else codes, np.int64)))
    else:
        for raw in (v.encode() for v in values):
            out += [uvarint(len(raw)), raw]
    return b"".join(out)


def read_column(c: Cursor, dictionary: list[str] | None = None) -> list[str]:
    kind, n = c.take(1)[0], c.uvarint()
    if kind == DELTA:
        return [str(x) for x in np.cumsum(c.varints(c.uvarint())).tolist()]
    if kind == DICTIONARY:
        known = dictionary or []
        return [known[i] if 0 <= i < len(known) else "" for i in c.varints(n).tolist()]
    return [c.take(c.uvarint()).decode() for _ in range(n)]


def wrap(payload: bytes, backend: str = "zstd", level: int = 6) -> bytes:
    """The payload, compressed and framed; bare without a backend."""
    if backend == "none":
        return payload
    if backend == "gzip":
        import gzip

        blob = gzip.compress(payload, level)
    elif backend == "zstd":
        import zstandard

        blob = zstandard.ZstdCompressor(level=level).compress(payload)
    else:
        raise ValueError(f"backend {backend!r} is not available")
    return WRAPPER + bytes([BACKENDS[backend]]) + len(blob).to_bytes(8, "little") + blob


def unwrap(data: bytes) -> bytes:
    c = Cursor(data)
    magic = c.take(4)
    if magic == MAGIC:
        return data
    if magic != WRAPPER:
        raise ValueError("not an archive")
    kind = c.take(1)[0]
    blob = c.take(c.fixed(8))
    if kind == BACKENDS["gzip"]:
        import gzip

        return gzip.decompress(blob)
    if kind == BACKENDS["zstd"]:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    raise ValueError(f"backend {kind} is not available")
