"""Byte containers: log chunks with their templates and dictionaries in one framed blob each.

A table containers(file, chunk, n_lines, n_bytes, blob) has a row per chunk of lines, so neither
writing nor reading holds more than `chunk_lines` lines of a file in a task, and a large file is
spread over tasks.  Every blob is complete: header, entry table, header fields, templates in use,
dictionaries, encoded columns, and the lines that no template restores, verbatim.

Line numbers are positions: the chunk's ordinal, which the entry table holds, times the lines of a
chunk.  So the lines of a file must be numbered from 0 without gaps.  A blob may hold several
entries and chunks; one that is written here holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HEAD_LENGTH, WILDCARD
from ..operators import mining, profile
from . import codec
from .archive import codec as known_backend

# Flags of the header, kinds of template tokens, tags of dictionaries.
MULTIPLE, CHECKSUM = 1, 2
LITERAL, VARIABLE = 0, 1
OF_HEADER, OF_VARIABLES = 0, 1
MOST = 0xFFFF  # bytes of a short string, tokens of a template
SUFFIX = ".logz"

BLOBS = "file string, chunk long, n_lines long, n_bytes long, blob binary"
KINDS = {codec.RAW: "raw", codec.NUMERIC: "raw", codec.DELTA: "delta", codec.DICTIONARY: "dict"}


@dataclass
class Entry:
    name: str
    n_bytes: int
    n_lines: int
    ordinals: list[int] = field(default_factory=list)


@dataclass
class Field:
    format: str = "%s"
    widths: list[int] = field(default_factory=list)
    delimiter: str = " "


@dataclass
class Container:
    entries: list[Entry] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    templates: list[list[str | None]] = field(default_factory=list)
    dictionaries: list[tuple[int, int, list[str]]] = field(default_factory=list)
    chunks: list[tuple[int, bytes]] = field(default_factory=list)
    failed: dict[str, tuple[list[bytes], list[bytes]]] = field(default_factory=dict)
    chunk_lines: int = 100_000
    window: int = 20
    head: int = HEAD_LENGTH


def _many(items: list, one) -> bytes:
    return codec.fixed(len(items), 4) + b"".join(one(x) for x in items)


def _blob(raw: bytes) -> bytes:
    return codec.fixed(len(raw), 4) + raw


def dump(c: Container, backend: str = "zstd", level: int = 6) -> bytes:
    """All sections in order, framed and compressed; the header holds a checksum of what follows it."""
    entry = lambda e: codec.short_string(e.name) + codec.fixed(e.n_bytes, 8) + codec.fixed(e.n_lines, 8) + _many(e.ordinals, lambda o: codec.fixed(o, 8)) + codec.fixed(0, 8)
    widths = lambda f: b"\0\1" + bytes([min(f.widths[0], 127)]) if f.widths else b"\1\xff\0"  # noqa: E731  # of text: -1, any width
    part = lambda f: bytes([not f.widths, bool(f.widths)]) + codec.short_string(f.format) + widths(f) + codec.short_string(f.delimiter)
    token = lambda t: bytes([VARIABLE if t is None else LITERAL]) + codec.short_string(WILDCARD if t is None else t)
    body = b"".join(
        [
            _many(c.entries, entry),
            codec.fixed(c.head, 4) + b"\0" + codec.short_string("") + _many(c.fields, part),
            _many(c.templates, lambda t: codec.fixed(len(t), 2) + b"".join(map(token, t))),
            _many(c.dictionaries, lambda d: bytes([d[0]]) + codec.fixed(d[1], 4) + _many(d[2], codec.short_string)),
            _many(c.chunks, lambda x: x[0].to_bytes(4, "little", signed=True) + _blob(x[1])),
            _many(list(c.failed.items()), lambda x: codec.short_string(x[0]) + _many(x[1][0], _blob) + _many(x[1][1], _blob)),
        ]
    )
    flags = CHECKSUM | (MULTIPLE if len(c.entries) > 1 else 0)
    head = codec.MAGIC + codec.fixed(codec.VERSION, 2) + codec.fixed(flags, 2) + bytes([codec.BACKENDS[backend]]) + codec.fixed(c.chunk_lines, 4) + codec.fixed(c.window, 4) + codec.fixed(crc32(body), 4)
    return codec.wrap(head + body, backend, level)


def parse(data: bytes) -> Container:
    """The container of a blob; ValueError if it is none, of another version, cut short or damaged."""
    c = codec.Cursor(codec.unwrap(data))
    if c.take(4) != codec.MAGIC:
        raise ValueError("not a container")
    if (version := c.fixed(2)) != codec.VERSION:
        raise ValueError(f"version {version} is not known")
    flags, _, chunk_lines, window = c.fixed(2), c.take(1), c.fixed(4), c.fixed(4)
    if flags & CHECKSUM and c.fixed(4) != crc32(c.data[c.at :]):
        raise ValueError("the checksum differs")
    many = lambda one: [one() for _ in range(c.fixed(4))]
    blob = lambda: c.take(c.fixed(4))
    short = lambda: list(c.take(c.fixed(1)))

    def entry() -> Entry:
        e = Entry(c.short_string(), c.fixed(8), c.fixed(8), many(lambda: c.fixed(8)))
        c.fixed(8)
        return e

    def part() -> Field:
        c.take(2)
        form, _ = c.short_string(), short()
        return Field(form, short(), c.short_string())

    def token() -> str | None:
        kind, value = c.take(1)[0], c.short_string()
        return None if kind == VARIABLE else value

    entries = many(entry)
    head, _, _ = c.fixed(4), c.take(1), c.short_string()
    fields = many(part)
    templates = many(lambda: [token() for _ in range(c.fixed(2))])
    dictionaries = many(lambda: (c.take(1)[0], c.fixed(4), many(c.short_string)))
    chunks = many(lambda: (int.from_bytes(c.take(4), "little", signed=True), blob()))
    failed = {}
    for _ in range(c.fixed(4)):
        name = c.short_string()
        failed[name] = (many(blob), many(blob))
    return Container(entries, fields, templates, dictionaries, chunks, failed, chunk_lines, window, head)


class _Dictionaries:
    """Of one tag and id, in the order of the columns that use them."""

    def __init__(self, of: list[tuple[int, int, list[str]]]):
        self.left: dict[tuple[int, int], Iterator[list[str]]] = {}
        for tag, tid in {(d[0], d[1]) for d in of}:
            self.left[tag, tid] = iter([d[2] for d in of if d[:2] == (tag, tid)])

    def column(self, c: codec.Cursor, tag: int, tid: int) -> list[str]:
        uses = c.data[c.at : c.at + 1] == bytes([codec.DICTIONARY])
        return codec.read_column(c, next(self.left.get((tag, tid), iter(())), None) if uses else None)


def _columns(c: codec.Cursor, known: _Dictionaries):
    """(eids, header columns, variable columns by template) of a chunk's bytes."""
    c.uvarint()
    eids = c.varints(c.uvarint())
    heads = [known.column(c, OF_HEADER, i) for i in range(c.uvarint())]
    own = {}
    for _ in range(c.uvarint()):
        tid = c.varint()
        own[tid] = [known.column(c, OF_VARIABLES, tid) for _ in range(c.uvarint())]
    return eids, heads, own


def lines_of(c: Container) -> Iterator[tuple[str, int, list[bytes]]]:
    """(entry, number of the first line, lines) of each chunk."""
    known = _Dictionaries(c.dictionaries)
    ordinals = [iter(e.ordinals) for e in c.entries]
    streams = {e.name: [iter(s) for s in c.failed.get(e.name, ([], []))] for e in c.entries}
    for at, data in c.chunks:
        name = c.entries[at].name
        load, match = streams[name]
        eids, heads, own = _columns(codec.Cursor(data), known)
        taken = {tid: zip(*columns) if columns else None for tid, columns in own.items()}
        out = []
        for i, eid in enumerate(eids.tolist()):
            if eid <= 0:
                out.append(next(load if eid < 0 else match))
                continue
            values = iter(next(taken[eid])) if taken.get(eid) is not None else iter(())
            words = [h[i] for h in heads] + [next(values) if t is None else t for t in c.templates[eid - 1]]
            out.append(" ".join(words).encode())
        yield name, next(ordinals[at], 0) * c.chunk_lines, out


def _filled(values: pd.Series, known: np.ndarray) -> list[str]:
    """The values of lines that have them; others repeat the one before, which costs least and is not read."""
    return pd.Series(np.where(known, values, None)).ffill().bfill().tolist()


def build(name: str, ordinal: int, rows: pd.DataFrame, templates: dict[int, list[str | None]], fields: list[Field], chunk_lines: int, head: int, analysed: bool) -> Container:
    """The container of a chunk: rows in line order with eid (of lines to be restored), raw (of others), header, vars."""
    good = (rows["eid"] > 0).to_numpy()
    used = sorted(set(rows.loc[good, "eid"].tolist()))
    number = {tid: i for i, tid in enumerate(used, 1)}
    c = Container([Entry(name, int(rows["n_bytes"].sum()), len(rows), [ordinal])], fields, [templates[t] for t in used], chunk_lines=chunk_lines, head=head)

    def encoded(tag: int, tid: int, values: list[str], seen: list[str]) -> bytes:
        kind = codec.choose(seen) if analysed else codec.RAW
        if kind == codec.DICTIONARY:
            codes, known = pd.factorize(np.array(values, object))
            if max(len(v.encode()) for v in known) <= MOST:
                c.dictionaries.append((tag, tid, list(known)))
                return codec.column(values, kind, codes)
            kind = codec.RAW
        return codec.column(values, kind)

    eids = np.array([number[e] if e > 0 else e for e in rows["eid"].tolist()], np.int64)
    out = [codec.uvarint(len(rows)), codec.uvarint(len(rows)), codec.varints(eids)]
    out.append(codec.uvarint(head if used else 0))
    for i in range(head if used else 0):
        cells = rows["header"].map(lambda h, i=i: h[i] if h is not None and len(h) > i else None)
        out.append(encoded(OF_HEADER, i, _filled(cells, good), cells[good].tolist()))
    out.append(codec.uvarint(len(used)))
    for tid in used:
        vectors = rows.loc[rows["eid"] == tid, "vars"].tolist()
        columns = [list(x) for x in zip(*vectors)]
        out += [codec.varint(number[tid]), codec.uvarint(len(columns))]
        out += [encoded(OF_VARIABLES, number[tid], x, x) for x in columns]
    c.chunks.append((0, b"".join(out)))
    failed = tuple(rows.loc[rows["eid"] == e, "raw"].map(bytes).tolist() for e in (-1, 0))
    if any(failed):
        c.failed[name] = failed
    return c


def encode(lines: DataFrame, backend: str = "zstd", level: int = 6, chunk_lines: int = 100_000, analysed: bool = True, window: int = 20, head: int = HEAD_LENGTH, options: dict | None = None) -> DataFrame:
    """containers(file, chunk, n_lines, n_bytes, blob): one shuffle of the matched lines by (file, chunk).

    Columns are written as the profile's rule says (analysed) or raw.  Templates and header fields are
    joined to the chunks of their file: at most the model of a file for each of its chunks."""
    known_backend(backend)
    chunk = F.floor(F.col("line_no") / chunk_lines).alias("chunk")
    model = mining.train(lines, head=head, **(options or {}))
    short = F.size("template").between(1, MOST) & F.forall("template", lambda t: F.octet_length(t["value"]) <= MOST)
    matched = mining.gated(mining.match(lines, model, head=head)).withColumn("exact", F.col("exact") & F.coalesce(short, F.lit(False)))
    eid = F.when(F.col("exact"), F.col("eid")).when(F.col("eid") < 0, -1).otherwise(0)
    rows = matched.select("file", chunk, "line_no", eid.alias("eid"), (F.octet_length("raw") + 1).alias("n_bytes"), F.when(~F.col("exact"), F.col("raw").cast("binary")).alias("raw"), F.when(F.col("exact"), F.col("header")).alias("header"), F.when(F.col("exact"), F.col("vars")).alias("vars"))
    chunks = lines.select("file", chunk).distinct()
    tokens = F.transform("tokens", lambda t: F.when(~t["is_var"], t["value"]))
    none = F.lit(None).cast("string")
    meta = model.templates.select("file", F.col("tid").alias("id"), tokens.alias("tokens"), none.alias("format"), F.lit(0).alias("width"))
    meta = meta.unionByName(profile.header_schema(lines, head=head).select("file", F.col("field").alias("id"), F.lit(None).cast("array<string>").alias("tokens"), "format", F.col("max_len").alias("width")))
    meta = chunks.join(meta, "file", "left")  # names of its own: cogroups refuse equal columns of one source
    meta = meta.select(F.concat("file").alias("of_file"), F.col("chunk").cast("long").alias("of_chunk"), "id", "tokens", "format", "width")

    def one(key: tuple, own: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        file, ordinal = key
        templates = {int(i): [t if isinstance(t, str) else None for t in tokens] for i, tokens in zip(about["id"], about["tokens"]) if tokens is not None}
        heads = about[about["format"].notna()].sort_values("id")
        fields = [Field(f, [int(w)] if w > 0 else []) for f, w in zip(heads["format"], heads["width"])]
        own = own.sort_values("line_no", ignore_index=True)
        c = build(file, int(ordinal), own, templates, fields, chunk_lines, head, analysed)
        c.window = window
        return pd.DataFrame([[file, int(ordinal), len(own), int(own["n_bytes"].sum()), dump(c, backend, level)]], columns=["file", "chunk", "n_lines", "n_bytes", "blob"])

    return rows.groupBy("file", "chunk").cogroup(meta.groupBy("of_file", "of_chunk")).applyInPandas(one, BLOBS)


def _mapped(blobs: DataFrame, schema: str, one) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in parts:
            for data in pdf["blob"]:
                for rows in one(parse(bytes(data))):
                    yield pd.DataFrame(rows, columns=names)

    return blobs.select("blob").mapInPandas(run, schema)


def decode(blobs: DataFrame) -> DataFrame:
    """lines(file, line_no, raw) of a table with a column blob."""

    def one(c: Container):
        for name, first, own in lines_of(c):
            at = iter(own)
            for i in range(0, len(own), 10_000):
                rows = list(islice(at, 10_000))
                yield {"file": [name] * len(rows), "line_no": range(first + i, first + i + len(rows)), "raw": rows}

    return _mapped(blobs, "file string, line_no long, raw binary", one).withColumn("raw", F.col("raw").cast("string"))


def listing(blobs: DataFrame) -> DataFrame:
    """A row per entry of each blob: its chunks, lines and bytes, templates and dictionaries beside it, lines kept verbatim."""

    def one(c: Container):
        rows = [(e.name, min(e.ordinals, default=0), len(e.ordinals), e.n_lines, e.n_bytes, len(c.templates), len(c.dictionaries), *map(len, c.failed.get(e.name, ((), ())))) for e in c.entries]
        yield rows

    return _mapped(blobs, "file string, chunk long, n_chunks int, n_lines long, n_bytes long, n_templates int, n_dictionaries int, n_load long, n_match long", one)


def columns(blobs: DataFrame) -> DataFrame:
    """(file, chunk, kind, tid, col, encoding, n): how each column of each blob is stored."""

    def one(c: Container):
        known, ordinals, rows = _Dictionaries(c.dictionaries), [iter(e.ordinals) for e in c.entries], []
        for at, data in c.chunks:
            cursor, place = codec.Cursor(data), (c.entries[at].name, next(ordinals[at], 0))

            def seen(kind: str, tag: int, tid: int, col: int):
                encoding = KINDS.get(cursor.data[cursor.at], "raw")  # noqa: B023
                rows.append((*place, kind, tid if tag else 0, col, encoding, len(known.column(cursor, tag, tid))))  # noqa: B023

            cursor.uvarint()
            cursor.varints(cursor.uvarint())
            for i in range(cursor.uvarint()):
                seen("header", OF_HEADER, i, i)
            for _ in range(cursor.uvarint()):
                tid = cursor.varint()
                for i in range(cursor.uvarint()):
                    seen("var", OF_VARIABLES, tid, i)
        yield rows

    return _mapped(blobs, "file string, chunk long, kind string, tid int, col int, encoding string, n long", one)


def write(lines: DataFrame, path: str, backend: str = "zstd", level: int = 6, chunk_lines: int = 100_000, analysed: bool = True, overwrite: bool = False, **options) -> None:
    """The table of containers, uncompressed Parquet as the blobs are compressed already."""
    made = encode(lines, backend, level, chunk_lines, analysed, **options)
    made.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "uncompressed").parquet(f"{path}/containers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table with a column blob: that of `write`, or the container files of a folder (not of folders below) or one such file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/containers")):
        return spark.read.parquet(f"{path}/containers")
    found = spark.read.format("binaryFile")
    if fs.getFileStatus(target).isDirectory():
        found = found.option("pathGlobFilter", f"*{SUFFIX}")
    return found.load(path).select(F.col("content").alias("blob"))
