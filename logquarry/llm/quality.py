"""Quality rules: base counts, and perplexity under a modified Kneser-Ney n-gram model.

The model is over the bytes of the texts (white space as one kind of byte), of order five,
one per language.  All n-grams of the distinct texts of a language are counted in Spark (a
group of copies would else teach the model its own text): tasks send one row per distinct
n-gram.  Lower orders, discounts and interpolated probabilities follow from these counts.
N-grams of the highest order seen once leave all their mass to the lower orders (they come
from the very document that is judged); the probabilities of every context sum to one.  They
are held as arrays sorted by n-gram code, a language each.  Up to `broadcast_grams` n-grams
(20 bytes each on the driver, 12 in a worker) are estimated on the driver and broadcast; more
are estimated by aggregations and joins, and joined with the documents' n-grams.

A document's perplexity is judged against bands of its language: the median plus and minus
`spread` times the distance of the outer deciles from it, so a band follows the language and
the bulk of each language stays inside.  Both are taken over the distinct texts of a language,
so a group of copies weighs as one.

Null texts have no words and fail the base rule.  Null and empty language are one language.
Rows that repeat are judged each, and alike.  Equal scores fall on the same side of a band.  An
empty table yields no rows.  Columns beside doc_id, text and lang are not read.  A very long
text is judged whole, by one task, in some fifty times its size of memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

ORDER = 5
U = np.uint64
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[9, 10, 11, 12, 13]] = 32
_SYMBOL = _text.mask(inside=b"#*$%&|<>")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def codes(data: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the `order` bytes that end with it as one number; texts begin with padding 2."""
    data = _SPACES[data]
    pad = order - 1
    sizes = np.diff(at)
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(at)), sizes) * pad
    wide = np.full(len(data) + pad * (len(at) - 1), 2, np.uint8)
    wide[place] = data
    out = np.zeros(len(data), np.int64)
    for i in range(order):
        out <<= 8
        out |= wide[place - pad + i]
    return out


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def merge(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[new], np.add.reduceat(counts, new) if len(new) else counts

    def rows():
        for lang, parts in held.items():
            keys, counts = merge(parts)
            for i in range(0, len(keys), 1 << 18):
                k, c = keys[i : i + (1 << 18)], counts[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], names=["lang", "g", "n"])

    for batch in batches:
        langs = np.array([x or "" for x in batch.column(0).to_pylist()], object)
        for lang in np.unique(langs.astype(str)):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for _, data, at in _text.slices(texts, _text.SMALL_SLICE_BYTES):
                if len(data):
                    k, c = np.unique(codes(data, at), return_counts=True)
                    held.setdefault(lang, []).append((k, c.astype(np.int64)))
                    waiting += len(k)
                if waiting > 1_500_000:
                    held = {x: [merge(p)] for x, p in held.items()}
                    waiting = sum(len(p[0][0]) for p in held.values()) // 2
                    if 2 * waiting > 4_000_000:
                        yield from rows()
                        held, waiting = {}, 0
    yield from rows()


def _discounts(grams: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each language from its counts of counts."""
    t = grams.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)))
    y = F.when(F.col("t1") + 2 * F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(F.lit(0.5))
    out = t.withColumn("y", y)
    for i in (1, 2, 3):
        raw = F.when(F.col(f"t{i}") > 0, i - (i + 1) * F.col("y") * F.col(f"t{i + 1}") / F.col(f"t{i}")).otherwise(F.lit(0.5 * i))
        out = out.withColumn(f"d{i}", F.greatest(F.lit(0.05 * i), F.least(raw, F.lit(0.95 * i))))
    return out.select("lang", "d1", "d2", "d3")


def _probabilities(g: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Logarithms of the probabilities of a language's n-grams (ascending codes) from their counts."""
    tables = {order: (g, n)}
    for k in range(order - 1, 0, -1):
        tables[k] = np.unique(tables[k + 1][0] & ((1 << 8 * k) - 1), return_counts=True)
    lower = None
    for k in range(1, order + 1):
        keys, counts = tables[k]
        t = [float((counts == i).sum()) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] > 0 else 0.5
        d = [min(0.95 * i, max(0.05 * i, i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] > 0 else 0.5 * i)) for i in (1, 2, 3)]
        d[0] = 1.0 if k == order else d[0]
        gone = np.choose(np.minimum(counts, 3) - 1, d)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] >> 8 != keys[:-1] >> 8]))
        sizes = np.diff(np.append(new, len(keys)))
        total, back = (np.repeat(np.add.reduceat(x, new), sizes) for x in (counts, gone))
        q = 1 / 256 if lower is None else lower[np.searchsorted(tables[k - 1][0], keys & ((1 << 8 * (k - 1)) - 1))]
        lower = (counts - gone) / total + back / total * q
    return np.log(lower)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, n) over the distinct texts of each language, as a written table."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text")).distinct()
    return _store.written(texts.mapInArrow(_text.tidy(_counter), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")


def local_model(counts: DataFrame, order: int = ORDER) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Codes, ascending, and logarithms of each language; counts must be few enough for the driver."""
    table = counts.select("lang", "g", F.col("n").cast("long").alias("n")).toArrow().combine_chunks()
    langs = table["lang"].combine_chunks().dictionary_encode()
    number, g, n = langs.indices.to_numpy(), table["g"].to_numpy(), table["n"].to_numpy()
    out = {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        own = np.flatnonzero(number == i)
        own = own[np.argsort(g[own])]
        out[lang] = (g[own], _probabilities(g[own], n[own], order).astype(np.float32))
    return out


def model(top: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, logp): the natural logarithm of the probability of each n-gram's last byte, from gram_counts."""
    tables = {order: top}
    for k in range(order - 1, 0, -1):  # how many different bytes come before an n-gram
        tables[k] = tables[k + 1].select("lang", (F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
        if k >= order - 2:
            tables[k] = _store.written(tables[k], f"grams{k}")
    lower = None
    for k in range(1, order + 1):
        d = F.broadcast(_discounts(tables[k]))  # one row per language
        t = tables[k].join(d, "lang").withColumn("h", F.shiftright("g", 8))
        t = t.withColumn("d", F.when(F.col("n") == 1, F.col("d1") if k < order else F.lit(1.0)).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = t.groupBy("lang", "h").agg(F.sum("n").alias("all"), F.sum("d").alias("back"))
        t = t.join(context, ["lang", "h"])
        own = F.col("n") - F.col("d")
        back = F.col("back") / F.col("all")
        if lower is None:
            p = (own / F.col("all")) + back / 256
            lower = t.select("lang", "g", p.alias("p"))
        else:
            suffix = lower.select("lang", F.col("g").alias("s"), F.col("p").alias("q"))
            t = t.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(suffix, ["lang", "s"])
            lower = t.select("lang", "g", (own / F.col("all") + back * F.col("q")).alias("p"))
    return lower.select("lang", "g", F.log("p").cast("float").alias("logp"))


def base_counts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    start, end, first = _text.words(data, at, _text.SPACE_SEPARATED)
    docs = len(at) - 1
    n_words = np.diff(first)

    def per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[edges[1:]] - sums[edges[:-1]]

    chars = per_doc(_text.SPACE_SEPARATED[data] & ((data & 0xC0) != 0x80), at)
    symbols = per_doc(_SYMBOL[data], at)
    # lines: all bytes between \n; those with a word
    breaks = data == 10
    cut = np.unique(np.concatenate([at[:-1], np.flatnonzero(breaks) + 1])) if len(data) else np.zeros(0, np.int64)
    cut = cut[cut < len(data)]
    stop = np.concatenate([cut[1:], [len(data)]])
    stop = stop - (breaks[stop - 1] & (stop > cut)) if len(cut) else stop[:0]
    seen = np.concatenate([[0], np.cumsum(_text.SPACE_SEPARATED[data])])
    full = seen[stop] > seen[cut] if len(cut) else np.zeros(0, bool)
    cut, stop = cut[full], stop[full]
    owner = np.searchsorted(at, cut, "right") - 1
    lines = _text.span_hash(_text.prefix(data.astype(U) + U(1), _text._BYTE), cut, stop, _text._BYTE)
    dups = np.zeros(docs, np.int64)
    if len(lines):
        order = np.lexsort([lines, owner])
        same = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        dups = np.bincount(owner[order][1:][same], minlength=docs)
    hashes = _text.word_hashes(data, start, end)
    places, keys = _text.windows(hashes, first, 5)
    repeats = np.zeros(docs, np.int64)
    if len(places):
        owner = np.searchsorted(first, places, "right") - 1
        keys = keys ^ _text.mix(owner.astype(U) + U(1))
        order = np.argsort(keys, kind="stable")
        equal = keys[order][1:] == keys[order][:-1]
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        repeats = per_doc(_text.covered(len(hashes), places[order[twice]], 5), first)
    return [n_words, chars, symbols, dups, repeats]


def _judge(blob):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(blob.value) if blob is not None else None
        for batch in batches:
            texts, langs = batch.column(2), [x or "" for x in batch.column(1).to_pylist()]
            base: list[list[np.ndarray]] = []
            score = np.full(len(texts), np.nan)
            for i, data, at in _text.slices(texts, _text.SMALL_SLICE_BYTES):
                base.append(base_counts(data, at))
                if known is None or not len(data):
                    continue
                keys = codes(data, at)
                logp = np.zeros(len(keys), np.float64)
                own = np.array(langs[i : i + len(at) - 1], object)
                for lang in set(own):
                    if lang not in known:  # its texts are all empty
                        continue
                    here = np.repeat(own == lang, np.diff(at))
                    g, p = known[lang]
                    logp[here] = p[np.minimum(np.searchsorted(g, keys[here]), len(g) - 1)]
                size = np.diff(at)
                full = np.flatnonzero(size)
                # each text's own sum: copies score alike, wherever they stand
                score[i + full] = -np.add.reduceat(logp, at[full]) / size[full]
            cols = [np.concatenate(c) for c in zip(*base, strict=True)] if base else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), *(pa.array(c, pa.int64()) for c in cols), pa.array(score, pa.float64(), from_pandas=True), *batch.columns[3:]], names=["doc_id", "lang", *(x.split()[0] for x in BASE.split(", ")), "log_perplexity", *batch.schema.names[3:]])

    return _text.tidy(run)


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = [x or "" for x in batch.column(2).to_pylist()]
        for i, data, at in _text.slices(batch.column(3)):
            keys = codes(data, at)
            for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), i):
                k, c = np.unique(keys[a:b], return_counts=True)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(k), t) for x, t in ((batch.column(0)[j].as_py(), pa.int64()), (batch.column(1)[j].as_py(), pa.int64()), (langs[j], pa.string()))] + [pa.array(k), pa.array(c.astype(np.int64))], names=["_d", "_t", "lang", "g", "c"])


def scores(docs: DataFrame, broadcast_grams: int = 12_000_000) -> DataFrame:
    """doc_id, lang, the base counts, log_perplexity (per byte; null without text) and _text, a hash of the text, of each row; a written table."""
    counts = gram_counts(docs)
    schema = f"doc_id long, lang string, {BASE}, log_perplexity double, _text long"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    if counts.count() <= broadcast_grams:
        blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(local_model(counts)))
        out = _store.written(own.mapInArrow(_judge(blob), schema), "scores")
        blob.destroy()
        _text.release()
        return out
    known = _store.written(model(counts), "model")
    marked = own.withColumn("_d", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_t", F.xxhash64("text", "lang"))
    once = marked.dropDuplicates(["_d", "_t"]).select("_d", "_t", "lang", "text")
    grams = once.mapInArrow(_text.tidy(_document_grams), "_d long, _t long, lang string, g long, c long")
    summed = grams.join(known, ["lang", "g"]).groupBy("_d", "_t").agg((-F.sum(F.col("c") * F.col("logp")) / F.sum("c")).alias("joined"))
    base = marked.select("doc_id", "lang", "text", "_text", "_d", "_t").mapInArrow(_judge(None), schema + ", _d long, _t long")
    return _store.written(base.join(summed, ["_d", "_t"], "left").withColumn("log_perplexity", F.col("joined")).drop("_d", "_t", "joined"), "scores")


def _judged(docs: DataFrame, spread: float, broadcast_grams: int) -> DataFrame:
    found = scores(docs, broadcast_grams)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.lit(10_000))
    # copies of a text have one vote; tasks merge theirs before the shuffle
    texts = found.where(~F.col("base_failed")).groupBy("lang", "_text").agg(F.min("log_perplexity").alias("log_perplexity"))
    bands = texts.groupBy("lang").agg(q.alias("q"))
    bands = bands.select("lang", (F.col("q")[1] - spread * (F.col("q")[1] - F.col("q")[0])).alias("lower"), (F.col("q")[1] + spread * (F.col("q")[2] - F.col("q")[1])).alias("upper"))
    both = found.join(F.broadcast(bands), "lang", "left")  # one row per language
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return both.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))


def judge(docs: DataFrame, spread: float = 4.0, broadcast_grams: int = 12_000_000) -> DataFrame:
    """The counts of each document, whether it fails the base rule, and whether it is kept."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")
    return _judged(docs, spread, broadcast_grams).select(*columns)


def keep(docs: DataFrame, spread: float = 4.0, broadcast_grams: int = 12_000_000) -> DataFrame:
    """The documents that the rules keep, with all their columns: each row by its own text and language."""
    d, t, lang = _store.private(docs, 3)
    gone = _judged(docs, spread, broadcast_grams).where("not kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias(d), F.col("_text").alias(t), F.coalesce("lang", F.lit("")).alias(lang))
    gone = _store.few(_store.written(gone, "gone"))
    marked = docs.withColumns({d: _store.key_of("doc_id"), t: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), lang: F.coalesce(F.col("lang").cast("string"), F.lit(""))})
    return marked.join(gone, [d, t, lang], "left_anti").select(*docs.columns)
