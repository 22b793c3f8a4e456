"""Token ids of whole texts with a public tokenizer, fast on repeated words.

The tokenizer splits text before any merge, and a space that follows a non-space and
precedes one always begins such a piece.  So a text cut there encodes piece by piece.  Pieces
of Latin letters, digits and ASCII signs are cut further, at the tokenizer's own pattern, and
a part seen before need not be encoded again.  A text in which a space meets other white
space (or ends the text) is given to the library whole.

Strings of special tokens in a text are ordinary text, as the tokenizers' README says.
"""

from __future__ import annotations

import os
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _text

#: Parts that a worker goes on remembering once there are twice as many: those met last.
REMEMBERED = 250_000
# Fixed value: the pattern by which the tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond these are left to the library, whose tables of letters may differ.
_OTHER = re.compile("[^\n\r\t -~\xa1-\u024f]")
#: A word of the letters of Latin scripts, and the signs that may follow it as one part (an apostrophe may not).
_LATIN = r"\A ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WHOLE = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def gather(table: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of table that begin tells of, in the order of rows, and where each starts."""
    size = np.diff(begin)[rows]
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(at[-1], table.dtype)
    for i in range(0, len(rows), 1 << 16):  # eight bytes for each id at once would be most of the memory
        some, edge = rows[i : i + (1 << 16)], at[i : i + (1 << 16) + 1]
        np.take(table, np.arange(edge[0], edge[-1]) + np.repeat(begin[some] - edge[:-1], size[i : i + (1 << 16)]), out=out[edge[0] : edge[-1]], mode="clip")
    return out, at


class Encoder:
    """Encodes Arrow arrays of texts to one flat array of ids with offsets."""

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_path())
        self.library.encode_special_tokens = True
        self.type = np.dtype(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.cut = regex.compile(PATTERN).findall
        #: Parts met before, their ids in a row, where each starts, and the call that met each last.
        self.known = pa.array([], pa.large_string())
        self.ids, self.begin = np.zeros(0, self.type), np.zeros(1, np.int64)
        self.met, self.calls = np.zeros(0, np.int64), 0
        self.stop = self.library.encode("\n", add_special_tokens=False).ids

    def _bytes(self, texts: list[str]) -> list[bytes]:
        rows = [x.ids for i in range(0, len(texts), 2048) for x in self.library.encode_batch_fast(texts[i : i + 2048], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(rows), self.type).tobytes()
        ends = list(accumulate(len(x) * self.type.itemsize for x in rows))
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without white space but for one space before: many at once, a line each."""
        if len(self.stop) != 1:
            return self._bytes(parts)
        out, step = [], self.type.itemsize
        for i in range(0, len(parts), 1 << 15):
            lines = ["\n".join(parts[j : min(j + 512, i + (1 << 15))]) + "\n" for j in range(i, min(i + (1 << 15), len(parts)), 512)]
            ids = np.concatenate([np.array(x.ids, self.type) for x in self.library.encode_batch_fast(lines, add_special_tokens=False)])
            ends = (np.flatnonzero(ids == self.stop[0]) * step).tolist()
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip([0, *(x + step for x in ends)], ends)]
        return out

    def _look_up(self, parts: pa.Array) -> np.ndarray:
        """The place of each part in the memory; parts not met before are encoded and added."""
        self.calls += 1
        if len(self.known) > 2 * self.remembered:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: self.remembered])
            self.known, self.met = self.known.take(pa.array(keep)), self.met[keep]
            self.ids, self.begin = gather(self.ids, self.begin, keep)
        unique = parts.dictionary_encode()
        place = pc.index_in(unique.dictionary, value_set=self.known)
        fresh = unique.dictionary.filter(place.is_null())
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            new = fresh.to_pylist()
            word = np.array([x.isalpha() or x[0] == " " and x[1:].isalpha() for x in new])
            order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
            coded = self._parts([new[i] for i in order[: word.sum()]]) + self._bytes([new[i] for i in order[word.sum() :]])
            where = np.empty(len(new), np.int64)
            where[order] = len(self.known) + np.arange(len(new))
            place[place < 0] = where
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(order))])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), self.type)])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.type.itemsize
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[place] = self.calls
        return place[unique.indices.to_numpy(zero_copy_only=False)]

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each starts; an empty string has none."""
        stem = pc.ascii_rtrim(pieces, characters=_SIGNS)
        plain = pc.match_substring_regex(stem, _LATIN)
        own = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        stem = stem.take(pa.array(own))
        # the signs after a word are one part
        data, at = _text.utf8(pieces)
        stop = at[own + 1]
        tail = stop - at[own] - np.diff(_text.utf8(stem)[1])
        signed = np.flatnonzero(tail)
        size = tail[signed]
        ends = np.concatenate([[0], np.cumsum(size)])
        signs = data[np.repeat(stop[signed] - ends[1:], size) + np.arange(ends[-1])]
        signs = pa.LargeStringArray.from_buffers(len(signed), pa.py_buffer(ends), pa.py_buffer(signs.tobytes()))
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False) & (np.diff(at) > 0))
        cut, sizes = [], []
        for x in pieces.take(pa.array(rest)).to_pylist():
            parts = (x,) if x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) or _OTHER.search(x) else self.cut(x)
            cut += parts
            sizes.append(len(parts))
        place = self._look_up(pa.concat_arrays([stem, signs, pa.array(cut, pa.large_string())]))
        # the parts in the order of their pieces
        piece = np.concatenate([own, own[signed], np.repeat(rest, sizes).astype(np.int64)])
        place = place[np.argsort(piece, kind="stable")]
        ids, begin = gather(self.ids, self.begin, place)
        return ids, begin[np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(pieces)))])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        first = split.offsets.to_numpy()
        first = first - first[0]
        flat = split.flatten().dictionary_encode()
        del split
        number, unique = flat.indices.to_numpy(zero_copy_only=False).copy(), flat.dictionary
        del flat
        heads = number[first[:-1]]
        opening = np.unique(heads)
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False).astype(bool)
        codes = number
        codes[first[:-1]] = len(unique) + np.searchsorted(opening, heads)
        if whole.any():  # their pieces are not pieces of the tokenizer; leave them out
            codes = codes[~np.repeat(whole, np.diff(first))]
        none = pa.scalar("", pa.large_string())
        needed = np.zeros(len(unique) + len(opening), bool)
        needed[codes] = True
        pieces = pa.concat_arrays([pc.binary_join_element_wise(none, unique, pa.scalar(" ", none.type)), unique.take(pa.array(opening))])
        table, begin = self._coded(pc.if_else(pa.array(needed), pieces, none))
        ids, places = gather(table, begin, codes)
        sizes = np.diff(first)
        sizes[whole] = 0
        at = places[np.concatenate([[0], np.cumsum(sizes)])]
        if not whole.any():
            return ids, at
        own = iter([np.frombuffer(x, self.type) for x in self._bytes([texts[int(i)].as_py() for i in np.flatnonzero(whole)])])
        rows = [next(own) if whole[i] else ids[at[i] : at[i + 1]] for i in range(n)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])

    def batches(self, texts: pa.Array, most: int = 4 * _text.SLICE_BYTES):
        """(first row, ids, offsets) of consecutive groups of whole documents."""
        _, at = _text.utf8(texts)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield (i, *self.encode(texts.slice(i, j - i)))
            i = j


def encoder(path: str | None = None, remembered: int = REMEMBERED) -> Encoder:
    """This worker's encoder: what one task has learnt serves the next."""
    _text.release()  # what other operators left in this worker
    if (path, remembered) not in _text.kept:
        _text.kept[path, remembered] = Encoder(path, remembered)
    return _text.kept[path, remembered]
