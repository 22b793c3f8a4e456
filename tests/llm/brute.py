"""Plain one-process versions of the operators' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


def tokens(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*x.ids, end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def base(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def kept_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    rank = lambda d: -(2**63) if d is None else d
    held = defaultdict(list)
    for d, t in docs:
        for k in {x.strip(strip).translate(LOW) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(rank(d))
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(held.get(k := x.strip(strip).translate(LOW), ())) >= 5 and max(held[k]) != rank(d))]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def lines(docs):
    return [(d, n, gone, sha(t.encode())) for d, n, gone, t in kept_lines(docs)]


def shingles(text):
    w = SPACE.findall((text or "").translate(LOW))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def roots(docs):
    """Each document's component, by the number of one of its documents."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for own in where.values():
        common.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    return [find(i) for i in range(len(docs))]


def jaccard(docs):
    rank = [-(2**63) if d is None else d for d, _ in docs]
    least, root = {}, roots(docs)
    for r, x in zip(root, rank, strict=True):
        least[r] = min(least.get(r, x), x)
    real = lambda x: None if x == -(2**63) else x
    return [(d, len(shingles(t)), real(least[r])) for (d, t), r in zip(docs, root, strict=True)]


def windows(docs, width=20):
    rank = lambda d: -(2**63) if d is None else d
    first = {}
    words = [SPACE.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, (rank(d), i)), (rank(d), i))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (rank(d), i) for j in range(i, i + width)}
        out.append((d, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())))
    return out


def strings(docs, width=200):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(hash(b[i : i + width]) for b in raw for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[hash(b[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes, by the book; top n-grams seen once discount to nothing."""

    def __init__(self, texts, order=5):
        self.order = order
        self.counts = [None] * (order + 1)
        self.counts[order] = Counter(g for t in texts for g in self.grams(t))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.context, self.back = [None], [None], [None]
        for k in range(1, order + 1):
            t = Counter(self.counts[k].values())
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
            d = [0] + [min(0.95 * i, max(0.05 * i, i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i)) for i in (1, 2, 3)]
            d[1] = 1.0 if k == order else d[1]
            self.discounts.append(d)
            context, back = Counter(), Counter()
            for g, n in self.counts[k].items():
                context[g[:-1]] += n
                back[g[:-1]] += d[min(n, 3)]
            self.context.append(context)
            self.back.append(back)

    def grams(self, text):
        b = b"\2" * (self.order - 1) + text.encode().translate(SPACES)
        return [b[i : i + self.order] for i in range(len(b) - self.order + 1)]

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / 256
        h = g[:-1]
        if not self.context[k][h]:
            return self.p(g[1:])
        n = self.counts[k][g]
        return ((n - self.discounts[k][min(n, 3)] if n else 0) + self.back[k][h] * self.p(g[1:])) / self.context[k][h]


def quality(rows, spread=4.0):
    """(doc_id, kept) of rows (doc_id, text, lang)."""
    langs = defaultdict(set)
    for _, t, lang in rows:
        if t is not None:
            langs[lang or ""].add(t)
    models = {x: KneserNey(sorted(own)) for x, own in langs.items()}
    seen = {}

    def score(t, lang):
        if (t, lang) not in seen:
            own = [math.log(models[lang].p(g)) for g in models[lang].grams(t)]
            seen[t, lang] = -sum(own) / len(own)
        return seen[t, lang]

    bands = {}
    for lang, own in langs.items():
        s = sorted(score(t, lang) for t in own if t and not base(t)[-1])
        q = [s[max(0, math.ceil(p * len(s)) - 1)] for p in (0.1, 0.5, 0.9)] if s else [0, 0, 0]
        bands[lang] = q[1] - spread * (q[1] - q[0]) - 1e-5, q[1] + spread * (q[2] - q[1]) + 1e-5
    kept = lambda t, lang: bool(t) and not base(t)[-1] and bands[lang][0] <= score(t, lang) <= bands[lang][1]
    return [(d, kept(t, lang or "")) for d, t, lang in rows]

