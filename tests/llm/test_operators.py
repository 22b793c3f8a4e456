"""Each operator against a brute-force version, on the small tables and on odd rows."""

import math
import os
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from logquarry.llm import chat, decontam, jaccard, langid, linededup, packing, quality, repeats, tokenfile, windows
from logquarry.llm import _store
from logquarry.llm.components import components

key = lambda r: tuple((x is not None, x) for x in r)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["documents", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_packing(docs):
    want = defaultdict(list)
    own = pairs(docs)
    for (d, _), ids in zip(own, brute.tokens([t for _, t in own], 0), strict=True):
        want[d].append(ids)
    found = packing.pack(docs, with_ids=True).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        assert brute.crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["doc_tokens"], r["start"], tuple(r["ids"])))
    for d, all_ids in want.items():
        exact = sorted((len(i), a, tuple(i[a : a + n])) for i in all_ids for a, n in {(s, len(x)) for t, s, x in by_doc[d] if t == len(i) and list(x) == i[s : s + len(x)]})
        assert sorted(by_doc[d]) == sorted(exact * (len(by_doc[d]) // max(1, len(exact)))) and sum(len(x) for _, _, x in by_doc[d]) == sum(map(len, all_ids))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(map(len, sum(want.values(), [])))
    if total > 50_000:
        assert total / (1024 * len(sequences)) > 0.95


def test_differencing_is_near_equal():
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 257, 800)]
    dealt = packing.windows(sizes, 1024)
    assert sorted(i for w in dealt for i in w) == list(range(800))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) <= 1024 and max(sums) - min(sums) < 60 and len(dealt) <= -(-sum(sizes) // 1024) + 1
    assert packing.windows([5], 1024) == [[0]] and packing.windows([], 1024) == []


def test_quality_base(docs):
    found = rows(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == sorted(((d, *brute.base(t)) for d, t in pairs(docs)), key=key)


def test_quality_paths_agree_and_keep_most(documents):
    a = rows(quality.judge(documents), "doc_id", "kept", "log_perplexity")
    b = rows(quality.judge(documents, broadcast_grams=0), "doc_id", "kept", "log_perplexity")
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(x[2] is None and y[2] is None or abs(x[2] - y[2]) < 1e-4 for x, y in zip(a, b, strict=True))
    assert sum(x[1] for x in a) > 0.7 * len(a)


@pytest.mark.parametrize("options", [{}, {"broadcast_grams": 0}])
def test_quality_copies_have_one_vote(spark, options):
    rng = np.random.default_rng(2)
    words = lambda n: ["".join(chr(x) for x in rng.integers(97, 123, 6)) for _ in range(n)]
    common = words(300)
    own = [(i, " ".join(rng.choice(common, 120)), "de") for i in range(100)]
    junk = [(50_000 + i, " ".join(words(80)), "de") for i in range(5)]
    copies = [(10_000 + i, own[0][1], "de") for i in range(700)]
    df = spark.createDataFrame(own + copies + junk, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality.judge(df, **options).collect()}
    assert not any(found[d]["base_failed"] or found[d]["kept"] for d, _, _ in junk)
    assert all(found[d]["kept"] for d, _, _ in own + copies)  # copies are not junk either


def test_kneser_ney(spark):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join("".join(rng.choice(list("abcdé"), int(rng.integers(1, 6)))) for _ in range(30)), "xy"[i % 2]) for i in range(30)]
    counts = quality.gram_counts(spark.createDataFrame([*texts, *texts[:5], (99, None, "x")], "doc_id long, text string, lang string"))
    here, there = quality.local_model(counts), defaultdict(dict)
    for r in quality.model(counts).collect():
        there[r["lang"]][r["g"]] = r["logp"]
    for lang in "xy":
        want = brute.KneserNey([t for _, t, x in texts if x == lang])
        g, p = here[lang]
        assert len(g) == len(want.counts[5]) == len(there[lang])
        for code, logp in zip(g.tolist(), p.tolist(), strict=True):
            exact = math.log(want.p(code.to_bytes(5, "big")))
            assert abs(exact - logp) < 1e-4 and abs(exact - there[lang][code]) < 1e-4
        for h in {x[:-1] for x in want.counts[5]}:
            assert abs(sum(want.p(h + bytes([c])) for c in range(256)) - 1) < 1e-6


@pytest.mark.parametrize("options", [{}, {"broadcast_grams": 0}])
def test_quality_kept(documents, options):
    some = documents.select("doc_id", "text", "lang").where("lang in ('en', 'fr') or lang is null")
    data = [tuple(r) for r in some.collect()]
    assert rows(quality.judge(some, **options), "doc_id", "kept") == sorted(brute.quality(data), key=key)


def test_decontamination(docs, benchmark_table):
    items = [(r["item_id"], r["text"]) for r in benchmark_table.collect()]
    want = sorted(brute.contamination(pairs(docs), items), key=key)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontam.contamination(docs, benchmark_table), *columns) == want
    assert rows(decontam.contamination(docs, benchmark_table, block_bytes=20_000), *columns) == want


def test_decontamination_odd_items(spark, odd):
    items = [(1, None), (2, ""), (3, "A-b c"), (3, "d e"), (None, "漢字 words"), (4, "t7 " * 1)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(pairs(odd), [("" if i is None else i, t) for i, t in items]), key=key)
    assert rows(decontam.contamination(odd, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_token_files(docs, tmp_path):
    path = str(tmp_path / "t")
    tokenfile.write(docs, path, shards=3)
    found = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read(docs.sparkSession, path).collect()), key=key)
    own = pairs(docs)
    assert found == sorted(((d, len(i), brute.crc(i)) for (d, _), i in zip(own, brute.tokens([t for _, t in own], 2), strict=True)), key=key)
    at = 0
    for r in sorted(tokenfile.read(docs.sparkSession, path).collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(tokenfile.read(docs.sparkSession, path).collect(), key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    cases = [[], [0], [0] * 61, [1] * 200, [2**60 - 1], [2**60], [2**64 - 1, 5, 2**63, 0, 15 << 60], list(range(5000))]
    cases += [(rng.integers(0, 2**62, 500) >> rng.integers(0, 62, 500)).tolist() for _ in range(20)]
    for c in cases:
        w = tokenfile.encode(np.array(c, np.uint64))
        assert tokenfile.decode(w).tolist() == c
        offsets = tokenfile.block_offsets(w)
        assert len(offsets) == -(-len(w) // tokenfile.STEP)


def test_lines(docs):
    want = sorted(brute.lines(pairs(docs)), key=key)
    for options in ({}, {"batches": 7, "fanout": 3, "hot": 1}):
        from pyspark.sql import functions as F

        out = linededup.dedup_lines(docs, **options)
        assert rows(out.withColumn("sha", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "sha") == want


def test_language(documents, odd, empty):
    found = langid.cross_check(documents).collect()
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in langid.cross_check(odd).where("doc_id in (4, 5, 6)").collect()} == {"und"}
    assert langid.cross_check(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_jaccard(docs):
    want = sorted(brute.jaccard(pairs(docs)), key=key)
    for options in ({}, {"local_hot": 2}):
        assert rows(jaccard.similar(docs, **options), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_finds_every_near_pair(spark):
    rng = np.random.default_rng(5)
    docs, n = [], 0
    for _ in range(60):
        words = [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(6, 400)))]
        for _ in range(4):
            copy = list(words)
            for p in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 40))):
                copy[p] = f"v{rng.integers(10**6)}"
            docs.append((n, " ".join(copy[: len(copy) - int(rng.integers(0, 1 + len(copy) // 12))])))
            n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.similar(df), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs))


def test_jaccard_short_stars_and_chains(spark):
    """Short texts linked to several that are not linked among themselves, and chains: each link counts."""
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    texts = []
    for _ in range(40):
        size = int(rng.integers(12, 60))
        hub, path = word(size), word(3 * size)
        more = max(1, (size - 4) // 18)
        texts += [hub] + [word(more) + hub if k % 2 else hub + word(more) for k in range(6)]
        texts += [path[k : k + size] for k in range(0, 2 * size, max(1, (size - 4) // 10))]
    docs = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard.similar(df), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs))


def test_jaccard_pairs_beside_the_least_set(spark):
    """q and b link, but meet only under sets that stand apart from one of them."""
    rng = np.random.default_rng(11)
    docs = []
    for _ in range(15):
        q = [f"w{x}" for x in rng.integers(10**9, size=200)]
        a, b, z = list(q), list(q), list(q)
        for own, places in ((a, [90]), (b, [20, 60, 120, 170]), (z, range(8, 200, 12))):
            for p in places:
                own[p] = f"v{rng.integers(10**9)}"
        docs += [(len(docs) + i, " ".join(t)) for i, t in enumerate((q, a, b, z))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"bin_rows": 3}):
        assert rows(jaccard.similar(df, **options), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs))


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for n in (*range(1, 40), 77, 130, 333, 1200):
        for _ in range(6):
            common = rng.integers(1, 2**63, n).astype(np.uint64)
            more = rng.integers(1, 2**63, n // 4).astype(np.uint64)
            x, y = np.sort(common), np.sort(np.concatenate([common, more]))
            sig, who = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert len(more) == 0 or set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(path, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}


def test_windows(docs):
    assert rows(windows.dedup_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.windows(pairs(docs)), key=key)


def test_places():
    for x in ([], [0], [255, 256, 1000, 5000], [0, 0, 3, 258, 258 + 255]):
        assert windows.unpack_places(windows.pack_places(np.array(x, np.int64))).tolist() == x


def test_strings(docs):
    want = sorted(brute.strings(pairs(docs)), key=key)
    for options in ({}, {"warm": 1, "hot": 10**9}, {"warm": 0, "hot": 1}):
        assert rows(repeats.remove_repeats(docs, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_maximal_repeats():
    texts = [b"xabcdey", b"zabcdew", b"qabcq", b"abc", b""]
    found = dict((texts[p[0][0]][p[0][1] : p[0][1] + n], p) for n, p in repeats.maximal_repeats(texts, 3))
    assert found == {b"abcde": [(0, 1), (1, 1)], b"abc": [(0, 1), (1, 1), (2, 1), (3, 0)]}


def test_chat(spark):
    call = '{"content": null, "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "search", "arguments": {"limit": "3"}}]}'
    data = [(1, 0, "user", "hi \"you\"\n"), (1, 1, "tool", '{"tool_call_id": "a", "content": "early"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id": "zz", "content": "lost"}'), (2, None, None, None), (2, 1, "assistant", '{"tool_calls": 5}'), (2, 1, "tool", "plain")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    schemas = {"search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]}}
    found = sorted(chat.format_chats(df, schemas).collect(), key=lambda r: (r["conv_id"], r["order_turn"] or -1, r["order_kind"], r["turn"] or -1))
    assert [(r["conv_id"], r["turn"], r["n_calls"], r["n_answered"], r["linked"], r["n_invalid"]) for r in found] == [
        (1, 0, 0, 0, False, 0), (1, 2, 2, 1, False, 1), (1, 1, 0, 0, True, 0), (1, 3, 0, 0, False, 0), (2, None, 0, 0, False, 0), (2, 1, 0, 0, False, 0), (2, 1, 0, 0, False, 0)]
    assert found[0]["json"] == '{"content":"hi \\"you\\"\\n","role":"user"}'
    assert '"arguments":{"limit":3,"query":"x"}' in found[1]["json"]
    assert chat.format_chats(df.limit(0)).count() == 0
    assert found[1]["json"].count('"answered":true') == 1


def test_chat_odd_messages(spark):
    """Names that are no strings, half surrogates, numbers as identifiers, what is not JSON, schemas of all kinds."""
    call = lambda id, name, arguments: '{"content": "\\ud800", "tool_calls": [{"id": %s, "name": %s, "arguments": %s}]}' % (id, name, arguments)  # noqa: E731, UP031
    data = [(1, 0, "assistant", call(1, '["x"]', "{}")), (1, 1, "tool", '{"tool_call_id": 1, "content": "\\udc00 x"}'), (1, 2, "assistant", call('"n"', '"t"', '{"a": NaN}')),
            (1, 3, "assistant", call('"b"', '"t"', '{"a": null, "b": [1, "x"], "c": {"d": 2}}')), (1, 4, "assistant", call('"c"', '"t"', '{"a": 3, "b": [true]}')), (None, 5, "tool", '{"tool_call_id": "b", "content": 1}')]
    schema = {"t": {"properties": {"a": {"type": ["null", "string"]}, "b": {"type": "array", "items": {"type": ["integer", "string"], "enum": [1, "x"]}}, "c": {"properties": {"d": {"type": "integer"}}, "required": ["d"]}}}}
    found = {r["turn"]: r for r in chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), schema).collect()}
    assert [(found[t]["n_calls"], found[t]["n_answered"], found[t]["n_invalid"], found[t]["linked"]) for t in range(6)] == [
        (1, 1, 1, False), (0, 0, 0, True), (0, 0, 0, False), (1, 0, 0, False), (1, 0, 1, False), (0, 0, 0, False)]
    assert '"answered":true' in found[0]["json"] and '"content":"\\ud800"' in found[0]["json"]
    assert found[2]["json"].startswith('{"content":"{')


def test_fetch(documents, tmp_path):
    path = str(tmp_path / "t")
    tokenfile.write(documents, path, shards=3)
    wanted = [3, 77, 78, 150, 10**6]
    own = [(d, t) for d, t in pairs(documents) if d in wanted]
    found = {r["doc_id"]: r["ids"] for r in tokenfile.fetch(documents.sparkSession, path, wanted).collect()}
    assert found == {d: ids for (d, _), ids in zip(own, brute.tokens([t for _, t in own], 2), strict=True)}
    assert tokenfile.fetch(documents.sparkSession, path, []).count() == 0


def test_simple8b_parts():
    rng = np.random.default_rng(6)
    ids = (rng.integers(0, 2**63, 9000).astype(np.uint64) << np.uint64(1)) >> rng.choice([0, 2, 40, 50, 60], 9000).astype(np.uint64)
    words = tokenfile.encode(ids)
    offsets = tokenfile.block_offsets(words)
    for a, b in rng.integers(0, 9001, (300, 2)):
        a, b = min(a, b), max(a, b)
        assert tokenfile.part(words, offsets, int(a), int(b)).tolist() == ids[a:b].tolist()


def test_interval_tree_of_random_texts():
    rng = np.random.default_rng(9)
    for _ in range(40):
        texts = ["".join(rng.choice(list("ab"), int(rng.integers(0, 30)))).encode() for _ in range(3)]
        want = defaultdict(set)
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for n in range(3, len(x) - i + 1):
                    want[x[i : i + n]].add((t, i))
        def maximal(s, own):
            left = {texts[t][i - 1] if i else -1 - t - 100 * i for t, i in own}
            right = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else -1 - t for t, i in own}
            return len(own) > 1 and (len(left) > 1 or min(left) < 0) and (len(right) > 1 or min(right) < 0)
        exact = sorted((len(s), sorted(own)) for s, own in want.items() if maximal(s, own))
        assert sorted(repeats.maximal_repeats(texts, 3)) == exact


def test_removing_spans(spark, benchmark_table):
    item = max((r["text"] for r in benchmark_table.collect()), key=len).rstrip(" .!?")
    docs = spark.createDataFrame([(1, f"Before, this. {item.upper()}! after it", "k"), (1, "clean text", "k"), (2, None, "k")], "doc_id long, text string, _d string")
    out = decontam.cut_spans(docs, benchmark_table)
    assert out.columns == docs.columns
    found = rows(out, "doc_id", "text")
    assert found == [(1, "Before, this. ! after it"), (1, "clean text"), (2, None)]


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("own") for c in ("_gone", "_bad", "_spare", "n_lines", "_p0", "_P1", "_t", "_o", "first", "kept", "component", "starts")})


def test_stages_keep_rows_and_columns(spark, documents, benchmark_table):
    """Each row goes by itself, whatever shares its id; all columns stay as they are."""
    from pyspark.sql import functions as F

    item = max((r["text"] for r in benchmark_table.collect()), key=len)
    good = [r["text"] for r in documents.where("lang = 'en' and length(text) > 600").orderBy("doc_id").limit(12).collect()]
    data = [(i, t, "en", "s", 0) for i, t in enumerate(good)] + [(0, "x " * 50, "en", "s", 0), (1, item + " tail", "en", "s", 0), (2, None, None, None, None), (2, good[3] + " end", "en", "s", 0), (4, good[4], "en", "s", 0)]
    docs = clashing(spark.createDataFrame(data, documents.schema))
    mine = [(d, t) for d, t, *_ in data]

    def same(out, want):
        assert out.columns == docs.columns
        assert rows(out, "doc_id", "text") == sorted(want, key=key)
        assert {r[0] for r in out.select("_gone").collect()} <= {"own"}

    kept = dict(zip(range(len(data)), brute.quality([(d, t, lang) for d, t, lang, *_ in data]), strict=True))
    same(quality.keep(docs), [mine[i] for i, (_, k) in kept.items() if k])
    hit = brute.contamination(mine, [(r["item_id"], r["text"]) for r in benchmark_table.collect()])
    same(decontam.remove(docs, benchmark_table), [x for x, h in zip(mine, hit, strict=True) if not h[-1]])
    same(linededup.rewrite(docs), [(d, None if t is None else x[3]) for (d, t), x in zip(mine, brute.kept_lines(mine), strict=True)])
    groups = defaultdict(list)
    for x, r in zip(mine, brute.roots(mine), strict=True):
        groups[r].append(x)
    one = jaccard.keep_one(docs)
    found = rows(one, "doc_id", "text")
    assert len(found) == len(groups) and all(sum(x in own for x in found) == 1 for own in groups.values())
    same(one.withColumn("n_chars", F.lit(0)).select(*docs.columns), found)


def test_texts_longer_than_a_block(spark):
    """One text beyond slices and blocks, in every operator on texts."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000)]
    long = " ".join(rng.choice(words, 1_400_000))
    docs_ = [(1, long[: 9 << 20]), (2, "short text"), (3, long[1000:5000]), (4, long[(5 << 20) : (5 << 20) + 3000])]
    docs = spark.createDataFrame([(d, t, "en") for d, t in docs_], "doc_id long, text string, lang string").coalesce(1)
    assert rows(windows.dedup_windows(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.windows(docs_))
    found = rows(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed")
    assert [x[1] for x in found] == [len(t) for _, t in docs_] and found[2][2] == 4000 and found[3][2] == 3000 and found[1][2] == 0
    assert [x[1] for x in rows(jaccard.similar(docs), "doc_id", "n_shingles", "component_id")] == [len(brute.shingles(t)) for _, t in docs_]
    assert rows(quality.judge(docs), "doc_id", "n_words")[0][1] == len(docs_[0][1].split())
    assert {r["lang_pred"] for r in langid.identify(docs, {"en": b"abc abd"}).collect()} == {"en"}
    ids = brute.tokens([t for _, t in docs_], 0)
    packed = packing.pack(docs).collect()
    assert sum(r["length"] for r in packed) == sum(map(len, ids)) and {r["doc_tokens"] for r in packed if r["doc_id"] == 1} == {len(ids[0])}
