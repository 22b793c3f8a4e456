"""The encoder against the library, text by text."""

import random

import brute
import pyarrow as pa

from logquarry.llm import tokens

PARTS = ["a", "the", "ing", "É", "ß", "ſ", "Ω", "я", "漢", "ª", "ʼ", "ǀ", "ƻ", "ɏ", "ɐ", "́", "٣", "12", "½", "'", "'s", "'S", ".", ",", "!!", "&&&", "_", "—", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "​", " ", "<|endoftext|>", "<|", "😀", "\x00", "×", "\xad"]


def encoded(encoder, texts):
    ids, at = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_random_texts_with_little_memory():
    draw, encoder = random.Random(5), tokens.Encoder(remembered=50)
    for _ in range(60):
        texts = [" ".join("".join(draw.choices(PARTS, k=draw.randint(draw.random() >= 0.1, 5))) for _ in range(draw.randint(0, 25))) for _ in range(12)]
        found = encoded(encoder, pa.array([None, *texts, ""]).slice(1))
        assert found == [ids[:-1] for ids in brute.tokens([*texts, ""], 0)]


def test_signs_after_a_word_are_not_cut_by_pattern():
    encoder = tokens.Encoder()
    texts = ["Alpha beta; gamma!! delta%%% alpha, été. beta:"]
    cut = encoder.cut
    encoder.cut = lambda x: cut(x) if x[:1] != " " else []  # the text's first word may be cut
    assert encoded(encoder, pa.array(texts)) == [ids[:-1] for ids in brute.tokens(texts, 0)]
