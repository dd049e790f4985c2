"""Pieces that texts are cut into before they are encoded: ids as of whole texts, few pieces given to the library."""

import itertools
import json
import random

import numpy as np
import pytest

from quarrykit.llm import tokenids

ALPHABET = ["a", "b", "s", "ll", "Z", "é", "ß", "×", "÷", "ª", "́", "’", "…", "ж", "日", " ", " ", "\u0085", "'", "'", "-", "_", "5", "²", ".", " ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1f", "\x00", "\x7f", "<|endoftext|>", "<|endof", "text|>", "😀"]


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def given(encoder, monkeypatch):
    """Texts that go to the library."""
    seen, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: seen.extend(texts) or encode(texts))
    return seen


@pytest.mark.parametrize("memo", [600_000, 3_000, 10])
@pytest.mark.parametrize("added", [[], ["b.", "\nZ", "a'", "é-a", "-a'"]])
def test_ids_are_those_of_whole_texts(spec, monkeypatch, memo, added):
    from tokenizers import Tokenizer

    shape = json.loads(spec)
    for k, content in enumerate(added):
        shape["added_tokens"].append(shape["added_tokens"][0] | {"id": len(shape["model"]["vocab"]) + k, "content": content})
    monkeypatch.setattr(tokenids, "MEMO", memo)
    library, encoder = Tokenizer.from_str(json.dumps(shape)), tokenids.Encoder(json.dumps(shape))
    r = random.Random(5)
    pairs = ["".join(x) for n in (2, 3) for x in itertools.product(ALPHABET, repeat=n)]
    around = [f"a{''.join(x)}b" for x in itertools.product(ALPHABET, repeat=2)]
    long = ["".join(r.choices(ALPHABET, k=r.randrange(30))) for _ in range(20_000)]
    texts = pairs + around + long
    r.shuffle(texts)
    for i in range(0, len(texts), 7_000):
        some = texts[i : i + 7_000]
        got, want = encoder.encode(some), library.encode_batch(some, add_special_tokens=False)
        assert [t for t, g, w in zip(some, got, want, strict=True) if g.tolist() != w.ids] == []


def test_words_are_encoded_once_whatever_stands_beside_them(spec, monkeypatch):
    encoder = tokenids.Encoder(spec)
    words = [f"w{a}{b}ö" for a in "abcdefghij" for b in "klmnopqrst"]
    encoder.encode([" ".join(["x", *words, "x"])])
    seen = given(encoder, monkeypatch)
    encoder.encode([f"x {w}{mark}x" for w in words for mark in (".", ",", ";", ":", "!", "?", ".\n", "'s")])
    assert len("".join(seen)) < 100


def test_pieces_met_often_outlive_an_overflow(spec, monkeypatch):
    monkeypatch.setattr(tokenids, "MEMO", 400)
    encoder = tokenids.Encoder(spec)
    often = " ".join(["x", *(f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"), "x"])
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng = np.random.default_rng(1)
    rare = [" ".join(["x", *("".join(rng.choice(letters, 9)) for _ in range(90)), "x"]) for _ in range(12)]
    encoder.encode([often])
    seen = given(encoder, monkeypatch)
    for text in rare:
        encoder.encode([often, text])
    assert len(encoder._known) <= 400
    assert sum(text.count(" wak") for text in seen) == 0
