"""Token ids by words against the tokenizer on whole texts."""

import random

import numpy as np
from tokenizers import Tokenizer

from vesper.llm import packing


def test_ids_of_random_strings_equal_the_tokenizer(monkeypatch):
    rng = random.Random(20)
    scripts = [range(0x20, 0x7F), range(0xC0, 0x250), range(0x300, 0x370), range(0x370, 0x530), range(0x5D0, 0x700), range(0x900, 0x980), range(0xE00, 0xE5B), range(0x1E00, 0x2070), range(0x3040, 0x30FF), range(0x4E00, 0x4F00), range(0xAC00, 0xAC80), range(0x1F600, 0x1F640)]
    scripts = ["".join(map(chr, s)) for s in scripts]
    special = ["İ", "ß", "Σ", "ς", "ﬁ", "Ǆ", "ẞ", "̇", "ͅ", "K", "Å", "‍", " ", " ", "\x85", "\x1c", "﻿", "'", "'S", "'re"]
    marks = ".,;: .,;: \t\n"

    def text():
        out = []
        for _ in range(rng.randint(1, 6)):
            pool = rng.choice(scripts)
            out.append("".join(rng.choices(pool, k=rng.randint(0, 4))) + (rng.choice(special) if rng.random() < 0.3 else "") + rng.choice(marks))
        return "".join(out)

    texts = [text() for _ in range(100_000)] + ["İ.", "İ,", "İ;", "İ:", "aİ.", "İa.", "éx."]
    monkeypatch.setattr(packing, "CACHE", 50_000)  # so that it is emptied on the way
    monkeypatch.setattr(packing, "LONGEST", 6)
    encoder = Tokenizer.from_file(packing.tokenizer_path())
    words = packing.WordTokens(packing.tokenizer_path())
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        for t, found, e in zip(part, words(part), encoder.encode_batch(part, add_special_tokens=False), strict=True):
            assert found == np.array(e.ids, "<u4").tobytes(), repr(t)


def test_the_cache_is_a_stages_own():
    encode = packing.WordTokens(packing.tokenizer_path())
    encode.begin(1)
    first = list(encode(["some words, and more"]))
    encode.begin(1)
    assert encode.cache
    encode.begin(2)
    assert not encode.cache and list(encode(["some words, and more"])) == first
