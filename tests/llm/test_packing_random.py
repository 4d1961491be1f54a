"""Ids of random strings, Unicode, control characters and runs of spaces included, against the tokenizers library."""

import random

import numpy as np

from quirefold.llm import packing, queries


def test_ids_of_random_strings():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(8)
    pools = ["abc XYZ 019 .,'’\"-", " \t\n\r\x0b  　", "éßñøŁжחبक日本語한", "\x00\x07\x1f\x7f\x85​ ﻿", "😀🇫🇷👩‍👩‍👧́̈", "²½Ⅷ٣०"]
    texts = []
    for _ in range(3000):
        pool = "".join(rng.sample(pools, rng.randrange(1, 4)))
        texts.append("".join(rng.choice(pool) for _ in range(rng.randrange(60))))
    texts += [" ".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    got = packing._ids_of(path, 1000)(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
