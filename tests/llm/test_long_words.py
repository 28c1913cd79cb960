"""Unbroken words of any length: equal to the library, in seconds."""

import random
import time

from tessera.llm import bpe


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_long_words_as_the_library():
    random.seed(9)
    ours, theirs = bpe.load(bpe.default_path()), library()
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "aab", "中文字典日本語", "é", "-=+/", "ab中é"):
        for n in (255, 256, 257, 1000, 4001):
            word = "".join(random.choice(alphabet) for _ in range(n))
            assert ours.encode(word) == theirs.encode(word, add_special_tokens=False).ids


def test_a_word_of_a_megabyte():
    random.seed(10)
    word = "".join(random.choice("etaoinshrdlu") for _ in range(1 << 20))
    began = time.process_time()
    got = bpe.load(bpe.default_path()).encode(word)
    assert time.process_time() - began < 120 and got == library().encode(word, add_special_tokens=False).ids
