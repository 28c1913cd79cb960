"""Collocations against a plain count, with marks, several languages, odd bytes, hot words, ranges of a few phrases."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, best=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(words)
            f.update((g, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {}
    for (g, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
            longer = max([x for (h, q), x in f.items() if h == g and len(q) == len(p) + 1 and x >= least and p in (q[:-1], q[1:])], default=0)
            if longer < a:
                found.setdefault(g, []).append((-score, -a, " ".join(p).encode(), a, f[g, p[:k]], f[g, p[k:]]))
    return {(g, i + 1, p.decode(), a, x, y, n[g], -s) for g, c in found.items() for i, (s, _, p, a, x, y) in enumerate(sorted(c)[:best])}


def got(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    words = ["the", "The", "of", "a", "é", "\x00", "\x01", "\x01\x02", "b\x00", "中", "x-y"] + [f"w{i}" for i in range(40)]
    some = lambda: "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "? "]) for _ in range(random.randint(0, 60)))
    out = [(some() + random.choice(["one two three four five six ", "in order to ", ""]), random.choice(["en", "en", "fr", None, "und", "", "e\x00"])) for _ in range(600)]
    return [*out, (None, "en"), ("", None), (" ,. ", "fr"), ("the of " * 30_000 + "end", "en")]


@pytest.mark.parametrize("least, longest, best", [(3, 5, 2000), (20, 3, 7), (10**9, 5, 2000)])
def test_as_counted(spark, rows, monkeypatch, least, longest, best):
    monkeypatch.setattr(collocations, "RANGE_ROWS", 5)
    monkeypatch.setattr(collocations, "HASHES", 1000)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, n int, part int, key int").repartition(5)
    want = plain(rows, least, longest, best)
    assert got(collocations.collocations(docs, least=least, longest=longest, best=best)) == want
    assert bool(want) == (least < 100)


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([("big red dog. big red", None)] * 100, "text string, lang string")
    assert got(collocations.collocations(docs)) == plain([("big red dog. big red", None)] * 100, 100)
    assert got(collocations.collocations(docs.limit(0))) == set()


def test_scores_past_64_bits():
    """Floor of a quotient whose numerator has 30 digits; the first of equal cuts."""
    assert collocations.best_cut(10**12, 10**15, [10**13, 10**12 + 1], [10**12 + 7, 10**13]) == (10**30 // (10**13 * (10**12 + 7)), 10**13, 10**12 + 7)
    assert collocations.best_cut(1, 1, [1, 1], [1, 1])[1:] == (1, 1)
