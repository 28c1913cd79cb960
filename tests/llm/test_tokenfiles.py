"""Token files: the code against plain lists, files against the library, order, repeats, nulls, long texts."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenfiles
from tessera.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def library(text):
    from tokenizers import Tokenizer

    if not hasattr(library, "t"):
        library.t = Tokenizer.from_file(tokenfiles.default_path())
    return library.t.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000), st.integers(0, 3000), st.integers(0, 3000))
@settings(max_examples=60, deadline=None)
def test_code_round_trip(numbers, a, b):
    f = tokenfiles.TokenFile(tokenfiles.file_bytes(np.array(numbers, np.uint64), [1, None], [len(numbers), 0], 7, 8) + b"\0" * 8)
    assert f.ids().tolist() == numbers and f.ids(a, b).tolist() == numbers[a:b]
    assert (f.part, f.sequence, f.names.to_pylist(), f.lengths.tolist()) == (7, 8, [1, None], [len(numbers), 0])


def test_words_hold_what_the_selectors_say():
    """Runs as the published table has them: 240 zeros in a word, then 4 numbers of 15 bits, then one of 60."""
    words, counts, _, _ = tokenfiles.pack(np.array([0] * 240 + [32767] * 4 + [2**60 - 1], np.uint64))
    assert [w >> 60 for w in words.tolist()] == [0, 12, 15] and counts.tolist() == [3]
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"\1" * 80)


def test_texts_as_the_library():
    odd = ["", "a  b", "a \n b", " x", "it's 's don't", "<|endoftext|> a<|endoftext|>b", "a\x85 b", "a\x1c b", "　x 　y", "a\r\n b\n\tc", "x.<|endoftext|>.'s"]
    random.seed(3)
    odd += ["".join(random.choice(" \n\t\r\x0b\x1c'sa1.é\xa0　\x85<|>中") for _ in range(random.randint(0, 30))) for _ in range(5000)]
    ids, counts = tokenfiles.load(tokenfiles.default_path()).encode(pa.array(odd))
    at = 0
    for text, n in zip(odd, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library(text), repr(text)
        at += n


def wanted(rows):
    """doc_id, start, n_tokens, crc of rows in order."""
    out, start = [], 0
    for i, text in rows:
        ids = [*library(text), 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, QUERIES["op11_tokens"](spark, DIR).collect())) == wanted(rows)


def test_hard_rows(spark, tmp_path):
    long = "word " * 200_000 + "x" * 100_000
    rows = [(5, "five"), (None, "last"), (-3, None), (7, ""), (6, long), (9, "<|endoftext|>"), (4, "é中 \n  x"), *[(8, "again")] * 500]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, part int, i int").repartition(5)
    tokenfiles.write(docs, f"{tmp_path}/a", file_ids=1000)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(map(tuple, tokenfiles.read(spark, f"{tmp_path}/a", digests=True).collect()), key=lambda r: r[1]) == wanted(order)
    got = {r["start"]: r for r in tokenfiles.read(spark, f"{tmp_path}/a").collect()}
    flat = [i for _, text in order for i in [*library(text), 0]]
    assert all(r["ids"] == flat[s : s + r["n_tokens"]] for s, r in got.items())
    middle = tokenfiles.stretch(spark, f"{tmp_path}/a", 900, len(flat) - 1).orderBy("number").collect()
    assert [tuple(r) for r in middle] == list(enumerate(flat))[900:-1]
    tokenfiles.write(docs.limit(0), f"{tmp_path}/b")
    none = tokenfiles.read(spark, f"{tmp_path}/b", digests=True)
    assert none.count() == 0 and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
