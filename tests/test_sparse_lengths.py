"""Sparse search meets rows by falling length and leaves out pairs whose lengths cannot reach the k-th score."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans.catalogue import ORACLES, QUERIES

KIND = pa.schema([("vec_id", pa.int64()), ("indices", pa.list_(pa.string())), ("values", pa.list_(pa.float64()))])


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), KIND, strict=True)], schema=KIND)


def kept(asked, rows, metric="dot", k=3):
    """The search of one task, in this process: {query: [(score, identifier)]}."""
    sent = search._sparse_block(pa.Table.from_batches(list(search._without_repeats(iter([batch(asked)])))))
    best, place = np.full((len(sent[0]), k), -np.inf), np.full(len(sent[1]), -1, np.int32)
    floor, out = best.min(axis=1), {}
    for at in range(0, len(rows), 40):
        some = batch(rows[at : at + 40])
        names = search._identifiers(some.column(0))
        for q, r, s in search._sparse_scores(some, names, sent, best, floor, place, metric, k):
            for a, b, c in zip(q.tolist(), r.tolist(), s.tolist(), strict=True):
                out.setdefault(sent[0][a].as_py(), set()).add((-c, int(names[b])))
        assert (place == -1).all()
    return {q: [(-s, i) for s, i in sorted(found)[:k]] for q, found in out.items()}


def written_out(asked, rows, metric, k):
    def sums(terms, values):
        own = {}
        for t, w in zip(terms or [], values or [], strict=True):
            own[t] = own.get(t, 0.0) + w
        return own

    length = lambda s: max(math.sqrt(sum(x * x for x in s.values())), 1e-12)
    every = [(i, sums(t, v)) for i, t, v in rows]
    want = {}
    for q, t, v in asked:
        own = sums(t, v)
        met = [(i, s, {x for x in own if x in s and x is not None}) for i, s in every]
        scored = [(sum(own[x] * s[x] for x in both) / (length(own) * length(s) if metric == "cosine" else 1), i) for i, s, both in met if both]
        if scored:
            want[q] = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
    return want


def table(n, kind, seed):
    """Lengths from 1 to some hundred; equal rows; words of all, of few and of one row; a null word; rows without words."""
    random.seed(seed)
    weight = {"counts": lambda: 1.0, "whole": lambda: float(random.choice([3, 1, 2, -1, 0])), "parts": lambda: random.choice([0.1, 0.7, 1.3]), "signed": lambda: random.choice([0.3, -0.4, 0.0, 2.0])}[kind]
    out = []
    for i in range(n):
        terms = [random.choice([f"c{random.randrange(4)}", f"m{random.randrange(40)}", f"r{random.randrange(900)}", f"only{i}", None]) for _ in range(int(random.paretovariate(0.7)) % 400)]
        out.append((i, terms, [weight() for _ in terms]))
    return [*out[:-3], (n - 3, *out[5][1:]), (n - 2, None, None), (n - 1, [], [])]


@pytest.mark.parametrize("metric", ["dot", "cosine"])
@pytest.mark.parametrize("kind", ["counts", "whole", "parts", "signed"])
@pytest.mark.parametrize("cells, entries, first", [(1 << 20, 1 << 20, 64), (60, 50, 1), (7, 1 << 20, 5)])
def test_nothing_is_lost(monkeypatch, metric, kind, cells, entries, first):
    for name, size in (("CELLS", cells), ("ENTRIES", entries), ("FIRST_ROWS", first)):
        monkeypatch.setattr(search, name, size)
    rows = table(150, kind, 5)
    got, want = kept(rows[::5], rows, metric), written_out(rows[::5], rows, metric, 3)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in best], rel=1e-11, abs=1e-12)
        if metric == "dot" and kind in ("counts", "whole"):
            assert got[q] == best


def test_large_and_tiny_weights():
    """Sums that pass 2^24 or squares that pass the range of doubles decide as they should."""
    odd = 2.0**24
    rows = [(1, ["a", "b"], [odd, 1.0]), (2, ["a", "b"], [odd, 2.0]), (3, ["a"], [odd]), (4, ["b"], [5.0])]
    assert kept([(9, ["a", "b"], [1.0, 1.0])], rows) == {9: [(odd + 2, 2), (odd + 1, 1), (odd, 3)]}
    rows = [(i, ["a"], [10.0**-i]) for i in range(196, 204)] + [(5, ["a"], [1e200]), (6, ["a"], [math.inf]), (7, ["a"], [math.nan])]
    assert [i for _, i in kept([(9, ["a"], [1e-3])], rows)[9]] == [6, 5, 196]
    assert [i for _, i in kept([(9, ["a"], [1e-3])], rows[:8])[9]] == [196, 197, 198]


def test_most_pairs_are_left_out(monkeypatch):
    """Long rows have the best products; short ones are not met by queries whose lists are full of longer ones."""
    cells = []
    plain = search._products
    monkeypatch.setattr(search, "_products", lambda asked, met, n, m, *more: cells.append(n * m) or plain(asked, met, n, m, *more))
    random.seed(3)
    rows = [(i, random.choices("abcdefgh", k=1 + i % 500), None) for i in range(4000)]
    rows = [(i, t, [1.0] * len(t)) for i, t, _ in rows]
    asked = rows[::20]
    sent = search._sparse_block(pa.Table.from_batches(list(search._without_repeats(iter([batch(asked)])))))
    best, place = np.full((len(asked), 3), -np.inf), np.full(8, -1, np.int32)
    list(search._sparse_scores(batch(rows), np.arange(4000), sent, best, best.min(axis=1), place, "dot", 3))
    assert 0 < sum(cells) < len(asked) * len(rows) / 4


def test_repeated_words_make_no_further_pass(spark, monkeypatch):
    """A block was measured by words with repeats, and each block splits all texts again."""
    passes = []
    keep = search.stored
    monkeypatch.setattr(search, "stored", lambda df, name: passes.append(name) or keep(df, name))
    rows = spark.createDataFrame([(i, ["a"] * 500 + [f"b{i}"]) for i in range(40)], "vec_id bigint, indices array<string>").withColumn("values", F.array_repeat(F.lit(1.0), F.size("indices")))
    asked = rows.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(search, "QUERY_BYTES", 40 * 150)
    whole = sorted(map(tuple, search.sparse_topk(asked, rows, "dot", 2).collect()))
    assert "found" not in passes and whole[:2] == [(0, 1, 0, 250001.0), (0, 2, 1, 250000.0)] and len(whole) == 80
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    assert sorted(map(tuple, search.sparse_topk(asked, rows, "dot", 2).collect())) == whole and passes.count("found") > 1


def test_no_queries_and_no_words(spark):
    rows = spark.createDataFrame([(1, ["a"], [1.0]), (2, [], []), (3, [None], [2.0]), (4, ["a", None], [1.0, 1.0])], "vec_id bigint, indices array<string>, values array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    assert search.sparse_topk(asked.filter("query_id > 9"), rows, "dot", 2).count() == search.sparse_topk(asked.filter("query_id IN (2, 3)"), rows, "cosine", 2).count() == 0
    assert search.sparse_topk(asked, rows.filter("vec_id = 2"), "dot", 2).count() == 0
    got = search.sparse_topk(asked.filter("query_id = 4"), rows, "cosine", 3).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in got] == [(1, round(0.5**0.5, 9)), (4, 0.5)]


def test_hybrid_search_splits_the_texts_once(spark, tmp_path, monkeypatch):
    passes = []
    keep = search.stored
    monkeypatch.setattr(search, "stored", lambda df, name: passes.append(name) or keep(df, name))
    monkeypatch.setattr(search, "QUERY_BYTES", 6000)  # 20 queries of two numbers, or of some ten different words
    rows = spark.range(2000)
    word = F.transform(F.sequence(F.lit(0), F.col("id") * 31 % 700), lambda i: F.concat(F.lit("w"), (i * i + F.col("id")) % (F.col("id") % 13 + 1)))
    rows.select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    numbers = F.array(F.col("id") % 17, F.col("id") % 23).cast("array<float>")
    rows.select(F.col("id").alias("vec_id"), numbers.alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["hybrid_rrf"](spark, str(tmp_path)).collect()))
    assert "found" not in passes
    db = duckdb.connect()
    for name in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    db.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    assert got == sorted(db.sql(ORACLES["hybrid_rrf"]).fetchall()) and len(got) == 200
