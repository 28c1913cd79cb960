"""Sparse search in blocks that are measured by all their entries, against products written out."""

import math
import random

import pytest

from tessera.operators import search
from tessera.sources import vectors


@pytest.fixture(scope="module")
def lists():
    """Common and rare indices, repeated ones, weights of every sign; some weights are nothing, one row is very long."""
    random.seed(11)
    out = []
    for i in range(400):
        terms = [f"c{random.randrange(6)}" for _ in range(random.randrange(7))] + [f"r{random.randrange(300)}" for _ in range(random.randrange(9))]
        out.append((i, terms, [random.choice([0.1, 0.7, 1.3, -0.4, 0.0, 2.0]) for _ in terms]))
    long = [f"r{i}" for i in range(3000)]
    return [*out, (400, long, [0.3] * 3000), (401, [], []), (402, None, None), (403, out[7][1], out[7][2])]


def products(lists, positive, metric, k):
    sums = {}
    for i, terms, values in lists:
        own = sums.setdefault(i, {})
        for t, w in zip(terms or [], values or [], strict=True):
            own[t] = own.get(t, 0.0) + (abs(w) + 0.25 if positive else w)
    norm = lambda s: max(math.sqrt(sum(x * x for x in s.values())), 1e-12)
    want = {}
    for q in range(0, 404, 4):
        scored = [(sum(sums[q][t] * s[t] for t in sums[q] if t in s) / (norm(sums[q]) * norm(s) if metric == "cosine" else 1), i) for i, s in sums.items() if set(sums[q]) & set(s)]
        want[q] = scored, k
    return want


@pytest.mark.parametrize("metric", ["dot", "cosine"])
@pytest.mark.parametrize("positive", [True, False])
@pytest.mark.parametrize("cells", [1 << 20, 300])
def test_against_products_written_out(spark, lists, monkeypatch, metric, positive, cells):
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "ENTRIES", cells)
    rows = spark.createDataFrame([(i, t, v and [abs(x) + 0.25 if positive else x for x in v]) for i, t, v in lists], "vec_id bigint, indices array<string>, values array<double>").repartition(3)
    got = {}
    for r in search.sparse_topk(rows.filter("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id"), rows, metric, 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    for q, (scored, k) in products(lists, positive, metric, 7).items():
        exact = dict((i, s) for s, i in scored)
        best = sorted(exact.values(), reverse=True)[:k]
        mine = [got.get(q, {})[n] for n in range(1, len(best) + 1)]
        assert len(got.get(q, {})) == len(best)
        assert [s for s, _ in mine] == pytest.approx(best, rel=1e-11, abs=1e-12) and all(exact[i] == pytest.approx(s, rel=1e-11, abs=1e-12) for s, i in mine)
        ties = {i: s for s, i in mine if i in (7, 403)}  # equal rows
        assert len(set(ties.values())) <= 1


def test_one_long_query_makes_no_passes(spark, monkeypatch):
    """Blocks had as many queries as would fit if all were as long as the longest."""
    rows = spark.createDataFrame([(i, [f"t{i}"] * (1000 if i == 0 else 1)) for i in range(200)], "query_id bigint, indices array<string>")
    monkeypatch.setattr(search, "QUERY_BYTES", 32 * 2000)
    assert len(search.blocks_by_entries(rows, "indices")) == 1
    monkeypatch.setattr(search, "QUERY_BYTES", 32 * 300)
    assert len(search.blocks_by_entries(rows, "indices")) == 4


def test_entries_are_summed_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(search, "ENTRIES", 3)
    rows = spark.createDataFrame([(1, ["b", "a", "b", None], [1.0, 2.0, 0.5, 4.0]), (2, [], []), (3, None, None), (4, ["c", "c", "d"], [None, None, 1.0]), (5, ["a"] * 9, [1.0] * 9)], "vec_id bigint, indices array<string>, values array<double>")
    found = vectors.sparse_entries(rows)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(1, "a", 2.0), (1, "b", 1.5), (1, None, 4.0), (4, "c", None), (4, "d", 1.0), (5, "a", 9.0)]))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
