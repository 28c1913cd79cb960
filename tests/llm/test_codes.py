"""Product codes against plain rounds: ties, floors below zero, unused entries, repeats, nulls, owners of a few members."""

import hashlib
import math
import random

import pytest

from tessera.llm import codes


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def assign(p):
        out = []
        for x in cut[p]:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            chosen = [e for e, _ in assign(p)]
            for e in range(len(books[p])):
                own = [x for x, c in zip(cut[p], chosen) if c == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    last = [assign(p) for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(r[0], r[2], "".join(f"{last[p][n][0]:02x}" for p in range(parts)), sum(last[p][n][1] for p in range(parts))) for n, r in enumerate(kept)]
    by = {}
    for _, label, _, e in out:
        by[label] = by.get(label, 0) + e
    return sorted((i, code, e, by[label], sha) for i, label, code, e in out)


SCHEMA = "vec_id bigint, embedding array<double>, label int, position int, entry int, r string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    point = lambda: [random.choice([-1, 1]) * random.choice([0.25, 0.5, 1 / 3, random.random()]) for _ in range(16)]
    out = [(i - 50, point(), random.choice([1, 1, 2, None])) for i in range(400)]
    out += [(7, point(), 1), (7, point(), None), (900, [0.5] * 16, 3), *[(1000 + i, [0.1] * 16, 2) for i in range(150)]]
    return [*out, (901, None, 1), (902, [None] + [0.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (None, [0.0] * 16, 1)]


@pytest.mark.parametrize("parts, entries, rounds", [(8, 16, 6), (4, 3, 2), (2, 256, 1), (16, 1, 3)])
def test_as_plain_rounds(spark, rows, monkeypatch, parts, entries, rounds):
    monkeypatch.setattr(codes, "OWNED", 20)
    monkeypatch.setattr(codes, "CELLS", 100)
    got = codes.compressed(table(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert sorted(map(tuple, got.collect())) == plain(rows, parts, entries, rounds)


def test_only_movers_are_shuffled(spark, rows, monkeypatch):
    """Later rounds place fewer members than the first, which places all; none is placed twice in a round."""
    placed, whole = [], codes._placed
    monkeypatch.setattr(codes, "_placed", lambda *a: placed.append(whole(*a)) or placed[-1])
    codes.compressed(table(spark, rows)).count()
    sizes = [p.count() for p in placed]
    assert len(placed) == codes.ROUNDS and sizes[0] == 8 * (len(rows) - 5) and all(0 < s < sizes[0] / 2 for s in sizes[1:])
    assert all(p.select("r", "position").distinct().count() == s for p, s in zip(placed, sizes))


def test_few_none_and_odd_vectors(spark):
    few = [(3, [0.1] * 8, None), (2, [-0.1] * 8, None)]
    assert sorted(map(tuple, codes.compressed(table(spark, few)).collect())) == plain(few)
    for none in ([], [(1, None, 1)]):
        got = codes.compressed(spark.createDataFrame([(*r, 1, 2, "x") for r in none], SCHEMA))
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for odd in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [], 1)], [(1, [1e12] * 8, 1)]):
        with pytest.raises(ValueError):
            codes.compressed(table(spark, odd))


def test_components_of_any_size(spark):
    """Distances that do not fit in 64 bits are those to entries that are not nearest, or an error."""
    random.seed(14)
    rows = [(i, [random.choice([1e5, -3e7, 5e8, 8e9, 0.25]) + random.random() for _ in range(16)], 1) for i in range(60)]
    wide = [(i, v, label) for i, v, label in rows if i < 16] + [(100 + i, [x + random.choice([0, 2.0, 1e5]) for x in v], label) for i, v, label in rows if i < 16]
    assert sorted(map(tuple, codes.compressed(table(spark, wide), rounds=2).collect())) == plain(wide, rounds=2)
    a, b = codes.nearest(codes.np.array([[1 << 44, 0]]), codes.np.array([[-(1 << 44), 0], [(1 << 44) - 5, 3]]))
    assert (a.tolist(), b.tolist()) == ([1], [34])
