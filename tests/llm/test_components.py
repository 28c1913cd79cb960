"""Components against a plain union-find: chains, stars, cliques, loops, repeats, nulls, strings."""

import random

import pytest

from tessera.llm.components import connected


def plain(links):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return sorted((x, top(x)) for x in parent if top(x) != x)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components(spark, kind):
    random.seed(13)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(i, j) for i in range(200, 208) for j in range(200, 208)]
    links += [(random.randint(300, 500), random.randint(300, 500)) for _ in range(90)] + [(None, 5), (6, None), (7, 7), (1, 0), (0, 1)]
    random.shuffle(links)
    if kind == "string":
        links = [tuple(None if x is None else f"n{x:04d}" for x in p) for p in links]
    got = connected(spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(4))
    assert sorted((r["id"], r["component_id"]) for r in got.collect() if r["id"] != r["component_id"]) == plain(links)
    stars = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, connected(stars).collect())) == [(2, 1), (3, 1), (5, 4)] and connected(stars.limit(0)).count() == 0
