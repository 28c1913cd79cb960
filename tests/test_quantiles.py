"""Quantiles against sorted lists: one group that holds all, many small ones, nulls, NaN, repeated values."""

import math
import random

import numpy as np
import pytest

from tessera.operators import evaluate, prepare, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(6)
    out = [("hot", random.choice([1.5, random.gauss(0, 10)])) for _ in range(3000)] + [(f"g{i % 7}", float(random.randint(0, 5))) for i in range(60)]
    out += [(None, 2.0), (None, None), ("none", None), ("one", 4.0), ("nan", math.nan), ("nan", 1.0)]
    return spark.createDataFrame(out, "k string, v double").repartition(6)


def test_nearest_ranks(spark, rows):
    by = {}
    for r in rows.collect():
        by.setdefault(r["k"], []).append(r["v"])
    got = {r["k"]: r for r in evaluate.latencies(rows, "v", "k").collect()}
    assert set(got) == set(by)
    for k, values in by.items():
        known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            want = known[max(1, math.ceil(q * len(known))) - 1] if known else 0.0
            assert got[k][name] == want or math.isnan(got[k][name]) and math.isnan(want)
        assert got[k]["n"] == len(known)
    whole = evaluate.latencies(rows.filter("k = 'hot'"), "v").first()
    assert whole["p95"] == got["hot"]["p95"] and whole["n"] == 3000


def test_one_group_is_spread(spark, rows):
    """No task of the running counts has more than a part of the hot group's values."""
    running = quantiles.running_counts(rows.filter("k = 'hot'"), "v", ["k"])
    plan = running._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    told = running.orderBy("v").collect()
    assert [r["before"] for r in told] == np.r_[0, np.cumsum([r["n"] for r in told])[:-1]].tolist()


def test_interpolated(spark, rows):
    values = [r["v"] for r in rows.filter("k = 'hot'").collect()]
    got = quantiles.interpolated(quantiles.running_counts(rows, "v", ["k"]), "v", {"a": 0.5, "b": 0.95, "c": 0.123}, ["k"]).filter("k = 'hot'").first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.quantile(values, [0.5, 0.95, 0.123]))
    lengths = spark.createDataFrame([(random.randint(0, 50),) for _ in range(500)] + [(None,)], "n bigint")
    known = np.array([r[0] for r in lengths.collect() if r[0] is not None])
    told = prepare.length_stats(lengths, "n").first()
    logs = np.log(known[known > 0])
    want = [len(known), known.mean(), np.median(known), known.std(), *np.quantile(known, [0.95, 0.99]), known.max(), logs.mean(), logs.std()]
    assert np.allclose(list(told), want)
    none = prepare.length_stats(lengths.limit(0), "n").first()
    assert none["n"] == 0 and none["median"] is None and none["std"] is None
