"""Results, ground truth, dates, loading and embedding on rows that the tables do not have."""

import math
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions.dates import literal_micros, micros, spark_pattern
from tessera.operators import embedding, evaluate, load, prepare, results, search, truth
from tessera.operators.embedding import Entry
from tessera.operators.filters import checked_queries, chosen
from tessera.operators.filters import evaluate as filtered
from tessera.plans import grid
from tessera.sources import files, vectors
from tessera.sources.store import ParquetStore

LONG = "query_id bigint, rank int, vec_id bigint, score double"


def points(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def asked(spark, *rows):
    return spark.createDataFrame([(i, list(v)) for i, v in enumerate(rows)], "query_id bigint, embedding array<double>")


# --- search -------------------------------------------------------------------------------------------------------
def test_neighbours_of_long_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64) * 1e4
    rows = [(i, (base + rng.normal(size=64) * 1e-4).tolist()) for i in range(300)]
    got = [r["vec_id"] for r in search.dense_topk(asked(spark, base.tolist()), points(spark, rows), "euclidean", 5).orderBy("rank").collect()]
    want = sorted((sum((a - b) ** 2 for a, b in zip(v, base, strict=True)), i) for i, v in rows)
    assert got == [i for _, i in want[:5]]


def test_infinite_scores_lose_nothing(spark):
    inf = math.inf
    rows = points(spark, [(i, [inf, 0.0]) for i in (4, 2, 9, 7)] + [(1, [5.0, 0.0]), (3, [-inf, 0.0]), (5, [math.nan, 0.0])])
    got = search.dense_topk(asked(spark, [1.0, 1.0]), rows, "dot", 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 4, 7]
    assert [r["vec_id"] for r in search.dense_topk(asked(spark, [1.0, 1.0]), rows, "dot", 9).orderBy("rank").collect()] == [2, 4, 7, 9, 1]
    slot = search.dense_topk(asked(spark, [1.0, 1.0]), rows, "dot", 3, nan="slot").orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in slot] == [(1, 2), (2, 4)]


def test_ranked_queries_in_blocks_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [f"t{i % 5}", f"t{i % 7}", "all", f"t{i % 5}"], [1.0, 2.0, -0.5, 1.0]) for i in range(90)] + [(90, [], []), (91, None, None)], "vec_id bigint, indices array<string>, values array<double>")
    ask = rows.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    flat = [(r["vec_id"], dict.fromkeys(r["indices"] or [], 0.0), r) for r in rows.collect()]
    for i, sums, r in flat:
        for t, w in zip(r["indices"] or [], r["values"] or [], strict=True):
            sums[t] += w
    for metric in ("dot", "cosine"):
        whole = sorted(map(tuple, search.sparse_topk(ask, rows, metric, 6).collect()))
        best = []
        for q, qs, _ in flat:
            if q % 10 or not qs:
                continue
            norm = lambda s: math.sqrt(sum(x * x for x in s.values())) or 1e-12
            scored = sorted((-sum(qs[t] * s[t] for t in qs if t in s) / (norm(qs) * norm(s) if metric == "cosine" else 1), i) for i, s, _ in flat if set(qs) & set(s))
            best += [(q, n + 1, i) for n, (_, i) in enumerate(scored[:6])]
        if metric == "dot":
            assert [x[:3] for x in whole] == sorted(best)
        assert len(whole) == len(best)
        monkeypatch.setattr(search, "CELLS", 40)
        assert [x[:3] for x in sorted(map(tuple, search.sparse_topk(ask, rows, metric, 6).collect()))] == [x[:3] for x in whole]
        monkeypatch.setattr(search, "CELLS", 1 << 22)
        monkeypatch.setattr(search, "QUERY_BYTES", 64 * 4 * 3)
        assert sorted(map(tuple, search.sparse_topk(ask, rows, metric, 6).collect())) == whole
        monkeypatch.undo()


def test_maxsim_skips_rows_without_tokens(spark):
    rows = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, []), (3, None), (4, [[2.0, 2.0]]), (5, [[1.0]])], "vec_id bigint, tokens array<array<double>>")
    got = search.maxsim_topk(rows.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id"), rows, "dot", 5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(4, 4.0), (1, 2.0)]


def test_tie_rules(spark):
    df = spark.createDataFrame([(0, 1.0, 1, b"x", "f", 1), (0, 1.0, None, b"x", "f", 0)], "query_id bigint, score double, vec_id bigint, raw binary, filename string, file_row_number bigint")
    assert search.ranked(df, 1, search.tie_order(df.schema, "ordinal")).first()["vec_id"] is None
    with pytest.raises(Exception, match="null identifier"):
        search.ranked(df, 1, search.tie_order(df.schema, "id")).collect()
    for rule, column in (("id", "raw"), ("other", "vec_id")):
        with pytest.raises(ValueError):
            search.tie_order(df.schema, rule, column)


def test_bounds_are_checked(spark):
    merged = spark.createDataFrame([(1, 1, 5, 3.0), (1, 2, 6, 1.0), (2, 1, 5, 2.0)], LONG)
    bounds = spark.createDataFrame([(1, 2.0), (2, 0.5)], "query_id bigint, bound double")
    assert [r["query_id"] for r in search.unreached(merged, bounds, 2).orderBy("query_id").collect()] == [1, 2]
    assert search.trimmed(merged, bounds).count() == 2


# --- results ------------------------------------------------------------------------------------------------------
def test_results_are_written_with_their_provenance(spark, tmp_path):
    queries = asked(spark, [1.0, 0.0], [0.0, 1.0]).withColumn("tag", F.lit("a"))
    found = search.dense_topk(queries.filter("query_id = 0"), points(spark, [(7, [1.0, 1.0])]), "dot", 3)
    lists = results.result_lists(found, queries, ["tag"])
    told = {"run": results.run_identity({"k": 3}, "corpus"), "settings": results.identity({"k": 3}), "tie": "id"}
    path = results.write_result(lists, str(tmp_path), "x/queries.parquet", "plain", 3, told)
    back = spark.read.parquet(path)
    assert path.endswith("topk_queries_plain_k3.parquet") and dict(back.dtypes)["hit_scores"] == "array<float>"
    assert sorted((r["query_id"], r["tag"], tuple(r["hit_ids"])) for r in back.collect()) == [("0", "a", ("7",)), ("1", "a", ())]
    assert results.read_json(spark, f"{path}.json")["run"] == told["run"] and results.read_json(spark, f"{path}.none") is None
    assert results.identity({"a": 1, "b": 2}) == results.identity({"b": 2, "a": 1}) != results.identity({"a": 1})
    assert results.write_result(lists, str(tmp_path), "q", "plain", 3, told, rank=2).endswith("/rank002.parquet")
    with pytest.raises(ValueError, match="named like"):
        results.result_lists(found, queries.withColumn("hit_ids", F.lit(1)), ["hit_ids"])


def test_only_parts_of_one_run_are_merged(spark):
    one = {"run": "r", "settings": "s", "tie": "id", "k": 2, "parts": 2}
    assert results.check_runs([{**one, "rank": 1}, {**one, "rank": 0}]) == one
    for wrong in ([{**one, "rank": 0}], [{**one, "rank": 0}, {**one, "rank": 1, "tie": "ordinal"}], [{**one, "rank": 0}, {**one, "rank": 0}], []):
        with pytest.raises(ValueError):
            results.check_runs(wrong)
    assert results.check_runs([{**one, "rank": 0}], forced=True)["forced"]
    schema = "part int, query_id string, hit_ids array<string>, hit_scores array<float>, nan_hits int"
    good = [(0, "1", ["a", "b"], [3.0, 1.0], 0), (1, "1", ["c"], [2.0], 1)]
    assert [r["vec_id"] for r in results.merge_lists(spark.createDataFrame(good, schema), 3, 2).orderBy("rank").collect()] == ["a", "c"]
    for bad in (good[:1], [*good, good[1]], [good[0], (1, "1", None, [2.0], 0)], [good[0], (1, "1", ["c"], [], 0)]):
        with pytest.raises(Exception, match="do not fit together"):
            results.merge_lists(spark.createDataFrame(bad, schema), 3, 2).collect()


# --- truth ----------------------------------------------------------------------------------------------------------
def test_bad_truth_is_refused(spark):
    lists = spark.createDataFrame([(1, [1, 2], [2.0, 1.0]), (2, [1, 2, 3], [1.0, 2.0, 1.5]), (3, [1], [math.inf]), (4, [1, 2], [1.0]), (5, [1, 2], [1.0, 1.0]), (6, [1], None), (7, [], [])], "query_id bigint, ids array<bigint>, scores array<double>")
    got = {r["query_id"]: r["p"] for r in lists.select("query_id", truth.problem().alias("p")).collect()}
    assert [got[i] for i in (1, 5, 6, 7)] == [None] * 4
    assert [got[i].split()[-1] for i in (2, 3, 4)] == ["first", "finite", "length"]
    assert truth.checked(lists.filter("query_id IN (1, 5)")).count() == 2
    with pytest.raises(Exception, match="ground truth of query"):
        truth.checked(lists).collect()
    assert truth.long_of(lists.filter("query_id = 1")).count() == 2


def test_orientation_is_read_or_guessed(spark):
    rows = [(1, 1, 1, 1.0), (1, 2, 2, 3.0), (2, 1, 1, -3.0), (2, 2, 2, -1.0), (3, 1, 1, 2.0), (3, 2, 2, 2.0), (4, 1, 1, 5.0), (4, 2, 2, 4.0)]
    df = spark.createDataFrame(rows, LONG)
    got = {r["query_id"]: (r["cutoff"], r["known"], r["comparable"]) for r in truth.orientation(df, 2).collect()}
    assert got == {1: (-3.0, True, False), 2: (1.0, True, True), 3: (2.0, False, True), 4: (4.0, True, True)}
    got = {r["query_id"]: (r["cutoff"], r["known"], r["comparable"]) for r in truth.orientation(df, 2, higher_is_better=False).collect()}
    assert got == {1: (-3.0, True, True), 2: (1.0, True, True), 3: (-2.0, False, True), 4: (4.0, True, True)}


def test_any_order_of_ties_is_as_good(spark):
    deep = spark.createDataFrame([(1, n + 1, 10 + n, 2.0 if n == 0 else 1.0) for n in range(6)], LONG)
    found = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 15, 0.0), (1, 3, 14, 0.0)], LONG)
    r = truth.overlap_tolerant(found, deep, 3, 0.5).first()
    assert (r["depth"], r["overlap"]) == (3, 1) and abs(r["rbo_tolerant"] - (1 - 0.5**3)) < 1e-12 and r["rbo"] < r["rbo_tolerant"]
    assert truth.cutoff_ties(deep, 3).count() == 3 and truth.cutoff_ties(deep, 3, most=2).count() == 0
    assert truth.overlap_tolerant(found.limit(0), deep, 3).first()["rbo"] == 0
    wide = evaluate.rank_biased_overlap(found, deep, 3, 0.5).first()
    assert abs(wide["rbo"] - r["rbo"]) < 1e-12
    assert truth.epsilon_for("float32") == 5e-6 and truth.epsilon_for("float16") == truth.epsilon_for("float32", True) == 2e-3
    assert truth.no_tie_report(None) and truth.no_tie_report("dot", True, False) and truth.no_tie_report("dot", True) is None


# --- dates and filters ------------------------------------------------------------------------------------------------
def test_dates_of_all_formats(spark):
    texts = ["2017-09-19T11:23:19Z", "2017-09-19 11:23:19", "2017-09-19 13:23:19+02", "2017-09-19t11:23:19.000000z", "2017-09-19T09:23:19-02:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = 1505820199000000
    assert [r[0] for r in df.select(micros(F.col("t"))).collect()] == [want] * 5 + [None]
    assert [literal_micros(t) for t in texts[:2]] == [want] * 2 and literal_micros(want / 1e6, "epoch_s") == literal_micros("1505820199", "epoch_s") == want
    assert literal_micros("19.09.2017", "%d.%m.%Y") == 1505779200000000 == literal_micros("2017-09-19")
    assert spark_pattern("%Y-%m'T'%H") == "yyyy'-'MM'''T'''HH"
    with pytest.raises(Exception, match="CAST_INVALID|malformed"):
        spark.createDataFrame([("soon",)], "t string").select(micros(F.col("t"))).collect()
    for bad in ("soon", math.nan):
        with pytest.raises(ValueError):
            literal_micros(bad)


def kept(df, spec, **more):
    return [r["i"] for r in df.filter(filtered(df.schema, spec, **more)).orderBy("i").collect()]


def test_date_filters_and_strictness(spark):
    df = spark.createDataFrame([(1, 100, "01/02/2020"), (2, 200, None)], "i int, s bigint, t string")
    assert kept(df, {"must": [{"field": "s", "range": {"gt": 100}}]}, dates={"s": "epoch_s"}) == [2]
    assert kept(df, {"must": [{"field": "s", "range": {"lt": 200}}]}, dates={"s": "epoch_us"}) == [1]
    assert kept(df, {"must": [{"field": "t", "range": {"gte": "01/02/2020"}}]}, dates={"t": "%d/%m/%Y"}) == [1]
    ask = spark.createDataFrame([(1, 1.5, None)], "query_id int, x double, lang string")
    names = {c: F.col(c) for c in ask.columns}
    for spec, more in (
        ({"must": [{"field": "s", "match": []}]}, {"strict": True}),
        ({"must": [{"field": "s", "range": {"gt": 1, "lt": "2020-01-01"}}]}, {"strict": True, "dates": ["s"]}),
        ({"must": [{"field": "s", "match_from_query": "none"}]}, {"query": names, "query_schema": ask.schema}),
        ({"must": [{"field": "s", "match_from_query": "x"}]}, {"query": names, "query_schema": ask.schema}),
        ({"must": [{"field": "s", "range_from_query": {"gt": "x"}}]}, {"query": names, "query_schema": ask.schema, "dates": ["s"], "query_dates": []}),
        ({"must": [{"field": "t", "match": "x"}]}, {"dates": ["t"]}),
    ):
        with pytest.raises(ValueError):
            filtered(df.schema, spec, **more)
    with pytest.raises(Exception, match="no value in 'lang'"):
        checked_queries(ask, {"must": [{"field": "t", "match_from_query": "lang"}]}).collect()
    assert chosen(ask, "query_id", ["1"]).count() == 1
    with pytest.raises(ValueError, match="no query"):
        chosen(ask, "query_id", [5])


# --- sources and loading ------------------------------------------------------------------------------------------------
def test_vector_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], ([1, 1], [0.5, 0.25]), [[1.0], None]), (2, [1.0, 2.0], None, None)], "vec_id bigint, d array<float>, s struct<indices:array<int>,values:array<float>>, m array<array<float>>")
    assert vectors.dense(df, "d").count() == 2
    with pytest.raises(Exception, match="not 3 numbers"):
        vectors.dense(df, "d", 3).collect()
    assert [tuple(r) for r in vectors.sparse_entries(vectors.sparse(df, "s")).collect()] == [(1, 1, 0.75)]
    assert [(r["vec_id"], r["token"]) for r in vectors.token_rows(df, "m").collect()] == [(1, 0)]
    uneven = spark.createDataFrame([(1, ([1], [0.5, 0.25]))], "vec_id bigint, s struct<indices:array<int>,values:array<float>>")
    with pytest.raises(Exception, match="differ in length"):
        vectors.sparse(uneven, "s").collect()
    halves = pa.table({"vec_id": pa.array(range(5), pa.int64()), "v": pa.array([np.arange(3, dtype=np.float16)] * 5, pa.list_(pa.float16()))})
    pq.write_table(halves, tmp_path / "h.parquet", row_group_size=2)
    got = vectors.half_vectors(spark, [str(tmp_path / "h.parquet")], "v", "vec_id bigint").orderBy("vec_id").collect()
    assert [(r["vec_id"], r["v"]) for r in got] == [(i, [0.0, 1.0, 2.0]) for i in range(5)]
    rows = df.withColumn("at", F.lit("2020-01-01"))
    asked_ = vectors.load_queries(rows, "vec_id", "d", ("at",), {"at": "rfc3339"}).first()
    assert (asked_["at"], asked_["at_us"], asked_["embedding"]) == ("2020-01-01", 1577836800000000, [1.0, 2.0])
    assert set(vectors.load_queries(df, "vec_id", "s").columns) == {"query_id", "indices", "values"}
    assert vectors.load_queries(df, "vec_id", "m").columns == ["query_id", "tokens"]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert files.selected(["a"], "b") == [] and len(said) == 1


def test_points_identifiers_and_names(spark, tmp_path):
    load.register_functions(spark)
    spark.range(3).write.parquet(f"{tmp_path}/p")
    scan = files.scan(spark, f"{tmp_path}/p")
    rows = load.points(scan, "vf_point_id(filename, file_row_number)", {"v": "array(id)"}, {"id": "id + 1", "word": "random_word()", "words": "random_words(3)", "pick": "random_choice(array('a', 'b'))"}, "id % 2")
    got = rows.collect()
    assert len(got) == 3 and rows.columns == ["__id", "__shard_key", "v", "id", "word", "words", "pick"]
    assert all(r["word"] in load.WORDS and len(r["words"].split()) == 3 and r["pick"] in "ab" and r["id"] == r["v"][0] + 1 for r in got)
    first = scan.filter("file_row_number = 0").select(files.key_of(F.col("filename")).alias("f")).first()["f"]
    assert load.virtual_id(spark, first, 0, "vf_point_id(filename, file_row_number)") in {r["__id"] for r in got}
    assert load.points(scan, limit=2).count() == 2
    for bad in ({"identifier": "1.5"}, {"vectors": {"a": "id"}, "payload": {"a": "id"}}):
        with pytest.raises(ValueError):
            load.points(scan, **bad)
    odd = spark.createDataFrame([(1, math.nan, None, b"x", True)], "a bigint, b double, c string, d binary, e boolean")
    assert odd.select(load.payload_json(odd)).first()[0] == '{"a":1,"b":null,"c":null,"d":null,"e":true}'
    assert load.named(load.DISTANCES, "L2") == "euclidean" and load.named(load.DATATYPES, None) is None
    with pytest.raises(ValueError):
        load.named(load.MODIFIERS, "bm25")
    listing = spark.createDataFrame([(f"f{i}",) for i in range(5)], "path string")
    held = lambda n: listing.filter(f"path < 'f{n}'").select(F.concat(F.col("path"), F.lit(":0")).alias("vec_id"))
    assert [load.resume_file(listing, held(n), "concat(filename, ':', file_row_number)") for n in (0, 1, 3, 5)] == [0, 0, 2, 4]


def test_files_by_content(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0], None)], "i int, e array<double>, s struct<indices:array<int>,values:array<double>>")
    for name in ("a", "b"):
        load.write_embeddings(df.repartition(1), {"e": "dense", "s": "sparse"}, f"{tmp_path}/{name}", ["i"])
    one, two = (load.content_addressed(spark, f"{tmp_path}/{n}", 2000) for n in ("a", "b"))
    assert [x.rsplit("/", 2)[1:] for x in one] == [x.rsplit("/", 2)[1:] for x in two] and len(one[0].rsplit("/", 2)[1]) == 4
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/a").dtypes == [("i", "int"), ("e", "array<float>"), ("s", "struct<indices:array<int>,values:array<float>>")]
    with pytest.raises(ValueError, match="source columns too"):
        load.write_embeddings(df, {"i": "dense"}, f"{tmp_path}/c", ["i"])
    series = spark.createDataFrame([(1.5, 3.0, True, [0.5]), (0.5, 2.0, False, [])], "t_s double, latency_ms double, ok boolean, recalls array<double>")
    for form in ("csv", "jsonl"):
        load.write_series(series, f"{tmp_path}/{form}", form)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/jsonl").count() == 2


def test_the_writer_batches_paces_and_tries_again(spark, tmp_path):
    (tmp_path / "sent").mkdir()
    where = str(tmp_path / "sent")

    def send(rows):
        import os

        name = f"{where}/{rows[0]['k']}-{rows[0]['i']}"
        if rows[0]["k"] == 1 and not os.path.exists(name + ".tried"):
            open(name + ".tried", "w").close()
            raise OSError("busy")
        if rows[0]["k"] == 2:
            e = ValueError("refused")
            e.retry = False
            raise e
        assert len({r["k"] for r in rows}) == 1 and len(rows) <= 4
        open(name, "w").close()

    df = spark.range(30).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k")).repartition(2, "k")
    told = load.pour(df, send, "k", 4, sleep=lambda s: None).agg(F.sum("points"), F.sum("retries"), F.sum("failed"), F.sum("batches")).first()
    assert tuple(told) == (20, 3, 3, 9)
    clock = iter([0.0, 0.0, 0.0, 5.0]).__next__
    pace = load.Pace(10, clock)
    assert [pace.wait(10), pace.wait(5), pace.wait(10)] == [0.0, 0.5, 0.0]
    assert load.retryable() and load.retryable(grpc=14) and not load.retryable(grpc=3) and load.retryable(http=503) and not load.retryable(http=404)
    assert [load.backoff(n) for n in (0, 1, 10)] == [0.25, 0.5, 30.0]


def test_rows_that_some_query_wants(spark):
    corpus = spark.createDataFrame([(i, i % 5, float(i)) for i in range(20)], "vec_id bigint, label int, x double")
    ask = spark.createDataFrame([(0, 1, [2], 3.0, 9.0), (1, 2, [2, 4], 5.0, 12.0), (2, None, None, None, None)], "query_id int, label int, labels array<int>, low double, high double")
    some = lambda **c: {r["vec_id"] for r in search.wanted_rows(ask, corpus, {"must": [{"field": "label", **c}]}).collect()}
    assert some(match_from_query="label") == {i for i in range(20) if i % 5 in (1, 2)}
    assert some(match_from_query="labels") == {i for i in range(20) if i % 5 in (2, 4)}
    kept = search.wanted_rows(ask, corpus, {"must": [{"field": "x", "range_from_query": {"gte": "low", "lt": "high"}}]})
    assert {r["vec_id"] for r in kept.collect()} == set(range(3, 13))


def test_store_and_settings(spark, tmp_path):
    store = ParquetStore(spark, f"{tmp_path}/s")
    rows = points(spark, [(i, [float(i)]) for i in range(6)])
    assert store.exists(rows).count() == 0 and store.compact(1) is None
    store.upsert(rows, 1)
    store.upsert(points(spark, [(2, [9.0])]), 2)
    store.compact(3)
    assert store.points().count() == 6 and store.points().filter("vec_id = 2").first()["embedding"] == [9.0]
    assert store.exists(points(spark, [(2, []), (77, [])])).count() == 1
    store.drop()
    assert store.points() is None
    assert grid.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    assert grid.expanded("${A}/x/${B:-y}", {"A": "1"}) == "1/x/y" and grid.human(1536) == "1.5 KiB" and grid.human(7) == "7 B"
    with pytest.raises(ValueError, match="not set"):
        grid.expanded("${NONE}", {})


def test_ordinals_of_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"a": {n}}}\n' if n % 7 else "bad\n\n" for n in range(100)))
    (tmp_path / "y.jsonl").write_text('{"a": 5}\n')
    rows = files.json_lines(spark, str(tmp_path), schema="a int", ordinals=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["filename"][-7:], []).append((r["record_ordinal"], r["a"]))
    assert sorted(by["x.jsonl"]) == list(enumerate(n for n in range(100) if n % 7)) and by["y.jsonl"] == [(0, 5)]


def test_numbers_within_a_hot_key(spark):
    rows = spark.range(5000).select((F.col("id") % 997).alias("v"), "id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("k"))
    got = {}
    for r in prepare.numbered(rows, "k", ["v", "id"]).collect():
        got.setdefault(r["k"], []).append((r["place"], r["v"], r["id"]))
    for held in got.values():
        held.sort()
        assert [p for p, _, _ in held] == list(range(len(held))) and [x[1:] for x in held] == sorted(x[1:] for x in held)
    assert sum(map(len, got.values())) == 5000 and max(r["n"] for r in prepare.batches(rows, "k", ["v", "id"], 16).groupBy("k", "batch").agg(F.count("v").alias("n")).collect()) == 16
    even = prepare.sampled_padding(rows, "v", "id", 50, 20).first()
    assert even["batches"] == 20 and 0 < even["efficiency"] <= 1


# --- embedding ------------------------------------------------------------------------------------------------------
def test_entries_are_checked():
    text = lambda **x: Entry(**{"name": "a", "kind": "dense", "type": "hashing", "input_column": "t", **x})
    for bad in ({"kind": "x"}, {"input_column": None}, {"pooling": "mean"}, {"max_length": 0}, {"modality": "image", "max_length": 5}, {"modality": "multimodal"}, {"modality": "multimodal", "input_column": None, "input_columns": {"text": "t"}}, {"modality": "multimodal", "input_column": None, "input_columns": {"text": "t", "image": "t"}}):
        with pytest.raises(ValueError):
            text(**bad)
    for entries, more in (
        ([text(), text()], {}),
        ([text(), text(name="b", output_column="a_embedding")], {}),
        ([text(), text(name="b", modality="image")], {}),
        ([text()], {"drop": ["a_embedding"]}),
        ([text()], {"source": ["a_embedding"]}),
        ([text(), text(name="b", input_column="u")], {"splits": True}),
    ):
        with pytest.raises(ValueError):
            embedding.check(entries, **more)
    fused = embedding.passes([text(), text(name="b", kind="sparse", options={"batch_size": 4}), text(name="c", kind="sparse", max_length=3), text(name="d", type="other")])
    assert [[e.name for e in g] for g in fused] == [["a", "b"], ["c"], ["d"]]
    assert [[e.name for e in g] for g in embedding.passes([text(), text(name="b")])] == [["a"], ["b"]]
    assert embedding.planned([text()])[0]["inputs"] == ["t"]


def test_empty_inputs_have_no_embedding(spark):
    df = spark.createDataFrame([(1, "A b a", b"x"), (2, " ", None), (3, None, b"y"), (4, "", b"")], "i int, t string, img binary")
    entries = [Entry("d", "dense", "hashing", input_column="t", options={"dims": 4, "batch_size": 1}), Entry("m", "multivector", "hashing", input_column="t", pooling="max", options={"dims": 4}), Entry("x", "dense", "hashing", "multimodal", input_columns={"text": "t", "image": "img"}, options={"dims": 4})]
    got = {r["i"]: r for r in embedding.embed(df, entries, drop=["img"]).collect()}
    assert sum(got[1]["d_embedding"]) == 3 and len(got[1]["m_embedding"]) == 3 and max(got[1]["m_pooled"]) == 1.0
    assert [got[i]["d_embedding"] for i in (2, 3, 4)] == [None] * 3
    assert [got[i]["x_embedding"] is None for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert "img" not in embedding.embed(df, entries, drop=["img"]).columns
    pieces = embedding.CHUNKERS["fixed_char"](df.select("i", "t"), "t", 2)
    assert sorted((r["i"], r["t"]) for r in pieces.collect()) == [(1, "A "), (1, "a"), (1, "b "), (2, " "), (4, "")]
    assert embedding.CHUNKERS["passthrough"](df, "t") is df
