"""The training-data queries against SQL, libraries or plain versions over the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall())


def said(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, DIR)
    assert said(got.columns, got.collect()) == said([c[0] for c in want.description], want.fetchall())


def test_tokens_as_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in QUERIES["op2_bpe"](spark, DIR).collect():
        ids = tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_near_duplicates(spark, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = {}, defaultdict(list)
    for i, text in docs.items():
        words = re.findall(WORD, (text or "").translate(lower))
        n = min(4, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    parent = {i: i for i in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(docs):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op4_minhash"](spark, DIR).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in docs}


def test_repeated_windows(spark, docs):
    words = {i: re.findall(WORD, t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(docs):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op8_substring"](spark, DIR).collect()}
    for i, w in words.items():
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_languages_held_out(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DIR}/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op9_langid"](spark, DIR).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def test_fingerprints_of_equal_texts(spark, docs):
    rows = QUERIES["op5_fingerprints"](spark, DIR).collect()
    by_text = defaultdict(set)
    for r in rows:
        by_text[docs[r["doc_id"]] or ""].add(r["fingerprint"])
        assert r["n_chars"] == len(docs[r["doc_id"]] or "") and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())


def test_every_row_comes_back(spark, docs):
    assert {r["doc_id"] for r in QUERIES["op7_pii"](spark, DIR).select("doc_id").collect()} == set(docs)
    assert QUERIES["op3_chat"](spark, DIR).count() > 0


def test_pipeline_on_hard_rows(spark, tmp_path):
    rows = [(1, "one two three four five six seven eight", "en", "a", 39), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "123 456", "en", None, 7), (5, "write to x@example.com or call, it is a text", "en", "b", 44), (6, "one two three four five six seven eight", "en", "b", 39)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, content in (("some", rows), ("none", [])):
        where = f"{tmp_path}/{name}"
        spark.createDataFrame(content, schema).write.parquet(f"{where}/documents.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, where).collect()}
        assert got == ({1, 5} if content else set())
