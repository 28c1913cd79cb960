"""The pipeline's rows against a plain version of all five stages, on the whole of the smallest table."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def distinct(docs):
    """The smallest doc_id of each group of texts whose five-word shingles are similar by 0.8 or more."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders, parent = {}, defaultdict(list), {i: i for i in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(docs):
        words = re.findall(WORD, docs[i][0].translate(lower))
        n = min(5, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
        for j, both in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: d for i, d in docs.items() if top(i) == i}


def redacted(docs):
    seen = Counter()
    for text, _ in docs.values():
        seen.update((c.kind, c.votes, c.shape) for c in pii.candidates(text, pii.base_spans(text)))
    weights = pii.train(seen)
    return {i: (pii.redacted(text, pii.find(text, weights)[1]), source) for i, (text, source) in docs.items()}


def mixed(docs):
    """(doc_id, text) as often as the mix takes it, the last time perhaps cut."""
    sizes = {i: len(re.findall(WORD, text)) for i, (text, _) in docs.items()}
    by = defaultdict(list)
    for i, (_, source) in docs.items():
        by[source].append(i)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    size = {s: sum(sizes[i] for i in by[s]) for s in order}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:  # what a source cannot take is shared again among the others
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= 2 * size[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    for s in order:
        budget = round(target[s])
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        queue = sorted((md5(f"7:{i}:{sizes[i]}:{md5(docs[i][0])}")[:12], i) for i in by[s])
        while budget > 0:
            for _, i in queue:
                words = re.findall(WORD, docs[i][0])
                if words and budget > 0:
                    yield i, docs[i][0] if len(words) <= budget else " ".join(words[:budget])
                    budget -= min(budget, len(words))


def test_pipeline_as_plain_steps(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {i: (t, s) for i, t, s in duckdb.sql(f"SELECT doc_id, text, source FROM '{DIR}/documents.parquet'").fetchall()}
    docs = {i: d for i, d in docs.items() if d[0] and any(c.isalpha() for c in d[0])}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    want = Counter()
    for i, text in mixed(redacted(distinct(docs))):
        want[i, tuple(library.encode(text, add_special_tokens=False).ids)] += 1
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "ids").collect())
    assert got == want and sum(want.values()) > 100


def test_predictions_take_effect(spark, monkeypatch):
    """A missing label is filled in, and documents of a language that is not wanted do not reach the next stage."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bare = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    was = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identified(spark, bare, DIR).collect()}
    filled = [i for i in got if i % 5 == 0]
    assert len(filled) > 20 and sum(got[i] == was[i] for i in filled) >= 0.9 * len(filled)
    assert all(got[i] == was[i] for i in got if i % 5)
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en", "fr"))
    fewer = {r["doc_id"] for r in corpus_pipeline.identified(spark, bare, DIR).collect()}
    assert fewer < set(got) and sum(was[i] in ("en", "fr") for i in fewer) >= 0.95 * len(fewer)
    lost = [i for i in got if was[i] in ("en", "fr") and i not in fewer]
    assert len(lost) <= 0.05 * len(got)
    # nothing to learn from: nothing is rejected
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.identified(spark, blank, DIR).collect()} == set(got)
