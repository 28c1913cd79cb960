"""Rows on which the training-data operators once did less than the whole job."""

import numpy as np
import xxhash

import corpus_pipeline
from tessera.llm import chat, fingerprints, substring
from tessera.llm.queries import QUERIES

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plainly(rows):
    """Repaired turns of one conversation, as one sequence without blocks."""
    last = lambda v: (v is None, v or "" if v is None or isinstance(v, str) else v)
    rows = sorted(rows, key=lambda r: tuple(map(last, r)))
    roles = [chat.canonical_role(r[1]) for r in rows]
    costs = [0, *[chat._FAR] * 3]
    for role in roles:
        costs = [min(costs[a] + min([c for x, y, c, _, _ in chat.moves(role) if (x, y) == (a, b)], default=chat._FAR) for a in range(4)) for b in range(4)]
    end = min(range(4), key=lambda s: costs[s] + chat.END_COST[s])
    plan = chat.repair(roles, 0, end)
    return [(no, role, text, role_out, action, cost) for (no, role, text), (role_out, action, _, cost) in zip(rows, plan, strict=True)]


def test_crowded_conversations_keep_one_order(spark):
    names = ["user", "assistant", None, "system", "gpt", "odd", "human"]
    one = [(n % 3 if n % 5 else None, names[n * n % 7], f"text {n % 400}") for n in range(3000)] + [(1, "user", "again")] * 1500
    # few numbers, many nulls, and many copies of one turn; and a conversation of many numbers with ties of cost
    two = [(n, names[n * n * n % 11 % 7], "x") for n in range(700)]
    rows = [(c, *r) for c, conversation in ((None, one), (7, two)) for r in conversation]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)).orderBy("block", "position").collect()
    for c, conversation in ((None, one), (7, two)):
        mine = [r for r in got if r["conv_id"] == c]
        want = plainly(conversation)
        assert [(r["turn"], r["role_in"], r["role_out"]) for r in mine] == [(w[0], w[1], w[3]) for w in want]
        assert [r["action"] for r in mine[:-1]] == [w[4] for w in want[:-1]]
        assert [r["cost"] for r in mine[:-1]] == [w[5] for w in want[:-1]]
        assert all(w[2] in r["rendered"] for r, w in zip(mine, want, strict=True))


def test_language_stage_without_labels_keeps_all_letters(spark):
    texts = ["a text of some words", "un autre texte", None, "", "12 34", "\u4e2d\u6587", "one more"]
    for label in (None, "und"):
        docs = spark.createDataFrame([(n, t, label, "a", len(t or "")) for n, t in enumerate(texts)], DOCUMENTS)
        got = {r["doc_id"] for r in corpus_pipeline.identified(spark, docs, "").collect()}
        assert got == {0, 1, 5, 6}


def test_words_that_agree_in_32_bits_are_different(spark):
    words = [f"w{n}" for n in range(300_000)]
    low = np.array([xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF for w in words])
    order = np.argsort(low, kind="stable")
    twin = int(np.flatnonzero(low[order][1:] == low[order][:-1])[0])
    a, b = words[order[twin]], words[order[twin + 1]]
    rows = []
    for n in range(20):  # templates of twelve words and one that differs, which the anchor covers in some
        start = [f"t{n}x{k}" for k in range(12)]
        rows += [(3 * n, " ".join([*start, a])), (3 * n + 1, " ".join([*start, b])), (3 * n + 2, " ".join([*start, a]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 13 * (i % 3 == 2) for i, _ in rows}


def test_full_automata_and_hot_anchors_change_nothing(spark):
    words = [f"w{n % 37}" for n in range(60)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(i % 9)] + words[i % 5 : 20 + i % 23] + [f"b{i % 4}"] * (i % 3) + words[25:45])) for i in range(120)]
    rows += [(None, rows[3][1]), (3, rows[4][1]), (None, None), (200, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want = sorted(map(str, substring.deduplicated(docs).collect()))
    held = [(i if i is not None else 1 << 62, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in sorted(held, key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    gone = sorted(str((i if i < 1 << 62 else None, len({x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}))) for i, w in held)
    assert sorted(str((r["doc_id"], r["n_removed"])) for r in substring.deduplicated(docs).collect()) == gone
    for options in ({"states": 3}, {"hot": 2}, {"states": 20, "hot": 30}):
        assert sorted(map(str, substring.deduplicated(docs, **options).collect())) == want


def test_one_row_of_each_group_stays(spark):
    text, other = " ".join(f"a{n}" for n in range(40)), " ".join(f"b{n}" for n in range(40))
    rows = [(None, text), (None, text + " more"), (9, text), (9, text), (4, text + " end"), (None, other), (None, other), (5, None), (5, None), (None, " "), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCUMENTS).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.distinct(spark, docs, "").collect()), key=str)
    assert got == sorted([(4, text + " end"), (None, other), (5, None), (5, None), (None, " "), (None, " ")], key=str)


def test_fingerprints_group_across_the_table(spark, tmp_path):
    texts = ["One text", "one  TEXT", None, "", "another", "\ufb01ne", "fine", "alone"]
    rows = [(n if n % 11 else None, texts[n * n % 8 if n % 3 else 0]) for n in range(200)] + [(500, "Nameless"), (None, "no name"), (None, "no  name"), (500, "nameless"), (500, "alone")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    smallest = {}
    for i, t in rows:
        smallest.setdefault(fingerprints.canonical(t), []).extend([i] * (i is not None))
    want = sorted((str(i), fingerprints.digest(fingerprints.canonical(t)), str(min(smallest[fingerprints.canonical(t)], default=None))) for i, t in rows)
    got = QUERIES["op5_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["group_id"])) for r in got) == want


def test_both_groupings_agree(spark):
    rows = [(n, f"text {n % 7}") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.grouped(docs).collect()}
    assert got == {n: n % 7 for n, _ in rows}
    assert {r["doc_id"]: r["group_id"] for r in fingerprints.exact_groups(docs).collect()} == got
