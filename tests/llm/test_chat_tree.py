"""Conversations of more blocks than a row may hold: the tree of matrices gives the repair that one list of them gives."""

import random

from tessera.llm import chat

ROLES = ["user", "assistant", "system", "human", "bot", None, "", "x"]


def test_tree_gives_the_same_repair(spark, monkeypatch):
    random.seed(12)
    rows = [(c, n, random.choice(ROLES), f"{c}-{n}") for c, size in ((1, 400), (2, 90), (3, 2), (None, 130)) for n in range(size)]
    rows += [(4, 5, random.choice(ROLES), str(n)) for n in range(100)]  # all at one place
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    whole = sorted(map(str, chat.format_chats(turns, block=4).collect()))
    for most in (2, 3, 30):  # up to seven levels
        monkeypatch.setattr(chat, "TOGETHER", most)
        assert sorted(map(str, chat.format_chats(turns, block=4).collect())) == whole
    assert len(whole) == len(rows)
