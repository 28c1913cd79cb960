"""Embedding passes hold a slice of a batch at a time, and pooled vectors have the precision of the numbers they come from."""

import pyarrow as pa

from tessera.operators import embedding
from tessera.operators.embedding import Entry, HashingEmbedder


def test_batches_are_cut_by_the_size_of_their_texts():
    texts = ["a" * 40, None, "b" * 70, "", "c" * 500, "é" * 20, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array([None, b"x" * 50, *[None] * 5])], ["n", "t", "i"])
    pieces = list(embedding.sliced(batch, ["t", "i"], 100))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1], [2, 3], [4], [5, 6]]
    assert [x for p in pieces for x in p.column(1).to_pylist()] == texts
    assert list(embedding.sliced(batch.slice(0, 0), ["t"], 100)) == []


def test_slices_give_the_same_rows(spark, monkeypatch):
    texts = ["one two one", None, " ", "x " * 3000, "", "y", "z w " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    entries = [Entry(k, k, "hashing", input_column="t", pooling="mean" if k == "multivector" else None, options={"dims": 4, "batch_size": 2}) for k in ("dense", "sparse", "multivector")]
    whole = sorted(map(tuple, embedding.embed(rows, entries).collect()))
    monkeypatch.setattr(embedding, "SLICE", 8)
    assert sorted(map(tuple, embedding.embed(rows, entries).collect())) == whole
    assert whole[3][4] == [HashingEmbedder(4).embed(["x"], ("dense",))["dense"][0]] * 3000 and whole[0][5] == [sum(x) / 3 for x in zip(*whole[0][4], strict=True)]
    assert whole[1][2:] == (None,) * 4 == whole[2][2:]


def test_means_are_not_cut_to_32_bits(spark):
    """A mean of 32 bits lies beside the half between two decimals on which the mean itself lies."""
    slots = HashingEmbedder(16).slots(" ".join(f"w{i}" for i in range(200)))
    third, other = f"w{slots.index(3)} ", f"w{next(i for i, s in enumerate(slots) if s != 3)} "
    for n in (3, 6, 9, 27):
        rows = spark.createDataFrame([(third * n + other * (320 - n),)], "t string")
        entry = Entry("m", "multivector", "hashing", input_column="t", pooling="mean")
        assert embedding.embed(rows, [entry]).first()["m_pooled"][3] == n / 320
