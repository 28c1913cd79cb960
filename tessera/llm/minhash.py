"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's signature holds ``POSITIONS`` minima of 16 bits. Two documents whose
sets have Jaccard similarity J differ in about (1 - J) of the positions, so links
of J >= 0.8 lie within ``MAX_ERRORS`` with a margin of about five standard
deviations (figures in the README). Signatures are cut into ``CHUNKS`` chunks of four
positions: by the pigeonhole principle a pair within ``MAX_ERRORS`` < 2 * CHUNKS
errors has a chunk with one error at most. Each chunk is indexed under its four
variants with one position left out, so a join on equal index keys finds every
pair within the distance. Pairs are then held against the distance on whole
signatures and confirmed on the full shingle sets.

Documents with the same set become one class first. In a bucket of the index,
classes are linked to one centre, not to each other; what is still apart after
those links were confirmed is compared across components, block by block: full
sets go to the block once each, and only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import maybe_in, rows_of, ship, stored, table
from tessera.llm.components import connected

CHUNKS, CHUNK = 12, 4
POSITIONS = CHUNKS * CHUNK
MAX_ERRORS = 2 * CHUNKS - 1
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CACHE_WORDS = 250_000
#: Shingles hashed at once, so that a block stays in the processor's cache.
BLOCK = 1024
#: Members of a bucket that are held against each other in one cell of the last comparison.
CELL = 512
#: Shingle hashes of the members of a cell, on average at most.
CELL_HASHES = 1 << 21
#: Partners of a centre that are compared in one group, and how many centres may be cut into several, at most: those with the most.
STAR, STARS = 256, 1 << 16
#: Classes of documents that have no identifier are numbered from here.
NO_NAME = 1 << 62
#: Bytes of a shingle's hash in stored sets.
HASH_BYTES = 8

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, POSITIONS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_words: dict[bytes, int] = {}


def scrambled(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _words
    out = list(map(known.get, words))
    if None in out:
        if len(known) > CACHE_WORDS:
            known.clear()
        for i, h in enumerate(out):
            if h is None:
                w = words[i]
                out[i] = h = xxhash.xxh3_64_intdigest(w)
                if len(w) < 64:
                    known[w] = h
    return np.fromiter(out, np.uint64, len(out))


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash for every run of ``length`` words."""
    n = len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = scrambled(out * STEP + hashes[k : k + n] + np.uint64(k + 1))
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle count as one; no words, none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(sequence_hashes(word_hashes(words), min(shingle, len(words))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low 16 bits of the smallest value of each of the hash functions."""
    best = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    spread = scrambled(hashes * STEP)
    for at in range(0, len(spread), BLOCK):
        block = (spread[at : at + BLOCK, None] ^ _XOR) * _MUL
        np.minimum(best, block.min(axis=0), out=best)
    return (scrambled(best) & np.uint64(0xFFFF)).astype(np.uint16)


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def index_keys(sig: np.ndarray) -> np.ndarray:
    """48 keys a signature: for each chunk, each choice of three of its four positions."""
    chunks = sig.astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
    whole = chunks[..., 0] << np.uint64(48) | chunks[..., 1] << np.uint64(32) | chunks[..., 2] << np.uint64(16) | chunks[..., 3]
    out = np.empty(chunks.shape, np.uint64)
    for left_out in range(CHUNK):
        kept = np.uint64(0xFFFF << 16 * (3 - left_out) ^ 0xFFFFFFFFFFFFFFFF)
        out[..., left_out] = scrambled(scrambled(whole & kept) + np.arange(1, CHUNKS + 1, dtype=np.uint64) * STEP + np.uint64(left_out))
    return out.view(np.int64).reshape(len(chunks), CHUNKS * CHUNK)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _slim(docs: DataFrame, shingle: int) -> DataFrame:
    """i, h (hash of the text), n_shingles, class_key (128-bit digest of the set), signature; the last two are null for documents without words."""
    kind = docs.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for (text,) in rows_of(batch, "t"):
                hashes = shingle_set(text, shingle)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(packed(hashes)) if len(hashes) else None)
                sigs.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["i", "h", "n_shingles", "class_key", "signature"])

    return docs.select("i", "h", "t").mapInArrow(run, f"i {kind}, h bigint, n_shingles bigint, class_key binary, signature binary")


def _keys(classes: DataFrame) -> DataFrame:
    """key, k: 48 index keys for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(s for (s,) in rows_of(batch, "signature"))
            keys = index_keys(np.frombuffer(data, "<u2").reshape(-1, POSITIONS))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids, pa.int64())], ["key", "k"])

    return classes.select("k", "signature").mapInArrow(run, "key bigint, k bigint")


def _lanes(signature: Column) -> Column:
    """A signature as longs of four positions each, for comparison in the JVM."""
    text = F.hex(signature)
    return F.array(*[F.conv(F.substring(text, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(POSITIONS // 4)])


def _errors(a: str, b: str) -> Column:
    """Number of differing positions: fold each 16-bit lane of the exclusive or to its lowest bit, then count bits."""
    total = F.lit(0)
    for i in range(POSITIONS // 4):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple]:
    """For each meeting of two cells: its rows, and an iterator over (row number, numbers of the rows near it).

    Near are members of another component, within the signature distance, and of a size that allows a link. A pair that shares
    several buckets is near in the first of them alone: its components differ there too, so that bucket is compared.
    """

    def settle(at: tuple, held: list) -> tuple[tuple, list, Iterator[tuple]]:
        cells, k, c, size = (np.array([r[i] for r in held], np.int64) for i in range(4))
        signs = np.frombuffer(b"".join(r[4] for r in held), "<u2").reshape(-1, POSITIONS)
        keys = index_keys(signs)
        second = np.flatnonzero(cells == at[2])

        def near() -> Iterator[tuple]:
            for i in np.flatnonzero(cells == at[1]):
                may = second[(c[second] != c[i]) & (100 * np.minimum(size[second], size[i]) >= percent * np.maximum(size[second], size[i]))]
                may = may[k[may] < k[i]] if at[1] == at[2] else may
                may = may[(signs[may] != signs[i]).sum(axis=1) <= MAX_ERRORS]
                may = may[keys[i][(keys[may] == keys[i]).argmax(axis=1)] == at[0]]
                if len(may):
                    yield i, may

        return at, held, near()

    at, held = None, []
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("key", "lo", "hi")]
        for key, lo, hi, *row in rows_of(batch, "key", "lo", "hi", *names):
            if (key, lo, hi) != at:
                if len(held) > 1:
                    yield settle(at, held)
                at, held = (key, lo, hi), []
            held.append(row)
    if len(held) > 1:
        yield settle(at, held)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_MEMBER = "key bigint, lo int, hi int, cell int, k bigint, c bigint, size bigint, signature binary"


def _with_sets(docs: DataFrame, members: DataFrame, sends: DataFrame, shingle: int) -> DataFrame:
    """``sends`` (k and other columns) with the packed set of class k in ``hashes``.

    Only the texts of the first documents of these classes are read into sets, once each.
    """
    others = [(n, kind) for n, kind in sends.dtypes if n != "k"]
    to = stored(sends.groupBy("k").agg(F.collect_list(F.struct(*[n for n, _ in others])).alias("to")).join(members, "k"), "sends")
    keyed = maybe_in(docs.withColumn("h", F.xxhash64("t")), to.select(F.col("first_hash").alias("h"))).filter("maybe").drop("maybe")
    texts = keyed.join(to, (keyed["h"] == to["first_hash"]) & keyed["i"].eqNullSafe(to["first_id"])).select("k", "t", "to")
    schema = pa.schema([*[(n, _ARROW[kind]) for n, kind in others], ("k", pa.int64()), ("hashes", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [[] for _ in schema], 0
            for k, text, to in rows_of(batch, "k", "t", "to"):
                data = packed(shingle_set(text, shingle))
                for x in to:
                    for column, value in zip(out, (*x.values(), k, data), strict=True):
                        column.append(value)
                    held += len(data)
                    if held > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema.names)
                        out, held = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema.names)

    return texts.mapInArrow(sets, ", ".join(f"{n} {kind}" for n, kind in [*others, ("k", "bigint"), ("hashes", "binary")]))


def _links_across(docs: DataFrame, members: DataFrame, apart: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between near classes of one bucket and different components, held against each other on full sets.

    A bucket is dealt into cells, and every two cells meet in a task of their own. A first pass over signatures tells who has a
    near class in a meeting; the sets of these go to the meeting, once each, and only links leave it.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    rows = apart.withColumn("other", other).select("key", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "cell", "k", "c", "size", "signature")
    names = [f.split()[0] for f in _MEMBER.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, held, near in _met(batches, percent):
            some = np.zeros(len(held), bool)
            for i, mates in near:
                some[i] = some[mates] = True
            if some.any():
                wanted = [(*at, *held[i]) for i in np.flatnonzero(some)]
                kinds = [_ARROW[f.split()[1]] for f in _MEMBER.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*wanted, strict=True), kinds, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, near in _met(batches, percent):
            k = np.array([r[1] for r in held], np.int64)
            sizes = np.array([len(r[5]) // HASH_BYTES for r in held], np.int64)
            begin = np.cumsum(sizes) - sizes
            values, number = np.unique(unpacked(b"".join(r[5] for r in held)), return_inverse=True)
            marked = np.zeros(len(values), bool)
            left, right = [], []
            for i, mates in near:
                own = number[begin[i] : begin[i] + sizes[i]]
                marked[own] = True
                both = np.array([np.count_nonzero(marked[number[begin[m] : begin[m] + sizes[m]]]) for m in mates])
                marked[own] = False
                linked = mates[100 * both >= percent * (sizes[mates] + sizes[i] - both)]
                left.append(np.maximum(k[linked], k[i]))
                right.append(np.minimum(k[linked], k[i]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    wanted = met(rows.select(*names)).mapInArrow(ask, _MEMBER)
    sets = _with_sets(docs, members, wanted, shingle).select(*names, "hashes")
    return stored(met(sets).mapInArrow(compare, "a bigint, b bigint").distinct(), "across")


def _hot_centres(pairs: DataFrame) -> DataFrame:
    """b, salts: centres with more than ``STAR`` partners, at most ``STARS`` of them, and into how many groups their partners go.

    The others have either few partners or less than one of ``STARS`` parts of all pairs.
    """
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    return counts.filter(F.col("n") > max(STAR, -(-total // STARS))).select("b", F.ceil(F.col("n") / F.lit(STAR)).cast("int").alias("salts"))


def _confirmed(docs: DataFrame, members: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full sets have 100 * intersection >= percent * union.

    Each set goes to the classes b it is compared with; a class b with many partners is repeated for every ``STAR`` of them.
    """
    hot = _hot_centres(pairs)
    dealt = pairs.join(F.broadcast(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    sends = dealt.select(F.col("a").alias("k"), "b", "salt", F.lit(1).alias("role")).unionByName(dealt.select(F.col("b").alias("k"), "b", "salt", F.lit(0).alias("role")).distinct())
    rows = _with_sets(docs, members, sends, shingle).repartition("b", "salt").sortWithinPartitions("b", "salt", "role", "k")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            left, right = [], []
            for b, salt, role, a, data in rows_of(batch, "b", "salt", "role", "k", "hashes"):
                if role == 0:
                    if (b, salt) != at:
                        at, centres = (b, salt), []
                    if data not in centres:
                        centres.append(data)
                    continue
                own = unpacked(data)
                if any(similar(own, unpacked(c), percent) for c in centres):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return stored(rows.mapInArrow(compare, "a bigint, b bigint").distinct(), "confirmed")


def near_duplicates(docs: DataFrame, identifier: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """identifier, n_shingles, component_id, kept, links: a row for each row of ``docs``.

    Links join documents whose shingle sets have 100 * intersection >= percent * union, and component_id is the smallest
    identifier that can be reached; rows of one identifier are one document. ``links`` is the number of other classes (documents with another set) that a document's
    class was linked to on the way; within a component not every pair is tried once its members are connected. Documents with
    fewer words than a shingle have their whole sequence as one shingle; null, empty and blank texts have an empty set and are
    linked with nothing, repeated rows of them included. Rows without an identifier take part but name
    no component: theirs is null where no other document is reached. The identifier is an integer type below 2^62. Texts may be of
    any length, an empty table gives an empty table, and other columns, whatever their names, are not looked at.
    """
    ship(docs.sparkSession)
    ids = docs.select(docs[identifier].cast("long").alias("i"), docs[text].alias("t"))
    slim = stored(_slim(ids.withColumn("h", F.xxhash64("t")), shingle), "signatures")
    # one class for each different set: near copies are looked for between classes, so exact copies cost nothing more
    classes = slim.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct(F.col("i").isNull().alias("n"), "i", "h")).alias("x"), F.min("signature").alias("signature"))
    unnamed = F.lit(NO_NAME) + F.shiftrightunsigned(F.xxhash64("class_key"), 3)
    classes = stored(classes.select(F.coalesce(F.col("x.i"), unnamed).alias("k"), F.col("x.i").alias("first_id"), F.col("x.h").alias("first_hash"), "class_key", "signature"), "classes")
    keys = _keys(classes)
    centres = keys.groupBy("key").agg(F.min("k").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = stored(keys.join(centres, "key"), "shared")
    lanes = classes.select("k", _lanes(F.col("signature")).alias("s")).dropDuplicates(["k"])
    left, right = lanes.select(F.col("k").alias("a"), F.col("s").alias("sa")), lanes.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    met = stored(shared.filter("k != b").select(F.col("k").alias("a"), "b").distinct(), "met")
    hot = stored(_hot_centres(met).select("b"), "hot")
    signed = met.join(left, "a")
    # a centre that very many classes meet is broadcast to them, the others are joined
    near = signed.join(F.broadcast(hot), "b", "left_anti").join(right, "b").unionByName(signed.join(F.broadcast(right.join(F.broadcast(hot), "b", "left_semi")), "b"))
    near = near.withColumn("e", _errors("sa", "sb")).filter(F.col("e") <= MAX_ERRORS)
    stars = stored(near.groupBy("a").agg(F.min(F.struct("e", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "stars")
    sources = classes.select("k", "first_id", "first_hash")
    links = _confirmed(ids, sources, stars, shingle, percent)
    found = connected(links)
    # what is still apart: buckets with members of several components, compared across components
    label = shared.select("key", "k").join(found.withColumnRenamed("id", "k"), "k", "left").withColumn("c", F.coalesce("component_id", "k")).drop("component_id")
    sized = slim.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.first("n_shingles").alias("size")).join(classes, "class_key").select("k", "signature", "size").dropDuplicates(["k"])
    label = label.join(sized, "k")
    mixed = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes")).filter("lo != hi")
    cells = F.ceil(F.greatest(F.col("n") / F.lit(CELL), F.col("hashes") / F.lit(CELL_HASHES))).cast("int")
    apart = label.join(mixed.select("key", cells.alias("cells")), "key").withColumn("cell", F.pmod(F.xxhash64("k"), F.col("cells")).cast("int"))
    links = links.unionByName(_links_across(ids, sources, apart, shingle, percent))
    found = connected(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("links"))
    named = classes.select("class_key", "k").join(found.withColumnRenamed("id", "k"), "k", "left").join(degree, "k", "left").select("class_key", F.coalesce("component_id", "k").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = slim.select("i", "n_shingles", "class_key").join(named, "class_key", "left")
    component = F.when(F.col("component_id") < NO_NAME, F.col("component_id")).otherwise(F.col("i"))
    kind = docs.schema[identifier].dataType
    return out.select(F.col("i").cast(kind).alias(identifier), "n_shingles", component.cast(kind).alias("component_id"), component.eqNullSafe(F.col("i")).alias("kept"), F.coalesce("links", F.lit(0)).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
