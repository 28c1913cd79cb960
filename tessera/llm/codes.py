"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds over resident members (Jégou et al., "Product
Quantization for Nearest Neighbor Search", TPAMI 2011).

Vectors become parts, a row for each position. A part belongs to the owner (position, entry, salt) of its nearest entry; the
salt spreads an entry that holds very many parts. Parts are written once in the order of their owners and stay where they are:

1. Owners sum their resident members, range by range of the stored rows; the sums meet by position and entry, and only the
   entries themselves, of which there are few, come to the driver.
2. Members meet the new entries. A part that keeps its entry stays where it lies; only parts that change theirs are shuffled, to
   their new owner, and written as the members that arrived in this round.

No list of departures is kept: a part lies where it arrived last. Whether it has left since follows from the entries of
the rounds since then, which every task has, so members that left are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, shuffle_partitions, stored, table
from tessera.llm.topk import whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Parts that an owner is meant to hold.
OWNED = 1 << 16
#: Differences that are held at once.
CELLS = 1 << 20
#: Components below the first leave room for squared distances in 64 bits; all have to stay below the second, so that sums of them fit.
NEAR, MOST = 1 << 26, 1 << 45

#: Entries of each position: PARTS arrays of (entries, width).
Codebooks = list[np.ndarray]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry, the first of equal ones, and its squared distance, in whole numbers."""
    which, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    step = max(1, CELLS // max(1, entries.size))
    small = max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) < NEAR
    for at in range(0, len(parts), step):
        some = slice(at, at + step)
        which[some], far[some] = _least(parts[some, None, :] - entries[None], small)
    return which, far


def _least(difference: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    d = (difference**2).sum(axis=2)
    if not small:
        about = (difference.astype(float) ** 2).sum(axis=2)
        wide = about > 2.0**62
        d[wide] = np.iinfo(np.int64).max  # farther than any distance that fits
        rows = np.flatnonzero(wide.all(axis=1))
        if len(rows):
            whole = (difference[rows].astype(object) ** 2).sum(axis=2)
            which, least = d.argmin(axis=1), d.min(axis=1)
            which[rows] = [min(range(len(r)), key=r.__getitem__) for r in whole]
            if max(r.min() for r in whole) > np.iinfo(np.int64).max:
                raise ValueError("a squared distance does not fit in 64 bits")
            least[rows] = [int(r.min()) for r in whole]
            return which, least
    return d.argmin(axis=1), d.min(axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _residents(batch: pa.RecordBatch, history: list[Codebooks], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """position, row numbers and parts of the members in a batch (position, entry, arrived, part) that have not left.

    A part that arrived in round t chose its entry by history[t]; it left if it preferred another one in a round since."""
    position, entry, arrived = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    parts = _matrix(batch.column(3), width)
    for p in np.unique(position).tolist():
        here = np.flatnonzero(position == p)
        for t in range(1, len(history)):
            check = np.flatnonzero(arrived[here] < t)
            if len(check):
                stays = np.ones(len(here), bool)
                stays[check] = nearest(parts[here[check]], history[t][p])[0] == entry[here[check]]
                here = here[stays]
        if len(here):
            yield p, here, parts[here]


def _member_sums(members: DataFrame, history: list[Codebooks], width: int) -> DataFrame:
    """position, entry, n, sums: a row for each run of an owner's members in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            entry = batch.column(1).to_numpy(zero_copy_only=False)
            for p, here, parts in _residents(batch, history, width):
                for e in np.unique(entry[here]).tolist():
                    own = parts[entry[here] == e]
                    out.append((p, e, len(own), own.sum(axis=0).tolist()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["position", "entry", "n", "sums"])

    return members.select("position", "entry", "arrived", "part").mapInArrow(run, "position int, entry int, n bigint, sums array<bigint>")


def _updated(members: DataFrame, history: list[Codebooks], width: int) -> Codebooks:
    """Entries as the floor of the mean of their members; those without members stay."""
    wide = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    out = [book.copy() for book in history[-1]]
    for r in _member_sums(members, history, width).groupBy("position", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # a row for each entry
        out[r["position"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def _movers(members: DataFrame, history: list[Codebooks], now: Codebooks, width: int) -> DataFrame:
    """r, position, entry, arrived, part: members that prefer another of the new entries, with that entry."""
    round_ = len(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = batch.column(1).to_numpy(zero_copy_only=False)
            rows, chosen = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for p, here, parts in _residents(batch, history, width):
                found = nearest(parts, now[p])[0]
                moved = np.flatnonzero(found != entry[here])
                rows.append(here[moved])
                chosen.append(found[moved])
            taken = batch.take(pa.array(np.concatenate(rows)))
            arrived = pa.array(np.full(taken.num_rows, round_, np.int32))
            yield pa.RecordBatch.from_arrays([taken.column(4), taken.column(0), pa.array(np.concatenate(chosen).astype(np.int32)), arrived, taken.column(3)], ["r", "position", "entry", "arrived", "part"])

    return members.select("position", "entry", "arrived", "part", "r").mapInArrow(run, _MEMBER)


_MEMBER = "r bigint, position int, entry int, arrived int, part array<bigint>"


def _placed(rows: DataFrame, salts: int, name: str) -> DataFrame:
    """Members at their owners: shuffled by (position, entry, salt) and written in that order."""
    owner = [F.col("position"), F.col("entry"), F.pmod(F.xxhash64("r"), F.lit(salts))]
    parts = max(shuffle_partitions(rows.sparkSession), 1)
    return stored(rows.repartitionByRange(parts, *owner, "r").sortWithinPartitions(*owner), name)


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``vectors`` (vec_id, v, r), all of one length that ``parts`` divides.

    They start as the parts of the ``entries`` vectors of smallest vec_id, and of those that share one, of least components; of as
    many as there are.
    """
    first = [r["v"] for r in vectors.orderBy("vec_id", "v").select("v").limit(entries).collect()]
    if not first:
        return []
    width = len(first[0]) // parts
    history: list[Codebooks] = [[np.array([v[p * width : (p + 1) * width] for v in first], np.int64) for p in range(parts)]]
    begin, n = history[0], vectors.count()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), parts * width)
            chosen = np.concatenate([nearest(v[:, p * width : (p + 1) * width], begin[p])[0] for p in range(parts)]).astype(np.int32)
            flat = np.concatenate([v[:, p * width : (p + 1) * width].ravel() for p in range(parts)])
            position = np.repeat(np.arange(parts, dtype=np.int32), len(v))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(position) + 1) * width, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column(0).to_numpy(zero_copy_only=False), parts)), pa.array(position), pa.array(chosen), pa.array(np.zeros(len(position), np.int32)), lists], ["r", "position", "entry", "arrived", "part"])

    salts = max(1, -(-n // OWNED))
    members = _placed(vectors.select("r", "v").mapInArrow(cut, _MEMBER), salts, "members")
    for round_ in range(1, rounds + 1):
        now = _updated(members, history, width)
        if round_ < rounds:  # after the last round nobody asks where the parts lie
            arrivals = _placed(_movers(members, history, now, width), salts, "arrivals")
            members = members.unionByName(arrivals)
        history.append(now)
    return history[-1]


def digest_of(books: Codebooks) -> str:
    """Hex SHA-256 of all components in decimal, by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of ``vectors`` but v, code and error: the nearest entry of each part, two hex digits each, and the squared distances summed."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "v"], "code string, error bigint"])
    others = [c for c in vectors.columns if c != "v"]
    width = books[0].shape[1] if books else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(len(others)), len(books) * width)
            found = [nearest(v[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            chosen = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            codes = [row.tobytes().hex() for row in chosen]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], [*others, "code", "error"])

    return vectors.select(*others, "v").mapInArrow(run, schema)


def compressed(rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each row whose vector is sound.

    Components are floor(scale * x). Vectors that are null or hold null, NaN or infinite components are left out, and so are rows
    without an identifier. All others need one length, which ``parts`` divides, and components below ``MOST``: the job fails where
    that does not hold. Rows that repeat an identifier are rows each. label_error is the sum over all rows of the same label, nulls
    together. At most 256 entries. An empty table, or one without sound vectors, gives no rows. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    ship(rows.sparkSession)
    own = rows.select(rows[identifier].alias("vec_id"), rows[vector].alias("embedding"), rows[label].alias("label"))
    vectors = stored(whole_vectors(own, "vec_id", "embedding", scale, keep=("label",)).drop("length"), "vectors")
    most = F.array_max(F.transform("v", lambda c: F.abs(c)))
    least, longest, greatest = vectors.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(most)).first()
    if least != longest or (least or 0) % parts or least == 0:
        raise ValueError(f"vectors of {least} to {longest} components cannot be cut into {parts} equal parts")
    if greatest is not None and greatest >= MOST:
        raise ValueError(f"components reach {greatest}, the bound is {MOST}")
    books = fitted(vectors, parts, entries, rounds)
    codes = encoded(vectors.drop("r"), books)
    if not books:
        return codes.select("vec_id", "code", "error", F.lit(None).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = stored(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Each round as two tables: the chosen entry of each part, and the entries as floors of means."""
    out = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, j, v[p * (len(v) // 8) + j + 1] AS x FROM v, range(8) a(p), range(64) b(j) WHERE j < len(v) // 8),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v),
c0 AS (SELECT p, e, j, x AS c FROM x JOIN f USING (vec_id) WHERE e < 16)"""
    for t in range(ROUNDS + 1):
        out += f""",
d{t} AS (SELECT vec_id, x.p, e, sum((x - c) * (x - c)) AS d FROM x JOIN c{t} k ON k.p = x.p AND k.j = x.j GROUP BY ALL),
a{t} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS n FROM d{t}) WHERE n = 1)"""
        if t < ROUNDS:
            out += f""",
m{t} AS (SELECT p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{t} USING (vec_id, p) GROUP BY ALL),
c{t + 1} AS MATERIALIZED (SELECT k.p, k.e, k.j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{t} k LEFT JOIN m{t} m ON m.p = k.p AND m.e = k.e AND m.j = k.j)"""
    return (
        out
        + f""",
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{ROUNDS}),
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r JOIN v USING (vec_id) GROUP BY label)
SELECT r.vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, h"""
    )


SQL = _sql()
