"""Document fingerprints: canonical exact digests.

A text is brought to a canonical form (NFKC, full case folding, white space runs
to one space) and digested with a 128-bit xxhash. Equal digests are only
candidates: before two documents count as the same, their canonical bytes are
compared.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, ship, shuffle_partitions, stored, table


#: Digests that several rows have, up to which they are broadcast, so that texts are not shuffled to meet them.
SENT = 200_000


def canonical(text: str | None) -> bytes:
    """Canonical bytes of a text; null is the empty text."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canonical_bytes: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canonical_bytes)


def likeness(a: bytes, b: bytes) -> float:
    """1.0 for documents that are the same: equal digests, confirmed on the bytes. Else 0.0."""
    return 1.0 if xxhash.xxh3_128_digest(a) == xxhash.xxh3_128_digest(b) and a == b else 0.0


def fingerprints(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """identifier, fingerprint: one row for each row, without a shuffle. Null and empty texts have the digest of no bytes; texts may be of any length;
    an empty table gives an empty table; other columns, whatever their names, are not looked at."""
    ship(docs.sparkSession)
    kind = docs.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t)) for (t,) in rows_of(batch, "t")], pa.string())], [identifier, "fingerprint"])

    return docs.select(docs[identifier].alias("i"), docs[text].alias("t")).mapInArrow(run, f"`{identifier}` {kind}, fingerprint string")


def _forms(docs: DataFrame, identifier: str, text: str) -> DataFrame:
    """identifier, fingerprint, form: digest and canonical bytes of each row."""
    kind = docs.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t) for (t,) in rows_of(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f) for f in forms], pa.string()), pa.array(forms, pa.binary())], [identifier, "fingerprint", "form"])

    return docs.select(docs[identifier].alias("i"), docs[text].alias("t")).mapInArrow(run, f"`{identifier}` {kind}, fingerprint string, form binary")


def exact_groups(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """identifier, fingerprint, group_id: the smallest identifier of the same canonical text (null where all are null).

    Grouping is by digest and, inside equal digests, by the canonical bytes themselves, as part of the grouping key: Spark
    compares keys byte by byte, and aggregates within each task first, so a group of copies that holds a third of all rows
    reaches that shuffle as one row a task; the join back is one that Spark may split where it is skewed. Null and empty texts are
    one group; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    rows = stored(_forms(docs, identifier, text), "forms")
    smallest = rows.groupBy("fingerprint", "form").agg(F.min(identifier).alias("group_id"))
    return rows.join(smallest, ["fingerprint", "form"]).select(identifier, "fingerprint", "group_id")


def _edit(text: str, following: str) -> str:
    """The last floor(n / 2) characters give way to the first as many of the following document, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(text: str, form: bytes, following: str, following_form: bytes) -> tuple:
    edited = _edit(text, following)
    edited_form = canonical(edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(form), digest(edited_form), likeness(form, edited_form), likeness(form, following_form)


def compare_with_next(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, in descending order of the identifier.

    Next document: by descending identifier, nulls last, equal identifiers by hash of the text and then by text; after the last
    comes the first. A single document is followed by itself. One range exchange carries the texts; each task passes over its
    sorted rows once, and only the last row of a task waits for the first row of the next. Null texts are empty, texts may be of any
    length, an empty table gives an empty table, and other columns are not looked at.
    """
    ship(docs.sparkSession)
    kind = docs.schema[identifier].dataType.simpleString()
    spark = docs.sparkSession
    source = docs.select(docs[identifier].alias("i"), F.coalesce(docs[text], F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    order = [F.col("i").desc_nulls_last(), F.col("h"), F.col("t")]
    ranged = source.repartitionByRange(shuffle_partitions(spark), order[0], order[1]).sortWithinPartitions(*order)
    schema = f"i {kind}, {_TYPES}, part int, edge string, edge_text string"
    arrow = pa.schema([("n_chars", pa.int64()), *[(c, pa.string()) for c in _RESULT[1:4]], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("edge_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the row before, whose next is this one
        for batch in batches:
            ids, rows = [], []
            index = batch.column(batch.schema.get_field_index("i"))
            for k, (value,) in enumerate(rows_of(batch, "t")):
                here = index[k : k + 1]
                form = canonical(value)
                if held is None:
                    ids.append(here)
                    rows.append((None,) * 6 + (part, "first", value))
                else:
                    ids.append(held[0])
                    rows.append((*_compare(held[1], held[2], value, form), part, None, None))
                held = (here, value, form)
            if ids:
                yield _record(ids, rows, arrow)
        if held is not None:
            yield _record([held[0]], [(None,) * 6 + (part, "last", held[1])], arrow)

    passed = stored(ranged.select("i", "t").mapInArrow(run, schema), "fingerprints")
    done = passed.filter("edge IS NULL").select("i", *_RESULT)
    # two rows for each task are left: they are matched by the number of the task, without their texts
    edges = passed.filter("edge IS NOT NULL")
    lasts = edges.filter("edge = 'last'").select("i", "edge_text", "part")
    parts = lasts.select("part")
    by_part = Window.orderBy("part")
    links = parts.withColumns({"following": F.lead("part").over(by_part), "least": F.min("part").over(Window.partitionBy(F.lit(0)))}).select("part", F.coalesce("following", "least").alias("following"))
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("following"), F.col("edge_text").alias("next_text"))
    pairs = lasts.join(links, "part").join(firsts, "following").select("i", "edge_text", "next_text")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = pa.schema(list(arrow)[:6])
        for batch in batches:
            rows = [_compare(a, canonical(a), b, canonical(b)) for a, b in rows_of(batch, "edge_text", "next_text")]
            if rows:
                yield _record([batch.column(0)], rows, short)

    settled = pairs.mapInArrow(settle, f"i {kind}, {_TYPES}")
    return done.unionByName(settled).withColumnRenamed("i", identifier)


def _record(ids: list[pa.Array], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], ["i", *schema.names])


def _sent(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.count() <= SENT else found


def grouped(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``compare_with_next``, with group_id as in ``exact_groups``.

    Only texts whose digest several rows have are grouped by their bytes. Where different bytes share a digest, all are. Null and
    empty texts are one group; rows that repeat an identifier and a text are in one group; a null identifier names a group only
    where all its rows lack one. An empty table gives an empty table.
    """
    compared = compare_with_next(docs, identifier, text)
    several = stored(fingerprints(docs, identifier, text).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"), "several")
    same = _forms(docs, identifier, text).join(_sent(several), "fingerprint", "left_semi").groupBy("fingerprint", "form").agg(F.min(identifier).alias("group_id"))
    same = stored(same.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("forms"), F.min("group_id").alias("group_id")), "groups")
    if same.filter("forms > 1").isEmpty():
        found = compared.join(_sent(same.drop("forms")), "fingerprint", "left")
        return found.select(*compared.columns, F.coalesce("group_id", identifier).alias("group_id"))
    groups = exact_groups(docs, identifier, text).groupBy(F.col(identifier).alias("gi"), F.col("fingerprint").alias("gf")).agg(F.min("group_id").alias("group_id"))
    return compared.join(groups, compared[identifier].eqNullSafe(groups["gi"]) & (compared["fingerprint"] == groups["gf"])).drop("gi", "gf")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
