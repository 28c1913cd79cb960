"""WARC archives by way of a chunked record table.

A payload becomes rows of (record, chunk number, bytes), each with the SHA-256 of
the payload up to and with that chunk; an oversized payload is never one row of
the archive. In the archive its first chunk is the record and the others are
continuation records, as the WARC standard's segmentation has it (ISO 28500,
section on record segmentation). Archives are written and read by Spark's text
format with the record separator as line separator, so they can lie in any store
that Spark reaches; each file is one gzip stream.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import maybe_in, rows_of, scratch_path, ship, stored, table

#: Ends a record's header and its block.
BREAK = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Payload bytes of a chunk.
CHUNK = 1 << 18
#: Equal payloads of fewer bytes are not worth a revisit record.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date of capture: pages carry none, and reruns must agree.
DATE = "1970-01-01T00:00:00Z"


def chunk_rows(pages: DataFrame, identifier: str, payload: str, keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """identifier, ``keep``, chunk_no (from 0), chunks, bytes, digest: one row for each chunk, at least one for each record.

    The payload is cut where it is read, and only chunks travel on. ``digest`` is the hex SHA-256 of the payload up to and with the
    chunk, carried along from chunk to chunk. ``payload`` is binary; null is the empty payload. Rows of a record are adjacent and in
    order.
    """
    ship(pages.sparkSession)
    data = F.coalesce(F.col(payload), F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.length(data) / F.lit(chunk))).cast("int")
    rows = pages.select(identifier, *keep, F.col(payload), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"), count.alias("chunks"))
    rows = rows.select(identifier, *keep, "chunk_no", "chunks", F.substring(data, F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for batch in batches:
            out = []
            for number, piece in rows_of(batch, "chunk_no", "bytes"):
                state = hashlib.sha256() if number == 0 else state
                state.update(piece)
                out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "digest"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "digest string"])
    return rows.mapInArrow(run, schema)


def _id(name: Column) -> Column:
    """A record identifier that follows from the page and chunk: a URN of an MD5-based UUID."""
    return F.regexp_replace(F.md5(name), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _safe(text: Column) -> Column:
    """A header value on one line: control characters are percent-encoded."""
    plain = F.coalesce(text, F.lit(""))
    coded = plain
    for code in (*range(32), 127):
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(plain.rlike(r"[\x00-\x1F\x7F]"), coded).otherwise(plain)


def decided(pages: DataFrame, identifier: str, payload: Column) -> DataFrame:
    """Columns of ``pages`` with __payload, __bytes, __digest and __first: the identifier of the response with an equal payload.

    Digests are counted before any payload moves: the smallest identifier of each digest comes from a grouped minimum. Payloads that
    are short, or of which a filter of fixed size says that no other has them, stay where they are; the others meet their first by
    digest, in a join that Spark may split where a payload is very common.
    """
    rows = pages.withColumn("__payload", F.coalesce(payload, F.lit(b""))).withColumns({"__bytes": F.length("__payload").cast("long"), "__digest": F.sha2("__payload", 256)})
    firsts = rows.filter(F.col("__bytes") >= LEAST_REVISIT).groupBy("__digest").agg(F.min(identifier).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    firsts = stored(firsts, "firsts")
    split = maybe_in(rows.withColumn("h", F.xxhash64("__digest")), firsts.select(F.xxhash64("__digest").alias("h")))
    among = (F.col("__bytes") >= LEAST_REVISIT) & F.col("maybe")
    kept = [*rows.columns, "__first"]
    alone = split.filter(~among).withColumn("__first", F.lit(None).cast(firsts.schema["__first"].dataType)).select(*kept)
    return alone.unionByName(split.filter(among).join(firsts, "__digest", "left").select(*kept))


def write(pages: DataFrame, path: str, identifier: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> None:
    """Write a record for each row: a response, or a revisit without a block where a page with a smaller identifier has the same
    payload of ``LEAST_REVISIT`` bytes or more. Null payloads are empty responses; a null identifier is never a revisit's target
    unless all copies lack one, and such rows are all responses. Rows repeated under the smallest identifier are all responses.
    Payloads may be of any length that a row holds; an empty table gives empty archives; other columns are not looked at.
    """
    own = pages.select(pages[identifier].alias("__id"), pages[url].alias("__url"), F.encode(pages[html], "UTF-8").alias("__html"))
    rows = decided(own, "__id", F.col("__html"))
    revisit = F.col("__first").isNotNull() & F.coalesce(F.col("__id") != F.col("__first"), F.lit(True))
    rows = rows.withColumn("__revisit", revisit).withColumn("__payload", F.when(F.col("__revisit"), F.lit(b"")).otherwise(F.col("__payload")))
    pieces = chunk_rows(rows, "__id", "__payload", ("__url", "__bytes", "__digest", "__first", "__revisit"), chunk)
    name = lambda n: _id(F.concat_ws(":", F.lit("page"), F.coalesce(F.col("__id").cast("string"), F.lit("null")), n))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    first, many = F.col("chunk_no") == 0, F.col("chunks") > 1
    # the block of a response is an HTTP answer: its head, then the payload
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__bytes").cast("string"), F.lit(BREAK))
    head = F.when(first & ~F.col("__revisit"), http).otherwise(F.lit(""))
    no = lambda c: F.when(c, F.lit(""))
    header = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(F.col("__revisit"), "revisit").when(first, "response").otherwise("continuation"),
        line("WARC-Record-ID", name(F.col("chunk_no").cast("string"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _safe(F.col("__url"))),
        no(~first).otherwise(F.concat(line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))), line("X-Payload-Length", F.col("__bytes").cast("string")), line("X-Page-ID", F.coalesce(F.col("__id").cast("string"), F.lit("null"))))),
        F.when(F.col("__revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _id(F.concat_ws(":", F.lit("page"), F.col("__first").cast("string"), F.lit("0")))), line("X-Refers-To-Page", F.col("__first").cast("string")))).otherwise(F.lit("")),
        F.when(many, line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"))).otherwise(F.lit("")),
        F.when(many & ~first, line("WARC-Segment-Origin-ID", name(F.lit("0")))).otherwise(F.lit("")),
        F.when(many & (F.col("chunk_no") == F.col("chunks") - 1), line("WARC-Segment-Total-Length", F.col("__bytes").cast("string"))).otherwise(F.lit("")),
        F.when(first & ~F.col("__revisit"), F.concat(line("Content-Type", F.lit("application/http; msgtype=response")), line("X-HTTP-Head-Length", F.length(head).cast("string")))).otherwise(F.lit("")),
        line("X-Chunk-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Length", (F.length("bytes") + F.length(head)).cast("string")),
    )
    # header, break and block are one line of the text format; the line separator ends the block
    block = F.concat(header.cast("binary"), F.lit(BREAK.encode()), head.cast("binary"), F.col("bytes")).cast("string")
    pieces.select(block.alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("chunks", pa.int32()), ("whole", pa.bool_())])


class _Records:
    """Puts records together from the text between breaks; holds at most one header and the piece of a block just read."""

    def __init__(self) -> None:
        self.buffer = b""
        self.state, self.left, self.skip = "header", 0, 0
        self.head: dict[str, str] = {}
        self.record: dict | None = None
        self.digest = hashlib.sha256()

    def feed(self, line: bytes, out: list[dict]) -> None:
        self.buffer += line + BREAK.encode()
        while self.buffer:
            if self.state == "header":
                at = self.buffer.find(BREAK.encode())
                if at < 0:
                    return
                self._begin(self.buffer[:at], out)
                self.buffer, self.state = self.buffer[at + len(BREAK) :], "block"
            if self.state == "block":
                data = self.buffer[: self.left]
                payload = data[self.skip :]
                self.skip -= len(data) - len(payload)
                self.digest.update(payload)
                self.record["read"] += len(payload)
                self.buffer, self.left = self.buffer[len(data) :], self.left - len(data)
                if self.left:
                    return
                if self.record["record_type"] == "response":
                    self.record["whole"] &= self.digest.hexdigest() == self.head["x-chunk-digest"].removeprefix("sha256:")
                self.state = "end"
            if len(self.buffer) < len(BREAK):
                return
            self.buffer, self.state = self.buffer[len(BREAK) :], "header"

    def _begin(self, header: bytes, out: list[dict]) -> None:
        self.head = head = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(header)}
        self.left, self.skip = int(head["content-length"]), int(head.get("x-http-head-length", 0))
        if head["warc-type"] != "continuation":
            self.end(out)
            number = lambda key: None if head.get(key, "null") == "null" else int(head[key])
            self.record = {"page_id": number("x-page-id"), "payload_bytes": int(head["x-payload-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"), "record_type": head["warc-type"], "refers_to": number("x-refers-to-page"), "target_uri": head["warc-target-uri"], "chunks": 0, "whole": True, "read": 0}
            self.digest = hashlib.sha256()
        self.record["chunks"] += 1

    def end(self, out: list[dict]) -> None:
        """The record so far is complete."""
        r = self.record
        if r is None:
            return
        if r["record_type"] == "response":
            digest = self.digest.hexdigest()
            r["whole"] &= digest == r["payload_digest"] and r["read"] == r["payload_bytes"]
            r |= {"payload_digest": digest, "payload_bytes": r["read"]}
        out.append(r)
        self.record = None


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, chunks, whole: one row for each record of the archives.

    Digest and length of responses are computed from the blocks, chunk by chunk; ``whole`` says that they and every chunk's own
    digest agree with the headers. Blocks end by the header's length, so payloads may hold breaks. target_uri is what the
    header says: null as the empty text, control characters percent-encoded. A page_id that was null is null again; archives of an
    empty table give no rows.
    """
    ship(spark)
    lines = spark.read.option("lineSep", BREAK).text(path).select(F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        records = _Records()
        for batch in batches:
            for (line,) in rows_of(batch, "line"):
                records.feed(line, out)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in _READ.names} for r in out], _READ)
                out = []
        records.end(out)
        if out:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in _READ.names} for r in out], _READ)

    return lines.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string, chunks int, whole boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
