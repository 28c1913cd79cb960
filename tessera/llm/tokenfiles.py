"""Token identifiers in binary files of Simple-8b words (Anh and Moffat, "Index compression using 64-bit words", 2010).

A word of 64 bits has a selector of 4 bits, which says how many identifiers of how many bits share the other 60. Identifiers of
more than 60 bits are escaped: a zero stands in their place, and position and value are kept beside the words. Blocks of
``BLOCK`` identifiers are packed each for itself, all blocks of a file in step, and the words of each block are counted, so that
any block is found and decoded alone, with array operations over all words of one selector at once.

A file (little-endian words of 64 bits): MAGIC; the packed words; positions, then values of escapes; the number of words of each
block in 16 bits; the documents' identifiers; bits that say which of these are null; the documents' lengths; a trailer of
``TRAILER`` words: part, sequence, identifiers, documents, packed words, escapes, 0, MAGIC. Spark's text writer writes each file as one line whose
end is a word of zeros, commits it and puts it into any store that Spark reaches. Files lie in ``path/data``; ``path/index`` has
for each file the number of the first of its identifiers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, ship, table
from tessera.llm.scanning import coded, gathered, slices, text_bytes

#: Fixed values of the published code: how many numbers of how many bits a word holds, by its selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_BITS = sorted(set(WIDTHS))
_LIMITS = np.array([1 << b for b in _BITS], np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)
#: Identifiers of a block; identifiers after which a file ends with its document; words of the trailer; remembered pieces of a worker.
BLOCK, FILE_IDS, TRAILER, CACHE_PIECES = 1024, 1 << 22, 8, 300_000
MAGIC = int.from_bytes(b"SIMPLE8B", "little")
#: Ends a file.
END = "\x00" * 8
_SPACE = COUNTS[0]
#: Numbers that are packed at once, a multiple of BLOCK.
_TOGETHER = 1 << 19


# --- the code -------------------------------------------------------------------------------------------------------
def _selectors(blocks: np.ndarray) -> np.ndarray:
    """The selector of the word that would begin at each position of each block: of those that fit the one with most numbers.

    Blocks end in ``_SPACE`` zeros."""
    need = _SMALL[blocks] if not blocks.size or int(blocks.max()) < 1 << 16 else np.searchsorted(_LIMITS, blocks.ravel(), "right").astype(np.uint8).reshape(blocks.shape)
    most = {1: need}  # the greatest need of so many numbers from each position on, which halves give
    width = blocks.shape[1] - _SPACE
    out = np.full((len(blocks), width), len(COUNTS) - 1, np.uint8)
    for selector in range(len(COUNTS) - 2, -1, -1):
        count, half = COUNTS[selector], max(most)
        if 2 * half < count:  # the next wider one is not made of the widest and itself
            half = max(most)
            most[2 * half] = np.maximum(most[half][:, :-half], most[half][:, half:])
            half *= 2
        left = max(w for w in most if w <= count)
        right = min(w for w in most if w >= count - left) if left < count else 0
        wide = most[left] if not right else np.maximum(most[left][:, : width + _SPACE - count + 1], most[right][:, count - right :][:, : width + _SPACE - count + 1])
        most[count] = wide
        fits = wide[:, :width] <= _BITS.index(WIDTHS[selector])
        if not fits.any():
            break
        out -= fits.view(np.uint8)  # where so many fit, fewer of more bits did
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of 64 bits, how many of them each block of ``BLOCK`` numbers has, and positions and values of escapes."""
    parts = [_packed(values[at : at + _TOGETHER]) for at in range(0, len(values), _TOGETHER)] or [_packed(values)]
    words, counts, escapes, escaped = zip(*parts, strict=True)
    return np.concatenate(words), np.concatenate(counts), np.concatenate([e + i * _TOGETHER for i, e in enumerate(escapes)]), np.concatenate(escaped)


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(values)
    blocks = np.zeros((-(-n // BLOCK), BLOCK + _SPACE), np.uint64)
    values = np.r_[values.astype(np.uint64), np.zeros(-n % BLOCK, np.uint64)]
    wide = np.flatnonzero(values >> np.uint64(60))
    escaped = values[wide]
    values[wide] = 0
    blocks[:, :BLOCK] = values.reshape(-1, BLOCK)
    selector = _selectors(blocks)
    step = np.array(COUNTS)[selector]
    begins = np.zeros(selector.shape, bool)
    # all blocks take a word at a time
    live, at, ends = np.arange(len(blocks)), np.zeros(len(blocks), np.int64), np.minimum(BLOCK, n - np.arange(len(blocks)) * BLOCK)
    while len(live):
        begins[live, at] = True
        at = at + step[live, at]
        open_ = at < ends[live]
        live, at = live[open_], at[open_]
    row, column = np.nonzero(begins)
    chosen, starts, flat = selector[row, column], row * (BLOCK + _SPACE) + column, blocks.ravel()
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        if WIDTHS[s]:
            picked = np.flatnonzero(chosen == s)
            at, packed = starts[picked], words[picked]
            for lane in range(COUNTS[s]):
                packed |= flat[at + lane] << np.uint64(lane * WIDTHS[s])
            words[picked] = packed
    return words, begins.sum(axis=1).astype(np.uint16), wide, escaped


def unpack(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of packed words, ``counts`` of them to a block; zeros where escapes belong."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.array(COUNTS)[selector]
    ends = np.r_[0, np.cumsum(held)]
    first = np.r_[0, np.cumsum(counts.astype(np.int64))]
    block = np.repeat(np.arange(len(counts)), counts)
    starts = ends[:-1] - ends[first[:-1]][block] + block * (BLOCK + _SPACE)
    out = np.zeros(len(counts) * (BLOCK + _SPACE), np.uint64)
    for s in np.unique(selector).tolist():
        if WIDTHS[s]:
            picked, mask = np.flatnonzero(selector == s), np.uint64((1 << WIDTHS[s]) - 1)
            for lane in range(COUNTS[s]):
                out[starts[picked] + lane] = (words[picked] >> np.uint64(lane * WIDTHS[s])) & mask
    return out.reshape(-1, BLOCK + _SPACE)[:, :BLOCK].ravel()[:n]


def file_bytes(ids: np.ndarray, documents: list[int | None], lengths: list[int], part: int = 0, sequence: int = 0) -> bytes:
    """The content of a file, without its end."""
    words, counts, escapes, escaped = pack(ids)
    counts = np.r_[counts, np.zeros(-len(counts) % 4, np.uint16)].astype("<u2").view("<u8")
    nulls = np.packbits(np.array([d is None for d in documents], bool), bitorder="little")
    nulls = np.r_[nulls, np.zeros(-len(nulls) % 8, np.uint8)].view("<u8")
    names = np.array([0 if d is None else d for d in documents], "<i8").view("<u8")
    trailer = np.array([part, sequence, len(ids), len(documents), len(words), len(escapes), 0, MAGIC], "<u8")
    return np.concatenate([np.array([MAGIC], "<u8"), words, escapes.astype("<u8"), escaped, counts, names, nulls, np.array(lengths, "<u8"), trailer]).astype("<u8").tobytes()


class TokenFile:
    """Random access to the content of one file."""

    def __init__(self, content: bytes) -> None:
        words = np.frombuffer(content, "<u8", len(content) // 8)
        if len(words) and words[-1] == 0:
            words = words[:-1]  # the end of the line
        if len(words) <= TRAILER or int(words[-1]) != MAGIC or int(words[0]) != MAGIC:
            raise ValueError("no token file, or a cut one")
        self.part, self.sequence, self.n, self.documents, packed, escapes, _, _ = map(int, words[-TRAILER:])
        blocks = -(-self.n // BLOCK)
        cuts = np.cumsum([1, packed, escapes, escapes, -(-blocks // 4), self.documents, -(-self.documents // 64), self.documents])
        self.words, self.escapes, self.escaped, counts, names, nulls, lengths = (words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.counts = counts.view("<u2")[:blocks]
        self.first = np.r_[0, np.cumsum(self.counts.astype(np.int64))]
        self.names = pa.array(names.view("<i8"), pa.int64(), mask=np.unpackbits(nulls.view(np.uint8), count=self.documents, bitorder="little").astype(bool))
        self.lengths = lengths.astype(np.int64)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Identifiers number ``start`` to ``end`` of the file; only blocks that hold any of them are decoded."""
        end = self.n if end is None else min(end, self.n)
        if start >= end:
            return np.empty(0, np.uint64)
        a, b = start // BLOCK, -(-end // BLOCK)
        out = unpack(self.words[self.first[a] : self.first[b]], self.counts[a:b], min(b * BLOCK, self.n) - a * BLOCK)
        here = slice(*np.searchsorted(self.escapes, (a * BLOCK, b * BLOCK)))
        out[self.escapes[here].astype(np.int64) - a * BLOCK] = self.escaped[here]
        return out[start - a * BLOCK : end - a * BLOCK]


# --- the tokenizer --------------------------------------------------------------------------------------------------
#: Classes of bytes: 1 white space; 2 what certainly begins no white space of Unicode, of this 3 ASCII letters and digits and
#: 4 punctuation, but for the apostrophe of contractions and the bar of special tokens; 0 all others.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x0A]] = 1
_CLASS[[*range(0xC3, 0xE1), *range(0xE4, 0xF5), 0x27, 0x7C]] = 2
_CLASS[[b for b in range(0x80) if chr(b).isalnum()]] = 3
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'|"]] = 4
_TURN = np.zeros(40, bool)  # by the classes of two bytes in a row, 8 times the first
_TURN[[3 * 8 + 4, 4 * 8 + 3]] = True


class PieceEncoder:
    """The tokenizers library over texts whose words recur: each different piece of a text is encoded once.

    The file's pattern lets a white-space character that a solid one follows begin a token, whatever stands before it, and lets no
    token cross between letters and punctuation. Texts are cut there, so the identifiers of the pieces are those of the text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Identifiers of each piece, 32 bits each. New ones pass the library as the words of one text; what was not met for long is
        forgotten."""
        if len(self.known) > CACHE_PIECES:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        if new := [p for p in pieces if p not in known and p not in before]:
            e = self.tokenizer.encode([p.decode() for p in new], is_pretokenized=True, add_special_tokens=False)
            ends = (4 * np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(new)))).tolist()
            ids = np.array(e.ids, np.uint32).tobytes()
            known.update(zip(new, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        if before:
            known.update([(p, before[p]) for p in pieces if p not in known])
        return list(map(known.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers of a column without nulls, and how many each text has."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        kind, first = _CLASS[data], offsets[:-1][offsets[:-1] < len(data)]
        begins = np.zeros(len(data), bool)
        np.logical_and(kind[:-1] == 1, kind[1:] >= 2, out=begins[:-1])
        begins[first[first > 0] - 1] = False  # what follows is another text
        begins[1:] |= _TURN[kind[:-1] * 8 + kind[1:]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        codes, pieces = coded(data, starts)
        encoded = self._ids(pieces.to_pylist())
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        counts = sizes[codes]
        ids = gathered(np.frombuffer(b"".join(encoded), np.uint32), (np.cumsum(sizes) - sizes)[codes], counts)
        ends = np.r_[0, np.cumsum(counts)]
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])


_LOADED: dict[str, PieceEncoder] = {}


def load(path: str) -> PieceEncoder:
    """The encoder of a file, kept for the life of the Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- files ----------------------------------------------------------------------------------------------------------
def write(docs: DataFrame, path: str, tokenizer: str | None = None, identifier: str = "doc_id", text: str = "text", end: int | None = 0, file_ids: int = FILE_IDS) -> None:
    """Write the identifiers of all texts, each followed by ``end``, in ascending order of the documents' identifiers.

    Texts are put in order by range, once, and encoded where they are written; a file ends with the document that brings it to
    ``file_ids``, so a task holds about as many. The documents' identifiers are whole numbers; null ones come last, and rows that
    repeat one are documents each, by a hash of their text. Null and empty texts have the end alone; texts of any length are
    encoded whole. An empty table has no file of identifiers. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or default_path()
    own = docs.select(docs[identifier].cast("long").alias("i"), docs[text].alias("t"))
    named = own.withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})  # r: equal rows are dealt evenly, too
    order = [F.col("i").asc_nulls_last(), F.col("h"), F.col("r")]
    rows = named.repartitionByRange(*order).sortWithinPartitions(*order).select("i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sequence = load(tokenizer), TaskContext.get().partitionId(), 0
        ids, names, lengths, n = [], [], [], 0

        def content() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(np.concatenate(ids), names, lengths, part, sequence)], pa.binary())], ["value"])

        for batch in batches:
            for rows in slices(batch, 1):
                found, counts = encoder.encode(rows.column(1))
                at = 0
                for name, count in zip(rows.column(0).to_pylist(), counts.tolist(), strict=True):
                    ids.append(found[at : at + count])
                    if end is not None:
                        ids.append(np.array([end], np.uint32))
                        count += 1
                    at += len(ids[-2] if end is not None else ids[-1])
                    names.append(name)
                    lengths.append(count)
                    n += count
                    if n >= file_ids:
                        yield content()
                        ids, names, lengths, n, sequence = [], [], [], 0, sequence + 1
        if names:
            yield content()

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(f"{path}/data")
    _index(spark, path)


_PLACES = "part bigint, sequence bigint, ids bigint, documents bigint"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").filter("length > 8")


def _index(spark: SparkSession, path: str) -> None:
    """part, sequence, ids, documents, first: a row for each file, from the trailers alone."""
    trailers = _files(spark, path).select(F.expr(f"substring(content, cast(length AS int) - {8 * TRAILER + 7}, {8 * TRAILER})").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.array([np.frombuffer(x, "<i8")[:4] for x in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in told.T], ["part", "sequence", "ids", "documents"])

    places = sorted(tuple(r) for r in trailers.mapInArrow(run, _PLACES).collect())  # a row for each file
    firsts = accumulate((p[2] for p in places), initial=0)
    spark.createDataFrame([(*p, f) for p, f in zip(places, firsts, strict=False)], f"{_PLACES}, first bigint").write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, digests: bool = False, identifier: str = "doc_id") -> DataFrame:
    """identifier, start, n_tokens, then ids (array of bigint), or with ``digests`` ids_crc32: a row for each document of the files.

    ``start`` is the number of identifiers of all documents before it; ids_crc32 the unsigned CRC-32 of its identifiers as
    little-endian unsigned integers of 32 bits, into which they have to fit. A task holds one file at a time.
    """
    ship(spark)
    last = "ids_crc32 bigint" if digests else "ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = TokenFile(batch.column(0)[i].as_py())
                ids, starts = f.ids(), np.r_[0, np.cumsum(f.lengths)]
                if digests:
                    if len(ids) and int(ids.max()) >> 32:
                        raise ValueError("identifiers of more than 32 bits have no such digest")
                    whole = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8))
                    told = pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64())
                else:
                    told = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view(np.int64), pa.int64()))
                where = [pa.array(np.full(f.documents, x, np.int64)) for x in (f.part, f.sequence)]
                yield pa.RecordBatch.from_arrays([*where, f.names, pa.array(starts[:-1]), pa.array(f.lengths), told], ["part", "sequence", identifier, "at", "n_tokens", last.split()[0]])

    found = _files(spark, path).select("content").mapInArrow(run, f"part bigint, sequence bigint, `{identifier}` bigint, at bigint, n_tokens bigint, {last}")
    index = spark.read.schema(f"{_PLACES}, first bigint").parquet(f"{path}/index").select("part", "sequence", "first")
    placed = found.join(index, ["part", "sequence"])
    return placed.select(identifier, (F.col("first") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def stretch(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """number, id: the identifiers number ``start`` to ``end`` (exclusive) of all files in order, for a reader that begins anywhere.

    Files outside are not opened, blocks outside are not decoded.
    """
    ship(spark)
    names = {(r["part"], r["sequence"]): r["first"] for r in spark.read.parquet(f"{path}/index").filter((F.col("first") < end) & (F.col("first") + F.col("ids") > start)).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = TokenFile(batch.column(0)[i].as_py())
                if (first := names.get((f.part, f.sequence))) is not None:
                    low = max(start - first, 0)
                    ids = f.ids(low, end - first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)) + first + low), pa.array(ids.view(np.int64))], ["number", "id"])

    # Spark numbers a writer's files by its task, so that is what their names begin with
    parts = [f"part-{p:05d}-" for p in sorted({p for p, _ in names})]
    files = _files(spark, path).filter(F.substring_index("path", "/", -1).rlike("^(" + "|".join(parts) + ")") if parts else F.lit(False))
    return files.select("content").mapInArrow(run, "number bigint, id bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, digests=True)
