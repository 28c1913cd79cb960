"""BPE encoding and decoding with a public word-end vocabulary.

A word is encoded over one contiguous array: the boundaries of its parts and,
beside it, the rank of every adjacent pair. The smallest rank is searched, its
right boundary deleted and the two neighbouring ranks refreshed, until no pair
has a rank. Words are short, so scanning the array beats a heap. Unbroken runs of
more than ``SHORT`` symbols take the same merges in the same order from a heap
over linked parts. Pieces between white space are remembered, within a bound, by
each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import rows_of, ship, table

#: Fixed values of the tokenizer file's pre-tokenizer and normaliser.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Unicode White_Space, what the pattern above and the normaliser call white space.
SPACES = " \t\n\v\f\r\x85\xa0  -     　"
_SPLIT = re.compile(f"[{SPACES}]+")
#: Python's str.split() also splits at these, which are no white space here.
_CONTROL = re.compile("[\x1c-\x1f]")
WORD_END = "</w>"
NO_RANK = 1 << 30
#: Symbols up to which a word is scanned for its smallest rank.
SHORT = 256
#: Remembered pieces and words of a worker; both are emptied when full.
CACHE_PIECES = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible Latin-1 stays, others move past U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, moved = {b: chr(b) for b in visible}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + moved)
            moved += 1
    return [out[b] for b in range(256)]


@dataclass
class WordBpe:
    """Encoder and decoder for one tokenizer file."""

    path: str
    _words: dict = field(default_factory=dict)
    _pieces: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for text, i in (*self.vocab.items(), *self.special.items()):
            self.tokens[i] = text
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(spec["model"]["merges"])}
        self.symbols = byte_symbols()
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, given as byte symbols."""
        n = len(word)
        if n > SHORT:
            return self._long_word_ids(word)
        # starts[i] is where part i begins; ranks[i] belongs to parts i and i + 1
        starts = list(range(n + 1))
        text = lambda i, j: word[i:j] + WORD_END if j == n else word[i:j]
        rank_of = self.ranks.get
        ranks = [rank_of((word[i], text(i + 1, i + 2)), NO_RANK) for i in range(n - 1)]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            del starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((text(starts[i], starts[i + 1]), text(starts[i + 1], starts[i + 2])), NO_RANK)
            if i:
                ranks[i - 1] = rank_of((text(starts[i - 1], starts[i]), text(starts[i], starts[i + 1])), NO_RANK)
        return [self.vocab[text(a, b)] for a, b in zip(starts, starts[1:], strict=False)]

    def _long_word_ids(self, word: str) -> list[int]:
        """The same for a word of any length: candidates (rank, place) in a heap, parts in a linked list.

        Of equal ranks the leftmost comes first, as in a scan. A candidate whose pair has changed since is passed over.
        """
        n = len(word)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        text = lambda i: word[i : end[i]] + WORD_END if end[i] == n else word[i : end[i]]
        rank_of = self.ranks.get
        rank = lambda i: rank_of((text(i), text(after[i])), NO_RANK) if after[i] < n else NO_RANK
        current = [rank(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(current) if r != NO_RANK]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if current[i] != r:
                continue
            gone = after[i]
            end[i], after[i], current[gone] = end[gone], after[gone], NO_RANK
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0:
                    current[j] = rank(j)
                    if current[j] != NO_RANK:
                        heappush(heap, (current[j], j))
        out, i = [], 0
        while i < n:
            out.append(self.vocab[text(i)])
            i = after[i]
        return out

    def _normal(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # lower case is taken character by character: no final sigma
        out: list[int] = []
        for word in PIECES.findall(piece.lower()):
            ids = self._words.get(word)
            if ids is None:
                if len(self._words) >= CACHE_PIECES:
                    self._words.clear()
                ids = self.word_ids("".join([self.symbols[b] for b in word.encode()]))
                if len(word) < 64:
                    self._words[word] = ids
            out += ids
        return out

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a piece without white space; the strings of special tokens in it are those tokens."""
        if self._special is None or "<|" not in piece:
            return self._normal(piece)
        out, at = [], 0
        for m in self._special.finditer(piece):
            out += [*self._normal(piece[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self._normal(piece[at:])

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces = _SPLIT.split(text) if _CONTROL.search(text) else text.split()
        known = self._pieces
        out = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.piece_ids(piece), "<u4").tobytes()
                if len(piece) < 64:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4").tolist()

    def decode(self, ids) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of a file, kept for the life of the Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, identifier: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """identifier, n_tokens, then ids (array of int), or with ``digests`` the SHA-256 of ids and of the decoded text.

    One row for each row; null and empty texts have no ids and decode to the empty text. Very long texts are encoded piece by
    piece between white space, unbroken ones of any length in time that hardly grows faster than they. Rows are independent, so repeated rows repeat. There is no shuffle. An empty table gives an empty
    table; other columns, whatever their names, are not looked at.
    """
    ship(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[identifier].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            counts, left, right = [], [], []
            for (value,) in rows_of(batch, "t"):
                packed = bpe.encode_bytes(value or "")
                ids = np.frombuffer(packed, "<u4")
                counts.append(len(ids))
                if digests:
                    left.append(hashlib.sha256(packed).hexdigest())
                    right.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
                else:
                    left.append(ids.astype("i4"))
            out = [batch.column(0), pa.array(counts, pa.int64())]
            if digests:
                yield pa.RecordBatch.from_arrays([*out, pa.array(left, pa.string()), pa.array(right, pa.string())], [identifier, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                values = pa.array(np.concatenate(left) if left else np.empty(0, "i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(offsets, values)], [identifier, "n_tokens", "ids"])

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(docs[identifier].alias("i"), docs[text].alias("t")).mapInArrow(run, f"`{identifier}` {kind}, n_tokens bigint, {rest}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
