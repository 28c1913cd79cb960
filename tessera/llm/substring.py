"""Substring dedup: suffix automata of reference shards, documents streamed past them for matching statistics.

An automaton of the whole corpus does not fit anywhere, and streaming every
document past the automaton of every shard would be quadratic. So a shard is
cut by content. Every window of ``WINDOW`` words has an anchor, the least of the
hashes of its runs of ``RUN`` words: equal windows have equal anchors, so two
documents that share a window meet in the shard of its anchor, and only there.

1. Anchors are counted. Those that occur once are left out: a window under such an
   anchor is in no other document. The others are broadcast as a filter of
   ``FILTER_BITS`` bits, whatever their number; the fuller it is, the more of what
   occurs once is sent for nothing in step 2, and nothing is lost.
2. The stretches of text around the anchors that passed go to the anchor's shard,
   in the order of the documents: each is matched against the automaton of all
   earlier ones and then added to it. Where the longest match that ends at a word
   has ``WINDOW`` words or more, that window is a repeat, once the hash of all its
   words is found among those of earlier documents. Rows of a shard stream past;
   a task holds one automaton of at most ``STATES`` states.
3. Words covered by repeats are removed.

Hot passages: a task sends equal stretches once, from its first document. Of an
anchor that very many rows hold, each window is a shard of its own. Where an
automaton is full, later stretches are still matched against it, and what is left
of them is settled by a grouped minimum over the hashes of their windows.

Words pass the automaton as 32 bits of their hashes; windows are confirmed by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import maybe_in, rows_of, stored, table
from tessera.llm.minhash import STEP, scrambled, word_hashes
from tessera.sources.shipping import ship

WINDOW = 13
#: A power of two. Shorter runs recur by chance, and what lies under them would be sent for nothing.
RUN = 8
#: Bits of the filter of repeated anchors: 32 MB, as 8,192 rows of 32,768 bits. A power of two.
FILTER_BITS = 1 << 28
#: Anchors with at least so many occurrences are hot, or more if else there were over HOT_MOST of them (2 MB).
HOT, HOT_MOST = 4096, 1 << 18
#: Words of the documents that a task settles among themselves before it sends their stretches.
TOGETHER = 1 << 21
#: States of an automaton beyond which nothing is added to it.
STATES = 200_000
#: A document without an identifier comes after all others.
LAST = np.iinfo(np.int64).max
_ROW_BITS = 1 << 15


class SuffixAutomaton:
    """Suffix automaton of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            q = nexts[last].get(symbol)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and symbol not in nexts[p]:
                    nexts[p][symbol] = cur
                    p = link[p]
                last = cur
                if p == -1:
                    continue
                q = nexts[p][symbol]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
            else:
                p, cur = last, None
            clone = len(nexts)
            nexts.append(dict(nexts[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p != -1 and nexts[p].get(symbol) == q:
                nexts[p][symbol] = clone
                p = link[p]
            link[q] = clone
            if cur is None:
                last = clone
            else:
                link[cur] = clone

    def matches(self, sequence) -> list[int]:
        """Matching statistics: the length of the longest match that ends at each symbol."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for symbol in sequence:
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(symbol)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            out.append(matched)
        return out


def anchors_of(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its anchor, the least hash of a run; and a hash of all its words."""
    runs, length = hashes, 1
    while 2 * length <= min(RUN, window):  # hashes of runs of 2, 4, 8 words
        runs = scrambled(runs[:-length] * STEP + runs[length:])
        length *= 2
    n = len(hashes) - window + 1
    least, wide, left = runs, 1, window - length + 1
    while 2 * wide <= left:  # least hashes of 2, 4 and so on runs in a row
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[:n], least[left - wide : left - wide + n])
    whole = runs[:n]
    for k in [*range(length, window - length, length), window - length] if window > length else []:
        whole = scrambled(whole * STEP + runs[k : k + n])
    return least, whole


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)].tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def ranges(numbers: list[int]) -> list[int]:
    """Rising numbers as start, count, start, count and so on."""
    out: list[int] = []
    for n in numbers:
        if out and n == out[-2] + out[-1]:
            out[-1] += 1
        else:
            out += [n, 1]
    return out


def pieces(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as a column of bytes."""
    ends = np.cumsum(counts)
    data = values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.r_[0, ends * values.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema.names)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """a, n: the anchors of all documents, counted within each batch; an anchor counts once for each stretch of windows under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.empty(0, np.uint64)]
            for (text,) in rows_of(batch, "t"):
                words = words_of(text)
                if len(words) >= window:
                    anchor, _ = anchors_of(word_hashes(words), window)
                    lists.append(anchor[np.r_[True, anchor[1:] != anchor[:-1]]])
            values, counts = np.unique(np.concatenate(lists), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int32))], ["a", "n"])

    return docs.select("t").mapInArrow(run, "a bigint, n int")


def _filter_of(shared: DataFrame) -> bytes:
    """``FILTER_BITS`` bits: those of the anchors in ``shared``, by their highest bits, are set."""
    slot = F.shiftrightunsigned("a", 64 - FILTER_BITS.bit_length() + 1)
    rows = shared.groupBy(F.floor(slot / _ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg(slot % _ROW_BITS).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():  # at most FILTER_BITS in all
        out[r["row"] * _ROW_BITS // 8 : (r["row"] + 1) * _ROW_BITS // 8] = r["bits"]
    return bytes(out)


def passing(anchors: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = anchors >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


class Shard:
    """Stretches under one anchor, in the order of their documents: automaton, and the windows of all earlier documents."""

    def __init__(self, window: int, states: int) -> None:
        self.window, self.states = window, states
        self.document = None
        self.whole: dict[bytes, int] = {}  # first document of each stretch, by the hashes of its windows
        self.windows: set[int] = set()
        self.automaton = SuffixAutomaton()
        self.waiting: list[tuple[list[int], list[int]]] = []  # stretches of the current document
        self.full = False

    def feed(self, document: int, symbols: bytes, hashes: bytes) -> tuple[list[int], list[int]]:
        """Numbers of the stretch's windows that an earlier document has, and of those that are yet to be settled elsewhere.

        Equal stretches are known by content and pass the automaton once.
        """
        if document != self.document:
            for sequence, own in self.waiting:
                self.automaton.add(sequence)
                self.windows.update(own)
            self.waiting, self.document = [], document
            self.full = len(self.automaton.next) > self.states
        count = len(hashes) // 8
        if self.whole.get(hashes, document) < document:
            return list(range(count)), []
        sequence, own = np.frombuffer(symbols, "<u4").tolist(), np.frombuffer(hashes, "<u8").tolist()
        hits = []
        if self.windows:
            ends = self.automaton.matches(sequence)
            hits = [k for k in range(count) if ends[k + self.window - 1] >= self.window and own[k] in self.windows]
        if self.full:
            held = set(hits)
            return hits, [k for k in range(count) if k not in held]
        if hashes not in self.whole:
            self.whole[hashes] = document
            self.waiting.append((sequence, own))
        return hits, []


_SENT = pa.schema([("k", pa.int64()), ("i", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("symbols", pa.binary()), ("hashes", pa.binary()), ("found", pa.list_(pa.int32()))])
_SENT_DDL = "k bigint, i bigint, h bigint, start int, symbols binary, hashes binary, found array<int>"
_FOUND = pa.schema([("i", pa.int64()), ("h", pa.int64()), ("found", pa.list_(pa.int32())), ("w", pa.int64()), ("start", pa.int32())])
_FOUND_DDL = "i bigint, h bigint, found array<int>, w bigint, start int"


def _stretches(docs: DataFrame, window: int, filter_: bytes, hot: np.ndarray) -> DataFrame:
    """Rows for the shards, and rows (``found``) for what a batch settles by itself: stretches that its own earlier documents have."""
    sent = docs.sparkSession.sparkContext.broadcast((filter_, hot))

    def settle(ids: list, hs: list, low: list, wide: list, keys: list, folds: list, starts: list, counts: list, owners: list) -> Iterator[pa.RecordBatch]:
        key, fold, start, count, owner = (np.concatenate(x) for x in (keys, folds, starts, counts, owners))
        doc, digest = np.array(ids, np.int64), np.array(hs, np.int64)
        # equal stretches, by 128 bits, are sent from their first document of the batch alone
        order = np.lexsort((doc[owner], fold, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (fold[order][1:] != fold[order][:-1])]
        first = doc[owner[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = doc[owner[order]] > first
        sent_, settled = order[~later], order[later]
        symbols, hashes = np.concatenate(low), np.concatenate(wide)
        at_low = np.cumsum([0, *map(len, low)])[:-1]
        at_wide = np.cumsum([0, *map(len, wide)])[:-1]
        for a in range(0, len(sent_), 1 << 15):
            x = sent_[a : a + (1 << 15)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(c) for c in (key[x].view(np.int64), doc[owner[x]], digest[owner[x]], start[x].astype(np.int32))],
                    pieces(symbols, at_low[owner[x]] + start[x], count[x] + window - 1),
                    pieces(hashes, at_wide[owner[x]] + start[x], count[x]),
                    pa.nulls(len(x), _SENT.field("found").type),
                ],
                schema=_SENT,
            )
        settled = settled[np.lexsort((start[settled], owner[settled]))]
        out = {n: [] for n in _SENT.names}
        for a, b in runs(owner[settled]):
            x, d = settled[a:b], owner[settled[a]]
            begin = np.flatnonzero(np.r_[True, start[x][1:] != (start[x] + count[x])[:-1]])
            found = np.stack([start[x][begin], np.add.reduceat(count[x], begin)], axis=1).ravel().tolist()
            for n, v in zip(_SENT.names, (hs[d], ids[d], hs[d], None, None, None, found), strict=True):
                out[n].append(v)
        yield _batch(out, _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, many = sent.value
        bits = np.frombuffer(data, np.uint8)
        ids, hs, low, wide = [], [], [], []  # of each document
        keys, folds, starts, counts, owners = [], [], [], [], []  # of its stretches
        size = 0
        for batch in batches:
            for i, h, text in rows_of(batch, "i", "h", "t"):
                words = words_of(text)
                if len(words) < window:
                    continue
                size += len(words)
                hashes = word_hashes(words)
                anchor, whole = anchors_of(hashes, window)
                number = np.flatnonzero(passing(anchor, bits))
                if not len(number):
                    continue
                own = anchor[number]
                alone = many[np.minimum(np.searchsorted(many, own), len(many) - 1)] == own if len(many) else np.zeros(len(own), bool)
                begins = np.flatnonzero(np.r_[True, (np.diff(number) != 1) | (own[1:] != own[:-1]) | alone[1:]])
                keys.append(np.where(alone, whole[number], own)[begins])
                folds.append(np.add.reduceat(scrambled(whole[number]), begins))
                starts.append(number[begins])
                counts.append(np.diff(np.r_[begins, len(number)]))
                owners.append(np.full(len(begins), len(ids)))
                ids.append(LAST if i is None else i)
                hs.append(h)
                low.append(hashes.astype(np.uint32))
                wide.append(whole)
                if size > TOGETHER:
                    yield from settle(ids, hs, low, wide, keys, folds, starts, counts, owners)
                    ids, hs, low, wide, keys, folds, starts, counts, owners = ([] for _ in range(9))
                    size = 0
        if ids:
            yield from settle(ids, hs, low, wide, keys, folds, starts, counts, owners)

    return docs.select("i", "h", "t").mapInArrow(run, _SENT_DDL)


def _repeats(sent: DataFrame, window: int, states: int) -> DataFrame:
    """i, h, found (ranges of windows) for repeats; and i, h, w, start for windows whose shard was full."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            key, document, digest = (batch.column(n).to_numpy() for n in range(3))
            start, symbols, hashes, settled = (batch.column(n).to_pylist() for n in range(3, 7))
            hits: dict[tuple[int, int], list[int]] = {}
            out = {n: [] for n in _FOUND.names}

            def tell(i, h, found=None, w=None, start=None, out=out):
                for n, v in zip(_FOUND.names, (i, h, found, w, start), strict=True):
                    out[n].append(v)

            for a, b in runs(key):
                if key[a] != at:
                    at, shard = key[a], Shard(window, states)
                if b < len(key) and document[a] == document[b - 1] and shard.document is None:
                    rows = [n for n in range(a, b) if settled[n] is not None]  # one document and no more: nothing to meet
                else:
                    rows = range(a, b)
                for n in rows:
                    i, h = int(document[n]), int(digest[n])
                    if settled[n] is not None:
                        tell(i, h, settled[n])
                        continue
                    own, first = hashes[n], start[n]
                    repeated, left = shard.feed(i, symbols[n], own)
                    if repeated:
                        hits.setdefault((i, h), []).extend(first + x for x in repeated)
                    for x in left:
                        tell(i, h, None, int.from_bytes(own[8 * x : 8 * x + 8], "little", signed=True), first + x)
            for (i, h), starts in hits.items():
                tell(i, h, ranges(sorted(set(starts))))
            yield _batch(out, _FOUND)

    return sent.repartition("k").sortWithinPartitions("k", "i").mapInArrow(meet, _FOUND_DDL)


_DONE = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def deduplicated(docs: DataFrame, identifier: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = True, states: int = STATES, hot: int = HOT) -> DataFrame:
    """identifier, n_words, n_removed, kept_sha256 and, with ``texts``, kept (kept words joined by a space).

    One row for each row. A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    identifier; windows are those of the input. Null, empty and short texts lose nothing. Rows of one identifier do not count
    as earlier than each other; rows without an identifier come last, and none of them is earlier than another. Texts may be
    of any length; an empty table gives an empty table; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[identifier].dataType.simpleString()
    rows = docs.select(docs[identifier].cast("long").alias("i"), docs[text].alias("t")).withColumn("h", F.xxhash64("t"))
    shared = stored(_anchors(rows, window).groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    total = shared.agg(F.sum("n")).first()[0] or 0
    many = np.sort(shared.filter(F.col("n") >= max(hot, -(-total // HOT_MOST))).select("a").toArrow()["a"].to_numpy().view(np.uint64))
    found = stored(_repeats(_stretches(rows, window, _filter_of(shared), many), window, states), "repeats")
    later = found.filter("w IS NOT NULL").select("i", "h", "w", "start")
    least = later.groupBy("w").agg(F.min("i").alias("least"), F.max("i").alias("most")).filter("least < most").select("w", "least")
    settled = later.join(least, "w").filter("i > least").select("i", "h", F.array("start", F.lit(1)).alias("found"))
    lists = found.filter("w IS NULL").select("i", "h", "found").unionByName(settled).groupBy("i", "h").agg(F.flatten(F.collect_list("found")).alias("found"))
    lists = stored(lists, "removed")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in _DONE.names}
            for value, found in rows_of(batch, "t", "found"):
                words = words_of(value)
                n, kept = len(words), words
                if found:
                    begin, count = np.array(found, np.int64).reshape(-1, 2).T
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + count + window - 1, -1)
                    kept = [w for w, gone in zip(words, (np.cumsum(edge)[:n] > 0).tolist(), strict=True) if not gone]
                for name, v in zip(_DONE.names, (n, n - len(kept), *_kept(kept, texts)), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_batch(out, _DONE).columns], ["i", *_DONE.names])

    # texts that lose nothing stay where they are, but for the few that the filter lets through
    split = maybe_in(rows, lists.select("h"))
    named = lists.select(F.col("i").alias("fi"), F.col("h").alias("fh"), "found")
    touched = split.filter("maybe")
    touched = touched.join(named, (F.coalesce(touched["i"], F.lit(int(LAST))) == named["fi"]) & (touched["h"] == named["fh"]), "left").select("i", "t", "found")
    whole = split.filter("NOT maybe").select("i", "t", F.lit(None).cast("array<int>").alias("found"))
    done = whole.unionByName(touched).mapInArrow(last, "i bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return done.select(F.col("i").cast(kind).alias(identifier), "n_words", "n_removed", "kept_sha256", *["kept"] * texts)


def _kept(words: list[bytes], texts: bool) -> tuple[str, str | None]:
    data = b" ".join(words)
    return hashlib.sha256(data).hexdigest(), data.decode() if texts else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False)
