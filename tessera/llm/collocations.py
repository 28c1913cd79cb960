"""Phrase collocation mining by count streams in prefix and suffix order, after the external estimation of n-gram models (Heafield
et al., "Scalable Modified Kneser-Ney Language Model Estimation", ACL 2013).

1. Words and pairs of words are counted by 64-bit hashes, and those that occur often enough set bits of a filter of fixed size.
2. Every word position is one record: the window of up to ``LONGEST`` words that begins there, cut where the filter says that a
   pair is rare. No frequent phrase is lost by that, for all pairs of words in it are frequent; equal windows of a task are one
   record with a count. A key holds the words themselves, so all counts from here on are exact.
3. Records in prefix order: each task streams a sorted range past a stack of the current window's prefixes. A phrase is the
   sum of all records below it and is complete when the stream leaves it; only those open at the edges of a range are added up
   afterwards. Phrases that are rare end here. The count of a language, above all its phrases, is the number of its words.
4. The frequent phrases in prefix order, the order of all lengths in lockstep: on the stack above a phrase are the counts of its
   first one, two, three words, below it those of its extensions to the right.
5. The same in suffix order for its last words and its extensions to the left. Cuts are scored where both meet.

Ranges of step 4 and 5 begin at phrases drawn from a sample; the prefixes of such a phrase are copied to its range, so that each
range is streamed without the others, however many phrases begin with the same word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, shuffle_partitions, stored, table
from tessera.llm.minhash import STEP, scrambled
from tessera.llm.scanning import coded, slices, text_bytes
from tessera.llm.substring import _filter_of, passing
from tessera.operators.prepare import numbered

LEAST, LONGEST, BEST = 100, 5, 2000
#: Hashes that a task counts at once; bytes of text that it scans at once; phrases aimed at for a range; phrases drawn for each.
HASHES, SCAN, RANGE_ROWS, DRAWN = 1 << 21, 4 << 20, 50_000, 32
UNKNOWN = "und"
#: Ends the language and each word in a key; words that hold it, or the escape itself, are escaped.
STOP, _ESCAPES = b"\x00", ((b"\x01", b"\x01\x02"), (b"\x00", b"\x01\x01"))
#: Bytes by what they are: 1 between words, 2 between pieces. Fixed by the contract.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _escaped(x: bytes) -> bytes:
    for a, b in _ESCAPES:
        x = x.replace(a, b)
    return x


def _plain(x: bytes) -> str:
    for a, b in reversed(_ESCAPES):
        x = x.replace(b, a)
    return x.decode()


class Words:
    """The words of some rows (lang, text): codes, whether the next one is in the same piece, and codes of languages."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        data, offsets = text_bytes(rows.column(1))
        kind = _KIND[data]
        word = kind == 0
        starts, ends = np.empty(len(data), bool), np.empty(len(data), bool)
        if len(data):
            starts[0], ends[-1] = word[0], word[-1]
            np.greater(word[1:], word[:-1], out=starts[1:])
            np.greater(word[:-1], word[1:], out=ends[:-1])
            first = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]  # no word crosses to the next text
            starts[first] = word[first]
            ends[first - 1] = word[first - 1]
        starts = np.flatnonzero(starts)
        length = np.flatnonzero(ends) + 1 - starts
        self.codes, words = coded(_LOWER[data[word]], np.cumsum(length) - length)
        self.words: list[bytes] = words.to_pylist()
        self.n = len(self.codes)
        # pieces that begin after a mark or with a text
        cut = np.zeros(self.n + 1, bool)
        cut[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
        at = np.searchsorted(starts, offsets)
        cut[at] = True
        self.joined = ~cut[1:]
        langs = pc.fill_null(rows.column(0), UNKNOWN).dictionary_encode()
        self.langs = [x.encode() for x in langs.dictionary.to_pylist()]
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word with its language, and of each word with the next one."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)[self.codes] if self.n else np.empty(0, np.uint64)
        lang = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in self.langs], np.uint64)[self.lang] if self.n else own
        single = scrambled(lang * STEP + own)
        return single, scrambled(single[:-1] * STEP + own[1:] + np.uint64(1))


def _frequent_hashes(docs: DataFrame, least: int) -> DataFrame:
    """a: hashes of words and of pairs of words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(HASHES, np.uint64), 0

        def told(keys: np.ndarray) -> pa.RecordBatch:
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(keys)]))], ["a", "n"])

        for batch in batches:
            for rows in slices(batch, 1, SCAN):
                w = Words(rows)
                single, double = w.hashes()
                yield told(single)
                double = double[w.joined[:-1]]
                while len(double):
                    taken = double[: HASHES - n]
                    held[n : n + len(taken)] = taken
                    n, double = n + len(taken), double[len(taken) :]
                    if n == HASHES:
                        yield told(held)
                        n = 0
        yield told(held[:n])

    counts = docs.mapInArrow(run, "a bigint, n bigint")
    return counts.groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("a")


def _records(docs: DataFrame, bits: bytes, longest: int) -> DataFrame:
    """key, n: the windows of all word positions, cut by the filter; words of which no phrase is frequent count for their language."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for rows in slices(batch, 1, SCAN):
                w = Words(rows)
                if not w.n:
                    continue
                single, double = w.hashes()
                known = passing(single, bits)
                pair = np.append(passing(double, bits) & w.joined[:-1] & known[:-1] & known[1:], False)
                size, run_on = known.astype(np.int64), pair.copy()
                for k in range(1, longest):
                    size += run_on
                    run_on = run_on & np.append(pair[k:], np.zeros(min(k, w.n), bool))[: w.n]
                yield _windows(w, size)

    return docs.mapInArrow(run, "key binary, n bigint")


def _windows(w: Words, size: np.ndarray) -> pa.RecordBatch:
    """The different windows of ``size`` words from each position on."""
    langs, words = [_escaped(x) + STOP for x in w.langs], [_escaped(x) + STOP for x in w.words]
    number, at, place = w.lang, np.arange(w.n), np.empty(0, np.int64)
    keys, counts = [], []
    for k in range(int(size.max()) + 1):
        # windows that end here, each with one of the places where it stands
        done = size[at] == k
        found, first, n = np.unique(number[done], return_index=True, return_counts=True)
        place = at[done][first]
        codes = [w.codes[place + j].tolist() for j in range(k)]
        keys += [b"".join([langs[x], *[words[c] for c in cs]]) for x, *cs in zip(w.lang[place].tolist(), *codes, strict=True)]
        counts.append(n)
        at, number = at[~done], number[~done]
        if not len(at):
            break
        number = np.unique(number * len(words) + w.codes[at + k], return_inverse=True)[1]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(counts), pa.int64())], ["key", "n"])


def _frequent(records: DataFrame, least: int) -> DataFrame:
    """key, f: languages, and the phrases of which there are ``least`` or more, from records in prefix order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [key, count, whether the range may begin within it]
        edge, keys, counts = True, [], []

        def leave() -> None:
            key, n, cut = stack.pop()
            if stack:
                stack[-1][1] += n
            if cut or n >= least:
                keys.append(key)
                counts.append(n)

        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    leave()
                at = len(stack[-1][0]) if stack else 0
                while at < len(key):
                    at = key.index(STOP, at) + 1
                    stack.append([key[:at], 0, edge])
                edge = False
                stack[-1][1] += n
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["key", "f"])
            keys, counts = [], []
        for x in stack:
            x[2] = True
        while stack:
            leave()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["key", "f"])

    parts = records.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key binary, f bigint")
    return parts.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _in_ranges(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, whose first column is a key, as sorted ranges, each with copies of the rows that are prefixes of its first key.

    Also part, the number of the range, and own, false for copies."""
    key = rows.columns[0]
    parts = max(shuffle_partitions(rows.sparkSession), -(-n // RANGE_ROWS))
    drawn = sorted(bytes(r[0]) for r in rows.select(key).distinct().orderBy(F.xxhash64(key), key).limit(DRAWN * parts).collect())
    begins = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    above: dict[bytes, list[int]] = {}
    for part, first in enumerate(begins, 1):
        at = first.find(STOP) + 1
        while at < len(first):
            above.setdefault(first[:at], []).append(part)
            at = first.index(STOP, at) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, taken, own = [], [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                part = bisect_right(begins, key)
                copies = [p for p in above.get(key, ()) if p > part]
                where += [part, *copies]
                taken += [i] * (1 + len(copies))
                own += [True] + [False] * len(copies)
            out = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where, pa.int32()), pa.array(own, pa.bool_())], [*out.schema.names, "part", "own"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], "part int, own boolean"])
    return rows.mapInArrow(place, schema).repartitionByRange(parts, "part").sortWithinPartitions("part", key)


def _streamed(rows: Iterator[dict], enter: Callable[[dict, dict | None], None], leave: Callable[[dict], None], key: str) -> Iterator[None]:
    """Stream sorted rows past a stack of prefixes; rows of equal keys become one. Yields after each row."""
    stack, part = [], None
    for row in rows:
        if stack and part == row["part"] and row[key] == stack[-1][key]:
            top = stack[-1]
            top["extended"] = max(top["extended"], row["extended"])
            top["own"] |= row["own"]
            continue
        while stack and (part != row["part"] or not row[key].startswith(stack[-1][key])):
            leave(stack.pop())
        part = row["part"]
        enter(row, stack[-1] if stack else None)
        stack.append(row)
        yield
    while stack:
        leave(stack.pop())
    yield


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _reversed(key: bytes) -> bytes:
    lang, *words, _ = key.split(STOP)
    return STOP.join([lang, *words[::-1], b""])


def _prefixes(frequent: DataFrame, n: int) -> DataFrame:
    """back, f, before, extended: of every frequent phrase the key in suffix order, the counts of its language and of its first words,
    and that of its most frequent extension to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def enter(row: dict, above: dict | None) -> None:
            row["before"] = [*above["before"], above["f"]] if above else []
            if len(row["before"]) != row["key"].count(STOP) - 1:
                raise ValueError("a prefix of a phrase is missing")
            if above:
                above["extended"] = max(above["extended"], row["f"])

        def leave(row: dict) -> None:
            if row["before"]:  # no language
                out.append((_reversed(row["key"]), row["f"], row["before"], row["extended"], row["own"]))

        for _ in _streamed(({**r, "extended": 0} for r in _rows(batches)), enter, leave, "key"):
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["back", "f", "before", "extended"])

    return _in_ranges(frequent.select("key", "f"), n).mapInArrow(run, "back binary, f bigint, before array<bigint>, extended bigint")


def best_cut(a: int, n: int, left: list[int], right: list[int]) -> tuple[int, int, int]:
    """score, l, r of the lowest-scoring cut, the first of equal ones; left[i] and right[i] count the words before and after it."""
    scores = [1000 * a * n // (x * y) for x, y in zip(left, right, strict=True)]
    i = scores.index(min(scores))
    return scores[i], left[i], right[i]


def _scored(prefixed: DataFrame, n: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score, extended: phrases of two words or more with the counts of their best cut, and those of their
    most frequent extension to either side. A phrase whose range was cut has several rows."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), *[(c, pa.int64()) for c in ("a", "l", "r", "n", "score", "extended")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def enter(row: dict, above: dict | None) -> None:
            row["after"] = [*above["after"], above["f"]] if above else []
            if len(row["after"]) != len(row["before"]) - 1:
                raise ValueError("a suffix of a phrase is missing")
            if above:
                above["extended"] = max(above["extended"], row["f"])

        def leave(row: dict) -> None:
            if row["after"]:
                lang, *words, _ = row["back"].split(STOP)
                n, *before = row["before"]
                score, left, right = best_cut(row["f"], n, before, row["after"][::-1])
                out.append((_plain(lang), " ".join(map(_plain, reversed(words))), row["f"], left, right, n, score, row["extended"]))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema.names)

        for _ in _streamed(_rows(batches), enter, leave, "back"):
            if len(out) >= 10_000:
                yield told()
                out.clear()
        yield told()

    return _in_ranges(prefixed, n).mapInArrow(run, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint, extended bigint")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, n, score, extended: all phrases of 2 to ``longest`` words that occur ``least`` times or more.

    a, l, r count the phrase and the parts of its lowest-scoring cut, n the words of its language; score is floor(1000 * a * n /
    (l * r)) in whole numbers; extended is the count of its most frequent extension by a word to either side, 0 if no such is
    frequent. Null texts have no words, null languages are ``und``. Texts of any length are read whole; repeated rows count each;
    an empty table, or one without a frequent phrase, gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(docs[lang].cast("string").alias("g"), docs[text].alias("t"))
    bits = _filter_of(_frequent_hashes(own, least))
    records = stored(_records(own, bits, longest), "windows")
    frequent = stored(_frequent(records, least), "frequent")
    n = frequent.count()
    prefixed = stored(_prefixes(frequent, n), "prefixes")
    rows = _scored(prefixed, n)
    return rows.groupBy("lang", "phrase", "a", "l", "r", "n", "score").agg(F.max("extended").alias("extended"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``best`` phrases by score, then a, both descending, then phrase.

    Phrases that some longer frequent phrase holds as often as they occur are left out. An extension that holds a phrase is at most
    as frequent, so it is enough to look at those by one word.
    """
    kept = phrases(docs, text, lang, least, longest).filter(F.col("extended") < F.col("a"))
    ordered = kept.select("*", (-F.col("score")).alias("s"), (-F.col("a")).alias("o"))
    placed = numbered(ordered, "lang", ["s", "o", "phrase"]).filter(F.col("place") < best)
    return placed.select("lang", (F.col("place") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
g AS (SELECT lang, ws[i : i + k - 1] AS g, CAST(count(*) AS HUGEINT) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, f, g, unnest(range(2, len(g))) AS m FROM g WHERE len(g) > 2),
parts AS (SELECT lang, f, g, m, unnest(range(1, len(g) - m + 2)) AS i FROM inner_),
longer AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS f FROM parts GROUP BY ALL),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM g WHERE len(g) > 1),
c AS (SELECT cuts.lang, cuts.g, a, k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
      FROM cuts JOIN n ON n.lang = cuts.lang JOIN g l ON l.lang = cuts.lang AND l.g = cuts.g[1 : k] JOIN g r ON r.lang = cuts.lang AND r.g = cuts.g[k + 1 : len(cuts.g)]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS cut FROM c),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN longer x ON x.lang = b.lang AND x.g = b.g WHERE cut = 1 AND (x.f IS NULL OR 100 * x.f < 100 * a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
