"""Language identification by cross-parsing.

For each language a suffix automaton holds a bounded sample of labelled text. A
document is parsed against it greedily into phrases: each phrase is the longest
match from where the last one ended, plus nothing, or one foreign character. The
language whose text explains the document in the fewest phrases, each weighed by
the logarithm of the sample's length (the cost of pointing into it), wins
(Ziv and Merhav, "A measure of relative entropy between individual sequences",
1993).

The automata become dense tables, one entry for each state and symbol, that hold
the next state and whether a phrase ends; documents of a batch then advance side
by side, one symbol a step, in all languages at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, ship, table
from tessera.llm.substring import SuffixAutomaton

#: The fitted sample, for each language: so many excerpts of so many characters. It bounds the size of the model.
EXCERPTS, EXCERPT = 60, 300
#: Letters that get a symbol of their own, by frequency in the sample. Further letters of the sample, as of scripts with thousands
#: of them, are spread over so many symbols by code point; letters that no sample holds share one.
ALPHABET, SPREAD = 61, 128
#: Bytes of all tables together; with many languages each sample is cut to fit.
MODEL_BYTES = 96 << 20
UNDETERMINED = "und"
#: Symbols: 0 stands between words, 1 for any other letter.
GAP, OTHER = 0, 1
#: Documents that still have symbols, below which the rest is parsed one by one.
FEW = 24


@dataclass
class Model:
    """Tables of all languages, one after the other: ``table[state * width + symbol]`` is twice the next state, plus one where a phrase ends."""

    languages: list[str]
    symbols: np.ndarray  # by code point below 65536: symbol, GAP for what is no letter
    table: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    width: int


def held_out(identifier: Column) -> Column:
    """crc32 of the identifier as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % 3 == 1, F.lit(zlib.crc32(b"") % 3 == 1))


def sample(docs: DataFrame, identifier: str, text: str, label: str, excerpts: int = EXCERPTS, excerpt: int = EXCERPT) -> list[tuple[str, str]]:
    """(language, excerpt): ``excerpts`` documents of each language, those with the least hashes, a stretch from the middle of each.

    Rank limits are taken within each task before the shuffle, so a language that holds most rows sends no more than others.
    """
    rows = docs.select(F.col(label).alias("lang"), F.col(identifier).alias("id"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    least = rows.withColumn("h", F.xxhash64("id", "text")).select("lang", "id", "h", F.substring(F.col("text"), F.greatest(F.lit(1), F.floor((F.length("text") - excerpt) / 2).cast("int")), F.lit(excerpt)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    least = least.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= excerpts)
    return [(r["lang"], r["text"]) for r in least.select("lang", "n", "text").orderBy("lang", "n").collect()]


def fit(rows: list[tuple[str, str]]) -> Model:
    """Automata of the excerpts of each language, in the order of the languages' code points."""
    by: dict[str, list[str]] = {}
    for language, text in rows:
        by.setdefault(language, []).append(text.lower())
    languages = sorted(by)
    letters = Counter(c for texts in by.values() for t in texts for c in t if c.isalpha() and ord(c) < 65536)
    symbols = np.zeros(65536, np.uint8)
    for i in range(65536):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            symbols[i] = OTHER
    ranked = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
    for n, c in enumerate(ranked):
        symbols[ord(c)] = n + 2 if n < ALPHABET else ALPHABET + 2 + ord(c) % SPREAD
    width = ALPHABET + 2 + (SPREAD if len(ranked) > ALPHABET else 0)
    most = MODEL_BYTES // max(1, len(languages)) // (8 * width)
    tables, roots, weights, base = [], [], [], 0
    for language in languages:
        automaton, length = SuffixAutomaton(), 0
        for text in by[language]:
            sequence = normal(text, symbols)[: max(0, most - length)].tolist()
            automaton.add(sequence)
            length += len(sequence)
        states = len(automaton.next)
        own = np.full((states, width), -1, np.int32)
        for state, follow in enumerate(automaton.next):
            for symbol, to in follow.items():
                own[state, symbol] = to
        restart = np.where(own[0] >= 0, own[0], 0)
        ends = own < 0
        own = np.where(ends, restart[None, :], own)
        tables.append(((own + base) * 2 + ends).astype(np.int32))
        roots.append(base)
        weights.append(np.log2(length + 2))
        base += states
    return Model(languages, symbols, np.concatenate(tables).ravel() if tables else np.empty(0, np.int32), np.array(roots, np.int64), np.array(weights), width)


def normal(text: str, symbols: np.ndarray) -> np.ndarray:
    """Symbols of a lower-cased text: letters, and one GAP for each stretch of anything else; no GAP at the ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = symbols[np.minimum(points, 65535)]
    high = points > 65535
    if high.any():
        out = out.copy()
        out[high] = [OTHER if chr(p).isalpha() else GAP for p in points[high]]
    keep = (out != GAP) | np.r_[False, out[:-1] != GAP]
    out = out[keep] if len(out) else out
    return out[:-1] if len(out) and out[-1] == GAP else out


def phrases(model: Model, documents: list[np.ndarray]) -> np.ndarray:
    """Number of phrase ends of each document (rows) in each language (columns)."""
    n, languages = len(documents), len(model.languages)
    counts = np.zeros((n, languages), np.int64)
    lengths = np.array([len(d) for d in documents])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    active = int((lengths > 0).sum())
    if not active or not languages:
        return counts
    flat = np.concatenate([documents[i] for i in order[:active]])
    at = np.concatenate([[0], np.cumsum(lengths[:active])])[:-1]
    state = np.repeat(model.roots[None, :], active, axis=0) * model.width
    found = np.zeros((active, languages), np.int64)
    step = 0
    while active >= FEW:
        until = int(lengths[active - 1])
        for k in range(step, until):
            entry = model.table[state + flat[at + k][:, None]]
            found[:active] += entry & 1
            state = (entry >> 1).astype(np.int64) * model.width
        step = until
        active = int(np.searchsorted(-lengths, -step, side="left"))
        at, state = at[:active], state[:active]
    entries = model.table
    for d in range(active):
        rest = flat[at[d] + step : at[d] + lengths[d]].tolist()
        for language in range(languages):
            s, ended = int(state[d, language]), 0
            for symbol in rest:
                entry = int(entries[s + symbol])
                ended += entry & 1
                s = (entry >> 1) * model.width
            found[d, language] += ended
    counts[order[: len(found)]] = found
    return counts


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language and score of each text, and whether it has a letter. Score: how far the second language's cost is above the winner's, as a share of it, 0 to 1."""
    documents = [normal(t.lower(), model.symbols) if t else np.empty(0, np.uint8) for t in texts]
    cost = (phrases(model, documents) + 1) * model.weights
    out = []
    for document, row in zip(documents, cost, strict=True):
        if not len(document) or not len(row):
            out.append((UNDETERMINED, 0.0, len(document) > 0))
            continue
        best = int(row.argmin())
        others = np.delete(row, best)
        out.append((model.languages[best], float(1 - row[best] / others.min()) if len(others) else 1.0, True))
    return out


def identify(docs: DataFrame, training: DataFrame, identifier: str = "doc_id", text: str = "text", label: str = "lang", lettered: str | None = None, predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the language and its score in columns of the names given, and whether the text has a
    letter in the column ``lettered`` if it is named; ``training`` has labelled texts. A name that ``docs`` has is an error.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing was learned. Ties go to
    the first language by code point. Whole texts of any length are parsed; rows are independent, repeated ones repeat, and there
    is no shuffle of them. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in (lettered, predicted, score) if c}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(training, identifier, text, label)))
    # at most MODEL_BYTES and the table of symbols
    kept, also = docs.schema.names, [lettered] if lettered else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{predicted}` string", f"`{score}` double", *[f"`{x}` boolean" for x in also]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found, held, size = [], [], 0
            for (value,) in rows_of(batch, text):
                held.append(value)
                size += len(value or "")
                if size > 4_000_000:
                    found += predict(m, held)
                    held, size = [], 0
            found += predict(m, held)
            told = [pa.array([x[n] for x in found], kind) for n, kind in enumerate((pa.string(), pa.float64(), pa.bool_())[: 2 + len(also)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*kept, predicted, score, *also])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), docs.filter(~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
