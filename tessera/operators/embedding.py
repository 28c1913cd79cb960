"""Embedding columns: entries and their checks, passes shared between entries, batch inference with empty inputs left out.

An embedder is a class with ``embed(values) -> {kind: [embedding for each value]}`` (a list or an Arrow array), registered by a
type name. It runs in mapInArrow over the rows where they lie, a slice of each batch at a time; embeddings are null where the input
is empty.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.text import blank
from tessera.functions.vectors import pooled
from tessera.operators.load import KINDS
from tessera.operators.prepare import split_texts
from tessera.sources.shipping import ship

#: Characters (or bytes) of input, over all columns, whose embeddings a task holds at once; a longer input is held alone.
SLICE = 1 << 18
PARTS = ("text", "image")
POOLINGS = ("mean", "max", "cls", "last")
EMBEDDERS: dict[str, type] = {}
CHUNKERS: dict[str, Callable] = {}
_TYPES = {
    "dense": pa.list_(pa.float32()),
    "sparse": pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))]),
    "multivector": pa.list_(pa.list_(pa.float32())),
}


def register(name: str, table: dict | None = None):
    table = EMBEDDERS if table is None else table

    def put(x):
        if name in table:
            raise ValueError(f"{name!r} is registered already")
        table[name] = x
        return x

    return put


@dataclass(frozen=True)
class Entry:
    """One embedding: what it is called, its kind (dense, sparse, multivector), the type of embedder and its options, and its input:
    a column of a modality, or several for ``multimodal``, of which one has to be there."""

    name: str
    kind: str
    type: str
    modality: str = "text"
    input_column: str | None = None
    input_columns: dict[str, str] | None = None
    output_column: str | None = None
    max_length: int | None = None
    pooling: str | None = None
    normalize: bool = False
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        bad = lambda why: ValueError(f"embedder {self.name!r}: {why}")
        if self.kind not in KINDS:
            raise bad(f"unknown kind {self.kind!r}")
        if self.modality == "multimodal":
            columns = self.input_columns or {}
            if self.input_column is not None or len(columns) < 2 or set(columns) - set(PARTS):
                raise bad(f"multimodal takes input_columns for two or more of {', '.join(PARTS)}")
            if len(set(columns.values())) < len(columns):
                raise bad("two parts have the same column")
        elif self.modality not in PARTS:
            raise bad(f"unknown modality {self.modality!r}")
        elif self.input_columns is not None or self.input_column is None:
            raise bad("one input_column is needed")
        if self.pooling is not None and (self.kind != "multivector" or self.pooling not in POOLINGS):
            raise bad(f"pooling is one of {', '.join(POOLINGS)} and for multivectors only")
        if self.max_length is not None and (self.max_length < 1 or "text" not in self.parts):
            raise bad("max_length is a positive number of characters of a text input")

    @property
    def column(self) -> str:
        return self.output_column or f"{self.name}_embedding"

    @property
    def pooled_column(self) -> str | None:
        return f"{self.name}_pooled" if self.pooling else None

    @property
    def parts(self) -> dict[str, str]:
        return dict(self.input_columns) if self.input_columns else {self.modality: self.input_column}


def check(entries: list[Entry], source: list[str] = (), drop: list[str] = (), splits: bool = False) -> None:
    """Names and output columns differ, a column has one modality, no output is dropped or named like a source column, and a chunker
    that splits has one text column to split."""

    def twice(values: list[str]) -> list[str]:
        return sorted(v for v, n in Counter(values).items() if n > 1)

    columns = [c for e in entries for c in (e.column, e.pooled_column) if c]
    modalities: dict[str, set[str]] = {}
    for e in entries:
        for part, column in e.parts.items():
            modalities.setdefault(column, set()).add(part)
    for found, what in (
        (twice([e.name for e in entries]), "names repeat"),
        (twice(columns), "output columns repeat"),
        (sorted(c for c, m in modalities.items() if len(m) > 1), "columns have several modalities"),
        (sorted(set(columns) & set(drop)), "outputs cannot be dropped"),
        (sorted(set(columns) & set(source)), "outputs are named like source columns"),
        (sorted(modalities) if splits and len(modalities) > 1 else [], "only one column can be split"),
        (sorted(e.name for e in entries if splits and e.modality != "text"), "only texts can be split"),
    ):
        if found:
            raise ValueError(f"{what}: {found}")


def passes(entries: list[Entry]) -> list[list[Entry]]:
    """Entries that one pass of an embedder serves: same type, input, truncation and options but for batch_size, different kinds, and an
    embedder that gives all of them. All others pass alone."""
    groups: dict[tuple, list[Entry]] = {}
    for e in entries:
        options = {k: v for k, v in e.options.items() if k != "batch_size"}
        fusable = e.modality != "multimodal" and e.kind in getattr(EMBEDDERS.get(e.type), "fuses", ())
        groups.setdefault((e.type, tuple(e.parts.items()), e.max_length, repr(sorted(options.items())), None if fusable else e.name), []).append(e)
    out = []
    for group in groups.values():
        out += [group] if len({e.kind for e in group}) == len(group) else [[e] for e in group]
    return out


@register("hashing")
class HashingEmbedder:
    """Embeddings from MD5 of lower-cased tokens, the same everywhere: counts of tokens by hash (dense, sparse) and a unit vector of each
    token (multivector). For tests and as a baseline."""

    fuses = ("dense", "sparse", "multivector")

    def __init__(self, dims: int = 16, batch_size: int = 256) -> None:
        self.dims, self.batch_size = dims, batch_size
        self.known: dict[str, int] = {}

    def slots(self, value: str | dict) -> list[int]:
        text = " ".join(map(str, value.values())) if isinstance(value, dict) else str(value)
        out = []
        for token in re.findall(r"[^\W_]+", text.lower()):
            if token not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dims
            out.append(self.known[token])
        return out

    def embed(self, values: list, kinds: tuple[str, ...]) -> dict[str, list]:
        found = [self.slots(v) for v in values]
        out: dict[str, list] = {}
        if "dense" in kinds:
            out["dense"] = [[float(c[j]) for j in range(self.dims)] for c in map(Counter, found)]
        if "sparse" in kinds:
            out["sparse"] = [{"indices": sorted(c), "values": [float(c[j]) for j in sorted(c)]} for c in map(Counter, found)]
        if "multivector" in kinds:
            # 32-bit numbers from the start: a text of n tokens has n * dims of them
            unit = np.eye(self.dims, dtype=np.float32)
            flat = unit[np.array([s for slots in found for s in slots], np.int64)].ravel()
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, self.dims), pa.int32()), pa.array(flat))
            out["multivector"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), tokens)
        return out


@register("passthrough", CHUNKERS)
def passthrough(rows: DataFrame, text: str, **_) -> DataFrame:
    """One row to one row."""
    return rows


@register("fixed_char", CHUNKERS)
def fixed_char(rows: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """One row to a row for each window of the text, under the text's own name."""
    return split_texts(rows, text, size, overlap).withColumnRenamed("piece", text)


def empty(column: str, modality: str = "text") -> Column:
    """Whether an input is empty: a null or blank text; a null or empty binary."""
    return blank(F.col(column)) if modality == "text" else F.coalesce(F.length(column) == 0, F.lit(True))


def skipped(rows: DataFrame, entries: list[Entry]) -> DataFrame:
    """entry, seen, skipped: rows of the source, and those whose input is empty for an entry."""
    gone = {e.name: [empty(c, m) for m, c in e.parts.items()] for e in entries}
    every = {}
    for name, tests in gone.items():
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        every[name] = F.count(F.when(test, 1))
    counts = rows.agg(F.count(F.lit(1)).alias("seen"), F.array(*[F.struct(F.lit(n).alias("entry"), c.alias("skipped")) for n, c in every.items()]).alias("x"))
    return counts.select("seen", F.explode("x").alias("x")).select("x.entry", "seen", "x.skipped")


def sliced(batch: pa.RecordBatch, columns: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of consecutive rows whose values of ``columns`` have up to ``most`` bytes in all; a row of more is a slice."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for values in (batch.column(batch.schema.get_field_index(c)) for c in columns):
        if pa.types.is_primitive(values.type):
            sizes += 8
        else:
            sizes += pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def embed(rows: DataFrame, entries: list[Entry], drop: list[str] = (), observation: Observation | None = None) -> DataFrame:
    """``rows`` without ``drop``, and a typed column for each entry, null where its input is empty.

    Entries of one group of ``passes`` share a pass. Texts are cut to ``max_length`` characters first. Pooled columns are the
    multivectors' mean, max, first or last token, as doubles. ``observation`` counts, in the pass itself, the rows ``seen`` and for each entry
    those ``skipped_<name>`` because its input is empty.
    """
    check(entries, [c for c in rows.columns if c not in drop], drop)
    if missing := sorted({c for e in entries for c in e.parts.values()} - set(rows.columns)):
        raise ValueError(f"no columns {missing}")
    ship(rows.sparkSession)
    plan = [[(e.column, e.kind) for e in group] for group in passes(entries)]
    made = [(EMBEDDERS[g[0].type], {**g[0].options, **({"batch_size": min(e.options["batch_size"] for e in g if "batch_size" in e.options)} if any("batch_size" in e.options for e in g) else {})}) for g in passes(entries)]
    inputs = [(list(g[0].parts.items()), g[0].max_length) for g in passes(entries)]
    columns = sorted({c for parts, _ in inputs for _, c in parts})
    kept = [c for c in rows.columns if c not in drop]
    flags = {f"__empty_{n}": empty(c, m) for n, (m, c) in enumerate((m, c) for parts, _ in inputs for m, c in parts)}
    marked = rows.select(*kept, *[F.col(c).alias(f"__in_{c}") for c in columns], *[f.alias(n) for n, f in flags.items()])
    outputs = [x for group in plan for x in group]
    if observation is not None:
        gone, flag = {}, 0
        for group in passes(entries):
            own = [F.col(f"__empty_{flag + n}") for n in range(len(group[0].parts))]
            flag += len(own)
            gone |= {e.name: reduce(and_, own) for e in group}
        marked = marked.observe(observation, F.count(F.lit(1)).alias("seen"), *[F.count(F.when(t, 1)).alias(f"skipped_{n}") for n, t in gone.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedders = [cls(**options) for cls, options in made]
        for whole in batches:
            for batch in sliced(whole, [f"__in_{c}" for c in columns], SLICE):
                yield embedded(batch, embedders)

    def embedded(batch: pa.RecordBatch, embedders: list) -> pa.RecordBatch:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        told: dict[str, pa.Array] = {}
        flag = 0
        for embedder, group, (parts, cut) in zip(embedders, plan, inputs, strict=True):
            gone = [batch.column(at[f"__empty_{flag + n}"]).to_pylist() for n in range(len(parts))]
            values = [batch.column(at[f"__in_{c}"]).to_pylist() for _, c in parts]
            flag += len(parts)
            cutter = lambda m, v, cut=cut: v[:cut] if m == "text" and cut else v
            items, place = [], np.full(batch.num_rows, -1)
            for row in range(batch.num_rows):
                there = {m: cutter(m, values[n][row]) for n, (m, _) in enumerate(parts) if not gone[n][row]}
                if there:
                    place[row] = len(items)
                    items.append(there if len(parts) > 1 else next(iter(there.values())))
            kinds = tuple(kind for _, kind in group)
            results: dict[str, list] = {k: [] for k in kinds}
            for start in range(0, len(items), embedder.batch_size):
                some = items[start : start + embedder.batch_size]
                for k, v in embedder.embed(some, kinds).items():
                    if len(v) != len(some):
                        raise RuntimeError(f"an embedder gave {len(v)} embeddings for {len(some)} inputs")
                    results[k].append(v if isinstance(v, pa.Array) else pa.array(v, _TYPES[k]))
            for column, kind in group:
                found = pa.concat_arrays([x.cast(_TYPES[kind]) for x in results[kind]] or [pa.array([], _TYPES[kind])])
                told[column] = found if len(items) == batch.num_rows else found.take(pa.array(place, pa.int64(), mask=place < 0))
        return pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in kept], *told.values()], [*kept, *told])

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], *[f"`{c}` {KINDS[kind]}" for c, kind in outputs]])
    out = marked.mapInArrow(run, schema)
    for e in entries:
        if e.pooled_column:
            out = out.withColumn(e.pooled_column, pooled(F.col(e.column).cast("array<array<double>>"), e.pooling, e.normalize))
    return out


def planned(entries: list[Entry]) -> list[dict]:
    """The passes over the data: entries, type, input columns and kinds of each."""
    return [{"entries": [e.name for e in g], "type": g[0].type, "inputs": list(g[0].parts.values()), "kinds": [e.kind for e in g]} for g in passes(entries)]
