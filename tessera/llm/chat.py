"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. A conversation that is not legal is
repaired at least cost: dynamic programming over the automaton of legal turns
chooses, for every turn, to keep it, to merge it into the turn before, to give
it another role, or to put an empty turn before it.

The cost of a stretch of turns is a matrix over the automaton's states, and
stretches combine by (min, +) products. So a conversation of any length is dealt
into blocks of ``BLOCK`` turns: blocks yield matrices, the matrices of a
conversation say in which states each block begins and ends, and each block is
then repaired alone. Of ways of equal cost the one with the lower states counts,
compared from the end; a matrix carries that comparison too, so where blocks are
cut changes nothing in the repair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, ship, shuffle_partitions, stored, table
from tessera.operators.prepare import numbered

ROLES = ("system", "user", "assistant")
#: States: nothing said yet, or the role of the last turn.
STATES = ("start", *ROLES)
#: Which role may follow which state.
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Other names of roles. Fixed values.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system", "instruction": "system"}
MERGE, RELABEL, UNKNOWN, INSERT = 2, 3, 1, 4
BLOCK = 128
#: Matrices that a row holds at most.
TOGETHER = 1024
_N = len(STATES)
_FAR = 1 << 40


def canonical_role(role: str | None) -> str | None:
    """One of the roles, or None for a role that is null or unknown."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def moves(role: str | None) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """(from state, to state, cost, action, empty turns put before) for a turn of a role, cheapest action first for equal costs."""
    out = []
    for s, state in enumerate(STATES):
        for r in ROLES:
            cost = 0 if r == role else UNKNOWN if role is None else RELABEL
            name = "keep" if cost == 0 else "relabel"
            if r in LEGAL[state]:
                out.append((s, STATES.index(r), cost, name, ()))
            if r == state:
                out.append((s, s, cost + MERGE, "merge" if cost == 0 else "relabel+merge", ()))
            for middle in LEGAL[state]:
                if r in LEGAL[middle] and r not in LEGAL[state]:
                    out.append((s, STATES.index(r), cost + INSERT, "insert+" + name, (middle,)))
    return out


_MOVES = {r: moves(r) for r in (*ROLES, None)}
#: For each role: least costs from state to state, times _N, plus the place of the state it begins in among all that end alike.
_MATRICES, _COSTS = {}, {}
for _r, _list in _MOVES.items():
    _m = np.full((_N, _N), _FAR, np.int64)
    for _a, _b, _c, _, _ in _list:
        _m[_a, _b] = min(_m[_a, _b], _c)
    _COSTS[_r] = _m
    _MATRICES[_r] = _m * _N + np.arange(_N)[:, None]
#: Cost of ending in a state, and the empty turns that end the conversation.
_ENDS = {"start": (0, ()), "system": (2 * INSERT, ("user", "assistant")), "user": (INSERT, ("assistant",)), "assistant": (0, ())}
END_COST = np.array([_ENDS[s][0] for s in STATES], np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product; for equal costs the middle state with the lower place in ``b`` counts, and places follow from it."""
    both = (a // _N)[:, :, None] * _N + b[None, :, :]
    middle = both.argmin(axis=1)
    end = np.arange(_N)
    key = b[middle, end] % _N * _N + a[np.arange(_N)[:, None], middle] % _N
    return np.minimum(both.min(axis=1) // _N, _FAR) * _N + key.argsort(axis=0).argsort(axis=0)


@lru_cache(1 << 12)
def _short(roles: tuple[str | None, ...]) -> np.ndarray:
    out = _MATRICES[roles[0]]
    for role in roles[1:]:
        out = product(out, _MATRICES[role])
    return out


def block_matrix(roles: list[str | None]) -> np.ndarray:
    """Least costs from each state to each state over a stretch of turns, with places as in ``_MATRICES``."""
    out = None
    for n in range(0, len(roles), 4):
        part = _short(tuple(roles[n : n + 4]))
        out = part if out is None else product(out, part)
    return out


def borders(matrices: list[np.ndarray], begin: int = 0, end: int | None = None) -> list[int]:
    """The states between stretches of a conversation, from ``begin`` to ``end``, or to its last: the cheapest way, ties as in ``repair``."""
    forward = [np.where(np.arange(_N) == begin, 0, _FAR)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m // _N).min(axis=0))
    states = [int((forward[-1] + END_COST).argmin()) if end is None else end]
    for n in range(len(matrices) - 1, -1, -1):
        states.append(int((forward[n] * _N + matrices[n][:, states[-1]]).argmin()))
    return states[::-1]


def repair(roles: list[str | None], begin: int, end: int) -> list[tuple[str, str, tuple[str, ...], int]]:
    """(role, action, empty turns before, cost) for each turn of a stretch that begins and ends in the given states."""
    costs = [np.where(np.arange(_N) == begin, 0, _FAR)]
    for role in roles:
        costs.append((costs[-1][:, None] + _COSTS[role]).min(axis=0))
    out, state = [], end
    for n in range(len(roles) - 1, -1, -1):
        a, _, cost, action, put = next(m for m in _MOVES[roles[n]] if m[1] == state and costs[n][m[0]] + m[2] == costs[n + 1][state])
        out.append((STATES[state], action, put, cost))
        state = a
    return out[::-1]


def rendered(text: str | None, role: str, action: str, put: tuple[str, ...]) -> str:
    """A turn as text in the style of ChatML; a merged turn goes on inside the turn before. A turn is closed by whatever opens next."""
    if action.endswith("merge"):
        return "\n" + (text or "")
    opened = "".join(f"<|im_start|>{r}\n<|im_end|>\n" for r in put)
    return f"{opened}<|im_start|>{role}\n{text or ''}"


def _last(name: str) -> Column:
    """A value that sorts with nulls last."""
    return F.struct(F.col(name).isNull().alias("n"), F.col(name).alias("v")).alias(name)


def _turn() -> Column:
    return F.struct(*map(_last, ("no", "role", "text")))


def _crowded(rows: DataFrame, block: int) -> DataFrame:
    """conv, b, b2, turns: the rows of stretches that are too long for one block, in order, ``block`` to a block.

    Different rows are dealt by ranges of their order, each with the number of its copies; the rows before a range in its
    stretch are known from one count for each range, so neither many numbers nor many copies meet in one task.
    """
    order = [F.col(c).asc_nulls_last() for c in ("conv", "b", "no", "role", "text")]
    different = rows.groupBy("conv", "b", "no", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    ranged = different.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for *here, n in rows_of(batch, "conv", "b", "n"):
                if here != at:
                    at, before = here, 0
                out.append(before)
                before += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int64())], [*batch.schema.names, "part", "before"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in different.schema)
    counted = stored(ranged.mapInArrow(count, f"{schema}, part int, before bigint"), "crowded")
    totals = counted.groupBy("conv", "b", "part").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv", "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("conv").alias("tc"), F.col("b").alias("tb"), F.col("part").alias("tp"), earlier.alias("base"))
    placed = counted.join(bases, counted["conv"].eqNullSafe(bases["tc"]) & (counted["b"] == bases["tb"]) & (counted["part"] == bases["tp"])).withColumn("first", F.col("base") + F.col("before"))
    cut = placed.withColumn("b2", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block))))
    copies = F.least(F.col("first") + F.col("n"), (F.col("b2") + 1) * block) - F.greatest(F.col("first"), F.col("b2") * block)
    held = cut.groupBy("conv", "b", "b2").agg(F.sort_array(F.collect_list(F.struct(_turn().alias("turn"), copies.cast("int").alias("n")))).alias("x"))
    return held.select("conv", "b", "b2", F.flatten(F.transform("x", lambda x: F.array_repeat(x["turn"], x["n"]))).alias("turns"))


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """conversation, block, position, turn, role_in, role_out, action, cost, rendered: one row for each turn.

    The rendered pieces of a conversation, joined in the order of block and position, are its text. Order of turns, at every
    size: by number, nulls last, ties by role and text (nulls last). A block holds the turns whose number falls in a stretch
    of ``block``; a stretch that repeated numbers make too long is cut in that same order. Where blocks end changes no repair.
    A null conversation is one conversation. Null, empty and unknown roles take the role that costs least; null texts are empty.
    Repeated rows are turns each; texts may be of any length; an empty table gives an empty table; other columns, whatever their
    names, are not looked at.
    """
    ship(turns.sparkSession)
    rows = turns.select(turns[conversation].alias("conv"), turns[turn].cast("long").alias("no"), turns[role].alias("role"), turns[text].alias("text"))
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("no") / F.lit(block)), F.lit(1 << 62)))
    crowded = stored(rows.groupBy("conv", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * block).select(F.col("conv").alias("cc"), F.col("b").alias("cb")), "long")
    inside = rows["conv"].eqNullSafe(crowded["cc"]) & (rows["b"] == crowded["cb"])
    blocks = rows.join(crowded, inside, "left_anti").groupBy("conv", "b").agg(F.sort_array(F.collect_list(_turn())).alias("turns")).select("conv", "b", F.lit(0).cast("long").alias("b2"), "turns")
    if not crowded.isEmpty():
        blocks = blocks.unionByName(_crowded(rows.join(crowded, inside, "left_semi"), block))
    blocks = stored(blocks.select("conv", F.struct("b", "b2").alias("at"), "turns"), "blocks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [block_matrix([canonical_role(x["v"]) for x in roles]).ravel().tolist() for (roles,) in rows_of(batch, "roles")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64()))], ["conv", "at", "m"])

    kind, at = turns.schema[conversation].dataType.simpleString(), "struct<b:bigint,b2:bigint>"
    matrices = blocks.select("conv", "at", F.col("turns.role").alias("roles")).mapInArrow(measure, f"conv {kind}, at {at}, m array<bigint>")
    cuts = _cuts(stored(matrices, "matrices")).withColumnRenamed("conv", "c2").withColumnRenamed("at", "at2")
    ready = blocks.join(cuts, blocks["conv"].eqNullSafe(cuts["c2"]) & (blocks["at"] == cuts["at2"])).select("conv", "n", "begin", "end", "last", "turns")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), ("position", pa.int32()), ("turn", pa.int64()), ("role_in", pa.string()), ("role_out", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])
        for batch in batches:
            index, out = [], []
            for k, (n, begin, end, is_last, turns_) in enumerate(rows_of(batch, "n", "begin", "end", "last", "turns")):
                plan = repair([canonical_role(t["role"]["v"]) for t in turns_], begin, end)
                for j, (t, (role_out, action, put, cost)) in enumerate(zip(turns_, plan, strict=True)):
                    piece = rendered(t["text"]["v"], role_out, action, put)
                    if (n or j) and not action.endswith("merge"):
                        piece = "<|im_end|>\n" + piece
                    if is_last and j + 1 == len(turns_):
                        extra, tail = _ENDS[STATES[end]]
                        cost += extra
                        piece += "<|im_end|>\n" + "".join(f"<|im_start|>{r}\n<|im_end|>\n" for r in tail)
                        action += "+close" if tail else ""
                    index.append(k)
                    out.append((n, j, t["no"]["v"], t["role"]["v"], role_out, action, cost, piece))
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]], ["conv", *schema.names])

    done = ready.mapInArrow(write, f"conv {kind}, block int, position int, turn bigint, role_in string, role_out string, action string, cost bigint, rendered string")
    return done.select(F.col("conv").alias(conversation), "block", "position", F.col("turn").alias(turn), "role_in", "role_out", "action", "cost", "rendered")


def _cuts(matrices: DataFrame) -> DataFrame:
    """conv, at, n, begin, end, last: the states between which each block is repaired, and its number in its conversation.

    matrices (conv, at, m). Of a conversation of more than ``TOGETHER`` blocks as many are multiplied to one, and these again, so
    that a row never holds more than ``TOGETHER`` matrices; states then pass from the top down.
    """
    many = stored(matrices.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TOGETHER).select(F.col("conv").alias("cm")), "many")
    if many.isEmpty():
        return _within(matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("parts")))
    among = matrices["conv"].eqNullSafe(many["cm"])
    few = _within(matrices.join(many, among, "left_anti").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("parts")))
    placed = numbered(matrices.join(many, among, "left_semi").withColumns({"b": F.col("at.b"), "b2": F.col("at.b2")}), "conv", ["b", "b2"]).select("conv", "at", F.col("place").alias("no"), "m")
    levels = [stored(placed.withColumn("up", F.floor(F.col("no") / TOGETHER)), "level")]
    while levels[-1].agg(F.max("no")).first()[0] >= TOGETHER:
        rows = levels[-1].groupBy("conv", "up").agg(F.sort_array(F.collect_list(F.struct("no", "m"))).alias("parts"))
        above = rows.select("conv", F.col("up").alias("no"), "parts").mapInArrow(_multiplied, f"conv {matrices.schema['conv'].dataType.simpleString()}, no bigint, m array<bigint>")
        levels.append(stored(above.withColumn("up", F.floor(F.col("no") / TOGETHER)), "level"))
    told = None
    for level in reversed(levels):
        rows = level.groupBy("conv", "up").agg(F.sort_array(F.collect_list(F.struct("no", *(["at"] if "at" in level.columns else []), "m"))).alias("parts"))
        if told is not None:
            known = told.select(F.col("conv").alias("ck"), F.col("no").alias("nk"), "begin", "end", F.col("last").alias("whole"))
            rows = rows.join(known, rows["conv"].eqNullSafe(known["ck"]) & (rows["up"] == known["nk"])).drop("ck", "nk")
        told = stored(_within(rows), "states")
    return few.unionByName(told.select(*few.columns))


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each row's matrices, in order."""
    for batch in batches:
        out = [reduce(product, (np.array(p["m"], np.int64).reshape(_N, _N) for p in parts)).ravel().tolist() for (parts,) in rows_of(batch, "parts")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv", "no", "m"])


def _within(rows: DataFrame) -> DataFrame:
    """conv, at (if parts have it), no or n, begin, end, last: states between the parts of a row (conv, parts; and begin, end, whole
    where the row is a stretch of a conversation that goes on unless ``whole``)."""
    part = rows.schema["parts"].dataType.elementType
    named = "at" in part.names
    stretch, number = "begin" in rows.columns, "no" in part.names
    entry = [*([f"at:{part['at'].dataType.simpleString()}"] if named else []), "n:bigint", "begin:int", "end:int", "last:boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            given = rows_of(batch, "begin", "end", "whole") if stretch else [(0, None, True)] * batch.num_rows
            for (parts,), (begin, end, whole) in zip(rows_of(batch, "parts"), given, strict=True):
                states = borders([np.array(p["m"], np.int64).reshape(_N, _N) for p in parts], begin, end)
                out.append([{**({"at": p["at"]} if named else {}), "n": p["no"] if number else n, "begin": a, "end": b, "last": whole and n + 1 == len(parts)} for n, (p, a, b) in enumerate(zip(parts, states[:-1], states[1:], strict=True))])
            kinds = [*([("at", batch.schema.field("parts").type.value_type.field("at").type)] if named else []), ("n", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct(kinds)))], ["conv", "cuts"])

    kept = rows.select("conv", "parts", *(["begin", "end", "whole"] if stretch else []))
    found = kept.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, cuts array<struct<{','.join(entry)}>>").select("conv", F.explode("cuts").alias("cut"))
    return found.select("conv", *(["cut.at"] if named else []), F.col("cut.n").cast("int").alias("n") if named else F.col("cut.n").alias("no"), "cut.begin", "cut.end", "cut.last")


def texts(done: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """conversation, block, text: the repaired conversations of ``format_chats`` as texts, a row for each block. A conversation is its
    blocks in order, joined by nothing; a block has a bounded number of turns. The null conversation is one like any other, null
    texts are empty pieces, and an empty table gives an empty table."""
    parts = done.groupBy(conversation, "block").agg(F.sort_array(F.collect_list(F.struct("position", "rendered"))).alias("x"))
    return parts.select(conversation, "block", F.array_join("x.rendered", "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
