"""Repair of conversations: the cheapest edits after which the roles read ``(s?(ua)+)?``.

Rows are kept, given another role or deleted, and empty turns inserted. All ways to do that are paths of a
lattice with a layer per row and four states (nothing written, after system, after user, after assistant),
whose arcs have whole costs. The cheapest path is found by the auction algorithm for shortest paths:

1. Every node has a price that never exceeds the cost of an arc plus the price of its end. A path grows from
   its origin along the cheapest arc; where the price of its last node is too low, the price is raised and
   the path contracted by that node. It ends at the destination, and then the origin's price is exact.
2. A conversation is worked off in windows of ``WINDOW`` rows from its end; a window's destination is
   reached at the exact prices of the window behind it, so that work grows with the rows.
3. Arcs whose cost is just the fall of the prices are tight, and cheapest paths have no others. Of these
   paths the one whose edits (``D`` delete, ``I`` insert, ``K`` keep, ``R`` rerole) come first in order is
   traced, from the smallest edit on, dead ends marked.

Rows are range-sorted by conversation and turn, so that a conversation of any size lies in many partitions,
and cut into pieces of at most ``PIECE`` rows. Pieces of one conversation send each other only the costs
between their border states (four by four) and the states in which they end.

Defined cases: null roles and texts are one space, null turns come first, a null conversation is one; rows of
one turn stand in the order of role and a hash of the text; equal rows are duplicates but for the first;
only roles that begin with s, u or a can be kept; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.session import materialise

WINDOW = 32  # rows whose prices are settled together
PIECE = 14  # a piece has 2 ** PIECE rows at most
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
_ROLES = "suax"  # x: no role that can be kept
FAULTS = ("none", "truncated", "blank", "duplicate")
CODES = "abcdefghijklmnop"  # a letter per fault and role
_NAMES = {"u": "user", "a": "assistant"}
Prices = tuple[int | None, ...]


# -- the lattice -------------------------------------------------------------------------------------


def _arcs(codes: str, closing: bool, layer: int, state: int) -> list[tuple[str, str, int, tuple[int, int]]]:
    """``(edit, initial written, cost, end)`` of the arcs of a node, in the order of the edits."""
    out = []
    follows, initial = (ASSISTANT, "a") if state == USER else (USER, "u")
    row = CODES.index(codes[layer]) if layer < len(codes) else None
    if row is not None:
        out.append(("D", "-", DELETE, (layer + 1, state)))
    if row is not None or closing:
        out.append(("I", initial, INSERT, (layer, follows)))
    if row is not None and row < 8:
        extra = TRUNCATED if row >= 4 else 0
        role = _ROLES[row % 4]
        if role == "s" and state == START:
            out.append(("K", "s", extra, (layer + 1, SYSTEM)))
        elif role == initial:
            out.append(("K", initial, extra, (layer + 1, follows)))
        out.append(("R", initial, REROLE + extra, (layer + 1, follows)))
    return out


class Lattice:
    """The window of some rows; ``exits``: what is still to pay from each state behind it, None: no way."""

    def __init__(self, codes: str, closing: bool, exits: Prices):
        last = len(codes)
        open_states = [q for q in range(4) if exits[q] is not None]
        self.arcs: dict[tuple[int, int], list] = {}  # of the nodes from which the destination can be reached
        for layer in range(last, -1, -1):
            given = [_arcs(codes, closing, layer, q) for q in range(4)]
            ways = {(layer, q) for q in open_states} if layer == last else set()
            for _ in range(4):  # inserts lead through states of the same layer
                ways |= {(layer, q) for q in range(4) if any(x[3] in ways or x[3] in self.arcs for x in given[q])}
            for node in ways:
                out = [("", "", exits[node[1]], None)] if layer == last and exits[node[1]] is not None else []
                self.arcs[node] = [x for x in given[node[1]] if x[3] in ways or x[3] in self.arcs] + out
        # the least exit is a lower bound everywhere, so no arc is cheaper than the fall of the prices
        self.prices: dict[tuple[int, int] | None, int] = dict.fromkeys(
            self.arcs, min((exits[q] for q in open_states), default=0)
        )
        self.prices[None] = 0  # the destination

    def auction(self, origin: tuple[int, int]) -> int | None:
        """The exact cost from ``origin`` to the destination; prices stay below all costs."""
        if origin not in self.arcs:
            return None
        prices, path = self.prices, [origin]
        while path[-1] is not None:
            node = path[-1]
            least, end = min(((cost + prices[end], end) for _, _, cost, end in self.arcs[node]), key=lambda x: x[0])
            if prices[node] < least:
                prices[node] = least  # the path contracts
                if len(path) > 1:
                    path.pop()
            else:
                path.append(end)
        return prices[origin]

    def first_path(self, origin: tuple[int, int]) -> list[tuple[str, str, int, tuple[int, int]]]:
        """The arcs of the cheapest path whose edits come first, after ``auction(origin)``."""
        prices = self.prices
        tight = lambda node: iter([x for x in self.arcs[node] if x[2] + prices[x[3]] == prices[node]])
        dead, path, open_arcs = set(), [], [(origin, tight(origin))]
        while open_arcs:
            node, arcs = open_arcs[-1]
            arc = next((x for x in arcs if x[3] not in dead), None)
            if arc is None:
                dead.add(node)
                open_arcs.pop()
                if path:
                    path.pop()
            elif arc[3] is None:
                return path
            else:
                path.append(arc)
                open_arcs.append((arc[3], tight(arc[3])))
        raise AssertionError("no tight path")


Traced = tuple[str, tuple[str, ...], int, int]  # edits; edits and initials of each row; cost; state behind


@lru_cache(maxsize=1 << 16)
def _window(codes: str, closing: bool, exits: Prices) -> tuple[Prices, tuple[Traced | None, ...]]:
    """Costs from each state before the rows, and what the first path from there does."""
    lattice = Lattice(codes, closing, exits)
    costs = tuple(lattice.auction((0, q)) for q in range(4))
    traced: list[Traced | None] = []
    for q in range(4):
        if costs[q] is None:
            traced.append(None)
            continue
        rows, edits, cost, state, before = [], [], 0, q, ""
        for edit, initial, price, (_, state) in lattice.first_path((0, q)):
            edits.append(edit)
            cost += price
            before += edit + initial
            if edit != "I":
                rows.append(before)
                before = ""
        if before:
            rows[-1:] = [rows[-1] + before] if rows else [before]  # inserted behind the last row
        traced.append(("".join(edits), tuple(rows), cost, state))
    return costs, tuple(traced)


def _settled(codes: str, closing: bool, exits: Prices) -> tuple[int, Prices, tuple[Traced | None, ...]]:
    """``_window`` for exits of any height: its costs are ``base`` more."""
    base = min((x for x in exits if x is not None), default=0)
    return base, *_window(codes, closing, tuple(None if x is None else x - base for x in exits))


def _windows(codes: str) -> list[str]:
    return [codes[i : i + WINDOW] for i in range(0, len(codes), WINDOW)]


END: Prices = tuple(0 if q in ACCEPTED else None for q in range(4))


def costs_before(codes: str, closing: bool, exits: Prices) -> list[Prices]:
    """Costs from each state before each window, and behind the last one."""
    out = [exits]
    parts = _windows(codes)
    for i, part in reversed(list(enumerate(parts))):
        base, costs, _ = _settled(part, closing and i == len(parts) - 1, out[-1])
        out.append(tuple(None if x is None else x + base for x in costs))
    return out[::-1]


def edits_from(codes: str, closing: bool, exits: Prices, states: range | list[int]) -> list[Traced | None]:
    """What the cheapest first path does from each of the states before the rows."""
    parts, costs = _windows(codes), costs_before(codes, closing, exits)
    out: list[Traced | None] = []
    for state in states:
        if costs[0][state] is None:
            out.append(None)
            continue
        edits, rows, cost = [], [], 0
        for i, part in enumerate(parts):
            found = _settled(part, closing and i == len(parts) - 1, costs[i + 1])[2][state]
            edits.append(found[0])
            rows += found[1]
            cost += found[2]
            state = found[3]
        out.append(("".join(edits), tuple(rows), cost, state))
    return out


# -- rows --------------------------------------------------------------------------------------------

_PLACED = ("conv", "turn", "role", "text")


def placed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows in order, as a table ``(conv, turn, role, text, at, ...)``; ``at`` rises with the order, its
    upper bits are the partition."""
    said = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    rows = rows.withColumns({"_said": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "_said", "_tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    first = F.substring("role", 1, 1)
    return materialise(
        rows.select(
            *_PLACED,
            F.monotonically_increasing_id().alias("at"),
            F.when(first.isin("s", "u", "a"), F.position(first, F.lit(_ROLES)) - 1).otherwise(3).alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
            F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
        ),
        "turns",
    )


def _piece(at: str = "at") -> Column:
    return F.shiftright(at, PIECE)


def pieces(rows: DataFrame) -> DataFrame:
    """``(conv, piece, start, codes, of, number, closing)``: the faults and roles of up to 2 ** ``PIECE`` rows of a
    conversation as letters; ``of`` is the first piece of the conversation, ``number`` how many it has."""
    again = rows.groupBy("conv", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv").alias("of"), F.col("same").alias("as"), "first")
    known = rows.select("conv", "at", "initial", "blank", "truncated", "same").join(
        again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("same") == F.col("as")), "left"
    )
    fault = F.when(F.col("blank"), 2).when(F.col("at") > F.col("first"), 3).when(F.col("truncated"), 1).otherwise(0)
    code = F.substring(F.lit(CODES), (fault * 4 + F.col("initial") + 1).cast("int"), F.lit(1))
    letters = F.array_sort(F.collect_list(F.struct("at", code.alias("code"))))
    whole = W.partitionBy("conv")
    return materialise(
        known.groupBy("conv", _piece().alias("piece"))
        .agg(F.min("at").alias("start"), letters.alias("letters"))
        .select(
            "conv",
            "piece",
            "start",
            F.array_join(F.col("letters.code"), "").alias("codes"),
            F.min("piece").over(whole).alias("of"),
            F.count(F.lit(1)).over(whole).alias("number"),
            (F.col("piece") == F.max("piece").over(whole)).alias("closing"),
        ),
        "turn-pieces",
    )


_EDITS = "struct<audit string, todo array<string>, cost long, state int>"


def _given(exits) -> Prices:
    return tuple(None if x < 0 else int(x) for x in exits)


def _sent(prices: Prices) -> list[int]:
    return [-1 if x is None else x for x in prices]


def _whole(codes: pd.Series) -> pd.DataFrame:
    """Edits of conversations of one piece."""
    return pd.DataFrame([edits_from(x, True, END, [START])[0] for x in codes], columns=["audit", "todo", "cost", "state"])


def _borders(codes: pd.Series, closing: pd.Series) -> pd.Series:
    """Costs from each state before a piece to each state behind it, or, of a last piece, to its end."""
    single = [tuple(0 if q == x else None for q in range(4)) for x in range(4)]
    return pd.Series(
        [[_sent(costs_before(x, last, y)[0]) for y in ([END] if last else single)] for x, last in zip(codes, closing, strict=True)]
    )


def _from_all(codes: pd.Series, closing: pd.Series, exits: pd.Series) -> pd.Series:
    names = ("audit", "todo", "cost", "state")
    return pd.Series(
        [
            [None if y is None else dict(zip(names, y, strict=True)) for y in edits_from(x, last, _given(to), range(4))]
            for x, last, to in zip(codes, closing, exits, strict=True)
        ]
    )


def _exits(frame: pd.DataFrame) -> pd.DataFrame:
    """What is to pay behind each piece of one conversation: four numbers a piece, from the last one on."""
    behind, out = END, []
    for row in frame.sort_values("piece", ascending=False).itertuples():
        out.append((row.of, row.piece, _sent(behind)))
        if row.closing:
            behind = _given(row.borders[0])
            continue
        ways = [_given(x) for x in row.borders]  # by the state behind the piece
        behind = tuple(
            min((ways[x][q] + behind[x] for x in range(4) if ways[x][q] is not None and behind[x] is not None), default=None)
            for q in range(4)
        )
    return pd.DataFrame(out, columns=["of", "piece", "exits"])


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    """The state before each piece of one conversation, from the first one on."""
    state, out = START, []
    for row in frame.sort_values("piece").itertuples():
        out.append((row.of, row.piece, state))
        state = int(row.states[state])
    return pd.DataFrame(out, columns=["of", "piece", "entry"])


def edits(cut: DataFrame) -> DataFrame:
    """``(conv, piece, start, audit, todo, cost)``: the edits of each piece; ``todo`` has, for each row, its
    edits with the initials they write, those of turns inserted before it (or behind the last) included."""
    whole = F.pandas_udf(_whole, _EDITS)
    short = cut.where("number = 1").withColumn("found", whole("codes"))
    long = cut.where("number > 1").select("conv", "piece", "start", "codes", "of", "closing")
    borders = F.pandas_udf(_borders, "array<array<long>>")
    exits = (
        long.select("of", "piece", "closing", borders("codes", "closing").alias("borders"))
        .groupBy("of")
        .applyInPandas(_exits, "of long, piece long, exits array<long>")
    )
    from_all = F.pandas_udf(_from_all, f"array<{_EDITS}>")
    ways = materialise(long.join(exits, ["of", "piece"]).withColumn("ways", from_all("codes", "closing", "exits")), "turn-ways")
    states = ways.select("of", "piece", F.transform("ways", lambda x: F.coalesce(x["state"], F.lit(-1))).alias("states"))
    entries = states.groupBy("of").applyInPandas(_entries, "of long, piece long, entry int")
    chosen = ways.join(entries, ["of", "piece"]).withColumn("found", F.get("ways", F.col("entry")))
    columns = ["conv", "piece", "start", "found.audit", "found.todo", "found.cost"]
    return materialise(short.select(*columns).unionByName(chosen.select(*columns)), "turn-edits")


# -- what comes out ----------------------------------------------------------------------------------


def report(rows: DataFrame, cut: DataFrame, done: DataFrame) -> DataFrame:
    """Per conversation ``gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    numbered = rows.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = numbered.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    roles = F.translate("codes", CODES, _ROLES * 4)
    earlier = F.lag(F.substring("roles", -1, 1)).over(W.partitionBy("conv").orderBy("piece"))
    bordered = cut.withColumn("roles", roles).withColumn("line", F.concat(F.coalesce(earlier, F.lit("")), "roles"))
    many = lambda i: F.sum(F.length(F.regexp_replace("codes", f"[^{CODES[4 * i:4 * i + 4]}]", ""))).alias(FAULTS[i])
    legal = F.regexp_count("line", F.lit("(?=su|ua|au)"))
    faults = bordered.groupBy("conv").agg(
        many(2), many(3), many(1), F.sum(F.length("line") - 1 - legal).cast("long").alias("illegal")
    )
    line = F.array_sort(F.collect_list(F.struct("piece", "audit")))
    audits = done.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(line["audit"], "").alias("audit"))
    named = lambda df, name: df.withColumnRenamed("conv", name)
    return (
        faults.join(named(audits, "c1"), F.col("conv").eqNullSafe(F.col("c1")))
        .join(named(gaps, "c2"), F.col("conv").eqNullSafe(F.col("c2")), "left")
        .select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    )


def _with_edits(rows: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Rows and, before the rows of each piece, its edits, dealt by ``by`` and sorted."""
    given = rows.select("conv", "at", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("array<string>").alias("todo"))
    heads = done.select(
        "conv", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), "todo"
    )
    both = given.unionByName(heads).withColumn("piece", _piece())
    return both.repartition(*by).sortWithinPartitions("conv", "at", "kind")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[Any, int, int, str, str, str]]]:
    """``(conv, at, part, edit, role, text)`` of every turn that comes out, a batch at a time."""
    todo: Iterator[str] = iter(())
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                todo = iter(row["todo"])
                continue
            pairs = next(todo)
            for part in range(len(pairs) // 2):
                edit, initial = pairs[2 * part : 2 * part + 2]
                if edit != "D":
                    role = row["role"] if edit == "K" else _NAMES[initial]
                    out.append((row["conv"], row["at"], part, edit, role, "" if edit == "I" else row["text"]))
        yield out


def repaired_turns(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The turns after all edits: ``(conv, at, part, edit, role, text)``, in the order of ``at, part``."""
    dealt = _with_edits(rows, done, ["conv", "piece"])
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    schema = T.StructType([dealt.schema["conv"]])
    for name, kind in (("at", "long"), ("part", "integer"), ("edit", "string"), ("role", "string"), ("text", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed(kept):
            for batch in kept:
                kind.append(batch.schema.field("conv").type)
                yield batch

        kind: list[pa.DataType] = []
        for out in _edited(typed(batches)):
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate([kind[0], *kinds])]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return dealt.select("conv", "at", "kind", "role", "text", "todo").mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)`` of the lines ``role:text`` of each conversation that has turns left.

    A SHA-256 cannot be split: a conversation is read by one task, as a sorted stream; memory holds one
    batch and the edits of one piece.
    """
    dealt = _with_edits(rows, done, ["conv"])
    schema = T.StructType([dealt.schema["conv"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: pa.DataType = pa.null()

        def typed(kept):
            nonlocal kind
            for batch in kept:
                kind = batch.schema.field("conv").type
                yield batch

        current: list = []
        for out in _edited(typed(batches)):
            found = []
            for conv, _, _, _, role, text in out:
                if current and current[0] == conv:
                    current[1].update(b"\n")
                else:
                    found += [current] if current else []
                    current = [conv, hashlib.sha256()]
                current[1].update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _digested(found, kind, schema.names)
        yield _digested([current] if current else [], kind, schema.names)

    return dealt.select("conv", "at", "kind", "role", "text", "todo").mapInArrow(run, schema)


def _digested(found: list, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array([c for c, _ in found], kind), pa.array([h.hexdigest() for _, h in found], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names)
