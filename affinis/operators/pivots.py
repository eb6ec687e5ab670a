"""Exact cosine search and threshold join that skip far groups: pivots and the triangle inequality of angles.

Every vector of the corpus belongs to the group of its nearest pivot, and a group knows the smallest and the
largest angle between its pivot and a member. With the angle *d* between a query and a pivot no member is
nearer to the query than ``max(d - largest, smallest - d)``, so a query visits only the groups
that can hold a partner. Results are the same as those of ``similarity.top_k`` and ``threshold_join``.

Groups lie on shelves of bounded bytes. For the nearest, a query is sent once to each shelf that holds a group it visits, marked
with these groups, and only the best of a shelf leave it. For the join nobody is sent: a task holds a shelf, or a panel of a
large group, reads all queries from a table of blocks and marks the groups that they visit (``streamed``).

Pivots come from a bounded sample, each the farthest from those before it. Their number is bounded by bytes,
as they and the angles of their groups are sent to every task; everything else is dealt by group.
Zero vectors are a group of their own, at similarity 0 to everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.operators import similarity as S
from affinis.operators import streamed
from affinis.operators.grouped import (
    HITS, LANE_ROWS, PAIRS, PANEL_BYTES, BestOf, PairsOf, Rows, best_by_query, compare_in_groups, lane_of, tasks_of,
)
from affinis.session import materialise, materialise_counted

PIVOT_BYTES = 16 << 20  # of all pivots
SAMPLE = 4  # vectors in the sample, for each pivot
SLACK = 1e-7  # of angles: their error where vectors are nearly parallel
_VEC = T.ArrayType(T.DoubleType())


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the unit vectors, each the one farthest from those taken before it."""
    taken, nearest = [0], sample @ sample[0]
    while len(taken) < min(count, len(sample)):
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-12:
            break  # only copies are left
        taken.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[taken]


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ pivots.T, -1.0, 1.0))


class _Marked:
    """Visitors meet the members of the groups they are marked for; ``firsts`` are the first groups of the shelves."""

    firsts: np.ndarray

    def on(self, firsts: np.ndarray) -> _Marked:
        self.firsts = firsts
        return self

    def meetings(self, panel: Rows, group, visitors: Rows, rows: slice) -> Iterator[tuple[np.ndarray, slice]]:
        if "starts" not in panel.extra:  # members by group, once a panel
            order = np.argsort(panel.extra["pivot"], kind="stable")
            panel.ids, panel.vectors = panel.ids[order], panel.vectors[order]
            found, starts = np.unique(panel.extra["pivot"][order], return_index=True)
            panel.extra = {"groups": found - self.firsts[group], "starts": np.append(starts, len(order))}
        marks = np.frombuffer(b"".join(visitors.extra["marks"][rows]), np.uint8).reshape(rows.stop - rows.start, -1)
        marks = np.unpackbits(marks, axis=1).astype(bool)
        starts = panel.extra["starts"]
        for place, lo, hi in zip(panel.extra["groups"], starts, starts[1:]):
            some = np.flatnonzero(marks[:, place])
            if len(some):
                for cols in S._tiles(hi - lo, S.TILE_ROWS):
                    yield some, slice(lo + cols.start, lo + cols.stop)


class _MarkedBest(_Marked, BestOf):
    pass


class _MarkedPairs(_Marked, PairsOf):
    pass


class _Shelf:
    """A panel of a shelf: the blocks of queries that pass it meet the groups of the shelf that they may have a partner in."""

    def __init__(self, batch: pa.RecordBatch, kernel: _MarkedPairs, shared, counts: np.ndarray, dim: int):
        self.kernel, self.dim, self.shelf = kernel, dim, S._column(batch, "shelf")[0]
        self.panel = Rows(batch, "cosine", dim, ["pivot"])
        first = kernel.firsts[self.shelf]
        self.places = slice(first, first + counts[self.shelf])
        self.pivots, self.sizes, self.low, self.high = shared.value

    def feed(self, batch: pa.RecordBatch):
        best = _best_by_group(S._prepare(S._vectors(batch, self.dim), "cosine"), self.pivots, self.low, self.high, self.places)[1]
        marked = (best >= self.kernel.threshold - 1e-12) & (self.sizes[self.places] > 0)
        some = np.flatnonzero(marked.any(axis=1))
        if len(some):
            visitors = Rows(batch.take(pa.array(some)), "cosine", self.dim, [])
            visitors.extra["marks"] = [x.tobytes() for x in np.packbits(marked[some], axis=1)]
            yield from self.kernel(self.panel, self.shelf, visitors)

    def finish(self):
        return ()


def _best_by_group(unit: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, places: slice) -> tuple[np.ndarray, np.ndarray]:
    """The angles of unit vectors and the pivots of some groups, and the highest similarity that a member of each can have; zero
    vectors, at a right angle to everything, are the last group."""
    own = pivots[places]
    angles = _angles(unit, own) if len(own) else np.zeros((len(unit), 0))
    gap = np.maximum(angles - high[places][: len(own)], low[places][: len(own)] - angles) - SLACK
    best = np.cos(np.clip(gap, 0.0, np.pi))
    if len(low[places]) > len(own):
        best = np.concatenate([best, np.zeros((len(unit), 1))], axis=1)
        angles = np.concatenate([angles, np.full((len(unit), 1), np.pi / 2)], axis=1)
    return angles, best


class PivotIndex:
    """A corpus ``(id, vec)``, unique by id, grouped by nearest pivot. Rows with a null id or vector take no part;
    vectors of different lengths and null or non-finite entries raise. ``compared`` counts the pairs that
    searches so far have compared, of ``rows`` × queries."""

    def __init__(
        self,
        corpus: DataFrame,
        pivots: int | None = None,
        pivot_bytes: int = PIVOT_BYTES,
        panel_bytes: int = PANEL_BYTES,
        lane_rows: int = LANE_ROWS,
    ):
        self.panel_bytes, self.lane_rows, self.compared = panel_bytes, lane_rows, 0
        self.session = corpus.sparkSession
        rows = corpus.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL")
        self.dim = S.dimension(rows)
        most = max(1, pivot_bytes // (8 * max(self.dim, 1)))
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * min(pivots or most, most)).select("id", "vec")
        self.rows = rows.count()
        count = min(most, pivots or max(1, round(2 * math.sqrt(self.rows))))
        table = drawn.limit(SAMPLE * count).toArrow().combine_chunks()  # bounded by ``pivot_bytes``
        parts = [S._prepare(S._vectors(b, self.dim), "cosine") for b in table.to_batches()]
        sample = np.concatenate(parts) if parts else np.empty((0, max(self.dim, 1)))
        sample = sample[np.einsum("ij,ij->i", sample, sample) > 0.5]
        self.pivots = spread_out(sample, count) if len(sample) else np.zeros((0, max(self.dim, 1)))
        self._group(rows)

    def _group(self, rows: DataFrame) -> None:
        pivots, dim = self.session.sparkContext.broadcast(self.pivots), self.dim
        schema = T.StructType(
            [T.StructField("id", T.LongType()), T.StructField("group", T.LongType()), T.StructField("angle", T.DoubleType())]
        ).add("vec", _VEC)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = S._vectors(batch, dim)
                unit = S._prepare(given, "cosine")
                zero = np.einsum("ij,ij->i", unit, unit) < 0.5
                if len(pivots.value):
                    angles = _angles(unit, pivots.value)
                    group = angles.argmin(axis=1)
                    angle = angles[np.arange(len(group)), group]
                else:
                    group, angle = np.zeros(len(unit), int), np.zeros(len(unit))
                group[zero], angle[zero] = len(pivots.value), 0.0
                columns = [
                    pa.array(S._column(batch, "id"), pa.int64()), pa.array(group, pa.int64()), pa.array(angle), _lists(given)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        typed = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(_VEC).alias("vec"))
        self.members = materialise(typed.mapInArrow(assign, schema), "pivot-groups")
        # a row per pivot
        found = self.members.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
        )
        size = len(self.pivots) + 1
        self.sizes, self.low, self.high = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        for r in found.collect():
            self.sizes[r["group"]], self.low[r["group"]], self.high[r["group"]] = r["n"], r["low"], r["high"]
        # groups one after another fill a shelf; one beyond its bytes has a shelf of its own, cut into panels
        held, tasks = self.sizes * 8 * max(self.dim, 1), tasks_of(self.session)
        most, firsts, full = min(self.panel_bytes, -(-int(held.sum()) // math.isqrt(tasks))), [0], 0
        for g, n in enumerate(held):
            if full and full + n > most:
                firsts.append(g)
                full = 0
            full += int(n)
        self.firsts = np.array(firsts)
        self.shelf_bytes = np.add.reduceat(held, self.firsts)

    def _visits(self, queries: DataFrame, choose) -> tuple[DataFrame, DataFrame]:
        """The shelves of the groups that ``choose(angles, best, batch)`` marks, as ``(group, id, vec, bound, pivot, marks)``, and
        their sizes.

        ``best`` is the highest similarity a member of each group can have. Visits are counted before
        vectors are copied, so that lanes are known.
        """
        shared = self.session.sparkContext.broadcast((self.pivots, self.sizes, self.low, self.high))
        dim, firsts = self.dim, self.firsts
        counts = np.diff(np.append(firsts, len(self.sizes)))

        def marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            pivots, sizes, low, high = shared.value
            given = S._vectors(batch, dim)
            angles, best = _best_by_group(S._prepare(given, "cosine"), pivots, low, high, slice(0, len(sizes)))
            return given, choose(angles, best, batch) & (sizes > 0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sent = np.zeros(len(shared.value[1]), np.int64), np.zeros(len(firsts), np.int64)
            for batch in batches:
                marked = marks(batch)[1]
                total += marked.sum(axis=0)
                sent += np.logical_or.reduceat(marked, firsts, axis=1).sum(axis=0)
            at, to = np.flatnonzero(total), np.flatnonzero(sent)
            # a shelf is numbered from -1 down
            yield pa.record_batch({"group": np.concatenate([at, -1 - to]), "visitors": np.concatenate([total[at], sent[to]])})

        schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("id", T.LongType())])
        schema = schema.add("vec", _VEC).add("bound", T.DoubleType()).add("pivot", T.LongType()).add("marks", T.BinaryType())
        width = np.arange(counts.max())

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in S._tiles(batch.num_rows, S.TILE_COLS):
                    rows = batch.slice(part.start, part.stop - part.start)
                    given, marked = marks(rows)
                    row, shelf = np.nonzero(np.logical_or.reduceat(marked, firsts, axis=1))
                    ids, bounds = S._column(rows, "id"), S._column(rows, "bound")
                    own = np.minimum(firsts[shelf][:, None] + width, marked.shape[1] - 1)
                    bits = np.packbits(marked[row[:, None], own] & (width < counts[shelf][:, None]), axis=1)
                    columns = [
                        pa.array(shelf, pa.int64()), pa.array(ids[row], pa.int64()), _lists(given[row]), pa.array(bounds[row]),
                        pa.array(np.full(len(row), -1)), pa.array([x.tobytes() for x in bits], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        # rows: at most one per group or shelf and task, then one per group or shelf
        counted = queries.mapInArrow(count, "group long, visitors long").groupBy("group").agg(F.sum("visitors").alias("visitors"))
        seen = {r["group"]: r["visitors"] for r in counted.collect()}
        self.compared += int(sum(n * int(self.sizes[g]) for g, n in seen.items() if g >= 0))
        listed = [(-1 - g, int(self.shelf_bytes[-1 - g]), n) for g, n in seen.items() if g < 0]
        self.sent = sum(x[2] for x in listed)
        sizes = self.session.createDataFrame(listed, "group long, bytes long, visitors long")
        return queries.mapInArrow(visit, schema), sizes

    def _compared(self, visitors: DataFrame, sizes: DataFrame, kernel, schema: T.StructType) -> DataFrame:
        ends = np.append(self.firsts, len(self.sizes))
        shelves = [(g, x) for x, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist())) for g in range(lo, hi)]
        placed = self.members.join(F.broadcast(self.session.createDataFrame(shelves, "group long, shelf long")), "group")
        members = placed.select(
            F.col("shelf").alias("group"), "id", "vec", F.lit(0.0).alias("bound"), F.col("group").alias("pivot"),
            F.lit(b"").alias("marks"),
        )
        lane = lane_of(self.sent, tasks_of(self.session), self.lane_rows)
        return compare_in_groups(
            members, visitors, kernel.on(self.firsts), schema, self.dim, sizes, panel_bytes=self.panel_bytes, lane_rows=lane
        )

    def _queries(self, queries: DataFrame, bound) -> DataFrame:
        rows = queries.where("id IS NOT NULL AND vec IS NOT NULL")
        return rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(_VEC).alias("vec"), bound.alias("bound"))

    def threshold_join(self, queries: DataFrame, threshold: float) -> DataFrame:
        """All pairs at or above ``threshold``: ``(left_id, right_id, sim)``; the corpus is the right side."""
        if not self.rows:
            return self.session.createDataFrame([], PAIRS)
        asked, before = self._queries(queries, F.lit(float(threshold))), self.compared
        self._visits(asked, lambda angles, best, batch: best >= threshold - 1e-12)  # counted only
        return self._met(asked.select("id", "vec"), _MarkedPairs(float(threshold)), self.compared - before)

    def _met(self, queries: DataFrame, kernel: _MarkedPairs, pairs: int) -> DataFrame:
        """Every query past every shelf; a shelf beyond ``panel_bytes`` is cut into panels."""
        panels = np.maximum(1, -(-self.shelf_bytes // self.panel_bytes))
        cells = np.concatenate([[0], np.cumsum(panels)])
        ends = np.append(self.firsts, len(self.sizes))
        places = [
            (g, x, int(cells[x]), int(panels[x])) for x, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist())) for g in range(lo, hi)
        ]
        table = F.broadcast(self.session.createDataFrame(places, "group long, shelf long, first long, panels long"))
        cell = (F.col("first") + F.pmod(F.xxhash64("id"), "panels")).cast("int")
        placed = self.members.join(table, "group").select(F.col("group").alias("pivot"), "shelf", cell.alias("cell"), "id", "vec")
        dealt = placed.repartitionById(int(cells[-1]), "cell").select("shelf", "pivot", "id", "vec").sortWithinPartitions("shelf")
        held = streamed.panel_blocks(dealt, 2 * self.panel_bytes)
        tasks = max(tasks_of(self.session), -(-pairs // streamed.TASK_PAIRS))
        lanes = -(-tasks // int(cells[-1]))
        shared = self.session.sparkContext.broadcast((self.pivots, self.sizes, self.low, self.high))
        start = partial(_Shelf, kernel=kernel.on(self.firsts), shared=shared, counts=np.diff(ends), dim=self.dim)
        return streamed.meet(held, streamed.written_blocks(queries.repartition(lanes, "id")), start, PAIRS, lanes)

    def top_k(self, queries: DataFrame, k: int = 50, *, exclude_self: bool = False) -> DataFrame:
        """``(query_id, rank, neighbour_id, sim)`` as ``similarity.top_k`` gives them; queries are unique by id.

        A query first visits its nearest groups until they have enough members; its k-th score there
        is a bound, and the second round visits only groups that can hold a better one.
        """
        if not self.rows:
            return self.session.createDataFrame([], "query_id long, rank int, neighbour_id long, sim double")
        enough, sizes = k + bool(exclude_self), self.sizes

        def nearest(angles: np.ndarray, best: np.ndarray, batch=None) -> np.ndarray:
            order = np.argsort(angles, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            first = np.concatenate([np.zeros((len(held), 1), np.int64), held[:, :-1]], axis=1) < enough
            out = np.empty(first.shape, bool)
            np.put_along_axis(out, order, first, axis=1)
            return out

        kernel = _MarkedBest(k, exclude_self)
        asked = self._queries(queries, F.lit(float("-inf")))
        visitors, planned = self._visits(asked, nearest)
        near = materialise(self._compared(visitors, planned, kernel, HITS), "pivot-near")
        last = best_by_query(near, k).groupBy("query_id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
        last = last.select("query_id", F.when(F.col("n") == k, F.col("key")).otherwise(float("-inf")).alias("bound"))
        again = queries.where("id IS NOT NULL AND vec IS NOT NULL").join(last, F.col("id") == F.col("query_id"), "left")
        again, _ = materialise_counted(self._queries(again, F.coalesce("bound", F.lit(float("-inf")))), "pivot-bounds")
        digit = 10.0**-S.DIGITS

        def maybe(angles: np.ndarray, best: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            return (best >= S._column(batch, "bound")[:, None] - digit) & ~nearest(angles, best)

        visitors, planned = self._visits(again, maybe)
        far = self._compared(visitors, planned, kernel, HITS)
        return best_by_query(near.unionByName(far), k).select("query_id", "rank", "neighbour_id", "sim")


def _lists(matrix: np.ndarray) -> pa.Array:
    starts = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(starts[: len(matrix) + 1]), pa.array(matrix.ravel()))
