"""Exact vector similarity: top-k search, threshold join, threshold counts.

A table of vectors is compared with another one panel by panel. A task holds one shelf of panels of the
left side (both bounded in bytes) and streams right-hand rows past them in Arrow batches, so a pair
of vectors exists only as one number in a small numpy tile. Four placements of one kernel:

* broadcast_right: the right side is small (checked); left rows come out complete. They stay where they are
  unless a task would compare more than ``TASK_PAIRS``: then they are dealt out;
* broadcast_left: the left side is small (checked); the right side stays where it is and partial
  results are merged;
* stream: a task holds one panel of the left side and reads all blocks of the right side (``streamed``); left rows come
  out complete, both sides lie on disk once, and a task compares a bounded number of pairs;
* grid: left shelves x right lanes, both sides replicated along the other axis, one cell per task. A
  right-hand row is sent once a shelf, however small the panels are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.operators import streamed

BROADCAST_BYTES = 64 << 20
PANEL_BYTES = 64 << 20
SHELF_BYTES = 64 << 20  # of the panels that a task of the grid holds together, at least one
TILE_ROWS = 2048
TILE_COLS = 512
DIGITS = 9  # scores equal to this many digits rank by id; thresholds and results use the raw score
METRICS = ("cosine", "dot", "euclidean")
CELLS = 1 << 16  # pairs whose difference is formed at a time
HEAVY, HEAVY_ROWS = 0.1, 64  # the share of the rows, and the rows, from which a term is a column of a matrix
NO_ID = np.iinfo(np.int64).max


# --------------------------------------------------------------------------- arrow <-> numpy


class Sparse:
    """Rows of sparse vectors: ``starts`` (one more than rows), sorted or not, ``idx`` and ``val``."""

    def __init__(self, starts: np.ndarray, idx: np.ndarray, val: np.ndarray, dim: int):
        self.starts, self.idx, self.val, self.dim = starts, idx, val, dim
        self._postings: tuple | None = None
        self._parts: dict[tuple[int, int], Sparse] = {}

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, rows) -> Sparse:
        if not isinstance(rows, slice):  # an order of rows
            sizes = np.diff(self.starts)[rows]
            ends = np.cumsum(sizes)
            at = np.repeat(self.starts[:-1][rows] - (ends - sizes), sizes) + np.arange(sizes.sum())
            return Sparse(np.concatenate([[0], ends]), self.idx[at], self.val[at], self.dim)
        part = self._parts.get((rows.start, rows.stop))
        if part is None:
            lo, hi = self.starts[rows.start], self.starts[rows.stop]
            part = Sparse(self.starts[rows.start : rows.stop + 1] - lo, self.idx[lo:hi], self.val[lo:hi], self.dim)
            self._parts[rows.start, rows.stop] = part  # the same tiles meet every batch
        return part

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def squares(self) -> np.ndarray:
        return np.bincount(self.rows(), self.val**2, len(self))

    def _columns(self, place: np.ndarray, width: int) -> np.ndarray:
        """The terms that have a place, as a matrix."""
        at = place[self.idx]
        kept = at >= 0
        cells = self.rows()[kept] * width + at[kept]
        return np.bincount(cells, self.val[kept], len(self) * width).reshape(len(self), width)

    def dots(self, right: Sparse) -> np.ndarray:
        """Inner products. Terms that many rows have are columns of a matrix; for the others work is done only where both
        rows have them."""
        if self._postings is None:
            times = np.bincount(self.idx, minlength=self.dim)
            heavy = np.flatnonzero(times >= max(HEAVY_ROWS, HEAVY * len(self)))
            place = np.full(self.dim, -1)
            place[heavy] = np.arange(len(heavy))
            light = np.flatnonzero(place[self.idx] < 0)
            order = light[np.argsort(self.idx[light], kind="stable")]
            first = np.searchsorted(self.idx[order], np.arange(self.dim + 1))
            self._postings = first, self.rows()[order], self.val[order], place, self._columns(place, len(heavy))
        first, rows, values, place, columns = self._postings
        if columns.shape[1]:
            out = (columns @ right._columns(place, columns.shape[1]).T).ravel()
        else:
            out = np.zeros(len(self) * len(right))
        owners = right.rows()
        counts = first[right.idx + 1] - first[right.idx]
        ends = np.cumsum(counts)
        start = 0
        while start < len(ends):  # a bounded number of meetings at a time
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 20), side="right")))
            part = slice(start, stop)
            times = counts[part]
            at = np.repeat(first[right.idx[part]] - (ends[part] - times - base), times) + np.arange(times.sum())
            cells = rows[at] * len(right) + np.repeat(owners[part], times)
            out += np.bincount(cells, values[at] * np.repeat(right.val[part], times), len(out))
            start = stop
        return out.reshape(len(self), len(right))


def _no_rows(dim: int, sparse: bool):
    if not sparse:
        return np.empty((0, dim))
    return Sparse(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), dim)


def _joined(parts: list):
    if not isinstance(parts[0], Sparse):
        return np.concatenate(parts)
    sizes = np.concatenate([np.diff(p.starts) for p in parts])
    return Sparse(
        np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.idx for p in parts]),
        np.concatenate([p.val for p in parts]), parts[0].dim,
    )


def _vectors(batch: pa.RecordBatch, dim: int):
    """Vectors of a batch: a float64 matrix from ``vec``, sparse rows from ``idx`` and ``val``.

    Raises for a vector of another length than ``dim`` and for null or non-finite entries.
    """

    def refuse(bad: np.ndarray, what: str) -> None:
        if bad.any():
            raise ValueError(f"vector of id {_column(batch, 'id')[np.argmax(bad)]} {what}")

    def broken(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        values = np.asarray(lists.flatten(), dtype=np.float64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        refuse(np.bincount(rows[~np.isfinite(values)], minlength=len(sizes)) > 0, "has null or non-finite entries")
        return sizes, values, rows

    if "vec" in batch.schema.names:
        sizes, values, _ = broken(batch.column(batch.schema.get_field_index("vec")))
        refuse(sizes != dim, f"is not {dim} long")
        return values.reshape(batch.num_rows, dim)
    sizes, places, rows = broken(batch.column(batch.schema.get_field_index("idx")))
    lengths, values, _ = broken(batch.column(batch.schema.get_field_index("val")))
    refuse(sizes != lengths, "has not as many values as indices")
    outside = (places < 0) | (places >= dim)
    refuse(np.bincount(rows[outside], minlength=len(sizes)) > 0, f"has an index outside 0..{dim - 1}")
    return Sparse(np.concatenate([[0], np.cumsum(sizes)]), places.astype(np.int64), values, dim)


def _squares(matrix) -> np.ndarray:
    return matrix.squares() if isinstance(matrix, Sparse) else np.einsum("ij,ij->i", matrix, matrix)


def _prepare(matrix, metric: str):
    if metric != "cosine":
        return matrix
    norms = np.sqrt(_squares(matrix))
    norms[norms == 0.0] = 1.0  # a zero vector keeps similarity 0 to everything
    if isinstance(matrix, Sparse):
        return Sparse(matrix.starts, matrix.idx, matrix.val / norms[matrix.rows()], matrix.dim)
    return matrix / norms[:, None]


def _scores(left, right, metric: str, least) -> np.ndarray:
    """Scores of all pairs; those that may reach ``least`` (a number or one per left row) are exact.

    Distances come from inner products first. Their error has a bound, and pairs that may be near
    enough are computed again from differences, so that equal vectors are 0 apart.
    """
    dots = left.dots(right) if isinstance(left, Sparse) else left @ right.T
    if metric != "euclidean":
        return dots
    size = _squares(left)[:, None] + _squares(right)[None, :]
    square = size - 2.0 * dots
    dim = left.dim if isinstance(left, Sparse) else left.shape[1]
    slack = size * (4 * (dim + 4) * np.finfo(float).eps)
    scores = -np.sqrt(np.maximum(square, 0.0))
    maybe = -np.sqrt(np.maximum(square - slack, 0.0)) >= np.asarray(least).reshape(-1, 1)
    rows, cols = np.nonzero(maybe)
    for part in _tiles(len(rows), max(1, CELLS // max(1, dim // 16))):
        scores[rows[part], cols[part]] = -_distances(left, right, rows[part], cols[part])
    return scores


def _distances(left, right, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    if not isinstance(left, Sparse):
        gaps = left[rows] - right[cols]
        return np.sqrt(np.einsum("ij,ij->i", gaps, gaps))
    out = np.empty(len(rows))
    for i, (r, c) in enumerate(zip(rows, cols)):
        gaps = np.zeros(left.dim)
        gaps[left.idx[left.starts[r] : left.starts[r + 1]]] += left.val[left.starts[r] : left.starts[r + 1]]
        gaps[right.idx[right.starts[c] : right.starts[c + 1]]] -= right.val[right.starts[c] : right.starts[c + 1]]
        out[i] = np.sqrt(gaps @ gaps)
    return out


def _tiles(n: int, width: int) -> Iterator[slice]:
    for start in range(0, n, width):
        yield slice(start, min(n, start + width))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)))


# --------------------------------------------------------------------------- kernels
# A kernel is created for one left panel, sees right batches in any order, and yields record batches.


class TopK:
    """Best ``k`` right rows of each left row; scores equal to ``DIGITS`` digits go to the smaller id."""

    def __init__(self, ids: np.ndarray, left, metric: str, k: int, drop_self: bool):
        self.ids, self.left, self.metric, self.k = ids, left, metric, k
        self.keys = np.full((len(ids), k), -np.inf)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), NO_ID)
        self.floor = np.full(len(ids), -np.inf)  # least rounded score of a row that counts
        self.drop_self = drop_self
        if drop_self:
            self.by_id = np.argsort(ids, kind="stable")
            self.sorted_ids = ids[self.by_id]

    def feed(self, batch: pa.RecordBatch, right):
        ids = _column(batch, "id")
        for cols in _tiles(len(ids), TILE_COLS):
            right_ids = ids[cols]
            own_col = own_row = np.empty(0, dtype=np.int64)
            if self.drop_self and len(self.ids):
                at = np.searchsorted(self.sorted_ids, right_ids)
                at[at == len(self.sorted_ids)] = 0
                own_col = np.nonzero(self.sorted_ids[at] == right_ids)[0]
                own_row = self.by_id[at[own_col]]
            for rows in _tiles(len(self.ids), TILE_ROWS):
                s = _scores(self.left[rows], right[cols], self.metric, self.keys[rows, -1] - 10.0**-DIGITS)
                mine = (own_row >= rows.start) & (own_row < rows.stop)
                s[own_row[mine] - rows.start, own_col[mine]] = -np.inf
                self._merge(rows, s, right_ids)
        return ()

    def _merge(self, rows: slice, s: np.ndarray, right_ids: np.ndarray) -> None:
        self.merge(np.arange(rows.start, rows.stop), s, right_ids)

    def merge(self, rows: np.ndarray, s: np.ndarray, right_ids: np.ndarray, allowed: Callable | None = None) -> None:
        """Scores ``s`` of left ``rows`` and right rows; ``allowed(r, c)`` marks pairs, by place in ``s``, that count.
        Only scores that may be among the best are rounded."""
        last, floor = self.keys[rows, -1], self.floor[rows]
        least = np.maximum(last, floor) - 10.0**-DIGITS
        hit = s >= least[:, None]
        if not np.isfinite(least).all():
            hit &= s > -np.inf
        hit_row, hit_col = np.nonzero(hit)
        scores = s[hit_row, hit_col]
        keys = np.round(scores, DIGITS)
        level, found = last[hit_row], self.found[rows, -1][hit_row]
        better = ((keys > level) | ((keys == level) & (right_ids[hit_col] < found))) & (keys >= floor[hit_row])
        hit_row, hit_col, scores, keys = (x[better] for x in (hit_row, hit_col, scores, keys))
        if allowed is not None:
            kept = allowed(hit_row, hit_col)
            hit_row, hit_col, scores, keys = (x[kept] for x in (hit_row, hit_col, scores, keys))
        if not len(hit_row):
            return
        touched = np.unique(hit_row)
        k = self.k
        row = np.concatenate([np.repeat(touched, k), hit_row])
        at = rows[touched]
        key, score, ids = (
            np.concatenate([old[at].ravel(), new])
            for old, new in ((self.keys, keys), (self.scores, scores), (self.found, right_ids[hit_col]))
        )
        order = np.lexsort((ids, -key, row))
        start = np.searchsorted(row[order], touched)
        take = order[start[:, None] + np.arange(k)[None, :]]
        self.keys[at], self.scores[at], self.found[at] = key[take], score[take], ids[take]

    def finish(self):
        filled = self.found != NO_ID
        row, col = np.nonzero(filled)
        for part in _tiles(len(row), 100_000):
            r, c = row[part], col[part]
            yield pa.record_batch(
                {
                    "query_id": self.ids[r],
                    "rank": (c + 1).astype(np.int32),
                    "neighbour_id": self.found[r, c],
                    "sim": self.scores[r, c],
                    "key": self.keys[r, c],
                }
            )


class Pairs:
    """Every pair at or above the threshold; the pairs leave tile by tile."""

    def __init__(self, ids: np.ndarray, left: np.ndarray, metric: str, threshold: float):
        self.ids, self.left, self.metric, self.threshold = ids, left, metric, threshold

    def feed(self, batch: pa.RecordBatch, right: np.ndarray):
        ids = _column(batch, "id")
        for cols in _tiles(len(ids), TILE_COLS):
            for rows in _tiles(len(self.ids), TILE_ROWS):
                s = _scores(self.left[rows], right[cols], self.metric, self.threshold)
                r, c = np.nonzero(s >= self.threshold)
                if len(r):
                    yield pa.record_batch(
                        {
                            "left_id": self.ids[rows][r],
                            "right_id": ids[cols][c],
                            "sim": s[r, c],
                        }
                    )

    def finish(self):
        return ()


class Counts:
    """Number of right rows at or above the threshold, one row per left row."""

    def __init__(self, ids: np.ndarray, left: np.ndarray, metric: str, threshold: float):
        self.ids, self.left, self.metric, self.threshold = ids, left, metric, threshold
        self.count = np.zeros(len(ids), dtype=np.int64)

    def feed(self, batch: pa.RecordBatch, right: np.ndarray):
        for cols in _tiles(len(right), TILE_COLS):
            for rows in _tiles(len(self.ids), TILE_ROWS):
                s = _scores(self.left[rows], right[cols], self.metric, self.threshold)
                self.count[rows] += (s >= self.threshold).sum(axis=1)
        return ()

    def finish(self):
        yield pa.record_batch({"id": self.ids, "members": self.count})


class Leader:
    """Of the right rows at or above the threshold: largest ``weight``, then smallest ``leader``."""

    def __init__(self, ids: np.ndarray, left: np.ndarray, metric: str, threshold: float):
        self.ids, self.left, self.metric, self.threshold = ids, left, metric, threshold
        self.weight = np.full(len(ids), -1, dtype=np.int64)
        self.leader = np.full(len(ids), NO_ID)

    def feed(self, batch: pa.RecordBatch, right: np.ndarray):
        weights, leaders = _column(batch, "weight"), _column(batch, "leader")
        for cols in _tiles(len(right), TILE_COLS):
            for rows in _tiles(len(self.ids), TILE_ROWS):
                near = _scores(self.left[rows], right[cols], self.metric, self.threshold) >= self.threshold
                w = np.where(near, weights[cols][None, :], -1)
                top = w.max(axis=1)
                who = np.where(near & (w == top[:, None]), leaders[cols][None, :], NO_ID).min(axis=1)
                better = (top > self.weight[rows]) | (
                    (top == self.weight[rows]) & (who < self.leader[rows])
                )
                self.weight[rows] = np.where(better, top, self.weight[rows])
                self.leader[rows] = np.where(better, who, self.leader[rows])
        return ()

    def finish(self):
        known = self.leader != NO_ID
        yield pa.record_batch(
            {"id": self.ids[known], "weight": self.weight[known], "leader": self.leader[known]}
        )


# --------------------------------------------------------------------------- placement


def _vector_columns(df: DataFrame) -> list[str]:
    return ["vec"] if "vec" in df.columns else ["idx", "val"]


def _bytes(df: DataFrame, dim: int, rows: int | None) -> int:
    """Memory of the vectors: 8 bytes a component, or 24 bytes a stored entry of sparse ones."""
    if "vec" in df.columns:
        return (df.count() if rows is None else rows) * 8 * max(dim, 1)
    return df.agg(F.coalesce(F.sum(F.size("idx") * 24 + 24), F.lit(0)).alias("n")).first()["n"]


def dimension(df: DataFrame) -> int:
    """Length of the vectors, from one row that has one."""
    if "vec" not in df.columns:
        raise ValueError("sparse vectors need an explicit dim")
    first = df.where("vec IS NOT NULL").select(F.size("vec").alias("n")).first()
    return first["n"] if first else 0


def _grid_task(batches, make, metric: str, dim: int):
    """One cell after another: side 0 fills the panels of the shelf, side 1 streams past them."""
    cell, kernels, ids, panels, sparse = None, None, {}, {}, False

    def start():
        if not panels:
            return [make(np.empty(0, dtype=np.int64), _no_rows(dim, sparse), metric)]
        return [make(np.concatenate(ids[x]), _prepare(_joined(panels.pop(x)), metric), metric) for x in sorted(panels)]

    for batch in batches:
        cells, sides, numbers = (_column(batch, x) for x in ("cell", "side", "panel"))
        sparse = "vec" not in batch.schema.names
        change = np.nonzero((np.diff(cells) != 0) | (np.diff(sides) != 0) | (np.diff(numbers) != 0))[0] + 1
        for lo, hi in zip([0, *change], [*change, batch.num_rows]):
            if lo == hi:
                continue
            piece = batch.slice(lo, hi - lo)
            if cells[lo] != cell:
                for kernel in kernels or ():
                    yield from kernel.finish()
                cell, kernels, ids, panels = cells[lo], None, {}, {}
            if sides[lo] == 0:
                ids.setdefault(numbers[lo], []).append(_column(piece, "id"))
                panels.setdefault(numbers[lo], []).append(_vectors(piece, dim))
                continue
            if kernels is None:
                kernels = start()
            for part in _tiles(piece.num_rows, TILE_COLS):
                rows = piece.slice(part.start, part.stop - part.start)
                right = _prepare(_vectors(rows, dim), metric)
                for kernel in kernels:
                    yield from kernel.feed(rows, right)
    for kernel in kernels or ():
        yield from kernel.finish()


def _partial_task(batches, make, metric: str, dim: int, shared):
    ids, left = shared.value
    kernel = make(ids, left, metric)
    for batch in batches:
        for part in _tiles(batch.num_rows, TILE_COLS):
            rows = batch.slice(part.start, part.stop - part.start)
            yield from kernel.feed(rows, _prepare(_vectors(rows, dim), metric))
    yield from kernel.finish()


class _Panel:
    """A kernel made of the rows of a panel; null columns of the left side are not sent."""

    def __init__(self, batch: pa.RecordBatch, make, metric: str, dim: int):
        self.metric, self.dim = metric, dim
        self.kernel = make(_column(batch, "id").astype(np.int64), _prepare(_vectors(batch, dim), metric), metric)

    def feed(self, batch: pa.RecordBatch):
        for part in _tiles(batch.num_rows, TILE_COLS):
            rows = batch.slice(part.start, part.stop - part.start)
            yield from self.kernel.feed(rows, _prepare(_vectors(rows, self.dim), self.metric))

    def finish(self):
        yield from self.kernel.finish()


def _task_pairs(vec: list[str]) -> int:
    return streamed.TASK_PAIRS if vec == ["vec"] else streamed.SPARSE_PAIRS


def _compare(
    left: DataFrame,
    right: DataFrame,
    make: Callable,
    schema: T.StructType,
    metric: str,
    method: str,
    dim: int | None,
    panel_bytes: int,
    broadcast_bytes: int,
    lanes: int | None,
    left_rows: int | None = None,
    right_rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """Run a kernel over all panels. The flag says whether a left row may appear repeatedly."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    spark = left.sparkSession
    vec = _vector_columns(left)
    left, right = (side.where(" AND ".join(f"{c} IS NOT NULL" for c in ["id", *vec])) for side in (left, right))
    extra = [c for c in ("weight", "leader") if c in right.columns]
    dim = dim or dimension(left) or dimension(right)
    if method in ("auto", "broadcast_right"):
        right_bytes = _bytes(right, dim, right_rows)
        if right_bytes <= broadcast_bytes:
            if right_bytes > broadcast_bytes // 16:  # less than that is little work for any left row
                pairs = (right.count() if right_rows is None else right_rows) * (left.count() if left_rows is None else left_rows)
                if pairs > _task_pairs(vec):
                    left = left.repartition(streamed.panels_of(0, pairs, spark, task_pairs=_task_pairs(vec)))
            shared = _broadcast_stream(right.select("id", *vec, *extra), metric, dim)
            task = partial(_complete_task, make=make, metric=metric, dim=dim, shared=shared)
            return left.select("id", *vec).mapInArrow(task, schema), False
        if method == "broadcast_right":
            raise ValueError(f"right side holds more than {broadcast_bytes} bytes")
    left_bytes = _bytes(left, dim, left_rows)
    if method == "auto":
        method = "broadcast_left" if left_bytes <= broadcast_bytes else "stream"
    if method == "broadcast_left":
        if left_bytes > broadcast_bytes:
            raise ValueError(f"left side holds more than {broadcast_bytes} bytes")
        shared = _broadcast_panel(left.select("id", *vec), metric, dim)
        stream = right.select("id", *vec, *extra)
        task = partial(_partial_task, make=make, metric=metric, dim=dim, shared=shared)
        return stream.mapInArrow(task, schema), True
    if method == "stream":
        pairs = (left.count() if left_rows is None else left_rows) * (right.count() if right_rows is None else right_rows)
        held = min(panel_bytes, streamed.HELD_BYTES)
        panels = streamed.panels_of(left_bytes, pairs, spark, held, _task_pairs(vec))
        dealt = streamed.panel_blocks(left.select("id", *vec).repartition(panels, "id"), held)
        blocks = streamed.written_blocks(right.select("id", *vec, *extra))
        start = partial(_Panel, make=make, metric=metric, dim=dim)
        return streamed.meet(dealt, blocks, start, schema, lanes or 1), (lanes or 1) > 1
    if method != "grid":
        raise ValueError(f"unknown method {method!r}")

    panels = max(1, math.ceil(left_bytes / panel_bytes))
    shelves, lanes = _shape(panels, panel_bytes, lanes, 3 * spark.sparkContext.defaultParallelism)
    bucket = F.xxhash64("id")
    nulls = [F.lit(None).cast("bigint").alias(c) for c in extra]
    panel = F.pmod(bucket, F.lit(panels))
    side0 = left.select(
        "id", *vec, *nulls, panel.alias("panel"), F.pmod(panel, F.lit(shelves)).alias("shelf"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("side"),
    )
    side1 = right.select(
        "id", *vec, *extra, F.lit(0).cast("bigint").alias("panel"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shelves - 1).cast("bigint"))).alias("shelf"),
        F.pmod(bucket, F.lit(lanes)).alias("lane"), F.lit(1).alias("side"),
    )
    cell = (F.col("shelf") * F.lit(lanes) + F.col("lane")).cast("int").alias("cell")
    columns = ["id", *vec, *extra, cell, "side", "panel"]
    cells = (
        side0.select(*columns)
        .unionByName(side1.select(*columns))
        .repartitionById(shelves * lanes, F.col("cell"))
        .sortWithinPartitions("cell", "side", "panel")
    )
    task = partial(_grid_task, make=make, metric=metric, dim=dim)
    return cells.mapInArrow(task, schema), lanes > 1


def _shape(panels: int, panel_bytes: int, lanes: int | None, tasks: int) -> tuple[int, int]:
    """Shelves and lanes of the grid: shelves of at most ``SHELF_BYTES``, or a panel, and about ``tasks`` cells. The
    copies of both sides are fewest where shelves and lanes are equally many."""
    shelves = math.ceil(panels / max(1, SHELF_BYTES // panel_bytes))
    if lanes is None:
        shelves = max(shelves, min(panels, math.isqrt(tasks)))
        lanes = max(1, math.ceil(tasks / shelves))
    return shelves, lanes


def _complete_task(batches, make, metric: str, dim: int, shared):
    """Each batch of left rows meets the whole right side and leaves with final results."""
    right_columns, right = shared.value
    for batch in batches:
        for part in _tiles(batch.num_rows, TILE_ROWS):
            rows = batch.slice(part.start, part.stop - part.start)
            kernel = make(_column(rows, "id"), _prepare(_vectors(rows, dim), metric), metric)
            yield from kernel.feed(right_columns, right)
            yield from kernel.finish()


def _collected(df: DataFrame, dim: int) -> tuple[pa.Table, np.ndarray]:
    # only reached after the size check against broadcast_bytes
    table = df.toArrow().combine_chunks()
    parts = [_vectors(b, dim) for b in table.to_batches()]
    return table, _joined(parts) if parts else _no_rows(dim, "vec" not in df.columns)


def _broadcast_panel(left: DataFrame, metric: str, dim: int):
    table, matrix = _collected(left, dim)
    ids = table.column("id").to_numpy().astype(np.int64)
    return left.sparkSession.sparkContext.broadcast((ids, _prepare(matrix, metric)))


def _broadcast_stream(right: DataFrame, metric: str, dim: int):
    table, matrix = _collected(right, dim)
    numbers = table.select([c for c in table.column_names if c in ("id", "weight", "leader")])
    order = np.argsort(numbers.column("id").to_numpy(), kind="stable")
    columns = pa.record_batch(
        {c: numbers.column(c).to_numpy()[order] for c in numbers.column_names}
    )
    return right.sparkSession.sparkContext.broadcast((columns, _prepare(matrix[order], metric)))


_LONG, _DOUBLE = T.LongType(), T.DoubleType()
_TOPK = T.StructType(
    [
        T.StructField("query_id", _LONG),
        T.StructField("rank", T.IntegerType()),
        T.StructField("neighbour_id", _LONG),
        T.StructField("sim", _DOUBLE),
        T.StructField("key", _DOUBLE),
    ]
)
_PAIRS = T.StructType(
    [T.StructField("left_id", _LONG), T.StructField("right_id", _LONG), T.StructField("sim", _DOUBLE)]
)
_COUNTS = T.StructType([T.StructField("id", _LONG), T.StructField("members", _LONG)])
_LEADER = T.StructType(
    [T.StructField("id", _LONG), T.StructField("weight", _LONG), T.StructField("leader", _LONG)]
)


# --------------------------------------------------------------------------- public operators


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 50,
    *,
    exclude: str = "none",
    metric: str = "cosine",
    min_sim: float | None = None,
    method: str = "auto",
    dim: int | None = None,
    panel_bytes: int = PANEL_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    lanes: int | None = None,
) -> DataFrame:
    """Exact nearest neighbours: ``(query_id, rank, neighbour_id, sim)``, rank from 1.

    Both inputs are ``(id, vec)`` tables (or ``(id, idx, val)`` with ``dim``), unique by id. Rows with a
    null id or vector take no part; vectors of different lengths and null or non-finite entries raise.
    ``exclude`` is ``none``, ``self`` (drop the query's own id) or ``top1`` (drop the best hit,
    whatever it is). Scores equal to nine digits rank by id; ``sim`` and ``min_sim`` are not rounded.
    """
    if exclude not in ("none", "self", "top1"):
        raise ValueError(f"unknown exclude mode {exclude!r}")
    skip = 1 if exclude == "top1" else 0
    make = partial(_make_topk, k=k + skip, drop_self=exclude == "self")
    hits, repeated = _compare(
        queries, corpus, make, _TOPK, metric, method, dim, panel_bytes, broadcast_bytes, lanes
    )
    ranked = hits
    if repeated:
        order = W.partitionBy("query_id").orderBy(F.desc("key"), "neighbour_id")
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(
            F.col("rank") <= k + skip
        )
    if skip:
        ranked = ranked.where(F.col("rank") > skip)
    if min_sim is not None:
        ranked = ranked.where(F.col("sim") >= min_sim)
    return ranked.select("query_id", (F.col("rank") - skip).alias("rank"), "neighbour_id", "sim")


def _make_topk(ids, left, metric, k, drop_self):
    return TopK(ids, left, metric, k, drop_self)


def threshold_join(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    metric: str = "cosine",
    method: str = "auto",
    dim: int | None = None,
    panel_bytes: int = PANEL_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    lanes: int | None = None,
) -> DataFrame:
    """All pairs with similarity at or above ``threshold``: ``(left_id, right_id, sim)``.

    The result is as large as the number of such pairs; where sizes or best partners are enough,
    ``threshold_counts`` and ``leaders`` return one row per left row.
    """
    return _compare(
        left, right, partial(_make, Pairs, threshold), _PAIRS, metric, method, dim,
        panel_bytes, broadcast_bytes, lanes,
    )[0]


def threshold_counts(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    metric: str = "cosine",
    method: str = "auto",
    dim: int | None = None,
    panel_bytes: int = PANEL_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    lanes: int | None = None,
    left_rows: int | None = None,
    right_rows: int | None = None,
) -> DataFrame:
    """How many right rows reach ``threshold`` for each left row, without making the pairs.

    Left rows without any partner are present with 0 as long as the right side is not empty.
    """
    counts, repeated = _compare(
        left, right, partial(_make, Counts, threshold), _COUNTS, metric, method, dim,
        panel_bytes, broadcast_bytes, lanes, left_rows, right_rows,
    )
    return counts.groupBy("id").agg(F.sum("members").alias("members")) if repeated else counts


def leaders(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    metric: str = "cosine",
    method: str = "auto",
    dim: int | None = None,
    panel_bytes: int = PANEL_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    lanes: int | None = None,
    left_rows: int | None = None,
    right_rows: int | None = None,
) -> DataFrame:
    """For each left row the heaviest right row within reach: ``(id, weight, leader)``.

    ``right`` carries ``weight`` and ``leader`` columns; equal weights go to the smaller leader.
    """
    found, repeated = _compare(
        left, right, partial(_make, Leader, threshold), _LEADER, metric, method, dim,
        panel_bytes, broadcast_bytes, lanes, left_rows, right_rows,
    )
    if not repeated:
        return found
    best = F.min_by(F.struct("weight", "leader"), F.struct(-F.col("weight"), "leader"))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def _make(kernel, threshold, ids, left, metric):
    return kernel(ids, left, metric, threshold)
