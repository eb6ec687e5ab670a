"""Approximate cosine search and threshold join: buckets by the sides of random hyperplanes.

A table cuts space by some hyperplanes; vectors on the same sides of all of them share a bucket. Two vectors at
angle *a* fall on the same side of a plane with probability ``1 - a / pi``, so the number of planes and of
tables follows from the similarity that is to be found and the recall that is wanted. Vectors of a bucket are
compared with exact scores; a bucket of any size is cut into panels and lanes (``grouped``), so near copies
that share every bucket are one bucket's tiles, never rows of pairs.

Where the similarity to be found is so low that tables are many and buckets large, a vector would be sent to more
tables than there are panels of all vectors, only to meet nearly as many others. Then every vector meets every panel once, and
pairs that share no bucket are dropped there: the same result from a few copies of a vector.

Where all vectors are more than one panel, panels are streamed past (``streamed``), and disk holds both sides once.

Scores are exact and no pair below the threshold is returned; what can be missing are pairs that share no bucket.
Zero vectors are in no bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.operators import similarity as S
from affinis.operators import streamed
from affinis.operators.grouped import (
    HITS, LANE_ROWS, PAIRS, PANEL_BYTES, BestMet, BestOf, Met, PairsOf, best_by_query, compare_in_groups, group_sizes, lane_of,
    tasks_of,
)
from affinis.session import materialise_counted

RECALL = 0.95
MOST_TABLES = 128
MOST_BITS = 24
SEED = 17
SLICES = 1 << 16  # of the left rows of a join, by a hash of the id
PAIRS_AT_ONCE = 1 << 25  # pairs of a join that are held against others together
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def choose_tables(similarity: float, recall: float = RECALL, rows: int = 1 << 20) -> tuple[int, int]:
    """Planes per table and tables that find a pair at ``similarity`` with at least the wanted probability.

    More planes make buckets smaller but need more tables. Of all that reach the recall with at most
    ``MOST_TABLES`` tables, those are taken with the least work: copies sent, and pairs compared
    if all ``rows`` were far from each other. One plane and enough tables always reach it for a
    similarity above -0.9; below that there is nothing to gain from buckets.
    """
    if not 0 < recall < 1 or not -0.9 <= similarity <= 1:
        raise ValueError("a recall between 0 and 1 and a similarity of at least -0.9 are needed")
    side = 1 - math.acos(min(1.0, similarity)) / math.pi
    best = None
    for bits in range(1, MOST_BITS + 1):
        share = side**bits
        tables = 1 if share >= recall else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if tables > MOST_TABLES:
            break
        work = tables * (1 + rows / 2**bits / 64)
        if best is None or work < best[0]:
            best = work, bits, tables
    if best is None:
        raise ValueError(f"{MOST_TABLES} tables do not reach a recall of {recall} at {similarity}")
    return best[1], best[2]


class FirstTable:
    """A pair belongs to the first table in which both are in one bucket."""

    def __call__(self, visitors, panel, group, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        kept = np.ones(len(r), bool)
        for part in S._tiles(len(r), S.CELLS):
            same = visitors.extra["codes"][r[part]] == panel.extra["codes"][c[part]]
            kept[part] = ~same.any(axis=1)
        return kept


class SharedBucket:
    """A pair that is in one bucket of any table."""

    def __call__(self, visitors, panel, group, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(r), bool)
        for part in S._tiles(len(r), S.CELLS):
            kept[part] = (visitors.extra["codes"][r[part]] == panel.extra["codes"][c[part]]).any(axis=1)
        return kept


class HyperplaneIndex:
    """``rows (id, vec)``, unique by id, in ``tables`` sets of buckets. Rows with a null id or vector take no part;
    vectors of different lengths and null or non-finite entries raise."""

    def __init__(self, rows: DataFrame, bits: int, tables: int, seed: int = SEED, **placement):
        if not 1 <= bits <= MOST_BITS or tables < 1:
            raise ValueError(f"1 to {MOST_BITS} planes and a table at least are needed")
        self.bits, self.tables, self.placement = bits, tables, placement
        given = rows.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL")
        self.dim = S.dimension(given)
        # of fixed size: bits * tables * dim
        self.planes = np.random.default_rng(seed).normal(size=(tables * bits, max(self.dim, 1)))
        self.rows, self.count = materialise_counted(self._coded(given), "plane-codes")
        self._all = self._blocks = None  # what is found out or written once

    def _coded(self, rows: DataFrame) -> DataFrame:
        planes, dim, tables, bits = self.planes, self.dim, self.tables, self.bits
        longs = T.ArrayType(T.LongType())
        vec = T.ArrayType(T.DoubleType())
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", vec), T.StructField("codes", longs)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = 1 << np.arange(bits)
            for batch in batches:
                given = S._vectors(batch, dim)
                kept = np.flatnonzero(S._squares(given) > 0)
                sides = (given[kept] @ planes.T > 0).reshape(len(kept), tables, bits)
                codes = (sides * weights).sum(axis=2).astype(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                    for x, width in ((given[kept], dim), (codes, tables))
                ]
                ids = pa.array(S._column(batch, "id")[kept], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *lists], schema.names)

        typed = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast(vec).alias("vec"))
        return typed.mapInArrow(run, schema)

    def _bucketed(self, coded: DataFrame) -> DataFrame:
        """A row per vector and table; ``group`` is the table and the bucket in it."""
        placed = coded.select("id", "vec", "codes", F.posexplode("codes").alias("t", "code"))
        group = F.shiftleft(F.col("t").cast("long"), self.bits) + F.col("code")
        # the tables before this one tell whether a pair has met already
        return placed.select(group.alias("group"), "id", "vec", F.slice("codes", F.lit(1), F.col("t")).alias("codes"))

    def sizes(self) -> DataFrame:
        """Members of each bucket, and the pairs compared in it."""
        found = self._bucketed(self.rows).groupBy("group").agg(F.count(F.lit(1)).alias("members"))
        return found.withColumn("compared", F.col("members") * F.col("members"))

    def _panels(self) -> int:
        """Panels of all vectors, and about as many lanes as keep all cores busy."""
        held = self.count * 8 * max(self.dim, 1)
        return max(math.ceil(held / self.placement.get("panel_bytes", PANEL_BYTES)), math.isqrt(tasks_of(self.rows.sparkSession)), 1)

    def meets_all(self) -> bool:
        """Whether vectors meet all others panel by panel: fewer copies than tables, and at most four times the pairs."""
        if self._all is None:
            panels = self._panels()
            few = self.tables <= panels + math.ceil(tasks_of(self.rows.sparkSession) / panels)
            self._all = not few and 4 * (self.sizes().agg(F.sum("compared")).first()[0] or 0) >= self.count**2
        return self._all

    def _met(self, kernel, schema: T.StructType, some: Column | None = None) -> DataFrame:
        """``kernel`` over every pair of vectors, or of those for which ``some`` holds and all; ``codes`` are those of all tables."""
        panels, tasks, spark = self._panels(), tasks_of(self.rows.sparkSession), self.rows.sparkSession
        held = self.count * 8 * max(self.dim, 1)
        columns = ["id", "vec", F.col("codes").cast("array<int>").alias("codes")]
        if some is not None or held > self.placement.get("panel_bytes", PANEL_BYTES):
            return self._streamed(kernel, schema, columns, some)
        if isinstance(kernel, BestOf):
            columns.append(F.lit(float("-inf")).alias("bound"))
        rows = self.rows.select(F.lit(0).cast("long").alias("group"), *columns)
        sizes = spark.createDataFrame([(0, held, self.count)], "group long, bytes long, visitors long")
        lane = lane_of(self.count * panels, tasks, self.placement.get("lane_rows", LANE_ROWS))
        return compare_in_groups(
            rows, None, kernel, schema, self.dim, sizes, panel_bytes=max(1, math.ceil(held / panels)), lane_rows=lane
        )

    def _streamed(self, kernel, schema: T.StructType, columns: list, some: Column | None) -> DataFrame:
        """The visitors are panels, all vectors are blocks: the disk holds both once, whatever the number of panels."""
        visitors = self.rows if some is None else self.rows.where(some)
        count = self.count if some is None else visitors.count()
        if self._blocks is None:
            self._blocks = streamed.written_blocks(self.rows.select(*columns))
        size = count * (8 * max(self.dim, 1) + 4 * self.tables)
        panels = streamed.panels_of(size, count * self.count, self.rows.sparkSession)
        dealt = streamed.panel_blocks(visitors.select(*columns).repartition(panels, "id"))
        given = {"kernel": kernel, "metric": "cosine", "dim": self.dim, "extra": ["codes"]}
        start = partial(BestMet, **given) if isinstance(kernel, BestOf) else partial(Met, visits=True, **given)
        return streamed.meet(dealt, self._blocks, start, schema)

    def threshold_join(self, threshold: float, some: Column | None = None) -> DataFrame:
        """Pairs of rows at or above ``threshold`` that share a bucket, each once: ``(left_id, right_id, sim)``; only those
        whose left row meets ``some``, a condition on ``id``, if it is given."""
        if self.meets_all():
            return self._met(PairsOf(threshold, SharedBucket()), PAIRS, some)
        placed = self._bucketed(self.rows)
        visitors = None if some is None else placed.where(some)
        sizes = group_sizes(placed, placed if visitors is None else visitors, self.dim)
        kernel = PairsOf(threshold, FirstTable())
        return compare_in_groups(placed, visitors, kernel, PAIRS, self.dim, sizes, **self.placement)

    def top_k(self, k: int = 50, *, exclude_self: bool = True) -> DataFrame:
        """The ``k`` best of the rows that share a bucket: ``(query_id, rank, neighbour_id, sim)``."""
        if self.meets_all():
            hits = self._met(BestOf(k, exclude_self, SharedBucket()), HITS)
        else:
            placed = self._bucketed(self.rows).select("group", "id", "vec", F.lit(float("-inf")).alias("bound"))
            sizes = group_sizes(placed, placed, self.dim)
            hits = compare_in_groups(placed, None, BestOf(k, exclude_self), HITS, self.dim, sizes, **self.placement)
        return best_by_query(hits, k).select("query_id", "rank", "neighbour_id", "sim")


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``(exact, found, recall, not_exact)``: how many of the rows of ``exact`` are in ``found``, by ``keys``, and how
    many of these have another ``sim`` there."""
    both = exact.select(*keys, "sim").join(found.select(*keys, F.lit(1).alias("hit"), F.col("sim").alias("s")), keys, "left")
    return both.agg(
        F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"),
        F.count_if(F.abs(F.col("s") - F.col("sim")) > 1e-12).alias("not_exact"),
    )


def recall_by_slices(search: Callable, keys: list[str], df: DataFrame, rows: int, most: int = PAIRS_AT_ONCE) -> DataFrame:
    """``recall`` of a join whose pairs are too many to lie on disk at once.

    ``search(some)`` gives ``(found, exact)`` of the left rows that meet ``some``, a condition on the ``id`` of ``df``, or of all if it is
    None. Slices of ids are searched one after the other, as many at a time as are about ``most`` pairs by those before;
    what a step has shuffled goes with its end. ``rows * rows`` pairs are expected at first.
    """
    spark, place = df.sparkSession, F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(SLICES))
    width = min(SLICES, max(1, SLICES * most // max(rows * rows, 1)))
    at, total, before = 0, [0, 0, 0], spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        while at < SLICES:
            end = min(SLICES, at + width)
            some = None if end - at == SLICES else (place >= at) & (place < end)
            counted = recall(*search(some), keys).select("exact", "found", "not_exact").first()
            total = [x + y for x, y in zip(total, counted)]
            at, width = end, max(1, min(16 * width, end * most // max(total[0], 1)))
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    counts = spark.createDataFrame([tuple(total)], "exact long, found long, not_exact long")
    return counts.select("exact", "found", (F.col("found") / F.col("exact")).alias("recall"), "not_exact")
