"""Exact top-k inner products by distributed histogram selection.

Queries come in blocks of bounded size. For a block, every candidate is scored, and tasks count
scores into histograms that start at the bound which vector lengths put on any score. Spark sums
the histograms, a window finds the bin that holds each query's k-th value, and the next pass counts
inside that bin, until bins are one score wide. The last pass keeps scores above the k-th value
and, of those equal to it, the smallest ids.

A task reports a histogram only from its top down to the bin where its own count reaches what is
asked for: the k-th value of all rows is no lower than that of some of them. In the same way the
last pass keeps k rows per query and task, so copies of one vector never add up.

Defined cases: rows with a null id, a null or empty vector, or a null or non-finite component take no part;
vectors meet only vectors of their length; candidates that have the query's id are its own rows; of
several query rows with one id, the smallest vector asks; repeated candidate rows each count;
queries with fewer than k candidates get all of them; components and scores that 64 bits may not hold raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.llm.batches import flat_array
from affinis.session import scratch_path

BLOCK = 1024  # queries per block; a block of 1,000-wide vectors is 8 MB
BINS = 2048
CELLS = 1 << 20  # scores in memory at a time
EXACT = 1 << 53  # integers that doubles hold
LARGEST = 2.0**63

Block = dict[int, tuple[np.ndarray, np.ndarray]]  # by vector length: ids, integer vectors


def quantise(components: np.ndarray, scale: int) -> np.ndarray:
    found = np.floor(scale * components.astype(np.float64))
    if (np.abs(found) >= LARGEST).any():
        raise ValueError("a component times the scale is beyond 64 bits")
    return found.astype(np.int64)


def _vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and integer vectors of the usable rows, one part per vector length."""
    ids, lists = (flat_array(batch.column(i)) for i in (0, 1))
    usable = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    lists = lists.filter(pa.array(usable))
    ids = ids.filter(pa.array(usable)).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        values = flat[starts[rows][:, None] + np.arange(size)]
        finite = np.isfinite(values).all(axis=1)
        if finite.any():
            yield int(size), ids[rows][finite], quantise(values[finite], scale)


def _scores(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Scores as ``queries x vectors``: products of doubles where they hold every sum exactly."""
    if exact:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _chunks(batches, scale: int, block: Block, exact: dict[int, bool]):
    """``(length, candidate ids, scores)`` with the queries' own rows marked."""
    for batch in batches:
        for size, ids, vectors in _vectors(batch, scale):
            if size not in block:
                continue
            query_ids, queries = block[size]
            step = max(1, CELLS // len(query_ids))
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                scores = _scores(queries, vectors[at : at + step], exact[size])
                own = np.searchsorted(query_ids, part)
                own[own == len(query_ids)] = 0
                same = np.flatnonzero(query_ids[own] == part)
                taken = np.ones(scores.shape, bool)
                taken[own[same], same] = False
                yield size, part, scores, taken


def _longest(rows: DataFrame, scale: int) -> dict[int, float]:
    """Largest vector length (norm) per number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            for size, _, vectors in _vectors(batch, scale):
                norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
                most[size] = max(most.get(size, 0.0), norm)
        yield pa.RecordBatch.from_pydict(
            {"size": pa.array(list(most), pa.int64()), "norm": pa.array(list(most.values()), pa.float64())}
        )

    found = rows.mapInArrow(run, "size long, norm double").groupBy("size").agg(F.max("norm").alias("norm"))
    return {r["size"]: r["norm"] for r in found.collect()}


def _histogram(rows: DataFrame, scale: int, block: Block, exact, low, shift: int, bins_wide: int, need) -> DataFrame:
    """``(query_id, bin, n)``: scores of each query in ``bins_wide`` bins, ``2 ** shift`` wide, from ``low`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {size: np.zeros(len(ids) * BINS, np.int64) for size, (ids, _) in block.items()}
        for size, _, scores, taken in _chunks(batches, scale, block, exact):
            bins = (scores - low[size][:, None]) >> shift
            taken &= (bins >= 0) & (bins < bins_wide)
            bins += (np.arange(len(bins)) * BINS)[:, None]
            sums[size] += np.bincount(bins[taken], minlength=len(sums[size]))
        for size, counts in sums.items():
            counts = counts.reshape(-1, BINS)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            query, place = np.nonzero((counts > 0) & (above < need[size][:, None]))
            yield pa.RecordBatch.from_pydict(
                {"query_id": block[size][0][query], "bin": place.astype(np.int32), "n": counts[query, place]}
            )

    return rows.mapInArrow(run, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def _kth_bins(histogram: DataFrame, needs: DataFrame) -> dict[int, tuple[int, int]]:
    """Per query the bin of its k-th value (or the lowest one it has) and the count above that bin."""
    down = W.partitionBy("query_id").orderBy(F.desc("bin"))
    found = (
        histogram.withColumn("upto", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0)))
        .join(F.broadcast(needs), "query_id")
        .where(F.col("upto") - F.col("n") < F.col("need"))
        .groupBy("query_id")
        .agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"), "upto"), "bin").alias("x"))
    )
    return {r["query_id"]: (r["x"]["bin"], r["x"]["above"]) for r in found.collect()}


def _kept(rows: DataFrame, scale: int, block: Block, exact, least, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: of each task the best k rows at or above the k-th value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: tuple(np.empty(0, np.int64) for _ in range(3)) for size in block}
        for size, part, scores, taken in _chunks(batches, scale, block, exact):
            taken &= scores >= least[size][:, None]
            query, column = np.nonzero(taken)
            query, score, ids = (
                np.concatenate(pair)
                for pair in zip(best[size], (query, scores[query, column], part[column]), strict=True)
            )
            order = np.lexsort((ids, -score, query))
            query = query[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            order = order[place < k]
            best[size] = (query[place < k], score[order], ids[order])
        for size, (query, score, ids) in best.items():
            yield pa.RecordBatch.from_pydict({"query_id": block[size][0][query], "vec_id": ids, "score": score})

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _select(rows: DataFrame, scale: int, block: Block, longest: dict[int, float], k: int) -> DataFrame:
    block = {size: part for size, part in block.items() if size in longest}
    bound, exact = {}, {}
    for size, (_, vectors) in block.items():
        norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()))
        bound[size] = int(norm * longest[size] * 1.0001) + 2
        exact[size] = bound[size] < EXACT
    spark = rows.sparkSession
    most = max(bound.values(), default=1)
    if 2 * most + 1 >= LARGEST:
        raise ValueError("scores can be beyond 64 bits")
    shift = max(0, (2 * most + 1).bit_length() - (BINS.bit_length() - 1))
    low = {size: np.full(len(ids), -most, np.int64) for size, (ids, _) in block.items()}
    need = {size: np.full(len(ids), k, np.int64) for size, (ids, _) in block.items()}
    bins_wide = BINS
    while block:
        asked = [(int(i), int(n)) for size, (ids, _) in block.items() for i, n in zip(ids, need[size], strict=True)]
        needs = spark.createDataFrame(asked, "query_id long, need long")
        found = _kth_bins(_histogram(rows, scale, block, exact, low, shift, bins_wide, need), needs)
        for size, (ids, _) in block.items():
            for i, query in enumerate(ids.tolist()):
                if query in found:  # else the query has no candidate at all
                    place, above = found[query]
                    low[size][i] += place << shift
                    need[size][i] -= above
        if shift == 0:
            break
        # the next pass looks into one bin of this one: scores above it are counted already
        finer = max(0, shift - (BINS.bit_length() - 1))
        shift, bins_wide = finer, 1 << (shift - finer)
    top = _kept(rows, scale, block, exact, low, k)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        top.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _blocks(queries: DataFrame, scale: int) -> Iterator[Block]:
    """Blocks of at most ``BLOCK`` distinct queries; rows arrive partition by partition."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def packed() -> Block:
        sizes = np.array([len(v) for v in vectors])
        out = {}
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            own = np.array([ids[i] for i in rows], np.int64)
            order = np.argsort(own)
            out[int(size)] = own[order], np.stack([vectors[i] for i in rows])[order]
        return out

    for row in queries.toLocalIterator():
        values = np.array([np.nan if x is None else x for x in row[1]], np.float64)
        if len(values) and np.isfinite(values).all():
            ids.append(row[0])
            vectors.append(quantise(values, scale))
        if len(ids) == BLOCK:
            yield packed()
            ids, vectors = [], []
    if ids:
        yield packed()


def exact_topk(
    df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each row that ``is_query`` holds for.

    Components x count as ``floor(scale * x)``; ties go to the smaller id.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asking = df.where(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # several rows of one id: the smallest usable vector asks
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    queries = asking.where(F.col("id").isNotNull() & usable).groupBy("id").agg(F.min("v").alias("v"))
    longest = _longest(rows, scale)
    path = scratch_path(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(queries, scale):
        _select(rows, scale, block, longest, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
