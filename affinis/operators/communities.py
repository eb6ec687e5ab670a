"""Similarity communities: groups of vectors around a centre, large ones first, disjoint.

The sequential rule is: take the candidates by size, keep one if none of its members is taken.
Here a round keeps, at once, every candidate that is the best remaining one for all of its
members, and drops every candidate that shares a member with those.

Vectors are compared once. Who is near whom is stored for each vector and block of others that
holds one of its partners: two bytes for each if they are few, or else bits, so a dense group costs a bit for each pair and never
becomes a list. The vectors of one block that are near to members of another are one row, a *tile*. A vector is sent once to each
shelf of many blocks, not to each block. A round is two passes over the tiles of the candidates that are left: ranks go to the
members, and the best rank of each member comes back. What is known of the vectors of a block, their ranks or the best
that they have seen, is one row, which meets tiles and not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.functions import constants as C
from affinis.functions.vectors import as_array, l2_normalise, norm
from affinis.operators import similarity as sim
from affinis.operators.grouped import LANE_ROWS, PANEL_BYTES, Rows, compare_in_groups, lane_of, tasks_of
from affinis.operators.ordered import ordered_parts, row_numbers
from affinis.session import materialise, materialise_counted, scratch_path


BLOCK = 2048  # vectors in a block of bits
NONE = np.iinfo(np.int64).max
_NEAR = T.StructType(
    [T.StructField("own", T.LongType()), T.StructField("block", T.LongType()), T.StructField("places", T.BinaryType())]
    + [T.StructField("sizes", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("members", T.LongType())]
)
STATE_BYTES = 64 << 20  # of what is known of all vectors, where it is sent to every task


def candidates(
    vectors: DataFrame,
    threshold: float = C.COMMUNITY_THRESHOLD,
    min_size: int = C.COMMUNITY_MIN_SIZE,
    **options,
) -> DataFrame:
    """``(centre_id, size)``: vectors with at least ``min_size`` members in reach, self included."""
    counts = sim.threshold_counts(vectors, vectors, threshold, **options)
    return counts.where(F.col("members") >= min_size).select(
        F.col("id").alias("centre_id"), F.col("members").alias("size")
    )


class NearBits:
    """For the visitors of one block and each block of the shelf a tile of the members they are near to: the ``places`` in their
    ``own`` block of the visitors that are near to any, and the bytes of each in ``bits`` (``_packed``)."""

    def __init__(self, threshold: float, block: int):
        self.threshold, self.block = threshold, block

    def __call__(self, panel: Rows, group, visitors: Rows) -> Iterator[pa.RecordBatch]:
        blocks, starts = np.unique(panel.ids // self.block, return_index=True)  # a panel is sorted by id
        order = np.argsort(visitors.ids, kind="stable")
        ids, vectors = visitors.ids[order], visitors.vectors[order]
        cuts = np.flatnonzero(np.diff(ids // self.block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
            for rows in sim._tiles(hi - lo, sim.TILE_COLS):
                own = slice(lo + rows.start, lo + rows.stop)
                if own.start < own.stop:
                    yield from self._tile(panel, blocks, starts, ids[own], vectors[own])

    def _tile(self, panel: Rows, blocks: np.ndarray, starts: np.ndarray, ids: np.ndarray, vectors) -> Iterator[pa.RecordBatch]:
        out = []
        for number, first, last in zip(blocks, starts, [*starts[1:], len(panel.ids)]):
            r, c = np.nonzero(sim._scores(vectors, panel.vectors[first:last], "dot", self.threshold) >= self.threshold)
            if len(r):
                some, at = np.unique(r, return_inverse=True)
                bits = _packed_places(at, panel.ids[first:last][c] - number * self.block, len(some), self.block)
                _, ends, data = bits.buffers()
                places = (ids[some] % self.block).astype("<u2").tobytes()
                sizes = np.diff(np.frombuffer(ends, np.int32)[: len(some) + 1]).astype("<i4").tobytes()
                out.append((ids[0] // self.block, number, places, sizes, data.to_pybytes(), len(r)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TILE_TYPES)], _NEAR.names)


_TILE_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())


class Tile:
    """A tile as numbers: which ``rows`` (places in their own block) are near to which ``places`` of the other block. Rows of few
    members are lists, one after another (``ends``); the others are marks."""

    def __init__(self, places: bytes, sizes: bytes, bits: bytes, block: int):
        rows, size = np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(sizes, "<i4")
        flat, few = np.frombuffer(bits, np.uint8), size < block // 8
        listed = np.repeat(few, size)
        self.rows, self.places = rows[few], flat[listed].view("<u2")
        self.times = size[few] // 2
        self.dense = rows[~few]
        self.marks = np.unpackbits(flat[~listed].reshape(-1, block // 8), axis=1).astype(bool) if len(self.dense) else None

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        rows, places = np.repeat(self.rows, self.times), self.places.astype(np.int64)
        if self.marks is None:
            return rows, places
        r, c = np.nonzero(self.marks)
        return np.concatenate([rows, self.dense[r]]), np.concatenate([places, c])

    def lower(self, values: np.ndarray, out: np.ndarray) -> None:
        """``out``, by place in the other block, falls to the least value of the rows near to it."""
        given = values[self.rows]
        some = given < NONE
        np.minimum.at(out, self.places[np.repeat(some, self.times)], np.repeat(given[some], self.times[some]))
        for part in sim._tiles(len(self.dense), 256):
            near = np.where(self.marks[part], values[self.dense[part]][:, None], NONE)
            np.minimum(out, near.min(axis=0), out=out)

    def least(self, values: np.ndarray, out: np.ndarray) -> None:
        """``out``, by row, falls to the least value of the members near to it."""
        if len(self.rows):
            starts = np.cumsum(self.times) - self.times
            np.minimum.at(out, self.rows, np.minimum.reduceat(values[self.places], starts))
        for part in sim._tiles(len(self.dense), 256):
            np.minimum.at(out, self.dense[part], np.where(self.marks[part], values, NONE).min(axis=1))


def _tiles_of(batch: pa.RecordBatch, block: int) -> Iterator[tuple[int, Tile]]:
    places, sizes, bits = (batch.column(batch.schema.get_field_index(x)) for x in ("places", "sizes", "bits"))
    for i in range(batch.num_rows):
        yield i, Tile(places[i].as_py(), sizes[i].as_py(), bits[i].as_py(), block)


def _packed_places(at: np.ndarray, places: np.ndarray, rows: int, block: int) -> pa.Array:
    """``_packed`` of the marks at ``(at, places)``, which are sorted; without the marks where all rows are lists."""
    counts = np.bincount(at, minlength=rows)
    if 2 * counts.max() < block // 8:
        ends = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
        data = places.astype("<u2").tobytes()
        return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    near = np.zeros((rows, block), bool)
    near[at, places] = True
    return _packed(near)


def _packed(near: np.ndarray) -> pa.Array:
    """Rows of a block of marks: the places as two bytes each where they take less than the bits."""
    width = near.shape[1] // 8
    counts = near.sum(axis=1)
    few = 2 * counts < width
    sizes = np.where(few, 2 * counts, width)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, listed = np.empty(ends[-1], np.uint8), np.repeat(few, sizes)
    out[listed] = np.nonzero(near[few])[1].astype("<u2").view(np.uint8)
    out[~listed] = np.packbits(near[~few], axis=1).ravel()
    return pa.Array.from_buffers(pa.binary(), len(near), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _near(column: pa.Array, block: int) -> np.ndarray:
    """The marks that ``_packed`` wrote."""
    sizes = np.array([len(x.as_py()) for x in column], np.int64)
    flat = np.frombuffer(b"".join(x.as_py() for x in column), np.uint8)
    out, few = np.zeros((len(sizes), block), bool), sizes < block // 8
    listed = np.repeat(few, sizes)
    out[np.repeat(np.flatnonzero(few), sizes[few] // 2), flat[listed].view("<u2")] = True
    out[~few] = np.unpackbits(flat[~listed].reshape(-1, block // 8), axis=1)
    return out


def _blobs(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as a binary column."""
    ends = pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, width: int, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(len(column), width)


def near_bits(numbered: DataFrame, rows: int, threshold: float, block: int = BLOCK, **placement) -> DataFrame:
    """``(own, block, places, sizes, bits, members)`` from ``numbered(num, vec)``, numbered from 0 without gaps: tiles of the vectors
    of each ``block`` that are at least ``threshold`` similar to vectors of the block ``own``, and how many pairs they are."""
    if block % 8 or block > 1 << 16:
        raise ValueError("a block is a multiple of 8, at most 65536")
    dim, tasks = sim.dimension(numbered), tasks_of(numbered.sparkSession)
    blocks, panel_bytes = max(1, -(-rows // block)), placement.get("panel_bytes", PANEL_BYTES)
    shelf = block * max(1, min(panel_bytes // (block * 8 * max(dim, 1)), -(-blocks // math.isqrt(tasks))))
    last = max(0, (rows - 1) // shelf)
    members = numbered.select((F.col("num") / shelf).cast("long").alias("group"), F.col("num").alias("id"), "vec")
    visitors = numbered.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("group"), F.col("num").alias("id"), "vec")
    sizes = members.groupBy("group").agg((F.count(F.lit(1)) * 8 * max(dim, 1)).alias("bytes")).withColumn("visitors", F.lit(rows))
    lane = lane_of(rows * (last + 1), tasks, placement.get("lane_rows", LANE_ROWS))
    return compare_in_groups(members, visitors, NearBits(threshold, block), _NEAR, dim, sizes, panel_bytes=panel_bytes, lane_rows=lane)


def _block_rows(held: dict[int, np.ndarray], name: str, block: int) -> pa.RecordBatch:
    numbers = sorted(held)
    values = np.array([held[x] for x in numbers], np.int64).reshape(-1, block)
    return pa.record_batch({"block": np.array(numbers, np.int64), name: _blobs(values)})


def _ranked_members(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """First pass: the best rank among the open candidates near each member, -1 if a kept one is near."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        numbers, states = sim._column(batch, "block"), _matrix(batch.column(batch.schema.get_field_index("state")), block, "<i8")
        for i, tile in _tiles_of(batch, block):
            tile.lower(np.maximum(states[i], -1), held.setdefault(int(numbers[i]), np.full(block, NONE)))
    yield _block_rows(held, "best", block)


def _least(frame: pd.DataFrame) -> pd.DataFrame:
    best = np.frombuffer(frame["best"].iloc[0], np.int64)
    for other in frame["best"].iloc[1:]:
        best = np.minimum(best, np.frombuffer(other, np.int64))
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "best": [best.tobytes()]})


def _best_of_members(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Second pass: the best rank that a member of each vector has seen; -1 if a kept candidate has it."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        numbers, best = sim._column(batch, "own"), _matrix(batch.column(batch.schema.get_field_index("best")), block, "<i8")
        for i, tile in _tiles_of(batch, block):
            tile.least(best[i], held.setdefault(int(numbers[i]), np.full(block, NONE)))
    yield _block_rows(held, "best", block)


_STATE = "block long, state binary, open long, kept long"


def _state_rows(blocks: np.ndarray, states: list[np.ndarray]) -> pa.RecordBatch:
    """The state of a vector: the rank of an open candidate, less than -1 for a kept one (``_kept``), or ``NONE``."""
    counts = [[int(((x > 0) & (x < NONE)).sum()) for x in states], [int((x < 0).sum()) for x in states]]
    return pa.record_batch(
        {"block": blocks, "state": pa.array([x.tobytes() for x in states], pa.binary()), "open": pa.array(counts[0], pa.int64()), "kept": pa.array(counts[1], pa.int64())}
    )


def _kept(rank):
    return -1 - rank


def _first_state(frame: pd.DataFrame, block: int) -> pd.DataFrame:
    state = np.full(block, NONE)
    state[(frame["num"] % block).to_numpy()] = frame["rank"].to_numpy()
    return _state_rows(np.array([frame["block"].iloc[0]]), [state]).to_pandas()


def _next_state(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """An open candidate is kept if its members have seen none before it, and goes if one is taken."""
    for batch in batches:
        seen, out = batch.column(batch.schema.get_field_index("best")), []
        for state, best in zip(_matrix(batch.column(batch.schema.get_field_index("state")), block, "<i8"), seen):
            best = np.frombuffer(best.as_py(), "<i8") if best.is_valid else np.full(block, NONE)
            is_open = (state > 0) & (state < NONE)
            after = np.where(is_open & (best == state), _kept(state), state)
            out.append(np.where(is_open & ((best < 0) | (best == NONE)), NONE, after))
        yield _state_rows(sim._column(batch, "block"), out)


def _sizes(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The members of each vector in the tiles of a batch."""
    for batch in batches:
        own = sim._column(batch, "own")
        nums, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, tile in _tiles_of(batch, block):
            nums += [own[i] * block + tile.rows, own[i] * block + tile.dense]
            counts += [tile.times.astype(np.int64), np.empty(0, np.int64) if tile.marks is None else tile.marks.sum(axis=1)]
        found, place = np.unique(np.concatenate(nums), return_inverse=True)
        size = np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)
        yield pa.record_batch({"num": found, "size": size})


def _written(state: DataFrame) -> tuple[DataFrame, int]:
    """The state as a table, and how many candidates are open."""
    spark, path, seen = state.sparkSession, scratch_path(state.sparkSession, "open"), Observation()
    state.observe(seen, F.coalesce(F.sum("open"), F.lit(0)).alias("open")).write.parquet(path)
    return spark.read.schema(_STATE).parquet(path), seen.get["open"]


def communities(
    vectors: DataFrame,
    threshold: float = C.COMMUNITY_THRESHOLD,
    min_size: int = C.COMMUNITY_MIN_SIZE,
    block: int = BLOCK,
    **options,
) -> DataFrame:
    """``(community_id, centre_id, size, channel_id)`` from ``vectors(id, vec)``, unique by id.

    Communities are numbered from 0 by falling size, then centre id. Rounds go on until no
    candidate is open; their number is bounded by the longest chain of overlapping candidates of falling
    rank. ``panel_bytes`` and ``lane_rows`` place the comparison.
    """
    placement = {k: v for k, v in options.items() if k in ("panel_bytes", "lane_rows")}
    given = vectors.select("id", "vec").where("id IS NOT NULL AND vec IS NOT NULL")
    numbered = row_numbers(ordered_parts(given, [], ["id"]), [], ["id"], "n").select((F.col("n") - 1).alias("num"), "id", "vec")
    numbered, rows = materialise_counted(numbered, "numbered")
    near = materialise(near_bits(numbered, rows, threshold, block, **placement), "near-bits")
    sizes = near.mapInArrow(lambda x: _sizes(x, block), "num long, size long").groupBy("num").agg(F.sum("size").alias("size"))
    sizes = sizes.where(F.col("size") >= min_size)
    ranked = sizes.join(numbered.select("num", "id"), "num").withColumn("_neg", -F.col("size"))
    ranked = row_numbers(ordered_parts(ranked, [], ["_neg", "id"]), [], ["_neg", "id"], "rank").select("rank", "num", "id", "size")
    ranked = materialise(ranked, "candidates")
    small = F.broadcast if 8 * rows <= STATE_BYTES else lambda x: x
    tiles = near.select("own", "block", "places", "sizes", "bits")

    def of_own(state: DataFrame) -> DataFrame:
        return tiles.join(small(state.select(F.col("block").alias("own"), "state")), "own")

    first = ranked.select((F.col("num") / block).cast("long").alias("block"), "num", "rank")
    state, n_open = _written(first.groupBy("block").applyInPandas(lambda x: _first_state(x, block), _STATE))
    while n_open:
        best = of_own(state.where("open > 0 OR kept > 0")).mapInArrow(lambda x: _ranked_members(x, block), "block long, best binary")
        best = best.groupBy("block").applyInPandas(_least, "block long, best binary")
        asked = tiles.join(small(state.where("open > 0").select(F.col("block").alias("own"))), "own", "left_semi")
        seen = asked.join(small(best), "block").mapInArrow(lambda x: _best_of_members(x, block), "block long, best binary")
        after = state.join(seen.groupBy("block").applyInPandas(_least, "block long, best binary"), "block", "left")
        state, n_open = _written(after.mapInArrow(lambda x: _next_state(x, block), _STATE))

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, number = sim._column(batch, "own"), sim._column(batch, "block")
            states = _matrix(batch.column(batch.schema.get_field_index("state")), block, "<i8")
            for i, tile in _tiles_of(batch, block):
                row, place = tile.pairs()
                kept = states[i][row] < 0
                yield pa.record_batch({"rank": _kept(states[i][row[kept]]), "num": number[i] * block + place[kept]})

    members = of_own(state.where("kept > 0")).mapInArrow(members_of, "rank long, num long")
    members = members.join(numbered.select("num", F.col("id").alias("channel_id")), "num")
    centres = ranked.select("rank", F.col("id").alias("centre_id"), "size")
    return number(materialise(members.join(centres, "rank").select("centre_id", "size", "channel_id"), "members"))


def number(members: DataFrame) -> DataFrame:
    centres = members.select("centre_id", "size").distinct().withColumn("_neg", -F.col("size"))
    order = ["_neg", "centre_id"]
    numbered = row_numbers(ordered_parts(centres, [], order), [], order, "n")
    ids = numbered.select("centre_id", (F.col("n") - 1).alias("community_id"))
    return members.join(ids, "centre_id").select("community_id", "centre_id", "size", "channel_id")


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))


def labels(
    channels: DataFrame,
    members: DataFrame,
    names: DataFrame | None = None,
    distinct_noise: bool = False,
) -> DataFrame:
    """``(channel_id, label, label_name)`` for every channel.

    Channels without a community share label 0 with the first community, unless
    ``distinct_noise`` gives them -1. ``names(label, label_name)`` is a lookup table.
    """
    noise = -1 if distinct_noise else 0
    labelled = channels.select("channel_id").join(
        members.select("channel_id", F.col("community_id").alias("label")), "channel_id", "left"
    )
    out = labelled.select("channel_id", F.coalesce("label", F.lit(noise).cast("bigint")).alias("label"))
    if names is None:
        table = F.create_map(*[F.lit(x) for item in C.COMMUNITY_NAMES.items() for x in item])
        name = F.try_element_at(table, F.col("label").cast("int"))
    else:
        out = out.join(names, "label", "left")
        name = F.col("label_name")
    return out.select("channel_id", "label", F.coalesce(name, F.lit("unlabelled")).alias("label_name"))


def community_sample(
    members: DataFrame, meta: DataFrame, community_id: int, n: int = 30, seed: str = "0"
) -> DataFrame:
    """A random ``n`` of the metadata rows of one community, in seeded order."""
    chosen = members.where(F.col("community_id") == community_id).select("channel_id")
    key = F.md5(F.concat_ws("-", F.lit(seed), "channel_id"))
    rows = meta.join(chosen, "channel_id", "left_semi").orderBy(key, "channel_id").limit(n)
    return rows.select("title", "about", "link")


def project_2d(vectors: DataFrame) -> DataFrame:
    """``(channel_id, pos_x, pos_y)``: unit vectors on their two main axes.

    The fit moves one ``d x d`` matrix, whatever the number of vectors. An axis points to where its
    largest loading is positive, so the picture does not flip from run to run.
    """
    sized = vectors.select("id", "vec", norm(F.col("vec")).alias("length"))
    unit = sized.select("id", array_to_vector(l2_normalise(F.col("vec"), F.col("length"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(unit)
    axes = model.pc.toArray()
    largest = axes[np.abs(axes).argmax(axis=0), [0, 1]]
    at = as_array(F.col("p"))
    return model.transform(unit).select(
        F.col("id").alias("channel_id"),
        (at[0] * float(np.sign(largest[0]) or 1.0)).alias("pos_x"),
        (at[1] * float(np.sign(largest[1]) or 1.0)).alias("pos_y"),
    )


def export_rows(labelled: DataFrame, positions: DataFrame) -> DataFrame:
    """``(channel_id, labels, pos_x, pos_y)`` for the community file."""
    return labelled.join(positions, "channel_id").select(
        "channel_id", F.col("label_name").alias("labels"),
        F.col("pos_x").cast("float").alias("pos_x"), F.col("pos_y").cast("float").alias("pos_y"),
    )


def write_export(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)
