"""Panels of one table meet all rows of another one, and no row is copied to disk for that.

Rows travel as *blocks*: a block is one row that holds the Arrow bytes of many. The panels of one side are shuffled once, the
blocks of the other side are written once, and Spark's Cartesian product lets a task that holds a panel read the table of
blocks from end to end. A grid of cells sends each row once a shelf and once a lane, which grows with the square of the
table where panels are bounded; here the disk holds both sides once, whatever the number of panels.

The bytes of a panel reach Python with the first block only. A task compares a bounded number of pairs (``panels_of``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.session import materialise

BLOCK_BYTES = 1 << 19
HELD_BYTES = 16 << 20  # of a panel
TASK_PAIRS = 1 << 30  # of dense vectors
SPARSE_PAIRS = 1 << 28
_IN_PART = (1 << 33) - 1  # the place of a row in its partition, in ``monotonically_increasing_id``


def as_bytes(batch: pa.RecordBatch) -> pa.Buffer:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def rows_of(data: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def _block(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch({"data": pa.array([as_bytes(batch).to_pybytes()], pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width = max(1, most * batch.num_rows // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, width):
            yield _block(batch.slice(start, width))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, width := max(1, most * batch.num_rows // max(batch.nbytes, 1))):
            part = batch.slice(start, width)
            if held and size + part.nbytes > most:
                yield _block(_whole(held))
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield _block(_whole(held))


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def panels_of(size: int, pairs: int, spark, held_bytes: int = HELD_BYTES, task_pairs: int = TASK_PAIRS) -> int:
    """Panels that hold ``size`` bytes, compare ``task_pairs`` of all ``pairs`` each at most, and keep all cores busy."""
    return max(math.ceil(size / held_bytes), math.ceil(pairs / task_pairs), 3 * spark.sparkContext.defaultParallelism)


def panel_blocks(dealt: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A panel, or more where it is larger than ``held_bytes``, from each partition of ``dealt``."""
    return dealt.mapInArrow(partial(_gathered, most=held_bytes), "data binary")


def written_blocks(rows: DataFrame) -> DataFrame:
    return materialise(rows.mapInArrow(partial(_cut, most=BLOCK_BYTES), "data binary"), "blocks")


def _meetings(batches: Iterator[pa.RecordBatch], start: Callable) -> Iterator[pa.RecordBatch]:
    panels = {}
    for batch in batches:
        number, held, data = (batch.column(batch.schema.get_field_index(x)) for x in ("panel", "held", "data"))
        for i, key in enumerate(number.to_pylist()):
            if key not in panels:
                panels[key] = start(rows_of(held[i]))
            yield from panels[key].feed(rows_of(data[i]))
    for panel in panels.values():
        yield from panel.finish()


def meet(panels: DataFrame, blocks: DataFrame, start: Callable, schema: T.StructType, lanes: int = 1) -> DataFrame:
    """``start(rows)`` for each panel, its ``feed(rows)`` with every block, then its ``finish()``: all give Arrow batches.

    With several ``lanes`` the blocks are dealt to as many tasks for each partition of ``panels``, which then hold the panel each.
    """
    at = F.monotonically_increasing_id()
    streamed = blocks.coalesce(lanes).select((at.bitwiseAND(F.lit(_IN_PART)) == 0).alias("first"), "data")
    held = panels.select(at.alias("panel"), F.col("data").alias("held"))
    pairs = streamed.crossJoin(held.hint("shuffle_replicate_nl"))  # the left side is read block by block
    cells = pairs.select("panel", F.when(F.col("first"), F.col("held")).alias("held"), "data")
    return cells.mapInArrow(partial(_meetings, start=start), schema)
