"""Spans found in texts: how scans report them and what queries derive from them.

Scans work on UTF-8 bytes, because all their patterns are ASCII, and report code points.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.batches import making_room, sliced, texts_of

Found = list[tuple[int, int, int, bool]]  # start, kind (as a number), end, added by the method
SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("added", T.BooleanType(), False),
    ]
)


def character_starts(data: bytes) -> np.ndarray:
    """The byte at which each character of UTF-8 begins, and the end."""
    return np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))


def code_points(data: bytes, found: Found) -> Found:
    """Byte offsets turned into code points, sorted by start, then kind, then end."""
    found = sorted(found)
    if not found or data.isascii():
        return found
    at = np.searchsorted(character_starts(data), [x for start, _, end, _ in found for x in (start, end)]).tolist()
    return [(at[2 * i], kind, at[2 * i + 1], added) for i, (_, kind, _, added) in enumerate(found)]


class Covered:
    """Whether a span lies inside one of the given spans, asked in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [start for start, _ in ordered]
        self.reach = list(accumulate((end for _, end in ordered), max))

    def __call__(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.reach[at - 1] >= end


def with_spans(
    df: DataFrame, scan: Callable[[bytes], Found], kinds: tuple[str, ...], text: str, out: str
) -> DataFrame:
    """``df`` with the array ``out`` of spans that ``scan`` finds in each whole text."""
    df = making_room(df, [out], [text])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(SPAN, False), False)])
    arrow = pa.list_(
        pa.struct(
            [
                pa.field("kind", pa.string(), False),
                pa.field("start", pa.int32(), False),
                pa.field("end", pa.int32(), False),
                pa.field("added", pa.bool_(), False),
            ]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            rows = []
            for value in texts_of(batch, text).cast(pa.large_binary()):
                data = value.as_py()
                rows.append(
                    [
                        {"kind": kinds[kind], "start": start, "end": end, "added": added}
                        for start, kind, end, added in code_points(data, scan(data))
                    ]
                )
            found = pa.array(rows, arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~s["added"])


def counted(spans: Column, kind: str) -> Column:
    """Base spans of one kind."""
    return F.size(F.filter(spans, lambda s: ~s["added"] & (s["kind"] == kind))).cast("long")


def digests(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    return [
        *(counted(spans, kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(joined(base_only(spans)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    ]
