"""Arrow batches inside tasks: bounded slices, words as hashes, n-grams.

A *word* is a token between white space, in lower case, without its characters that are neither
letters nor digits; tokens without such characters are no words. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20
CACHED_TOKENS = 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_HASHES: dict[str, int] = {}


def flat_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with nulls as empty strings."""
    values = flat_array(batch.column(batch.schema.get_field_index(column)))
    return pc.fill_null(values.cast(pa.large_string()), "")


def sliced(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one longer text. A worker that has read
    all of them gives free memory back, as it lives on for tasks of other operators."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(flat_array(batch.column(batch.schema.get_field_index(column)))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def word_of(token: str) -> str:
    token = token.lower()
    return token if token.isalnum() else "".join(filter(str.isalnum, token))


def _hash(token: str) -> int:
    word = word_of(token)
    return (xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) or 1) if word else 0


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row offsets, a code per token, and the distinct tokens the codes stand for."""
    lists = pc.utf8_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and one 64-bit hash per word, over all texts of the batch."""
    offsets, codes, distinct = tokens_of(texts)
    if len(_HASHES) > CACHED_TOKENS:
        _HASHES.clear()
    known = np.empty(len(distinct), np.uint64)
    for i, token in enumerate(distinct):
        value = _HASHES.get(token)
        if value is None:
            value = _hash(token)
            if len(token) < 64:
                _HASHES[token] = value
        known[i] = value
    hashes = known[codes] if len(distinct) else np.empty(0, np.uint64)
    kept = hashes != 0
    if not kept.all():
        before = np.concatenate([[0], np.cumsum(kept)])
        offsets, hashes = before[offsets], hashes[kept]
    return offsets, hashes


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def ngrams(offsets: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, hash, and first word (as a flat position) of every n-gram inside a row."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    if not len(starts):
        return bounds, np.empty(0, np.uint64), starts
    rolled = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        rolled = mix(rolled * _MULTIPLIER + hashes[j : len(hashes) - n + 1 + j])
    return bounds, rolled[starts], starts


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's ``bigint``."""
    return values.view(np.int64)


def making_room(df, results, needed=()):
    """``df`` without columns that have the name of a result, in any case of letters: results replace
    them. A result must not have the name of a column that the operator reads."""
    names = {x.lower() for x in results}
    taken = names & {x.lower() for x in needed}
    if taken:
        raise ValueError(f"results cannot be named like the columns they are made of: {sorted(taken)}")
    return df.select(*(f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in names))
