"""Passages of test items in training texts, exact or edited.

1. Every n-gram of an item is a *seed*, whatever else the texts hold: what is found in one text never
   depends on another text.
2. Texts meet items at seeds, so a text and an item that share no ``N`` unchanged words in a row do not
   meet. Around each meeting the item is aligned with the words of the text (Smith-Waterman: a match
   earns 2, a mismatch or gap costs 1). An item leaks into a text if the best local alignment earns at
   least ``LEAST`` of what the whole item can.
3. A *passage* of an item leaks too, however long the item is: a local alignment in which a mismatch or
   gap costs ``STRICT`` and that earns what ``PASSAGE`` unchanged words earn. So 13 words leak as they
   are, and longer passages may have an edit for every two words more. Score and place are then those
   of this alignment.

Items travel to the texts in blocks of at most ``BLOCK_WORDS`` words (or one longer item), so what is
sent is bounded and texts are not shuffled. Work grows with the meetings: a frequent n-gram costs one
alignment per text, item that has it, and stretch of the item's length.

Defined cases: null or empty texts hold nothing; items with a null id or fewer than ``N`` words take no
part; repeated items of one id count each, the best alignment per id is reported; repeated rows
give repeated rows; other columns pass through, but one that has the name of the
result is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.batches import flat_array, making_room, ngrams, signed, sliced, texts_of, word_hashes
from affinis.session import materialise

N = 3
LEAST = 0.5
PASSAGE = 13
STRICT = 4
BLOCK_WORDS = 2_000_000
SLICE = 2 << 20  # bytes of text at a time
CELLS = 1 << 19  # alignment cells per row of a batch
MEETINGS = 1 << 18  # pairs of a hit and an item in memory at a time
MATCH, MISMATCH, GAP = 2, -1, 1


def _item_words(items: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``(item_id, words)`` of the items that take part, with words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            offsets, hashes = word_hashes(texts_of(batch, text))
            out = pa.RecordBatch.from_arrays(
                [
                    flat_array(batch.column(batch.schema.get_field_index(key))),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(hashes))),
                ],
                ["item_id", "words"],
            )
            yield out.filter(pa.array(np.diff(offsets) >= n))

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text)
    return rows.mapInArrow(run, "item_id long, words array<long>")


class _Lookup:
    """Sorted distinct hashes behind a bit table that turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` of known hashes, and the places of these among the known."""
        maybe = np.flatnonzero(self.bits[(values >> np.uint64(42)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, values[maybe]), len(self.hashes) - 1)
        good = self.hashes[place] == values[maybe]
        return maybe[good], place[good]


@dataclass
class ItemBlock:
    """Items: their ids, and their words one after the other, with offsets."""

    ids: np.ndarray
    offsets: np.ndarray
    words: np.ndarray


class Seeds:
    """The n-grams of a block: ``first[i]`` to ``first[i + 1]`` are the seeds of the i-th distinct one,
    each with its item and its position there."""

    def __init__(self, block: ItemBlock, n: int):
        bounds, grams, starts = ngrams(block.offsets, block.words, n)
        owners = np.repeat(np.arange(len(block.ids)), np.diff(bounds))
        order = np.argsort(grams, kind="stable")
        distinct, first = np.unique(grams[order], return_index=True)
        self.table = _Lookup(distinct)
        self.first = np.append(first, len(grams))
        self.items = owners[order]
        self.places = (starts - block.offsets[owners])[order]


def _blocks(items: DataFrame, limit: int) -> Iterator[ItemBlock]:
    held, words = [], 0

    def packed() -> ItemBlock:
        return ItemBlock(
            np.array([key for key, _ in held], np.int64),
            np.cumsum([0, *(len(x) for _, x in held)]),
            np.concatenate([x for _, x in held]),
        )

    for row in items.toLocalIterator():
        if held and words + len(row["words"]) > limit:
            yield packed()
            held, words = [], 0
        held.append((row["item_id"], np.array(row["words"], np.int64).view(np.uint64)))
        words += len(row["words"])
    if held:
        yield packed()


def local_alignments(
    items: np.ndarray, windows: np.ndarray, mismatch: int = MISMATCH, gap: int = GAP
) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair of rows, and where in the window it ends (exclusive).

    Rows are padded with 0 (items) and 1 (windows), which match nothing.
    """
    count, width = windows.shape
    slope = np.arange(width, dtype=np.int32) * gap
    above = np.zeros((count, width), np.int32)
    best, end = np.zeros(count, np.int32), np.zeros(count, np.int64)
    for i in range(items.shape[1]):
        gained = np.where(items[:, i : i + 1] == windows, np.int32(MATCH), np.int32(mismatch))
        gained[:, 1:] += above[:, :-1]
        np.maximum(gained, above - gap, out=gained)
        np.maximum(gained, 0, out=gained)
        # a gap inside the row: the best cell to the left, less its distance
        above = np.maximum.accumulate(gained + slope, axis=1) - slope
        top = above.argmax(axis=1)
        score = above[np.arange(count), top]
        better = score > best
        best[better], end[better] = score[better], top[better] + 1
    return best, end


def _aligned(
    pairs: list[tuple[np.ndarray, np.ndarray]], mismatch: int = MISMATCH, gap: int = GAP
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, begin and end (in the window) of each ``(item words, window words)``."""
    scores, begins, ends = (np.zeros(len(pairs), np.int64) for _ in range(3))
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(pairs[order[stop]][1]) <= CELLS:
            stop += 1
        chosen = order[at:stop]
        for backward in (False, True):
            items = np.zeros((len(chosen), max(len(pairs[i][0]) for i in chosen)), np.uint64)
            windows = np.ones((len(chosen), max(len(pairs[i][1]) for i in chosen)), np.uint64)
            for row, i in enumerate(chosen):
                item, window = pairs[i]
                if backward:  # from its end, the same alignment seen the other way round
                    item, window = item[::-1], window[: ends[i]][::-1]
                items[row, : len(item)], windows[row, : len(window)] = item, window
            score, end = local_alignments(items, windows, mismatch, gap)
            for row, i in enumerate(chosen):
                if backward:
                    begins[i] = ends[i] - end[row]
                else:
                    scores[i], ends[i] = score[row], end[row]
        at = stop
    return scores, begins, ends


LEAK = T.StructType(
    [
        T.StructField("item_id", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
    ]
)
_ARROW_LEAK = pa.struct(
    [
        pa.field("item_id", pa.int64(), False),
        pa.field("score", pa.float64(), False),
        pa.field("start", pa.int32(), False),
        pa.field("end", pa.int32(), False),
    ]
)


def _meetings(offsets: np.ndarray, hashes: np.ndarray, block: ItemBlock, seeds: Seeds, n: int) -> Iterator[np.ndarray]:
    """``(row, item, step)`` of where texts meet items, some more than once: every hit meets each item that
    has the seed; hits are grouped by where the item would start, in steps of its length."""
    bounds, grams, starts = ngrams(offsets, hashes, n)
    where, place = seeds.table.hits(grams)
    total = np.cumsum(seeds.first[place + 1] - seeds.first[place])
    at = 0
    while at < len(where):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, side="right")))
        first, times = seeds.first[place[at:stop]], np.diff(total[at:stop], prepend=total[at - 1] if at else 0)
        seed = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        hit = np.repeat(where[at:stop], times)
        row = np.searchsorted(bounds, hit, side="right") - 1
        item = seeds.items[seed]
        diagonal = starts[hit] - offsets[row] - seeds.places[seed]
        yield np.unique(np.stack([row, item, diagonal // np.diff(block.offsets)[item]], axis=1), axis=0)
        at = stop


def _leaks_of(texts: pa.Array, block: ItemBlock, seeds: Seeds, n: int, least: float) -> list[dict]:
    """Per text, the best leak of each item of the block by its id."""
    offsets, hashes = word_hashes(texts)
    found: list[dict] = [{} for _ in range(len(offsets) - 1)]
    for meetings in _meetings(offsets, hashes, block, seeds, n):
        pairs, origins = [], []
        for r, i, step in meetings.tolist():
            words = block.words[block.offsets[i] : block.offsets[i + 1]]
            size = len(words)
            pad = math.ceil(max(MATCH * (1 - least) / GAP, 0.5) * size)  # what earns enough has no more gaps
            lo = max(0, step * size - pad)
            hi = min(int(offsets[r + 1] - offsets[r]), (step + 2) * size + pad)
            pairs.append((words, hashes[offsets[r] + lo : offsets[r] + hi]))
            origins.append((r, int(block.ids[i]), lo))
        scores, begins, ends = _aligned(pairs)
        whole = scores >= least * MATCH * np.array([len(words) for words, _ in pairs])
        # a stricter alignment earns no more than the best one
        parts = np.flatnonzero(~whole & (scores >= MATCH * PASSAGE))
        if len(parts):
            strict = _aligned([pairs[k] for k in parts], -STRICT, STRICT)
            scores[parts], begins[parts], ends[parts] = strict
            whole[parts] = strict[0] >= MATCH * PASSAGE
        for k in np.flatnonzero(whole).tolist():
            r, key, lo = origins[k]
            leak = (-int(scores[k]) / (MATCH * len(pairs[k][0])), lo + int(begins[k]), lo + int(ends[k]))
            found[r][key] = min(found[r].get(key, leak), leak)
    return found


def _with_block(df: DataFrame, block: ItemBlock, text: str, out: str, n: int, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(block, n)
        for batch in sliced(batches, text, SLICE):
            at = batch.schema.get_field_index(out)
            known = batch.column(at).to_pylist()
            rows = []
            for old, new in zip(known, _leaks_of(texts_of(batch, text), block, seeds, n, least), strict=True):
                best = {x["item_id"]: (-x["score"], x["start"], x["end"]) for x in old}
                for key, leak in new.items():
                    best[key] = min(best.get(key, leak), leak)
                rows.append(
                    [{"item_id": k, "score": -s, "start": b, "end": e} for k, (s, b, e) in sorted(best.items())]
                )
            yield batch.set_column(at, out, pa.array(rows, pa.list_(_ARROW_LEAK)))

    return df.mapInArrow(run, df.schema)


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "item_id",
    item_text: str = "text",
    out: str = "leaks",
    n: int = N,
    least: float = LEAST,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with the array ``out`` of ``(item_id, score, start, end)``: the items that leak into each
    text, the share of the item that its alignment earns (below ``least`` for passages), and the words ``[start, end)`` of the text."""
    docs = making_room(docs, [out], [text])
    words = materialise(_item_words(items, key, item_text, n), "items")
    result = docs.withColumn(out, F.array().cast(T.ArrayType(LEAK, False)))
    for block in _blocks(words, block_words):
        result = _with_block(result, block, text, out, n, least)
    return result
