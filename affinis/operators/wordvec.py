"""Word-vector encoder: mean of word vectors per message, then mean of messages per channel.

The mean of means equals one weighted mean over words, so only scalars are shuffled: each
message spreads weight 1 evenly over its known words, weights are summed per (block, channel, word),
and a vector is fetched once per word of a block instead of once per token.

Messages lie in blocks of at most ``BLOCK_WORDS`` words, or one longer message. Inside a block a word is a
number, so a word is sent to the vocabulary once per block and not once per message, and the messages are
sent as numbers, once.

A message is a row: rows that share a ``message_id`` are messages of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions import constants as C
from affinis.functions.text import drop_links
from affinis.functions.vectors import as_array
from affinis.session import materialise

BLOCK_WORDS = 1 << 21  # words of the messages of one block
_LISTED = 1024  # words of a block in one row


def message_tokens(messages: DataFrame, min_tokens: int = C.WORD_VECTOR_TOKENS) -> DataFrame:
    """``(channel_id, message_id, tokens)`` of messages with more than ``min_tokens`` words.

    The words of ``clean_words(clean_text(message))``. Without a cleaned text between, no run of white space has
    to be collapsed only to be split again.
    """
    texts = messages.select("channel_id", "message_id", drop_links(F.lower("message")).alias("tokens"))
    types = [f"{name} {texts.schema[name].dataType.simpleString()}" for name in ("channel_id", "message_id")]
    rows = texts.mapInArrow(_words_of_texts, f"{', '.join(types)}, tokens array<string>")
    return rows.where(F.size("tokens") > min_tokens)


def _words_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces texts by their words: what ``clean_text`` keeps, split at white space."""
    dropped = f"[^a-z{C.WS[1:-1]}{C.LETTERS}-]+"
    for batch in batches:
        kept = pc.utf8_trim_whitespace(pc.replace_substring_regex(batch.column("tokens"), dropped, ""))
        # an empty text has no words; split, it would be one empty word
        lists = pc.utf8_split_whitespace(pc.if_else(pc.equal(kept, ""), None, kept))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=batch.schema.names)


def word_blocks(tokens: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A written table of messages by block, with the words of each block as numbers.

    A row with ``ids`` is a message: its distinct words and their ``counts``. A row with ``tokens`` lists
    words of the block, numbered from ``first``.
    """
    channel = tokens.schema["channel_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for at, rows in enumerate(_gathered(batches, block_words)):
            yield from _block_rows(first + at, rows)

    schema = f"block bigint, channel_id {channel}, ids array<int>, counts array<int>, first int, tokens array<string>"
    return materialise(tokens.select("channel_id", "tokens").mapInArrow(blocks, schema), "word-blocks")


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most ``most`` words or of one row."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + most - size, side="right"))
            if stop <= start and held:
                yield _joined(held)
                held, size = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            size, start = size + int(ends[stop - 1] - before), stop
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _block_rows(block: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The messages of one block, then its words."""
    channels, lists = batch.column("channel_id"), batch.column("tokens")
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    known = flat.is_valid()
    coded = flat.filter(known).dictionary_encode()
    size = len(coded.dictionary)
    keys = row.filter(known).to_numpy().astype(np.int64) * max(size, 1) + coded.indices.to_numpy()
    keys, counts = np.unique(keys, return_counts=True)  # by message, then by word
    rows, ids = np.divmod(keys, max(size, 1))
    offsets = pa.array(np.searchsorted(rows, np.arange(len(lists) + 1)).astype(np.int32))
    ids = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
    counts = pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))
    names = ["block", "channel_id", "ids", "counts", "first", "tokens"]
    strings = pa.list_(pa.string())

    def filled(n: int) -> pa.Array:
        return pa.array(np.full(n, block, dtype=np.int64))

    n = len(lists)
    yield pa.RecordBatch.from_arrays(
        [filled(n), channels, ids, counts, pa.nulls(n, pa.int32()), pa.nulls(n, strings)], names=names
    )
    firsts = np.arange(0, size, _LISTED, dtype=np.int32)
    n = len(firsts)
    listed = pa.ListArray.from_arrays(pa.array(np.append(firsts, np.int32(size))), coded.dictionary.cast(pa.string()))
    none = pa.nulls(n, ids.type)
    yield pa.RecordBatch.from_arrays(
        [filled(n), pa.nulls(n, channels.type), none, none, pa.array(firsts), listed], names=names
    )


def block_tokens(blocks: DataFrame) -> DataFrame:
    """``(block, tokens)``: each word of a block once, some words to a row."""
    return blocks.where(F.col("tokens").isNotNull()).select("block", "first", "tokens")


def block_weights(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``(token, channels, weights)``, a row for each block and known word of it."""
    known = (
        block_tokens(blocks)
        .select("block", "first", F.posexplode("tokens").alias("pos", "token"))
        .join(words.select("token").hint("shuffle_hash"), "token", "left_semi")
        .select("block", (F.col("first") + F.col("pos")).alias("id"), "token")
    )
    messages = blocks.where(F.col("ids").isNotNull()).select(
        F.col("block").alias("in_block"), "channel_id", "ids", "counts"
    )
    channel = blocks.schema["channel_id"].dataType.simpleString()
    return messages.groupBy("in_block").cogroup(known.groupBy("block")).applyInArrow(
        _shares, f"token string, channels array<{channel}>, weights array<double>"
    )


def _shares(messages: pa.Table, known: pa.Table) -> pa.Table:
    """Spreads weight 1 of every message of a block over its known words; sums by channel and word."""
    tokens = known.column("token").combine_chunks()
    channels = messages.column("channel_id").combine_chunks().dictionary_encode(null_encoding="encode")
    lists = messages.column("ids").combine_chunks()
    ids, row = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
    counts = pc.list_flatten(messages.column("counts").combine_chunks()).to_numpy()
    place = np.full(max(ids.max(initial=-1), pc.max(known.column("id")).as_py() or 0) + 1, -1, dtype=np.int64)
    place[known.column("id").to_numpy()] = np.arange(len(tokens))
    ids = place[ids]
    kept = ids >= 0
    ids, row, counts = ids[kept], row[kept], counts[kept]
    share = counts / np.bincount(row, counts, minlength=len(lists))[row]
    width = max(len(channels.dictionary), 1)
    keys, at = np.unique(ids * width + channels.indices.to_numpy()[row], return_inverse=True)
    ids, codes = np.divmod(keys, width)
    offsets = pa.array(np.searchsorted(ids, np.arange(len(tokens) + 1)).astype(np.int32))
    weights = pa.array(np.bincount(at, share, minlength=len(keys)).astype(np.float64))  # counts of nothing are whole numbers
    columns = {
        "token": tokens,
        "channels": pa.ListArray.from_arrays(offsets, channels.dictionary.take(pa.array(codes))),
        "weights": pa.ListArray.from_arrays(offsets, weights),
    }
    return pa.table(columns)


def word_weights(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``(channel_id, token, weight)``; the weights of a channel sum to its known messages."""
    rows = block_weights(word_blocks(tokens), words)
    pairs = rows.select("token", F.explode(F.arrays_zip("channels", "weights")).alias("p"))
    return pairs.groupBy(F.col("p.channels").alias("channel_id"), "token").agg(F.sum("p.weights").alias("weight"))


def channel_means(tokens: DataFrame, words: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``(channel_id, embedding)`` from ``words(token, vector)``; channels without known words drop.

    ``blocks`` are the ``word_blocks`` of ``tokens`` where the caller has them.
    """
    blocks = word_blocks(tokens) if blocks is None else blocks
    weighted = block_weights(blocks, words).join(words.select("token", "vector").hint("shuffle_hash"), "token")
    channel = blocks.schema["channel_id"].dataType.simpleString()
    parts = weighted.select("channels", "weights", "vector").mapInArrow(
        _part_means, f"channel_id {channel}, vector array<double>, weight double"
    )
    mean = Summarizer.mean(array_to_vector(F.col("vector")), F.col("weight"))
    return parts.groupBy("channel_id").agg(as_array(mean).alias("embedding"))


def _part_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean and the weight of each channel among the words of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column("vector"))
        lists = batch.column("channels")
        channels = pc.list_flatten(lists).dictionary_encode(null_encoding="encode")
        codes, row = channels.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
        weights = pc.list_flatten(batch.column("weights")).to_numpy()
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(channels.dictionary) + 1))
        totals = np.bincount(codes, weights, minlength=len(channels.dictionary))
        means = np.empty((len(totals), vectors.shape[1]))
        for code, total in enumerate(totals):
            part = order[bounds[code] : bounds[code + 1]]
            means[code] = weights[part] @ vectors[row[part]] / total
        offsets = pa.array(np.arange(len(totals) + 1, dtype=np.int32) * vectors.shape[1])
        yield pa.RecordBatch.from_arrays(
            [channels.dictionary, pa.ListArray.from_arrays(offsets, pa.array(means.ravel())), pa.array(totals)],
            names=["channel_id", "vector", "weight"],
        )


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles."""
    values = pc.list_flatten(vectors)
    widths = pc.unique(pc.list_value_length(vectors))
    if vectors.null_count or values.null_count or len(widths) > 1:
        raise ValueError("word vectors need one width and no nulls")
    return values.to_numpy().astype(np.float64).reshape(len(vectors), -1)


def message_means(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``(channel_id, message_id, embedding)``: the per-message step on its own, one row per message."""
    numbered = materialise(tokens.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    counts = (
        numbered.select("channel_id", "message_id", "_row", F.explode("tokens").alias("token"))
        .groupBy("_row", "channel_id", "message_id", "token")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")), F.col("n"))
    return (
        counts.join(words, "token")
        .groupBy("_row", "channel_id", "message_id")
        .agg(as_array(mean).alias("embedding"))
        .drop("_row")
    )
