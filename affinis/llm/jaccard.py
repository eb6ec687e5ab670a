"""Join of texts whose sets of word n-grams are similar, by MinHash banding.

1. Every text becomes the set of its n-grams of words (a shorter text: all its words as one) and a
   signature of minima, cut into bands. Texts with equal sets are one *class representative* from
   here on, the smallest id, with the number of its copies as weight.
2. The band hashes are shuffled. Representatives that share one are chained to the smallest of them;
   the connected components of these chains hold all candidate pairs.
3. The n-gram set of each representative in such a component is sent to it. A component beyond
   ``BLOCK`` members or ``BLOCK_GRAMS`` n-grams is cut into blocks and every pair of blocks is a group of
   its own. Inside a group, pairs that share a band are verified on the full sets.
4. Groups report, per representative, the number of its links and one link that spans; links are
   never expanded into rows. The components of the spanning links are the classes.

Defined cases: null texts and texts without words have no n-grams and so no links; repeated rows are
copies; a null id gets the null class and no links; rows of one id with different texts are judged
one by one, as representatives have numbers of their own. Where one row of each class is kept, rows of one
id whose sets are equal count as one, and rows without words stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.batches import flat_array, mix, ngrams, signed, sliced, texts_of, word_hashes
from affinis.llm.graph import components
from affinis.session import materialise

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 256  # most minima in a signature
BLOCK = 1024  # representatives in a block
BLOCK_GRAMS = 1 << 21  # n-grams in a block, of more than one representative
SLICE = 2 << 20  # bytes of text at a time
CELLS = 1 << 22  # matrix cells in memory at a time


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """Bands and rows per band: the longest rows whose bands catch a pair at ``threshold`` with
    probability ``recall`` within ``most`` hashes. Longer rows let fewer unlike pairs through. Raises
    where even bands of one row would need more hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes do not reach a recall of {recall} at a similarity of {threshold}")
    return best


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the sorted distinct n-gram hashes of each row."""
    offsets, hashes = word_hashes(texts)
    bounds, grams, _ = ngrams(offsets, hashes, n)
    sets = []
    for row in range(len(offsets) - 1):
        lo, hi = bounds[row], bounds[row + 1]
        if hi > lo:
            sets.append(np.unique(grams[lo:hi]))
        else:
            words = hashes[offsets[row] : offsets[row + 1]]
            value = np.array([len(words)], np.uint64)
            for word in words:
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + word)
            sets.append(value[: min(len(words), 1)])
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return np.concatenate([[0], np.cumsum(sizes)]), flat


def set_keys(offsets: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per row that are equal for equal sets."""
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt * 0x9E3779B9)), dtype=np.uint64)])
        out.append(signed(sums[offsets[1:]] - sums[offsets[:-1]]))
    return out[0], out[1]


def band_hashes(offsets: np.ndarray, grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row (of a non-empty set) and band; keys of different bands differ."""
    values = (grams >> np.uint64(32)).astype(np.uint32)
    factors = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 31, bands * rows, dtype=np.uint32) * 2 + 1
    starts = offsets[:-1]
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            least = np.minimum.reduceat(values * factor, starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out


def signatures(df: DataFrame, text: str, key: str, n: int, bands: int, rows: int) -> DataFrame:
    """``(id, size, set_a, set_b, bands)`` of every row; rows without n-grams have size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            offsets, grams = shingle_sets(texts_of(batch, text), n)
            sizes = np.diff(offsets)
            a, b = set_keys(offsets, grams)
            some = sizes > 0
            found = np.empty((0, bands), np.uint64)
            if some.any():
                found = band_hashes(np.concatenate([offsets[:-1][some], offsets[-1:]]), grams, bands, rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(signed(found.ravel()))
            )
            ids = flat_array(batch.column(batch.schema.get_field_index(key)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes.astype(np.int32)), pa.array(a), pa.array(b), lists],
                ["id", "size", "set_a", "set_b", "bands"],
            )

    schema = "id long, size int, set_a long, set_b long, bands array<long>"
    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)


def _with_sets(df: DataFrame, text: str, n: int) -> DataFrame:
    """Rows ``(…, set_a, text)`` with ``grams`` for the text, if it is the text the key was made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            offsets, grams = shingle_sets(texts_of(batch, text), n)
            names = [x for x in batch.schema.names if x != text]
            grouped = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(grams)))
            out = pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), grouped], [*names, "grams"])
            own = flat_array(out.column("set_a")).to_numpy() == set_keys(offsets, grams)[0]
            yield out.filter(pa.array(own))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.mapInArrow(run, f"{fields}, grams array<long>")


def _strips(offsets: np.ndarray, grams: np.ndarray) -> Iterator[np.ndarray]:
    """A bit per row and n-gram that at least two rows have, ``CELLS`` words of 64 at a time."""
    rows = len(offsets) - 1
    _, codes, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    kept = np.flatnonzero(shared[codes])
    where, owner = place[codes[kept]], np.repeat(np.arange(rows), np.diff(offsets))[kept]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    wide = max(1, CELLS // max(rows, 1))
    words = (int(shared.sum()) + 63) // 64
    for first in range(0, words, wide):
        part = slice(*np.searchsorted(where, [first * 64, (first + wide) * 64]))
        at = where[part] - first * 64
        bits = np.zeros((rows, min(wide, words - first)), np.uint64)
        np.bitwise_or.at(bits, (owner[part], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        yield bits


def similar_pairs(
    bands: np.ndarray, offsets: np.ndarray, grams: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction
) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (one of ``left``, one of ``right``; first below second if both are the same rows)
    that share a band and whose sets are at least ``threshold`` similar."""
    sizes, same = np.diff(offsets), left is right
    num, den = threshold.numerator, threshold.denominator
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        near = np.zeros((len(rows), len(right)), bool)
        for band in range(bands.shape[1]):
            near |= bands[rows, band][:, None] == bands[right, band][None, :]
        a, b = sizes[rows][:, None], sizes[right][None, :]
        near &= np.minimum(a, b) * den >= np.maximum(a, b) * num
        if same:
            near &= rows[:, None] < right[None, :]
        p, q = np.nonzero(near)
        first.append(rows[p])
        second.append(right[q])
    p, q = np.concatenate(first), np.concatenate(second)  # at most as many as a pair of blocks has
    common = np.zeros(len(p), np.int64)
    for bits in _strips(offsets, grams) if len(p) else ():
        chunk = max(1, CELLS // bits.shape[1])
        for lo in range(0, len(p), chunk):
            both = bits[p[lo : lo + chunk]] & bits[q[lo : lo + chunk]]
            common[lo : lo + chunk] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    good = common * (num + den) >= num * (sizes[p] + sizes[q])
    return p[good], q[good]


def roots(count: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to."""
    label = np.arange(count)
    while True:
        new = label.copy()
        np.minimum.at(new, first, label[second])
        np.minimum.at(new, second, label[first])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches, key: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, from batches in which the rows of a group follow each other."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(x)).to_numpy() for x in key]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            name = tuple(c[lo] for c in columns)
            if held and name != current:
                yield pa.Table.from_batches(held)
                held = []
            current = name
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _links(grouped: DataFrame, threshold: float) -> DataFrame:
    """``(node, root, links)`` of every group, for representatives that have links in it."""
    exact = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["component", "left", "right"]):
            reps = table["node"].to_numpy()
            reps, kept = np.unique(reps, return_index=True)  # repeated rows of one id
            if len(reps) < 2:
                continue
            table = table.take(pa.array(kept)).combine_chunks()
            weights, block = table["weight"].to_numpy(), table["block"].to_numpy()
            lists = flat_array(table["grams"])
            offsets = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            grams = lists.flatten().to_numpy()
            bands = flat_array(table["bands"]).flatten().to_numpy().reshape(len(reps), -1)
            left = np.flatnonzero(block == table["left"][0].as_py())
            right = left if table["left"][0] == table["right"][0] else np.flatnonzero(block == table["right"][0].as_py())
            p, q = similar_pairs(bands, offsets, grams, left, right, exact)
            if not len(p):
                continue
            links = np.bincount(p, weights[q], len(reps)) + np.bincount(q, weights[p], len(reps))
            label = roots(len(reps), p, q)
            some = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_pydict(
                {"node": reps[some], "root": reps[label[some]], "links": links[some].astype(np.int64)}
            )

    return grouped.mapInArrow(run, "node long, root long, links long")


def _classes(df: DataFrame, text: str, key: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and ``(set_a, set_b, rep, class, class_id, n_links)`` of each set: the smallest
    id of the set, the number of its class, the smallest id of the class, and the links of a row of the set."""
    bands, rows = choose_bands(threshold, recall)
    signs = materialise(signatures(df, text, key, n, bands, rows), "signatures")
    reps = (
        signs.where("size > 0 AND id IS NOT NULL")
        .groupBy("set_a", "set_b")
        .agg(
            F.min("id").alias("rep"),
            F.count(F.lit(1)).alias("weight"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
        )
    )
    # the number is written with the row, so that every later step sees the same
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chains = banded.join(buckets, "band").select(F.col("node").alias("u"), "v")
    candidates = components(chains).join(reps, "node")

    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS))
    sizes = candidates.groupBy("component").agg(blocks.cast("int").alias("blocks"))
    members = candidates.select("component", "node", "rep", "set_a", "set_b", "weight", "bands").join(sizes, "component")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("_text"))
    with_sets = _with_sets(members.join(texts, "rep"), "_text", n)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grouped = (
        with_sets.withColumn("_other", other)
        .withColumns({"left": F.least("block", "_other"), "right": F.greatest("block", "_other")})
        .select("component", "left", "right", "block", "node", "weight", "bands", "grams")
        .repartition("component", "left", "right")
        .sortWithinPartitions("component", "left", "right")
    )
    found = materialise(_links(grouped, threshold), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    sets = (
        reps.select("set_a", "set_b", "node", "rep", "weight")
        .join(linked, "node", "left")
        .join(labels, "node", "left")
        .withColumn("class", F.coalesce("component", "node"))
        .withColumn("n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
    )
    sets = materialise(sets.select("set_a", "set_b", "rep", "class", "n_links"), "classes")
    # written too: Spark splits a class of any size only where nothing is aggregated in the stage of the join
    least = materialise(sets.groupBy("class").agg(F.min("rep").alias("class_id")), "least-ids")
    return signs, sets.join(least, "class")


def similarity_classes(
    df: DataFrame, text: str = "text", key: str = "doc_id", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """``(key, class_id, n_links)`` per row of ``df``: the smallest id of the row's class, and the
    number of other rows that are at least ``threshold`` similar to it."""
    signs, sets = _classes(df, text, key, n, threshold, recall)
    some = F.col("size") > 0
    none = signs.where(~some | F.col("id").isNull()).select(
        F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return (
        signs.where(some & F.col("id").isNotNull())
        .select("id", "set_a", "set_b")
        .join(sets.select("set_a", "set_b", "class_id", "n_links"), ["set_a", "set_b"])
        .select(F.col("id").alias(key), "class_id", "n_links")
        .unionByName(none)
    )


def _with_keys(df: DataFrame, text: str, n: int) -> DataFrame:
    """``df`` with the keys of the set of each text, and how many n-grams it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            offsets, grams = shingle_sets(texts_of(batch, text), n)
            added = [pa.array(x) for x in (*set_keys(offsets, grams), np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.LongType()) for x in ("_set_a", "_set_b", "_size"))])
    return df.mapInArrow(run, schema)


def one_per_class(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    n: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``df`` with one row of each class: the one of the smallest id; of several sets of that id the one of
    the smallest key, of several texts with that set the smallest text. Rows with a null id, and rows without
    words, stay.

    Most rows are told by their id alone. Only for ids that come more than once are the sets formed again.
    """
    signs, sets = _classes(df, text, key, n, threshold, recall)
    sets = materialise(sets.select("set_a", "set_b", "rep", "class", "class_id"), "named-classes")
    row = signs.where("size > 0 AND id IS NOT NULL").select("id", "set_a", "set_b").join(sets, ["set_a", "set_b"])
    known = signs.where("id IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    often = materialise(known.where("_rows > 1").select("_id"), "repeated-ids")
    dropped = row.where("class_id < id").select(F.col("id").alias("_id"))
    as_key = F.col(key).cast("long") == F.col("_id")
    some = df.where(F.col(key).isNotNull())
    once = some.join(dropped.unionByName(often).distinct(), as_key, "left_anti")

    # of the sets whose smallest id is that of the class, the first one stands for it
    first = sets.where("rep = class_id").groupBy("class", "class_id").agg(F.min(F.struct("set_a", "set_b")).alias("s"))
    first = first.select(F.col("class_id").alias("_id"), F.col("s.set_a").alias("_a"), F.col("s.set_b").alias("_b"))
    again = _with_keys(some.join(often, as_key, "left_semi"), text, n)
    kept = again.where("_size > 0").join(
        first, as_key & (F.col("_set_a") == F.col("_a")) & (F.col("_set_b") == F.col("_b")), "left_semi"
    )
    order = W.partitionBy(key, "_set_a", "_set_b").orderBy(text)
    kept = kept.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    parts = [once, kept, again.where("_size = 0"), df.where(F.col(key).isNull())]
    out = parts[0].select(*df.columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*df.columns))
    return out
