"""Quality of texts: random-indexing word vectors, pooled, and a small network on top.

1. Words are hashed into ``BUCKETS``. Each bucket owns a sparse random vector of ``NONZERO`` signs. Over
   *all* texts, the vector of a word is the sum of the random vectors of its neighbours; the sums are
   whole numbers, so tasks add up to the same vectors in any order.
2. A text is the mean of its words' vectors at unit length, frequent words weighing less, and of
   ``PRIOR`` average words, so that a few words are not taken for more than they tell.
3. A network of two layers is fitted on at most ``SAMPLE`` labelled texts (by hash of the id), and a
   temperature on a part of them that the network does not see.

A word here keeps its case, and the marks around it are a word of their own, because shouting and
symbols tell as much as letters. A token that repeats the one before counts as the one word
``again``, whatever it is.

Defined cases: null and empty texts are average words only, and scored like any other; labels that
are null or of no text are not used, of repeated ones the largest counts; without both labels in the sample the
score is the smoothed share of label 1; repeated rows give repeated rows; other columns pass through, but one that
has the name of the result is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.batches import CACHED_TOKENS, flat_array, making_room, sliced, texts_of, tokens_of

BUCKETS = 1 << 13
WIDTH = 64
NONZERO = 4
WINDOW = 2  # neighbours on each side
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 30
PRIOR = 10
SLICE = 1 << 20
AGAIN = 0  # bucket of repeated tokens
_COMMON = 1e-3  # a word of this share of all words weighs one half
_PARTS = re.compile(r"[^\W_]+|[\W_]+")
_CODES: dict[str, list[int]] = {}


def _codes(token: str) -> list[int]:
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) % (BUCKETS - 1) + 1 for x in _PARTS.findall(token)]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the bucket of every word and mark."""
    offsets, codes, distinct = tokens_of(texts)
    if len(_CODES) > CACHED_TOKENS:
        _CODES.clear()
    lists = []
    for token in distinct:
        found = _CODES.get(token)
        if found is None:
            found = _codes(token)
            if len(token) < 16:
                _CODES[token] = found
        lists.append(found)
    lists.append([AGAIN])
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([c for x in lists for c in x], np.int64)
    if not len(codes):
        return offsets, flat[:0]
    again = np.append(False, codes[1:] == codes[:-1])
    again[offsets[:-1][offsets[:-1] < len(codes)]] = False
    codes = np.where(again, len(distinct), codes)
    lengths = sizes[codes]
    stops = np.concatenate([[0], np.cumsum(lengths)])
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    words = flat[np.repeat(first[codes] - stops[:-1], lengths) + np.arange(stops[-1])]
    return stops[offsets], words


def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the random vector of each bucket."""
    rng = np.random.Generator(np.random.PCG64(3))
    return rng.integers(0, WIDTH, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def word_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(bucket, n, v0 … )``: of every word its count and the sum of its neighbours' random vectors."""
    fields = ", ".join(f"v{i} long" for i in range(WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = random_vectors()
        counts, sums = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS * WIDTH)
        for batch in sliced(batches, text, 2 * SLICE):
            offsets, words = word_codes(texts_of(batch, text))
            counts += np.bincount(words, minlength=BUCKETS)
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for step in range(1, WINDOW + 1):
                near = rows[step:] == rows[:-step]
                left, right = words[:-step][near], words[step:][near]
                for one, other in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        cells = one * WIDTH + places[other, j]
                        sums += np.bincount(cells, signs[other, j], BUCKETS * WIDTH)
        some = np.flatnonzero(counts)
        table = sums.reshape(BUCKETS, WIDTH).astype(np.int64)[some]
        columns = [pa.array(some.astype(np.int32)), pa.array(counts[some]), *(pa.array(c) for c in table.T)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", *(f"v{i}" for i in range(WIDTH))])

    parts = docs.select(text).mapInArrow(run, f"bucket int, n long, {fields}")
    return parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ["n", *(f"v{i}" for i in range(WIDTH))]))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """``BUCKETS x WIDTH`` vectors, at unit length times the weight of the word (two megabytes), and
    as last row the average word."""
    found = word_sums(docs, text).toArrow()
    out, counts = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    bucket = found["bucket"].to_numpy()
    counts[bucket] = found["n"].to_numpy()
    for i in range(WIDTH):
        out[bucket, i] = found[f"v{i}"].to_numpy()
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    share = counts / max(1.0, counts.sum())
    out = out / np.maximum(length, 1) * (_COMMON / (_COMMON + share))[:, None]
    return np.vstack([out, share @ out]).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text's words and ``PRIOR`` average ones."""
    offsets, words = word_codes(texts)
    sizes = np.diff(offsets)
    out = np.tile(PRIOR * vectors[-1].astype(float), (len(sizes), 1))
    # a text longer than the slice is summed in pieces
    limit = SLICE // 4
    for lo in range(0, len(words), limit):
        hi = min(len(words), lo + limit)
        first = np.searchsorted(offsets[1:], lo, side="right")
        last = np.searchsorted(offsets[:-1], hi, side="left")
        rows = np.arange(first, last)
        rows = rows[sizes[rows] > 0]
        starts = np.maximum(offsets[rows], lo) - lo
        out[rows] += np.add.reduceat(vectors[words[lo:hi]], starts, axis=0)
    return out / (sizes + PRIOR)[:, None]


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((inputs - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(inputs), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -500, 500)))


def fit_network(inputs: np.ndarray, labels: np.ndarray, calibration: np.ndarray) -> Network:
    """Adam on the log loss of the rows that are not for ``calibration``, then the temperature of
    least loss on those that are."""
    if len(np.unique(labels)) < 2:
        return Network(np.zeros(1), np.ones(1), [], constant=(labels.sum() + 1) / (len(labels) + 2))
    rng = np.random.Generator(np.random.PCG64(7))
    x, y = inputs[~calibration], labels[~calibration].astype(float)
    if len(np.unique(y)) < 2:
        x, y = inputs, labels.astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    net = Network(
        mean,
        scale,
        [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)],
    )
    x = (x - mean) / scale
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            w1, b1, w2, b2 = net.weights
            hidden = np.tanh(x[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - hidden**2)
            gradients = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(gradients):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                rate = 3e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.weights[i] = net.weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    if calibration.any():
        logits, truth = net.logits(inputs[calibration]), labels[calibration].astype(float)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    return net


def labelled_sample(labels: DataFrame, learn: Column, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` ``(key, label)`` rows that ``learn`` holds for, those of the smallest hashes.

    Hashes beyond the share that is needed, and a fifth more, are left out first, so that what the
    tasks send on for sorting does not grow with the labels.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull())
    per_id = known.groupBy(F.col(key).cast("long").alias(key)).agg(F.max(F.col(label)).cast("int").alias("_label"))
    spread = 1 << 30
    place = F.pmod(F.xxhash64(key), F.lit(spread))
    share = min(1.0, (1.2 * most + 1000) / max(1, known.count()))
    return per_id.where(place < int(share * spread)).orderBy(place, key).limit(most)


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = SAMPLE
) -> Classifier:
    """Word vectors of all ``docs`` and a network fitted on ``most`` labelled ones."""
    vectors = word_vectors(docs, text)
    sample = labelled_sample(labels, learn, label, key, most)
    rows = docs.select(F.col(key).cast("long").alias(key), text).join(F.broadcast(sample), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            found = pooled(texts_of(batch, text), vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * WIDTH), pa.array(found.ravel()))
            ids, truth = (flat_array(batch.column(batch.schema.get_field_index(x))) for x in (key, "_label"))
            yield pa.RecordBatch.from_arrays([ids, truth, lists], ["id", "label", "vector"])

    found = rows.select(key, text, "_label").mapInArrow(run, "id long, label int, vector array<double>").toArrow()
    ids, truth = found["id"].to_numpy(), found["label"].to_numpy()
    inputs = flat_array(found["vector"]).flatten().to_numpy().reshape(-1, WIDTH) if len(ids) else np.empty((0, WIDTH))
    order = np.lexsort((*inputs.T, truth, ids))
    ids, truth, inputs = ids[order], truth[order] > 0, inputs[order]
    held = np.array([xxhash.xxh32_intdigest(f"calibrate {i}") % 6 == 0 for i in ids], bool)
    return Classifier(vectors, fit_network(inputs, truth, held))


def score(df: DataFrame, classifier: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 as ``out``."""
    df = making_room(df, [out], [text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            found = classifier.network.scores(pooled(texts_of(batch, text), classifier.vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType(), False)]))
