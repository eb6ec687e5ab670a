"""Alignment of the tokens of two tokenizers over the same bytes, by products of incidence matrices.

1. Both tokenizers encode a text; their tokens tile its bytes. The incidence matrix of a tokenizer has a
   row per token and a column per byte, as compressed sparse rows made by hand (``Csr``).
2. Overlap links are the entries of A · Bᵀ, formed row by row after Gustavson: row *i* is the sum of the
   rows of Bᵀ that the entries of row *i* of A name. The value of an entry is the number of shared bytes.
3. Where tokens of both end at the same byte, a group ends. Products of the incidence matrices of
   tokens and groups give the shared-group links; they are formed in blocks, as a group may be large.
4. Before a space that follows a visible character, tokens of both tokenizers always end. The matrices of a
   text are block-diagonal there, and the block of a chunk that comes again is formed once a slice.
5. How often two ids are linked in the whole corpus: a slice of some megabytes of text sends each of its id
   pairs once, with a number; the sums are sent back once to each slice that has the pair. So the
   most frequent pair is one row per slice, and no table of pairs has to fit anywhere.

Defined cases: texts that are null or empty, and texts that one of the tokenizers does not give back byte
by byte, have no tokens, no links and no groups; repeated rows are documents of their own and count each;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.batches import sliced, texts_of
from affinis.llm.pieces import MARK, Pieces
from affinis.session import materialise

SLICE_BYTES = 4 << 20  # text of a slice
STEP_BYTES = 1 << 19  # text encoded and multiplied at a time
CELLS = 1 << 22  # products in memory at a time


# -- sparse matrices ---------------------------------------------------------------------------------


class Csr(NamedTuple):
    """Compressed sparse rows: row ``i`` has the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def transposed(m: Csr) -> Csr:
    counts = np.bincount(m.columns, minlength=m.width)
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    return Csr(_bounds(counts), rows[np.argsort(m.columns, kind="stable")], len(m.starts) - 1)


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def product(a: Csr, b: Csr, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries ``(row, column, value)`` of a · b in order, a block of whole rows of ``a`` at a time.

    A block has at most ``cells`` terms, or one row. Terms that come in order already, as those of two
    tilings do, are not sorted.
    """
    sizes = np.diff(b.starts)
    terms = _bounds(sizes[a.columns])[a.starts]  # terms before each row
    top = 0
    while top < len(a.starts) - 1:
        end = max(top + 1, int(np.searchsorted(terms, terms[top] + cells, side="right")) - 1)
        inner = a.columns[a.starts[top] : a.starts[end]]
        lengths = sizes[inner]
        before = _bounds(lengths)
        at = np.arange(before[-1]) + np.repeat(b.starts[inner] - before[:-1], lengths)
        owners = np.repeat(np.arange(top, end), np.diff(a.starts[top : end + 1]))
        keys = np.repeat(owners, lengths) * b.width + b.columns[at]
        if len(keys):
            if (keys[1:] < keys[:-1]).any():
                keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            found = keys[first]
            yield found // b.width, found % b.width, np.diff(np.append(first, len(keys)))
        top = end


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Tokens × bytes, for tokens that tile the bytes."""
    starts = _bounds(lengths)
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def group_incidence(a: Csr, b: Csr) -> tuple[Csr, Csr]:
    """Tokens × groups, for two tilings of the same bytes; a group ends where tokens of both end."""
    ends_a, ends_b = np.zeros(a.width, bool), np.zeros(a.width, bool)
    ends_a[a.starts[1:] - 1] = True
    ends_b[b.starts[1:] - 1] = True
    common = _bounds(ends_a & ends_b)
    groups = int(common[-1])
    return tuple(  # type: ignore[return-value]
        Csr(np.arange(len(m.starts)), common[m.starts[1:] - 1], groups) for m in (a, b)
    )


def shared_group_links(in_a: Csr, in_b: Csr, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of tokens of one group, as entries of the product of the group incidences."""
    return product(in_a, transposed(in_b), cells)


# -- tokenizers --------------------------------------------------------------------------------------


class Vocabularies(NamedTuple):
    """The files of the byte-level tokenizer (A) and the SentencePiece model (B), as their bytes."""

    a: bytes
    b: bytes

    @staticmethod
    def read(a: str, b: str) -> Vocabularies:
        return Vocabularies(Path(a).read_bytes(), Path(b).read_bytes())


def _byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is visible, else the
    next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in visible]
    return {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers and the bytes of each of their ids."""

    def __init__(self, files: Vocabularies):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        described = json.loads(files.a)
        cut_a = described.get("pre_tokenizer") or {}
        # A cuts words off by the usual pattern, and no piece of B reaches over a space
        self.cuts = (
            (described.get("normalizer"), cut_a.get("type"), cut_a.get("add_prefix_space")) == (None, "ByteLevel", False)
            and cut_a.get("use_regex", True)
            and Pieces(files.b).plain
        )
        alphabet = _byte_alphabet()
        entries = {i: s for s, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(alphabet.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both, the ids of all texts and their bounds; none for a text that one does not give back."""
        spaced = [" " + x if x else "" for x in texts]
        listed = [
            [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)],
            self.b.encode(texts, num_threads=1),
        ]
        said = [x.encode("utf-8", "surrogatepass") for x in spaced]
        whole, starts = np.frombuffer(b"".join(said), np.uint8), _bounds(np.fromiter(map(len, said), np.int64, len(said)))
        found, lost = [], np.zeros(len(texts), bool)
        tables = (self.bytes_a, self.lengths_a), (self.bytes_b, self.lengths_b)
        for lists, (table, lengths) in zip(listed, tables, strict=True):
            bounds = _bounds(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids = np.fromiter(chain.from_iterable(lists), np.int64, bounds[-1])
            given = np.frombuffer(b"".join(map(table.__getitem__, ids.tolist())), np.uint8)
            ends = _bounds(lengths[ids])[bounds]
            found.append((ids, bounds))
            if not np.array_equal(ends, starts) or not np.array_equal(given, whole):
                for i in range(len(texts)):
                    lost[i] |= not np.array_equal(given[ends[i] : ends[i + 1]], whole[starts[i] : starts[i + 1]])
        if lost.any():
            found = [
                (ids[~np.repeat(lost, np.diff(bounds))], _bounds(np.where(lost, 0, np.diff(bounds)))) for ids, bounds in found
            ]
        return found


@lru_cache(maxsize=2)
def _loaded(files: Vocabularies) -> Tokenizers:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    return Tokenizers(files)


# -- alignment of some texts -------------------------------------------------------------------------


class Aligned(NamedTuple):
    """Tokens of several texts, one after the other, and their matrices."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    texts_a: np.ndarray  # tokens before each text
    texts_b: np.ndarray
    bytes_a: Csr
    bytes_b: Csr
    groups_a: Csr
    groups_b: Csr

    def group_bounds(self) -> np.ndarray:
        """Groups before each text, from the group of each text's last token."""
        if not len(self.ids_a):
            return np.zeros(len(self.texts_a), np.int64)
        ends = self.groups_a.columns[np.maximum(self.texts_a[1:] - 1, 0)] + 1
        return np.concatenate([[0], np.maximum.accumulate(np.where(np.diff(self.texts_a) > 0, ends, 0))])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Overlap links: token of A, token of B, shared bytes."""
        blocks = list(product(self.bytes_a, transposed(self.bytes_b)))
        return tuple(np.concatenate([x[i] for x in blocks] or [np.empty(0, np.int64)]) for i in range(3))  # type: ignore[return-value]


def align(tokenizers: Tokenizers, texts: list[str]) -> Aligned:
    (ids_a, texts_a), (ids_b, texts_b) = tokenizers.encode(texts)
    a, b = byte_incidence(tokenizers.lengths_a[ids_a]), byte_incidence(tokenizers.lengths_b[ids_b])
    return Aligned(ids_a, ids_b, texts_a, texts_b, a, b, *group_incidence(a, b))


@lru_cache(maxsize=1)
def _written_ids(most: int) -> tuple[list[str], ...]:
    return tuple([f"{i}{mark}" for i in range(most)] for mark in (",", "|", ";"))


def written_groups(found: Aligned, most: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids of each group, by its rows of the transposed incidences."""
    by_group = [transposed(m) for m in (found.groups_a, found.groups_b)]
    sizes = [np.diff(m.starts) for m in by_group]
    before = _bounds(sizes[0] + sizes[1])
    codes = np.empty(before[-1], np.int64)
    for side, (m, ids) in enumerate(zip(by_group, (found.ids_a, found.ids_b), strict=True)):
        at = np.arange(len(m.columns)) + np.repeat(before[:-1] + side * sizes[0] - m.starts[:-1], sizes[side])
        last = np.zeros(len(m.columns), np.int64)
        last[m.starts[1:] - 1] = side + 1
        codes[at] = ids[m.columns] + most * last
    marks = sum(_written_ids(most), [])
    words = list(map(marks.__getitem__, codes.tolist()))
    # texts are cut where their tokens are: both tilings of a text end together
    ends = found.texts_a + found.texts_b
    return ["".join(words[ends[i] : ends[i + 1]])[:-1] for i in range(len(ends) - 1)]


# -- the corpus --------------------------------------------------------------------------------------

_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
_LONGS, _INTS = (pa.list_(pa.int64()), T.ArrayType(T.LongType())), (pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))
_BLOB = (pa.binary(), T.BinaryType())
_SLICE = {  # column of a slice: its type in Arrow and in Spark
    "slice": (pa.int64(), T.LongType()),
    **dict.fromkeys(_COUNTS, _LONGS),
    "groups_sha256": (pa.list_(pa.string()), T.ArrayType(T.StringType())),
    "chunks": _INTS,
    "codes": _BLOB,
    "linked": _BLOB,
    "pair": _BLOB,
    "a": _INTS,
    "b": _INTS,
    "links": _LONGS,
}


# texts in which a space stands beside another white space, or at an end, or which have the mark itself
_UNCUT = rf"\s |[\v\x1c-\x1f\x85\p{{Z}}] |^ | $|{MARK}"


def chunks(texts: pa.Array, cuts: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Chunks before each text, a code per chunk, and the distinct chunks: what stands between spaces, or
    a whole text that cannot be cut. Each stands for itself with a space before it."""
    filled = np.asarray(pc.binary_length(texts)) > 0
    cut = filled & ~np.asarray(pc.match_substring_regex(texts, _UNCUT)) if cuts else np.zeros(len(texts), bool)
    lists = pc.split_pattern(texts.filter(pa.array(cut)), " ")
    coded = pc.dictionary_encode(lists.flatten())
    distinct = coded.dictionary.to_pylist()
    whole = np.flatnonzero(filled & ~cut)
    numbers = np.zeros(len(texts), np.int64)
    numbers[cut] = np.diff(np.asarray(lists.offsets))
    numbers[whole] = 1
    bounds = _bounds(numbers)
    codes = np.empty(bounds[-1], np.int64)
    alone = np.zeros(len(codes), bool)
    alone[bounds[whole]] = True
    codes[~alone] = np.asarray(coded.indices)
    codes[alone] = len(distinct) + np.arange(len(whole))
    return bounds, codes, distinct + texts.take(pa.array(whole)).to_pylist()


def _steps(texts: list[str], limit: int) -> Iterator[list[str]]:
    step, size = [], 0
    for text in texts:
        if step and size + len(text) > limit:
            yield step
            step, size = [], 0
        step.append(text)
        size += len(text)
    if step:
        yield step


def _sliced_up(tokenizers: Tokenizers, texts: pa.Array, number: int) -> dict:
    """One row of ``_SLICE``: what each text has, its chunks, and the id pairs of each distinct chunk."""
    most = max(len(tokenizers.bytes_a), len(tokenizers.bytes_b))
    bounds, codes, distinct = chunks(texts, tokenizers.cuts)
    counts: dict[str, list[np.ndarray]] = {name: [np.empty(0, np.int64)] for name in _COUNTS}
    written, linked = [], [np.empty(0, np.int64)]
    for step in _steps(distinct, STEP_BYTES):
        found = align(tokenizers, step)
        rows, columns, _ = found.links()
        n_a, n_b = np.diff(found.texts_a), np.diff(found.texts_b)
        owner = np.repeat(np.arange(len(step)), n_a)
        groups = np.diff(found.group_bounds())
        sizes = [np.bincount(m.columns, minlength=m.width) for m in (found.groups_a, found.groups_b)]
        shared = np.bincount(np.repeat(np.arange(len(step)), groups), sizes[0] * sizes[1], len(step))
        for name, values in zip(
            _COUNTS, (n_a, n_b, groups, np.bincount(owner[rows], minlength=len(step)), shared), strict=True
        ):
            counts[name].append(values.astype(np.int64))
        written += written_groups(found, most)
        linked.append(found.ids_a[rows] << 32 | found.ids_b[columns])
    each = {name: np.concatenate(values) for name, values in counts.items()}
    # a text with a chunk that is not given back has no tokens at all
    lost = _summed((each["n_a"] == 0).astype(np.int64), codes, bounds) > 0
    if lost.any():
        kept = ~np.repeat(lost, np.diff(bounds))
        bounds = _bounds(np.where(lost, 0, np.diff(bounds)))
        codes = codes[kept]
    pairs, place = np.unique(np.concatenate(linked), return_inverse=True)
    again = np.bincount(codes, minlength=len(distinct))  # how often each chunk comes
    said = map(written.__getitem__, codes.tolist())
    digests = [
        hashlib.sha256(";".join(islice(said, n)).encode()).hexdigest() if n else "" for n in np.diff(bounds).tolist()
    ]
    return {name: _summed(x, codes, bounds) for name, x in each.items()} | {
        "slice": number,
        "groups_sha256": digests,
        "chunks": np.diff(bounds).astype(np.int32),
        "codes": _packed(codes),
        "linked": _packed(each["n_links"]),
        "pair": _packed(place),
        "a": (pairs >> 32).astype(np.int32),
        "b": (pairs & 0xFFFFFFFF).astype(np.int32),
        "links": np.bincount(place, np.repeat(again, each["n_links"]), len(pairs)).astype(np.int64),
    }


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each, which the first byte says."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _summed(values: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the sum of ``values`` over its chunks."""
    return np.diff(_bounds(values[codes])[bounds])


def slices(docs: DataFrame, files: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per slice of texts: ids and counts of its documents, and its distinct id pairs."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", T.ArrayType(docs.schema["id"].dataType))])
    for name, (_, kind) in _SLICE.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(files)
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text", SLICE_BYTES):
            ids = batch.column(0)
            row = _sliced_up(tokenizers, texts_of(batch, "text"), number)
            number += 1
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            columns = [whole, *(pa.array([row[name]], kind) for name, (kind, _) in _SLICE.items())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *_SLICE])

    return docs.mapInArrow(run, schema)


def pair_counts(cut: DataFrame) -> DataFrame:
    """``(a, b, total, best)``: links of each id pair in the corpus, and whether none with the same ``b`` has more."""
    pairs = cut.select(F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("p.*")
    counts = pairs.groupBy("b", "a").agg(F.sum("links").alias("total"))
    # at most one row per id of A meets in a window
    return counts.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("b")))


def alignment_counts(docs: DataFrame, files: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the id, ``n_a, n_b, n_groups, n_links``, ``n_shared`` (shared-group links), ``n_best`` (links
    whose id pair is linked most often among those of its B id), ``count_sum`` (over the links, how
    often their id pair is linked in the corpus) and ``groups_sha256`` of the written groups."""
    cut = materialise(slices(docs, files, key, text), "token-slices")
    placed = cut.select("slice", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("slice", "place", "p.*")
    known = placed.join(pair_counts(cut), ["a", "b"]).select(F.col("slice").alias("part"), "place", "total", "best")
    kind = cut.schema["id"].dataType.elementType
    out = T.StructType(
        [T.StructField(key, kind)]
        + [T.StructField(name, T.LongType()) for name in (*_COUNTS, "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType())]
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        totals = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, np.int64)
        place = right["place"].to_numpy()
        totals[place] = right["total"].to_numpy()
        best[place] = right["best"].to_numpy().astype(np.int64)
        parts = []
        for i in range(left.num_rows):  # one
            row = left.slice(i, 1)
            flat = {x: row[x].combine_chunks().flatten() for x in ("id", *_COUNTS, "groups_sha256", "chunks")}
            codes, linked, pair = (_unpacked(row[x][0].as_py()) for x in ("codes", "linked", "pair"))
            ends, bounds = _bounds(linked), _bounds(flat["chunks"].to_numpy())
            sums = [_summed(np.diff(_bounds(x[pair])[ends]), codes, bounds) for x in (best, totals)]
            columns = [flat["id"], *(flat[x] for x in _COUNTS), *map(pa.array, sums), flat["groups_sha256"]]
            parts.append(pa.Table.from_arrays(columns, out.names))
        return pa.concat_tables(parts)

    cut = cut.select("slice", "id", *_COUNTS, "groups_sha256", "chunks", "codes", "linked", "pair")
    return cut.groupBy("slice").cogroup(known.groupBy("part")).applyInArrow(finish, out)


def aligned(docs: DataFrame, files: Vocabularies, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment of every document itself: ids and end bytes of the tokens (of ``" " + text``), the group of
    each, and the overlap links as places of tokens with their shared bytes, all as arrays."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    names = ("a_ids", "a_ends", "a_groups", "b_ids", "b_ends", "b_groups", "link_a", "link_b", "link_bytes")
    schema = T.StructType(
        [T.StructField(key, docs.schema["id"].dataType)] + [T.StructField(x, T.ArrayType(T.LongType())) for x in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(files)
        for batch in sliced(batches, "text", STEP_BYTES):
            found = align(tokenizers, texts_of(batch, "text").to_pylist())
            rows, columns, shared = found.links()
            n = batch.num_rows
            texts = found.texts_a, found.texts_b
            links = np.searchsorted(rows, texts[0])
            lists = []
            first_group = None
            for ids, m, groups, at in zip(
                (found.ids_a, found.ids_b), (found.bytes_a, found.bytes_b), (found.groups_a, found.groups_b), texts, strict=True
            ):
                sizes = np.diff(at)
                base = np.repeat(m.starts[at[:-1]], sizes)
                if first_group is None:  # of each text; those of B begin with the same
                    first_group = groups.columns[np.minimum(at[:-1], max(len(ids) - 1, 0))] if len(ids) else np.zeros(n, int)
                lists += [(ids, at), (m.starts[1:] - base, at), (groups.columns - np.repeat(first_group, sizes), at)]
            per_text = np.diff(links)
            lists += [(x - np.repeat(at[:-1], per_text), links) for x, at in ((rows, texts[0]), (columns, texts[1]))]
            lists.append((shared, links))
            arrays = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64())) for x, at in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    return docs.mapInArrow(run, schema)
