"""SentencePiece encoding with source spans, and decoding.

A text is normalised by the model's compiled character map: at every place the longest key of the
map that starts there is replaced, and each byte of the result remembers the source byte it comes
from. White space becomes the piece mark, the text is cut where no piece of the vocabulary can
reach across, byte-pair merges run once per distinct chunk of a batch, and every piece is projected
to the source bytes ``[begin, end)`` it stands for.

Defined cases: null and empty texts have no pieces and decode to the empty text; repeated rows give
repeated rows; other columns pass through, but one that has the name of a result is replaced by it.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from affinis.llm.batches import flat_array, making_room, sliced, texts_of

MARK = "▁"
CACHED_CHUNKS = 200_000
PIECE_BYTES = 2 << 20  # text bytes per result batch


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys and the strings they are replaced by."""

    def __init__(self, blob: bytes):
        self.units, self.strings = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        units = self.units
        if not units:
            return None
        found, node = None, self._jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Pieces:
    """A BPE model with byte fallback, read from the bytes of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = type(proto.pieces[0])
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or any(
            p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces
        ):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK if spec.escape_whitespaces else " "
        self.fallback, self.unknown = proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_id
        self.ids, self.scores, self.bytes = {}, {}, {}
        surfaces = []
        for i, p in enumerate(proto.pieces):
            surface = p.piece.replace(self.space, " ").encode()
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                surface = bytes([int(p.piece[1:-1], 16)])
            else:
                surface = proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b""
            surfaces.append(surface)
        self.marked = np.array([p.piece.startswith(self.space) for p in proto.pieces])
        self.control = np.array([p.type == kinds.CONTROL for p in proto.pieces])
        self.byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.length = np.array([len(s) for s in surfaces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        # Where no piece reaches across: before a mark that follows another character, and
        # around a character that no piece of two or more characters contains.
        self.splits = not any(self.space in p.lstrip(self.space) for p in self.ids)
        joined = set().union(*(set(p) for p in self.ids if len(p) > 1))
        self.lone_newline = "\n" not in joined
        self.plain = not self.map.units and self.dummy and not self.squeeze and self.splits
        self.cache: dict[str, list[int]] = {}
        self.library = None
        if self.plain:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_proto=model)

    # -- normalisation ---------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its UTF-8 bytes (and its end) the source byte."""
        data = text.encode("utf-8", "replace")
        out, source, at = [], [], 0
        previous_space = self.squeeze
        mark = self.space.encode()
        while at < len(data):
            taken = self.map.longest(data, at)
            if taken is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                taken = width, data[at : at + width]
            size, replaced = taken
            if self.squeeze:
                replaced = re.sub(b" +", b" ", replaced)
                if previous_space:
                    replaced = replaced.lstrip(b" ")
                previous_space = replaced.endswith(b" ") if replaced else previous_space
            if replaced:
                if not out and self.dummy:
                    out.append(mark)
                    source += [at] * len(mark)
                replaced = replaced.replace(b" ", mark)
                out.append(replaced)
                source += [at] * len(replaced)
            at += size
        end = len(data)
        if self.squeeze:
            while out and out[-1].endswith(mark):
                end = source[-len(mark)]
                out[-1] = out[-1][: -len(mark)]
                del source[-len(mark) :]
                if not out[-1]:
                    out.pop()
        return b"".join(out).decode(), [*source, end]

    # -- merges ----------------------------------------------------------------------------------

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk that no piece reaches out of: best-scoring pairs first, leftmost on ties."""
        symbols: list[str | None] = list(chunk)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        scores, heap = self.scores, []
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                heap.append((-score, i, symbols[i] + symbols[i + 1], i + 1))
        heapq.heapify(heap)
        count = len(symbols)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[j] < count:
                before[after[j]] = i
                score = scores.get(joined + symbols[after[j]])
                if score is not None:
                    heapq.heappush(heap, (-score, i, joined + symbols[after[j]], after[j]))
            if before[i] >= 0:
                k = before[i]
                score = scores.get(symbols[k] + joined)
                if score is not None:
                    heapq.heappush(heap, (-score, k, symbols[k] + joined, i))
        out = []
        for symbol in symbols:
            if symbol is not None:
                found = self.ids.get(symbol)
                if found is not None:
                    out.append(found)
                elif self.fallback:
                    out += [self.bytes[b] for b in symbol.encode()]
                else:
                    out.append(self.unknown)
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        found = self.cache.get(chunk)
        if found is None:
            if self.lone_newline and "\n" in chunk and len(chunk) > 1:
                parts = [x for x in re.split("(\n)", chunk) if x]
                found = [i for x in parts for i in self.chunk_ids(x)]
            else:
                found = self.merge(chunk)
                if len(chunk) <= 48:
                    if len(self.cache) >= CACHED_CHUNKS:
                        self.cache.clear()
                    self.cache[chunk] = found
        return found

    def known(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each distinct chunk, and the ids of all, flat. A chunk comes without the
        mark before it. Where the model's own normalisation changes nothing, the library's merges
        take all distinct chunks of the batch together and put that mark back."""
        if self.library is None:
            found = [self.chunk_ids(x) for x in distinct]
        else:
            found = self.library.encode(distinct, num_threads=1)
            for i, x in enumerate(distinct):
                if not x:  # a mark alone, which the library takes for an empty text
                    found[i] = self.merge(self.space)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))

    def chunks(self, normalised: str) -> list[str]:
        if not self.splits:
            return [normalised] if normalised else []
        s = re.escape(self.space)
        return re.findall(f"{s}+[^{s}]*|[^{s}]+", normalised)

    # -- encoding of a batch -----------------------------------------------------------------------

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row offsets, ids, begins and ends, flat over all texts."""
        rows = len(texts)
        special = np.ones(rows, bool)
        if self.plain:
            special = pc.match_substring_regex(texts, f"  |^ | $|{MARK}").to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        special &= ~empty
        easy = texts.filter(pa.array(~special & ~empty))
        lists = pc.split_pattern(easy, " ")
        coded = pc.dictionary_encode(lists.flatten())
        distinct = coded.dictionary.to_pylist()
        per_row = np.zeros(rows, np.int64)
        per_row[~special & ~empty] = np.diff(lists.offsets.to_numpy())
        codes = coded.indices.to_numpy().astype(np.int64)
        aligned: dict[int, list[int]] = {}
        if special.any():
            index = {x: i for i, x in enumerate(distinct)}
            own: dict[int, list[int]] = {}
            for row in np.flatnonzero(special):
                normalised, source = self.normalise(texts[row].as_py())
                found = []
                for chunk in self.chunks(normalised):
                    if self.library is not None:
                        chunk = chunk[1:].replace(self.space, " ")
                    code = index.setdefault(chunk, len(distinct))
                    if code == len(distinct):
                        distinct.append(chunk)
                    found.append(code)
                own[row], aligned[row] = found, source
                per_row[row] = len(found)
            merged, at = [], 0
            for row in range(rows):  # back into row order
                if row in own:
                    merged.append(np.array(own[row], np.int64))
                else:
                    merged.append(codes[at : at + per_row[row]])
                    at += per_row[row]
            codes = np.concatenate(merged) if merged else codes
        sizes, flat = self.known(distinct)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        lengths = sizes[codes] if len(codes) else np.empty(0, np.int64)
        stops = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat(first[codes] - stops[:-1], lengths) if len(codes) else np.empty(0, np.int64)
        ids = flat[gather + np.arange(stops[-1])] if stops[-1] else np.empty(0, np.int32)
        offsets = stops[np.concatenate([[0], np.cumsum(per_row)])]
        begins, ends = self.spans(offsets, ids, aligned)
        return offsets, ids, begins, ends

    def spans(self, offsets, ids, aligned) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes of each piece. Where nothing was replaced, a piece is as long as its source
        and only the mark that was put before the text stands for nothing."""
        reach = np.cumsum(self.length[ids])
        starts = np.concatenate([[0], reach])[offsets[:-1]]
        per_row = np.diff(offsets)
        ends = reach - np.repeat(starts, per_row) - 1
        begins = ends - self.length[ids]
        begins[offsets[:-1][per_row > 0]] = 0
        for row, source in aligned.items():
            lo, hi = offsets[row], offsets[row + 1]
            own = ids[lo:hi]
            widths = [len(x) for x in self.normal_bytes(own)]
            stops = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
            at = np.array(source, np.int64)[stops]
            begins[lo:hi], ends[lo:hi] = at[:-1], at[1:]
        return begins.astype(np.int32), ends.astype(np.int32)

    def normal_bytes(self, ids) -> list[bytes]:
        space = self.space.encode()
        return [
            x if self.byte[i] else x.replace(b" ", space)
            for i in ids
            for x in [self.surface[self.start[i] : self.start[i] + self.length[i]].tobytes()]
        ]

    # -- decoding --------------------------------------------------------------------------------

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of the rows; bytes that are no UTF-8 become replacement characters."""
        lengths = self.length[ids]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.repeat(self.start[ids] - stops[:-1], lengths) + np.arange(stops[-1])
        data = self.surface[gather].tobytes()
        # a control piece says nothing, but bytes do not join across it
        controls = np.concatenate([[0], np.cumsum(self.control[ids])])
        silent = controls[offsets[1:]] > controls[offsets[:-1]]
        out = []
        for row in range(len(offsets) - 1):
            lo, hi = offsets[row], offsets[row + 1]
            if lo == hi:
                out.append("")
                continue
            skip = 0
            if self.dummy or self.squeeze:
                head = lo
                while head < hi - 1 and self.control[ids[head]]:
                    head += 1
                skip = int(self.marked[ids[head]])
            raw = data[stops[lo] + skip : stops[hi]]
            try:
                out.append(raw.decode() if not silent[row] else self._decode_runs(ids[lo:hi], skip))
            except UnicodeDecodeError:
                out.append(self._decode_runs(ids[lo:hi], skip))
        return out

    def _decode_runs(self, ids, skip: int) -> str:
        """Byte pieces join with each other only; each byte that is part of no character is replaced."""
        out, run = [], b""
        for i in ids:
            surface = self.surface[self.start[i] : self.start[i] + self.length[i]].tobytes()
            if self.byte[i]:
                run += surface
                continue
            out += [_replaced(run), surface.decode()]
            run = b""
        return "".join([*out, _replaced(run)])[skip:]


def _replaced(run: bytes) -> str:
    out = []
    while run:
        for width in (1, 2, 3, 4):
            try:
                out.append(run[:width].decode())
                run = run[width:]
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            run = run[1:]
    return "".join(out)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def model_bytes(path: str) -> bytes:
    """The model file, read where the plan is made and sent along with it (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def _list(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encode(df: DataFrame, model: bytes, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``, ``begins`` and ``ends`` (arrays of int, one entry per piece).

    With ``decoded``, a column of that name holds the text that the ids decode to.
    """
    ints = T.ArrayType(T.IntegerType(), False)
    fields = [T.StructField(x, ints, False) for x in ("ids", "begins", "ends")]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))
    df = making_room(df, [f.name for f in fields], [text])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in sliced(batches, text, PIECE_BYTES):
            offsets, ids, begins, ends = pieces.encode(texts_of(batch, text))
            columns = [*batch.columns, *(_list(offsets, x) for x in (ids, begins, ends))]
            names = [*batch.schema.names, "ids", "begins", "ends"]
            if decoded:
                columns.append(pa.array(pieces.decode(offsets, ids), pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids; null ids decode to the empty text."""
    df = making_room(df, [out], [ids])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            lists = flat_array(batch.column(batch.schema.get_field_index(ids)))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            found = pieces.decode(offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)
