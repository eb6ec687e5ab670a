"""Chat formatting: records of many layouts to canonical turns, and turns to training text.

The fingerprint of a record is a hash of its nested field paths (``messages[].role``). It selects a
declarative mapping, which says where turns are and which role each text has. Turns are written by a
template whose control strings are escaped inside roles and texts, so that the output can be read
back, and carry the span that counts for the loss.

Defined cases: records that are null, no JSON object, or of a fingerprint without mapping give one
row with a null ``layout``, role and text; null texts and roles are empty; a record without turns
gives no rows; repeated records give repeated rows; a column of the input that has the name
of a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.batches import making_room

# -- layouts ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``single``: pairs of role and field, in order. ``each``: a list field whose entries have
    ``role`` and ``text`` fields; ``roles`` renames the roles found there. ``optional`` fields may
    be missing or null.
    """

    name: str
    single: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    append: tuple[tuple[str, str], ...] = ()  # a field whose text is added to that of another

    def paths(self) -> Iterator[frozenset[str]]:
        fixed = [field for _, field in self.single] + [extra for extra, _ in self.append]
        if self.each:
            fixed += [self.each]
        always = [x for x in fixed if x not in self.optional]
        inner = [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"] if self.each else []
        for size in range(len(self.optional) + 1):
            for some in combinations(self.optional, size):
                yield frozenset([*always, *some, *inner])
                if inner:
                    yield frozenset([*always, *some])  # no entries

    def turns(self, record: dict[str, Any]) -> Iterator[tuple[str, str]]:
        extra = {to: record.get(field) for field, to in self.append}
        for role, field in self.single:
            text = record.get(field)
            if text is None and field in self.optional:
                continue
            parts = [text, extra.get(field)]
            yield role, "\n\n".join(_text(x) for x in parts[:1] + [x for x in parts[1:] if x])
        names = dict(self.roles)
        for entry in (record.get(self.each) or []) if self.each else []:
            entry = entry if isinstance(entry, dict) else {}
            role = _text(entry.get(self.role))
            yield names.get(role, role), _text(entry.get(self.text))


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Mapping("prompt", (("user", "prompt"),)),
    Mapping("system", (("system", "system"),)),
    Mapping("completion", (("assistant", "completion"),)),
    Mapping("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Mapping(
        "instruction",
        (("system", "system"), ("user", "instruction"), ("assistant", "output")),
        optional=("system", "input"),
        append=(("input", "instruction"),),
    ),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer"))),
    Mapping("messages", (("system", "system"),), each="messages", optional=("system",)),
    Mapping("speakers", (("system", "system"),), "conversations", "from", "value", SPEAKERS, optional=("system",)),
    Mapping("nested_messages", each="turns", role="author", text="text", roles=SPEAKERS),
)


def paths_of(value: Any, at: str = "") -> set[str]:
    """Nested field paths; lists add ``[]``, nulls and empty lists have no inner paths."""
    out: set[str] = set()
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{at}.{key}" if at else key
            if not isinstance(inner, dict) or not inner:
                out.add(path)
            out |= paths_of(inner, path)
    elif isinstance(value, list):
        for inner in value:
            out |= paths_of(inner, f"{at}[]")
    return out


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): layout for layout in reversed(LAYOUTS) for paths in layout.paths()}


def canonical_turns(df: DataFrame, record: str = "record", mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """One row per turn: the other columns of ``df``, then ``layout, part, role, text``.

    ``part`` numbers the turns of a record from 0.
    """
    known = MAPPINGS if mappings is None else mappings
    added = [
        T.StructField("layout", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
    df = making_room(df, [f.name for f in added], [record])
    kept = [f for f in df.schema.fields if f.name != record]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, layouts, parts, roles, texts = [], [], [], [], []
            for i, value in enumerate(batch.column(batch.schema.get_field_index(record))):
                found: list[tuple[str | None, int | None, str | None, str | None]]
                try:
                    parsed = json.loads(value.as_py() or "null")
                    layout = known.get(fingerprint(paths_of(parsed))) if isinstance(parsed, dict) else None
                except (ValueError, RecursionError):
                    layout = None
                if layout is None:
                    found = [(None, None, None, None)]
                else:
                    found = [(layout.name, j, role, text) for j, (role, text) in enumerate(layout.turns(parsed))]
                for name, part, role, text in found:
                    rows.append(i)
                    layouts.append(name)
                    parts.append(part)
                    roles.append(role)
                    texts.append(text)
            index = pa.array(rows, pa.int64())
            columns = [batch.column(batch.schema.get_field_index(f.name)).take(index) for f in kept]
            columns += [pa.array(layouts, pa.string()), pa.array(parts, pa.int32())]
            columns += [pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in [*kept, *added]])

    return df.mapInArrow(run, T.StructType([*kept, *added]))


# -- template -----------------------------------------------------------------------------------

OPEN, ROLE, TEXT, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
CONTROL = (OPEN, ROLE, TEXT, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRSTS = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escaped(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of every control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_FIRSTS})", r"$1\\")


_ESCAPE = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(
    f"{re.escape(OPEN)}{re.escape(ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(CLOSE)}", re.DOTALL
)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def formatted(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """``turns`` with ``segment`` and the span ``[loss_start, loss_end)`` of it that counts for the
    loss, empty for turns of other roles. The segments of a conversation follow each other."""
    turns = making_room(turns, ["segment", "loss_start", "loss_end"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN + ROLE), escaped(role), F.lit(TEXT))
    start = F.length(head)
    return turns.withColumns(
        {
            "segment": F.concat(head, escaped(text), F.lit(CLOSE)),
            "loss_start": start,
            "loss_end": start + F.when(role == learned, F.length(escaped(text))).otherwise(0),
        }
    )


def read_segments(segment: str) -> list[tuple[str, str]]:
    """Roles and texts of one or more segments."""
    return [(unescaped(role), unescaped(text)) for role, text in _SEGMENT.findall(segment)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame, order: list[str]) -> DataFrame:
    """What each conversation says when its segments are read back, as ``DIGEST``.

    Rows are dealt by conversation and sorted; a task reads them as a stream and keeps the state of
    one hash at a time, so a conversation of any length needs no memory.
    """
    columns = ["conv_id", *order, "segment", "loss_start", "loss_end"]
    dealt = segments.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", *order, "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current: Any = None

        def flush(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names
            )

        def done(state):
            conv, turns, all_hash, chars, loss_hash, length = state
            return conv, turns, all_hash.hexdigest(), chars, loss_hash.hexdigest(), length

        for batch in batches:
            rows = []
            for row in batch.select(["conv_id", "segment", "loss_start", "loss_end"]).to_pylist():
                if current is None or current[0] != row["conv_id"]:
                    if current is not None:
                        rows.append(done(current))
                    current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                segment = row["segment"]
                for role, text in read_segments(segment):
                    current[1] += 1
                    current[2].update(f"{role}\n{text}\n".encode())
                loss = unescaped(segment[row["loss_start"] : row["loss_end"]])
                current[3] += len(loss)
                current[4].update(loss.encode())
                current[5] += len(segment)
            yield flush(rows)
        yield flush([] if current is None else [done(current)])

    return dealt.mapInArrow(run, DIGEST)
