"""Secrets in texts: three fixed forms, and strings of high entropy.

Candidate strings are runs of token characters. Inside a candidate, every maximal run of one
character class is read through a sliding window; the counts of the window change by one character
in and one out, and with them the sum of ``c * log2(c)`` from which its Shannon entropy follows. The
sum is kept in integers, so it does not drift. A window also has to be mixed, as words and numbers are not:
by its digits and letters, or by small and capital letters that change often. Windows that reach the
entropy of their class are joined to spans. An allow-list suppresses candidates that are public by their
form, and windows beside a word that marks an example; spans inside a base span are not repeated.

Defined cases: null and empty texts have no spans; repeated rows give repeated rows; other columns
pass through, but one that has the name of the result is replaced by it; a null text stays null when masked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from affinis.llm.batches import sliced
from affinis.llm.spans import Covered, Found, with_spans

BASE_KINDS = ("assign", "access", "hex")

# fixed values: the base forms
ASSIGN = re.compile(
    rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE,
)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ASSIGN_LENGTH = 8
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 16
HEX = re.compile(rb"[0-9a-f]{32,}")
# end of fixed values


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters, the width of its window in characters, and the least entropy in bits.

    A window is mixed if it has ``letters`` and ``digits`` that stand beside each other ``meetings`` times, which
    words, numbers, dates and paths lack; or, where ``capitals`` is set, that many small and as many capital
    letters, and ``changes`` between neighbours of different kinds (small, capital, digit), more than joined words have.
    """

    name: str
    pattern: re.Pattern[bytes]
    window: int
    bits: float
    letters: int = 2
    digits: int = 2
    meetings: int = 0
    capitals: int = 0
    changes: int = 0


CLASSES = (
    CharacterClass("hex_entropy", re.compile(rb"[0-9a-fA-F]{20,}"), 20, 2.9),
    CharacterClass("base64_entropy", re.compile(rb"[A-Za-z0-9+/]{24,}={0,2}"), 24, 3.9, digits=3, meetings=2, capitals=5, changes=8),
    CharacterClass("url64_entropy", re.compile(rb"[A-Za-z0-9_-]{24,}"), 24, 3.9, digits=3, meetings=2, capitals=5, changes=8),
)
KINDS = (*BASE_KINDS, *(c.name for c in CLASSES))
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")

# Strings that look random but are public by their form: tried against the whole candidate.
ALLOWED = (
    re.compile(rb"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    re.compile(rb"(?i)^sha(?:1|256|384|512)-"),
    re.compile(rb"(?i)^(?:example|sample|dummy|placeholder|changeme)[-_/=][^-_/=]+$"),
    re.compile(rb"^[A-Za-z]+(?:[-_/][A-Za-z]+)+[-_/]?[0-9]*$"),
)
# Words that mark an example: no window counts that touches the part, between separators, with such a word,
# as far as ``REACH`` characters from the word.
MARKS = re.compile(rb"(?i)example|sample|dummy|placeholder|changeme|xxxx|deadbeef|0123456789|abcdefghij")
SEPARATORS = b"-_/="
REACH = 64

_SCALE = 1 << 40
_WEIGHT = [0, 0]


def _weight(count: int) -> int:
    while len(_WEIGHT) <= count:
        c = len(_WEIGHT)
        _WEIGHT.append(round(c * math.log2(c) * _SCALE))
    return _WEIGHT[count]


# small letter, capital letter, digit, sign
_SORT = bytes(0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in range(256))
# for two neighbours: whether their kinds differ, and whether a letter meets a digit; signs do not count
_BESIDE = {(x, y): (x != y and 3 not in (x, y), 3 not in (x, y) and (x == 2) != (y == 2)) for x in range(4) for y in range(4)}


def entropy_spans(data: bytes, kind: CharacterClass) -> list[tuple[int, int]]:
    """Joined windows of ``data`` (all of one class) that are mixed and reach the entropy of the class."""
    width = kind.window
    if len(data) < width:
        return []
    # H = log2(w) - sum(c * log2 c) / w, so H >= bits is a bound on the sum
    most = math.floor((math.log2(width) - kind.bits) * width * _SCALE)
    _weight(width + 1)  # for a moment the window is one wider
    counts, total, sorts, changes, meetings = [0] * 256, 0, [0] * 4, 0, 0
    kinds = data.translate(_SORT)
    pairs = list(map(_BESIDE.__getitem__, zip(b"\3" + kinds, kinds)))  # with the character before
    out: list[tuple[int, int]] = []
    for i, char in enumerate(data):
        total += _WEIGHT[counts[char] + 1] - _WEIGHT[counts[char]]
        counts[char] += 1
        sorts[kinds[i]] += 1
        change, meeting = pairs[i]
        changes += change
        meetings += meeting
        if i >= width:
            gone = data[i - width]
            counts[gone] -= 1
            total -= _WEIGHT[counts[gone] + 1] - _WEIGHT[counts[gone]]
            sorts[kinds[i - width]] -= 1
            change, meeting = pairs[i - width + 1]
            changes -= change
            meetings -= meeting
        if i + 1 >= width and total <= most:
            small, capital, digit, _ = sorts
            if (small + capital >= kind.letters and digit >= kind.digits and meetings >= kind.meetings) or (
                kind.capitals and min(small, capital) >= kind.capitals and changes >= kind.changes
            ):
                start = i + 1 - width
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def marked_parts(text: bytes) -> list[tuple[int, int]]:
    """The parts of a candidate, between separators, that have a mark of an example, as far as they reach."""
    out: list[tuple[int, int]] = []
    for match in MARKS.finditer(text):
        start, end = match.span()
        least, most = max(0, start - REACH), min(len(text), end + REACH)
        while start > least and text[start - 1] not in SEPARATORS:
            start -= 1
        while end < most and text[end] not in SEPARATORS:
            end += 1
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _between(start: int, end: int, marked: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The pieces of ``[start, end)`` outside the marked parts."""
    for left, right in marked:
        if left >= end:
            break
        if right > start:
            if left > start:
                yield start, left
            start = max(start, right)
    if start < end:
        yield start, end


def scan(data: bytes) -> Found:
    """All spans of one text, in bytes: base spans first found per kind, then those added."""
    found: Found = []
    low = data.lower()  # of bytes: ASCII letters only
    if any(word in low for word in ASSIGN_WORDS):
        for match in ASSIGN.finditer(data):
            if match.end(1) - match.start(1) >= ASSIGN_LENGTH:
                found.append((match.start(), 0, match.end(), False))
    if b"AKIA" in data:
        for match in ACCESS.finditer(data):
            if match.end() - match.start() >= ACCESS_LENGTH:
                found.append((match.start(), 1, match.end(), False))
    for match in HEX.finditer(data):
        found.append((match.start(), 2, match.end(), False))
    base = [(start, end) for start, _, end, _ in found]
    known = Covered(base)
    for candidate in CANDIDATE.finditer(data):
        text, at = candidate.group(), candidate.start()
        if any(rule.search(text) for rule in ALLOWED):
            continue
        marked = marked_parts(text)
        added: list[tuple[int, int]] = []
        for number, kind in enumerate(CLASSES, len(BASE_KINDS)):
            earlier = Covered(added)  # of other classes: spans of one class do not touch
            for run in kind.pattern.finditer(text):
                for left, right in _between(run.start(), run.start() + len(run.group().rstrip(b"=")), marked):
                    for start, end in entropy_spans(text[left:right], kind):
                        start, end = start + left + at, end + left + at
                        if not known(start, end) and not earlier(start, end):
                            added.append((start, end))
                            found.append((start, number, end, True))
    return found


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with the array ``out`` of ``(kind, start, end, added)``, in code points."""
    return with_spans(df, scan, KINDS, text, out)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with ``mask`` for each span, one for those that overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", spans: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mask``; overlapping spans are masked as one. A null text
    stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            at = batch.schema.get_field_index(text)
            found = batch.column(batch.schema.get_field_index(spans))
            values = batch.column(at).to_pylist()
            for i, row in enumerate(found):
                if values[i] is not None and row.as_py():
                    values[i] = masked(values[i], [(s["start"], s["end"]) for s in row.as_py()], mask)
            columns = list(batch.columns)
            columns[at] = pa.array(values, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
