"""Personal data in texts, disguised or plain, as spans of the source.

Base identifiers are found in the text itself. A text that holds a disguise also runs through
transducers: look-alike characters become the ASCII letter or digit they resemble, invisible
characters vanish, spelled digits become digits, and ``at`` and ``dot`` in brackets, or as words in
the shape of an address, become their signs. Each rewritten piece remembers its source characters.
Identifiers found in the result that touch a rewritten piece are mapped back and added.

Defined cases: null and empty texts have no spans; repeated rows give repeated rows; other columns
pass through, but one that has the name of the result is replaced by it.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from affinis.llm.spans import Covered, Found, character_starts, with_spans

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base forms. ``++`` never gives back what it took, so long runs stay linear
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
PART_MOST = 255
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
CARD_DIGITS = (12, 19)
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_DIGITS = (9, 15)
# end of fixed values

# fixed values: letters of other scripts that look like an ASCII letter
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х",
    "y": "уγ", "@": "﹫", ".": "․。﹒", "-": "‐‑‒–−﹣", "+": "﹢",
}
INVISIBLE = "­​‌‍⁠﻿"
# all country codes, and generic endings; other words after a worded dot are prose
COUNTRY_ENDS = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg "
    "ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi "
    "gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky "
    "kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl "
    "no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr "
    "ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za "
    "zm zw"
).split()
GENERIC_ENDS = (
    "com org net edu gov mil int arpa info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev page blog "
    "shop store online site website web tech technology cloud space xyz club live life news world email mail company agency digital "
    "group team work works today top vip wiki win icu one software systems solutions services support network media studio design "
    "zone ltd inc llc gmbh bank finance health care law legal consulting academy school university foundation church social chat "
    "berlin london paris tokyo nyc wien hamburg koeln bayern amsterdam brussels quebec scot wales bzh eus gal swiss"
).split()
WORDED_ENDS = frozenset(COUNTRY_ENDS + GENERIC_ENDS)
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
# end of fixed values

SIMILAR = {ord(x): plain for plain, others in LOOKALIKES.items() for x in others}
SIMILAR |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full width
SIMILAR |= {0x1D7CE + i: str(i % 10) for i in range(50)}  # mathematical digits
SIMILAR |= {0x1D400 + i: chr((65 if i % 52 < 26 else 71) + i % 52) for i in range(13 * 52)}
SIMILAR |= dict.fromkeys(map(ord, INVISIBLE), "")

_OTHER = re.compile("[" + re.escape("".join(map(chr, SIMILAR))) + "]")
_OTHER_BYTES = re.compile(rb"[\xce-\xd6]|\xc9\xa1|\xc2\xad|\xe2\x80|\xe2\x81|\xe2\x88|\xe3\x80\x82|\xef[\xb9\xbb-\xbd]|\xf0\x9d")
_NUMBER = "(?:" + "|".join(DIGIT_WORDS) + ")"
# Between two numbers of a run stand signs, or a dot as a word or in brackets, which is rewritten later.
_SIGNS = r"[\s().,\-\[\]{}<>]"
_SPELLED = re.compile(
    rf"(?i)(?<![^\W_])(?:plus[\s,-]++)?(?:{_NUMBER}|[0-9]++)(?:{_SIGNS}++(?:dot{_SIGNS}++)?(?:{_NUMBER}|[0-9]++))+(?![^\W_])"
)
# Digit words that follow each other are joined; a comma or line break between one and a figure is a space.
_SPELLED_WORD = re.compile(
    rf"(?i)plus[\s,-]+|{_NUMBER}(?:[\s,-]+(?={_NUMBER}))?|(?<=[a-z])[\s,]+(?=[0-9])|(?<=[0-9])[\s,]++(?={_NUMBER})"
)
_SPELLED_BYTES = re.compile((r"[^a-z0-9](?:" + "|".join(DIGIT_WORDS) + r")(?![a-z])").encode())
_SPELLED_FIRST = re.compile(("(?:" + "|".join(DIGIT_WORDS) + ")(?![a-z])").encode())
_BRACKETED = re.compile(r"(?i)(?:(?<!\s)\s++)?[\[({<]\s*(at|dot)\s*[\])}>]\s*")
_BRACKETED_BYTES = re.compile(rb"[\[({<]\s*(?:at|dot)\s*[\])}>]")
_DOT = r"(?:\s+dot\s+|\s*[\[({<]\s*dot\s*[\])}>]\s*)"
_WORDED_AT = re.compile(r"(?i)(?<=[A-Za-z0-9])(\s+at\s+)([A-Za-z0-9-]++)")
_LINK = re.compile(rf"(?i)(\.|{_DOT})([A-Za-z0-9-]++)")
# A local part that cannot be a word of prose, and the bytes of one before a worded sign
_JOINED = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?=[0-9._%+-]*[a-z])[A-Za-z0-9%-]+(?:(?:[._+]|{_DOT})[A-Za-z0-9%-]+)+\Z")
_JOINED_STEP = 80  # characters before a worded sign that are looked at, more while they belong to one word
_LOCAL_TEXT = frozenset(map(chr, LOCAL))
_JOINED_BYTES = re.compile(rb"[._+][a-z0-9%-]++\s++at\s")
_WORDED_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])(\s+dot\s+)(?=[A-Za-z0-9])")

Edit = tuple[int, int, str]


def luhn(digits: bytes) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = (char - 48) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(data: bytes) -> bytes:
    return bytes(c for c in data if 48 <= c <= 57)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain identifiers, in bytes."""
    found = []
    last, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > last and data[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(data, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            last = match.end()
        at = data.find(b"@", max(at + 1, last))
    for match in IP.finditer(data):
        if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= PART_MOST for p in match.group().split(b".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(data):
        if match.end() - match.start() >= CARD_DIGITS[0]:
            digits = _digits(match.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append((match.start(), 2, match.end()))
    if b"+" in data:
        for match in PHONE.finditer(data):
            if PHONE_DIGITS[0] <= len(_digits(match.group())) <= PHONE_DIGITS[1]:
                found.append((match.start(), 3, match.end()))
    return found


def transduce(text: str, edits: list[Edit]) -> tuple[str, list[int], list[int], list[int]]:
    """The text after ``edits`` (sorted, disjoint), and per run of it: where the run starts there,
    where it starts in the source, and how long its source is (-1: copied)."""
    out, starts, sources, widths = [], [], [], []
    at = length = 0
    for start, end, new in [*edits, (len(text), len(text), "")]:
        for source, piece, width in ((at, text[at:start], -1), (start, new, end - start)):
            if piece or width > 0:
                starts.append(length)
                sources.append(source)
                widths.append(width)
                out.append(piece)
                length += len(piece)
        at = end
    return "".join(out), starts, sources, widths


class Rewritten:
    """A text with the source place of each of its characters, through any number of edits."""

    def __init__(self, text: str):
        self.text, self.layers = text, []

    def apply(self, edits: list[Edit]) -> None:
        if edits:
            self.text, *layer = transduce(self.text, edits)
            self.layers.append(layer)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of ``[start, end)`` and whether it touches a rewritten piece."""
        touched = False
        for starts, sources, widths in reversed(self.layers):
            first, final = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            touched |= any(width >= 0 for width in widths[first : final + 1])
            begin = sources[first] + (start - starts[first] if widths[first] < 0 else 0)
            stop = sources[final] + (end - starts[final] if widths[final] < 0 else widths[final])
            start, end = begin, stop
        return start, end, touched


def _joined_from(text: str, end: int) -> int:
    start = max(0, end - _JOINED_STEP)
    while start and text[start - 1] in _LOCAL_TEXT:
        start -= 1
    return start


def worded_signs(text: str) -> list[Edit]:
    """``at`` as a word before a domain. A domain with a dot as a word or in brackets ends in a known ending,
    or in any letters after a bracketed dot; before one with plain dots only, the local part is a joined one."""
    edits = []
    for match in _WORDED_AT.finditer(text):
        worded, place = False, match.end()
        while link := _LINK.match(text, place):
            sign, end = link.group(1), link.group(2).lower()
            place = link.end()
            worded |= sign != "."
            bracketed = sign.strip()[0] in "[({<"
            if end in WORDED_ENDS or end.startswith("xn--") or (bracketed and len(end) > 1 and end.isalpha()):
                start = match.start(1)
                if worded or _JOINED.search(text[_joined_from(text, start) : start]):
                    edits.append((*match.span(1), "@"))
                    break
    return edits


def deobfuscated(text: str) -> Rewritten:
    """The text after all transducers."""
    result = Rewritten(text)
    result.apply([(m.start(), m.end(), SIMILAR[ord(m.group())]) for m in _OTHER.finditer(text)])
    edits = []
    for run in _SPELLED.finditer(result.text):
        for m in _SPELLED_WORD.finditer(run.group()):
            word = m.group().strip(" \t\r\n\f\v,-").lower()
            new = "+" if word == "plus" else str(DIGIT_WORDS.index(word)) if word in DIGIT_WORDS else " "
            edits.append((run.start() + m.start(), run.start() + m.end(), new))
    result.apply(edits)
    signs = {"at": "@", "dot": "."}
    worded = worded_signs(result.text)
    worded += [(*m.span(1), ".") for m in _WORDED_DOT.finditer(result.text)]
    worded += [(*m.span(), signs[m.group(1).lower()]) for m in _BRACKETED.finditer(result.text)]
    result.apply(sorted(worded))
    return result


def disguised(data: bytes) -> bool:
    """Whether any transducer could change the text."""
    low = data.lower()
    return bool(
        (not data.isascii() and _OTHER_BYTES.search(data))
        or b" dot" in low
        or b"\ndot" in low
        or b"\tdot" in low
        or _BRACKETED_BYTES.search(low)
        or _JOINED_BYTES.search(low)
        or _SPELLED_BYTES.search(low)
        or _SPELLED_FIRST.match(low)
    )


def scan(data: bytes) -> Found:
    """Base spans of one text, and those its disguises hide, in bytes of the source."""
    base = base_spans(data)
    found = [(start, kind, end, False) for start, kind, end in base]
    if disguised(data):
        text = data.decode("utf-8", "replace")
        result = deobfuscated(text)
        if result.layers:
            place = character_starts(data)
            plain = result.text.encode("utf-8", "replace")
            points = character_starts(plain)
            known = [Covered((s, e) for s, k, e in base if k == kind) for kind in range(len(KINDS))]
            new = base_spans(plain)
            at = np.searchsorted(points, [x for start, _, end in new for x in (start, end)]).tolist()
            for i, (_, kind, _) in enumerate(new):
                begin, stop, touched = result.source(at[2 * i], at[2 * i + 1])
                begin, stop = int(place[begin]), int(place[stop])
                if touched and not known[kind](begin, stop):
                    found.append((begin, kind, stop, True))
    return found


def find_private(df: DataFrame, text: str = "text", out: str = "private") -> DataFrame:
    """``df`` with the array ``out`` of ``(kind, start, end, added)``, in code points."""
    return with_spans(df, scan, KINDS, text, out)
