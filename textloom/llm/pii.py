"""Personal data in texts, plain and disguised, at exact source positions.

Plain identifiers are matched in the text as it is. Disguised ones are found by a
transducer that rewrites the text and keeps, for every piece it writes, the source
span it came from:

* letters of other scripts that look like Latin ones, and full-width or other decimal
  digits, become ASCII; zero-width characters go;
* "(at)", "[dot]" and the like become @ and . ; without brackets " dot " does so only before
  a digit or where the labels end in a known last one, and " at " only before such a
  domain and not after a word that stands before "at" in prose;
* runs of spelled digits, "plus" before them, become digits.

The same patterns then run over the rewritten text. A match that used a rewritten piece
is mapped back and added, unless plain ones cover it already. Plain matches always stay,
also where an added one goes further.

Positions are code points, end exclusive. Defined cases: null and empty texts have no
spans; very long texts take linear time, since each pattern starts only at the
beginning of a run of its own characters. Rows are independent.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o",
    "р": "p", "ѕ": "s", "х": "x", "у": "y", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_WORD = {w: str(i) for i, w in enumerate(DIGIT_WORDS)} | {"oh": "0"}
_NUMBER = "|".join(_WORD)
# Last labels that a domain spelled without brackets must end in.
LAST_LABELS = (
    "com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "me", "app", "dev", "eu", "uk", "de", "fr", "es", "it", "nl", "pl", "pt", "at", "ch",
    "be", "se", "no", "fi", "dk", "cz", "tr", "ru", "us", "ca", "br", "mx", "in", "jp", "cn", "au", "nz", "za", "test", "example",
)
# Words that stand before "at" in prose, and so are no local part when nothing is bracketed.
BEFORE_AT = frozenset(
    "a about all am an and are arrive arrived arrives be been but do down eat go good he her here him home i in is it keep laugh laughed live lived "
    "lives look looked looking looks me meet meets met not now off on one only or out over point pointed shop sit sits smile stand stands stare stared "
    "start starts stay stayed stays stop stops that the them there they this to up us was we were work worked works you".split()
)
_ENDS = rf"(?:[a-z0-9-]+(?:\s{{1,3}}dot\s{{1,3}}|\.))*(?:{'|'.join(LAST_LABELS)})\b(?!\s{{1,3}}dot\s)"
_REWRITE = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}\s{{0,3}}at\s{{0,3}}{_CLOSE}\s{{0,3}}"
    rf"|(?<=[a-z0-9])\s{{1,3}}at\s{{1,3}}(?=[a-z0-9-]+(?:\s{{0,3}}{_OPEN}\s{{0,3}}dot\s{{0,3}}{_CLOSE}|\s{{1,3}}dot\s{{1,3}}{_ENDS})))"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}\s{{0,3}}(?:dot|\.)\s{{0,3}}{_CLOSE}\s{{0,3}}|(?<=[a-z0-9])\s{{1,3}}dot\s{{1,3}}(?=[0-9]|{_ENDS}))"
    rf"|(?P<plus>\bplus\s+(?=(?:{_NUMBER}|[0-9])))"
    rf"|(?P<digits>\b(?:{_NUMBER})\b(?:[\s,-]{{1,2}}(?:{_NUMBER})\b)*)"
    rf"|(?P<zero>[{ZERO_WIDTH}]+)"
    rf"|(?P<other>[{''.join(LOOKALIKES)}]|(?![0-9])\d|[！-～])",
    re.IGNORECASE,
)
_WORDS = re.compile(rf"\b(?:{_NUMBER})\b", re.IGNORECASE)
_PLUS = re.compile(rf"\bplus\s+(?:{_NUMBER}|[0-9])", re.IGNORECASE)
_ODD = re.compile(rf"[{ZERO_WIDTH}{''.join(LOOKALIKES)}！-～]|(?![0-9])\d", re.IGNORECASE)
_SIGN = re.compile(rf"{_OPEN}\s{{0,3}}(?:at|dot|\.)\s{{0,3}}{_CLOSE}", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the identifiers that stand as such in the text."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _may_hide(text: str) -> bool:
    """Whether the transducer would rewrite anything: never false where ``_REWRITE`` finds something."""
    if not text.isascii() and _ODD.search(text):
        return True
    return "dot" in text.lower() or bool(_SIGN.search(text) or _WORDS.search(text) or _PLUS.search(text))


def _last_word(text: str, end: int) -> str:
    """The word that ends at a place, in lower case; "" if it is no word of letters alone."""
    start = end
    while start > max(0, end - 12) and text[start - 1].isalpha():
        start -= 1
    return "" if start and (text[start - 1] in _LOCAL) else text[start:end].lower()


class Rewritten:
    """A text after the transducer, with the way back."""

    def __init__(self, text: str) -> None:
        self.pieces: list[str] = []
        self.at: list[int] = []  # where each piece begins in the new text
        self.source: list[tuple[int, int, bool]] = []  # its source span, and whether it was rewritten
        n = end = 0

        def put(piece: str, start: int, stop: int, new: bool) -> None:
            nonlocal n
            self.pieces.append(piece)
            self.at.append(n)
            self.source.append((start, stop, new))
            n += len(piece)

        for m in _REWRITE.finditer(text):
            if m.start() > end:
                put(text[end : m.start()], end, m.start(), False)
            kind, found = m.lastgroup, m[0]
            if kind == "at" and found.strip().isalpha() and _last_word(text, m.start()) in BEFORE_AT:
                new = found
            elif kind == "digits":
                new = "".join(_WORD[w.casefold()] for w in _WORDS.findall(found))
            elif kind == "other":
                new = LOOKALIKES.get(found) or (
                    str(unicodedata.decimal(found)) if found.isdecimal() else chr(ord(found) - 0xFEE0) if "！" <= found <= "～" else found
                )
            else:
                new = {"at": "@", "dot": ".", "plus": "+"}.get(kind or "", "")
            put(new, *m.span(), True)
            end = m.end()
        put(text[end:], end, len(text), False)
        self.text = "".join(self.pieces)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span of the new text, and whether it holds a rewritten piece."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, b = self.source[first], self.source[last]
        begin = a[0] if a[2] else a[0] + start - self.at[first]
        stop = b[1] if b[2] else b[0] + end - self.at[last]
        return begin, stop, any(s[2] for s in self.source[first : last + 1])


def find(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, added) in order of kind and start."""
    if not text:
        return []
    base = plain(text)
    out = [(*x, False) for x in base]
    if _may_hide(text):
        covered: list[tuple[int, int]] = []  # what plain spans cover, as spans of different kinds may overlap
        for s, e in sorted((s, e) for _, s, e in base):
            if covered and s <= covered[-1][1]:
                covered[-1] = covered[-1][0], max(e, covered[-1][1])
            else:
                covered.append((s, e))
        starts = [s for s, _ in covered]
        new = Rewritten(text)
        for kind, s, e in plain(new.text):
            begin, stop, rewritten = new.back(s, e)
            k = bisect_right(starts, begin)
            if rewritten and not (k and covered[k - 1][1] >= stop):
                out.append((kind, begin, stop, True))
    return sorted(out)


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, added>>) of every whole text; kind numbers ``KINDS``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "added"), x)) for x in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["id", "spans"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(
        run, f"id {kind}, spans array<struct<kind:int,start:int,end:int,added:boolean>>"
    ).withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    )


def mask(text: str | None, marks: tuple[str, ...] = ("<email>", "<ip>", "<card>", "<phone>")) -> str | None:
    """The text with each span replaced by a mark of its kind; overlapping spans become one mark."""
    if not text:
        return text
    out, end = [], 0
    for kind, start, stop, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= end:
            out += [text[end:start], marks[kind]]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in the text column masked; all other columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([mask(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
