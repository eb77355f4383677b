"""Personal data and secrets behind disguises, with spans in the source text.

Detection runs on a normalised text that transducers make of the source, in this order:

1. homoglyphs: full-width, Cyrillic and Greek lookalikes and digits of other scripts become ASCII, invisible characters
   vanish;
2. spelled digits: runs of at least ``SPELLED`` number words (English, French, German, Spanish) become digits;
3. disguised signs: ``(at)``, ``[at]``, ``{at}`` and their kin become ``@``, ``(dot)`` and its kin ``.``; bare ``at`` and
   ``dot`` count only in a chain such as ``name at host dot com``.

Each transducer reports where it replaced what, and these edits compose to a map from every normalised position back to
the source, so that a span found in the normalised text is reported as source characters. Almost all texts have no
disguise; for these the map is the identity and costs nothing.
"""

from __future__ import annotations

import bisect
import bisect
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shredloom.llm.text import groups, lowered, segment_sums, words

SPELLED = 4

_SCRIPTS = {}
for _source, _target in (
    ("АВСЕНІЈКМОРЅТХаcсеһіјкморѕтхуӏԁԛԝ", "ABCEHIJKMOPSTXaccehijkmopstxylddw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεινοτυχ", "ABEZHIKMNOPTYXaeivotux"),
    ("ıɑɡƖ∂ⅼⅰⅽⅾⅿ", "iagldlicdm"),
    ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "012345678901234567890123456789"),
    ("․。｡·∙﹒．", "......."),
    ("＠﹫", "@@"),
    ("‐‑‒–—−﹣－", "--------"),
    ("\u00a0\u2007\u202f\u2009\u200a", "     "),
):
    _SCRIPTS |= {a: b for a, b in zip(_source, _target) if ord(a) > 127}
for _i in range(0x21, 0x7F):
    _SCRIPTS.setdefault(chr(0xFEE0 + _i), chr(_i))
for _i in range(10):
    for _base in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        _SCRIPTS[chr(_base + _i)] = str(_i)
for _i in range(26):
    for _base in (0x1D400, 0x1D5A0, 0x1D5D4, 0x1D670):
        _SCRIPTS[chr(_base + _i)] = chr(65 + _i)
        _SCRIPTS[chr(_base + 26 + _i)] = chr(97 + _i)
for _c in "\u200b\u200c\u200d\u2060\ufeff\u00ad":
    _SCRIPTS[_c] = ""
_GLYPH = re.compile("[" + "".join(re.escape(c) for c in _SCRIPTS) + "]")

_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}|\d{{1,4}})(?:[\s,.\-/]{{1,3}}(?:{_WORD}|\d{{1,4}})){{{SPELLED - 1},}}(?!\w)", re.I)
_ONE = re.compile(rf"{_WORD}(?!\w)|\d+", re.I)

_AT = r"\s*(?:\(\s*(?:at|arroba|@|ät)\s*\)|\[\s*(?:at|arroba|@|ät)\s*\]|\{\s*(?:at|arroba|@|ät)\s*\}|<\s*(?:at|@)\s*>|&#64;|&commat;|%40|[_-]at[_-](?=\w))\s*"
_DOT = r"\s*(?:\(\s*(?:dot|punkt|punto|point|\.)\s*\)|\[\s*(?:dot|punkt|punto|point|\.)\s*\]|\{\s*(?:dot|punkt|punto|point|\.)\s*\}|<\s*dot\s*>|&#46;|[_-]dot[_-](?=\w))\s*"
_SIGN = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_BARE_AT = r"\s+(?:at|arroba|ät)\s+|\s*@\s*"
_BARE_DOT = r"\s+(?:dot|punkt|punto|point)\s+|\s*\.\s*"
_CHAIN = re.compile(rf"(?<![\w.])[\w+%-]+(?:(?:\s+(?:dot|punkt|punto|point)\s+|\.)[\w+%-]+)*(?:{_BARE_AT})[a-z0-9-]+(?:(?:\s+(?:dot|punkt|punto|point)\s+|\.)[a-z0-9-]+)*(?:\s+(?:dot|punkt|punto|point)\s+|\.)[a-z]{{2,24}}(?!\w)", re.I)
_CHAIN_HINT = re.compile(r"\s(?:dot|punkt|punto|point)\s", re.I)
_CHAIN_SIGN = re.compile(r"\s+(?P<at>at|arroba|ät)\s+|\s*(?P<sign>@)\s*|\s+(?P<dot>dot|punkt|punto|point)\s+", re.I)

Edit = tuple[int, int, str]


class Aligned:
    """A text with the source position of each of its characters, kept as the runs between edits."""

    __slots__ = ("text", "at", "to", "width")

    def __init__(self, text: str) -> None:
        self.text = text
        # run i begins at ``at[i]`` in the text and ``to[i]`` in the source; ``width[i]`` is None where characters map one to
        # one, else how many source characters the whole run stands for
        self.at, self.to, self.width = [0], [0], [None]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span that ``text[start:end]`` stands for."""
        return self._source(start, False), self._source(end - 1, True)

    def _source(self, position: int, last: bool) -> int:
        i = bisect.bisect_right(self.at, position) - 1
        if self.width[i] is None:
            return self.to[i] + position - self.at[i] + last
        return self.to[i] + (self.width[i] if last else 0)

    def apply(self, edits: list[Edit]) -> None:
        """Replace spans of the text, in order and apart from each other, and compose the map."""
        if not edits:
            return
        parts, at, to, width = [], [], [], []
        done = size = 0

        def copy(lo: int, hi: int) -> None:
            nonlocal size
            i = bisect.bisect_right(self.at, lo) - 1
            while lo < hi:
                stop = min(hi, self.at[i + 1] if i + 1 < len(self.at) else hi)
                if stop > lo:
                    at.append(size)
                    if self.width[i] is None:
                        to.append(self.to[i] + lo - self.at[i])
                        width.append(None)
                    else:
                        to.append(self.to[i])
                        width.append(self.width[i])
                    parts.append(self.text[lo:stop])
                    size += stop - lo
                lo, i = stop, i + 1

        for lo, hi, new in edits:
            copy(done, lo)
            if new:
                a, b = self.source(lo, hi)
                at.append(size)
                to.append(a)
                width.append(b - a)
                parts.append(new)
                size += len(new)
            done = hi
        copy(done, len(self.text))
        self.text = "".join(parts)
        self.at, self.to, self.width = at or [0], to or [0], width or [None]


def _spelled(text: str) -> list[Edit]:
    edits = []
    for run in _SPELLED.finditer(text):
        parts = [m for m in _ONE.finditer(text, run.start(), run.end()) if m.start() == run.start() or not text[m.start() - 1].isalnum()]
        if sum(not m.group().isdigit() for m in parts) < 2:
            continue
        for m, after in zip(parts, [*parts[1:], None]):
            # a number takes the separator to the next one with it
            edits.append((m.start(), after.start() if after else m.end(), _DIGITS.get(m.group().lower(), m.group())))
    return edits


def _signs(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _SIGN.finditer(text)]


def _chains(text: str) -> list[Edit]:
    edits = []
    for chain in _CHAIN.finditer(text):
        if not _CHAIN_HINT.search(chain.group()):
            continue
        for m in _CHAIN_SIGN.finditer(text, chain.start(), chain.end()):
            edits.append((m.start(), m.end(), "." if m["dot"] else "@"))
    return edits


def _bracketed(low: str) -> bool:
    return any(c in low for c in "([{<&%") or "at-" in low or "dot-" in low or "at_" in low or "dot_" in low


class Hints:
    """For each row of a text column, whether it can hold what a step looks for; a step is skipped only where it can't."""

    def __init__(self, column: pa.Array) -> None:
        n = len(column)
        self.glyph, self.spelled, self.dot, self.digit = (np.zeros(n, bool) for _ in range(4))
        for g in groups(column):
            self.glyph[g.lo : g.hi] = segment_sums(_LEADS[g.data].astype(np.int64), g.offsets) > 0
            digit = (g.data >= 48) & (g.data <= 57)
            self.digit[g.lo : g.hi] = segment_sums(digit.astype(np.int64), g.offsets) > 0
        for g in groups(lowered(column)):
            w = words(g)
            row = g.lo + w.doc
            number = np.isin(w.hash, _NUMBERS)
            self.dot[row[np.isin(w.hash, _DOTS)]] = True
            digits = np.concatenate([[0], np.cumsum((g.data >= 48) & (g.data <= 57))])
            size = w.end - w.start
            part = number | ((digits[w.end] - digits[w.start] == size) & (size <= 4))
            # a run of SPELLED parts that holds a number word: count parts in every window of that many words
            if len(part) >= SPELLED:
                total = np.concatenate([[0], np.cumsum(part)])
                some = np.concatenate([[0], np.cumsum(number)])
                full = (total[SPELLED:] - total[:-SPELLED] == SPELLED) & (some[SPELLED:] > some[:-SPELLED])
                at = np.flatnonzero(full & (row[SPELLED - 1 :] == row[: len(row) - SPELLED + 1]))
                self.spelled[row[at]] = True
        for flag in (self.spelled, self.dot, self.digit):
            flag |= self.glyph


def _hashes(values: list[str]) -> np.ndarray:
    return words(next(groups(pa.array(values)))).hash


_NUMBERS, _DOTS = _hashes(list(_DIGITS)), _hashes(["dot", "punkt", "punto", "point"])
_LEADS = np.zeros(256, bool)
_LEADS[[c.encode()[0] for c in _SCRIPTS]] = True


def normalise(text: str, glyph: bool = True, spelled: bool = True, dot: bool = True) -> Aligned:
    """The text without disguises, aligned with the source."""
    a = Aligned(text)
    if glyph and _GLYPH.search(text):
        a.apply([(m.start(), m.end(), _SCRIPTS[m.group()]) for m in _GLYPH.finditer(text)])
    if spelled:
        a.apply(_spelled(a.text))
    if _bracketed(a.text.lower()):
        a.apply(_signs(a.text))
    if dot:
        a.apply(_chains(a.text))
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(value: str) -> bool:
    v = re.sub(r"\s", "", value).upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]?\d{3,4}(?![\w]|[.-]\d)|(?<!\w)\+\d{8,15}(?!\w)|(?<![\w.+-])0?\d{10,11}(?![\w-]|\.\d)")
_NUMBER = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){11,18}(?![\w-]|\.\d)")
_SECRET = re.compile(r"(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key|auth)\b)\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/=.]{8,})[\"']?")
_KEY = re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,})")
_SECRET_HINTS = ("key", "secret", "token", "passw", "auth", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyj")


def identifiers(text: str, digit: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the identifiers in a normalised text; of overlapping ones the first kind listed wins."""
    found: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        at = bisect.bisect_left(found, (start,))  # what is found is in order and apart: only its neighbours can overlap
        if (at == len(found) or end <= found[at][0]) and (at == 0 or start >= found[at - 1][1]):
            found.insert(at, (start, end, kind, text[start:end]))

    low = text.lower()
    if any(x in low for x in _SECRET_HINTS):
        for m in _KEY.finditer(text):
            add(m.start(), m.end(), "secret")
        for m in _SECRET.finditer(text):
            if re.search(r"\d", m[1]):
                add(m.start(1), m.end(1), "secret")
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if digit:
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m.group().split(".")):
                add(m.start(), m.end(), "ip")
        for m in _IBAN.finditer(text):
            if iban(m.group()):
                add(m.start(), m.end(), "iban")
        for m in _SSN.finditer(text):
            add(m.start(), m.end(), "ssn")
        for m in _NUMBER.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            add(m.start(), m.end(), "card" if 13 <= len(digits) <= 19 and luhn(digits) else "number")
        for m in _PHONE.finditer(text):
            if 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                add(m.start(), m.end(), "phone")
        if text.count(":") >= 2:
            for m in _IPV6.finditer(text):
                try:
                    ipaddress.IPv6Address(m.group())
                except ValueError:
                    continue
                if sum(c.isalnum() for c in m.group()) >= 4:
                    add(m.start(), m.end(), "ip")
    return found


def detect(text: str, glyph: bool = True, spelled: bool = True, dot: bool = True, digit: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) with spans in characters of the source text; flags as in :class:`Hints`."""
    a = normalise(text, glyph, spelled, dot)
    return [(*a.source(s, e), kind, value) for s, e, kind, value in identifiers(a.text, digit or spelled)]


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, source, value): every identifier of every text, ``text[start:end]`` being ``source``.

    Null and empty texts have none, and texts of any length are taken whole. Repeated rows give repeated results; a null id
    passes through; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, kind, source, value = [], [], [], [], [], []
            h = Hints(b.column("text"))
            for i, text in enumerate(b.column("text").to_pylist()):
                if not text:
                    continue
                for s, e, k, v in detect(text, h.glyph[i], h.spelled[i], h.dot[i], h.digit[i]):
                    row.append(i)
                    start.append(s)
                    end.append(e)
                    kind.append(k)
                    source.append(text[s:e])
                    value.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(np.array(start, np.int64)), pa.array(np.array(end, np.int64)), pa.array(kind, pa.string()), pa.array(source, pa.string()), pa.array(value, pa.string())],
                ["doc_id", "start", "end", "kind", "source", "value"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(one, f"doc_id {kind}, start bigint, end bigint, kind string, source string, value string")
