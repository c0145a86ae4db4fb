"""Personal data with offsets into the source text, disguised or not.

Base spans come from the text as it is: e-mail addresses, IPv4 addresses, payment card numbers (Luhn) and international
phone numbers. Then a chain of transducers normalises look-alike characters and invisible ones, spelled digits, and at
and dot disguises; each keeps, for every character it writes, the stretch of source it came from. The same detectors
run on the normalised text and their spans are mapped back; one that no base span of its kind holds is added. Base
spans always stay.

Texts that no transducer changes are not normalised. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm._common import attach, with_columns

KINDS = ("email", "ip", "card", "phone")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("base", T.BooleanType(), False)]), False)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that fails at the first digit of a run fails at every later one, so runs are entered at their first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Digit words of English, German, French and Spanish, from 0 to 9.
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
# Cyrillic and Greek letters that look like Latin ones.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS", strict=True))
GREEK = dict(zip("αονρικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aovpikuABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"

_WORD_DIGIT = {w: str(d) for d, words in enumerate(DIGIT_WORDS) for w in words}
_ANY_DIGIT_WORD = "|".join(sorted(_WORD_DIGIT, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[ ,-]+)?(?:{_ANY_DIGIT_WORD}|[0-9])(?:[ ,-]+(?:{_ANY_DIGIT_WORD}|[0-9])(?!\w)|[ ,]+(?:dot|point|punkt|punto)[ ,]+(?:{_ANY_DIGIT_WORD}|[0-9])(?!\w))+")
_SPELLED_PART = re.compile(r"(?i)[^\W\d_]+|[0-9]")
# One digit word beside digits that are not spelled.
_BESIDE = re.compile(rf"(?i)(?<=[0-9][ -])(?:{_ANY_DIGIT_WORD})(?!\w)|(?<!\w)(?:{_ANY_DIGIT_WORD})(?=[ -][0-9])")
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_AT_WORDS = ("at", "arroba", "arobase")
# White space before a bracket is entered at its first character only, so long stretches of it take linear time.
_BRACKET_AT = re.compile(rf"(?i)(?:(?<!\s)\s+)?[\[({{<]\s*(?:{'|'.join(_AT_WORDS)}|@)\s*[\])}}>]\s*")
_BRACKET_DOT = re.compile(rf"(?i)(?:(?<!\s)\s+)?[\[({{<]\s*(?:{'|'.join(_DOT_WORDS)}|\.)\s*[\])}}>]\s*")
_BARE_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])\s+(?:{'|'.join(_DOT_WORDS)})\s+(?=[A-Za-z0-9])")
_SAID_DOT = ""
_BARE_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9._%+-])\s+(?:{'|'.join(_AT_WORDS)})\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_SAID_DOT})")
# ``name at host.tld`` with a known end, unless the name is a word that goes before a place; fixed values.
_ENDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl"
_NO_NAMES = "us|me|it|them|him|her|more|here|there|online|available|website|site|page|info|information|visit|found|is|are|was|be|and|or|look|see|read|out|up|free|today|now|live|store|shop|home|details|him|you|start|join"
_PLAIN_AT = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?!(?:{_NO_NAMES})\s)([A-Za-z0-9._%+-]+)(\s+(?:{'|'.join(_AT_WORDS)})\s+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{_ENDS})(?![A-Za-z0-9-]))")
# ``name-at-host-dot-tld`` and the same with underscores.
_DASHED = re.compile(rf"(?i)(?<=[A-Za-z0-9])([-_])(?:{'|'.join(_AT_WORDS)})\1[A-Za-z0-9]+(?:\1(?:{'|'.join(_DOT_WORDS)})\1[A-Za-z0-9]+)+")
# What every match of these three has in it, found faster.
_NEAR_DIGIT = re.compile(r"[0-9](?:(?<=[^\W\d_][ -].)|[ -][^\W\d_])")
_NEAR_AT = re.compile(rf"(?i)\s(?:{'|'.join(_AT_WORDS)})\s+[A-Za-z0-9.-]+\.(?:{_ENDS})")
_NEAR_DASH = re.compile(rf"(?i)[-_](?:{'|'.join(_AT_WORDS)})[-_]")
_DASHED_PART = re.compile(r"[A-Za-z0-9]+")
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s+@\s*(?=[A-Za-z0-9-]+[.{_SAID_DOT}])|(?<=[A-Za-z0-9._%+-])@\s+(?=[A-Za-z0-9-]+[.{_SAID_DOT}])")


def _look_alikes() -> dict[str, str]:
    """Single characters and the ASCII character each stands for; fullwidth forms and digits of all scripts by rule."""
    table = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)} | CYRILLIC | GREEK
    table |= {"．": ".", "。": ".", "․": ".", " ": " ", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {chr(zero + d): str(d) for d in range(10)}
    return table | {c: "" for c in INVISIBLE}


LOOK_ALIKES = _look_alikes()
_LOOK_ALIKE = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + "]")

Spans = list[tuple[str, int, int]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Spans:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            found.append(("email", start, low))
        at = text.find("@", low)
    return found


def ips(text: str) -> Spans:
    small = lambda part: len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255
    return [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> Spans:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    return found


def phones(text: str) -> Spans:
    return [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def detect(text: str) -> Spans:
    """Spans of all kinds, by kind and start; matches of a kind are leftmost and don't overlap."""
    found = emails(text)
    if _DIGIT.search(text):
        found += ips(text) + cards(text) + (phones(text) if "+" in text else [])
    return found


class Aligned:
    """A text on its way through the transducers: ``start[i]`` and ``end[i]`` bound the source of character i."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace each match by the pieces (text, from, to) that ``write`` gives; from and to bound a piece's origin in this text."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            parts.append(self.text[at : m.start()])
            start += self.start[at : m.start()]
            end += self.end[at : m.start()]
            for piece, a, b in write(m):
                parts.append(piece)
                start += [self.start[a]] * len(piece)
                end += [self.end[b - 1]] * len(piece)
            at = m.end()
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.start, self.end = start + self.start[at:], end + self.end[at:]


def _as(piece: str) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    return lambda m: [(piece, m.start(), m.end())]


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for w in _SPELLED_PART.finditer(m[0]):
        word = w[0].lower()
        out.append(("+" if word == "plus" else "." if word in _DOT_WORDS else _WORD_DIGIT.get(word, word), m.start() + w.start(), m.start() + w.end()))
    return out


def _plain_at(m: re.Match) -> list[tuple[str, int, int]]:
    return [*((c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[1])), ("@", m.start(2), m.end(2))]


def _dashed(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for n, w in enumerate(_DASHED_PART.finditer(m[0])):
        a, b = m.start() + w.start(), m.start() + w.end()
        out += [("@" if n == 0 else ".", a - 1, b + 1)] if n % 2 == 0 else [(c, a + i, a + i + 1) for i, c in enumerate(w[0])]
    return out


def disguised(text: str) -> bool:
    """Whether a transducer changes the text: the first one that does matches the text as it is, so their own patterns decide."""
    if not text.isascii() and (_SAID_DOT in text or _LOOK_ALIKE.search(text)):
        return True
    if "@" in text and _SPACED_AT.search(text):
        return True
    if any(c in text for c in "[({<") and (_BRACKET_AT.search(text) or _BRACKET_DOT.search(text)):
        return True
    # _BARE_AT needs a dot that another one wrote
    if _BARE_DOT.search(text) or _SPELLED.search(text):
        return True
    return any(near.search(text) and p.search(text) for near, p in ((_NEAR_DIGIT, _BESIDE), (_NEAR_DASH, _DASHED), (_NEAR_AT, _PLAIN_AT)))


def normalise(text: str) -> Aligned:
    out = Aligned(text)
    out.rewrite(_LOOK_ALIKE, lambda m: [(LOOK_ALIKES[m[0]], m.start(), m.end())])
    out.rewrite(_SPELLED, _digits)
    out.rewrite(_BESIDE, _digits)
    out.rewrite(_DASHED, _dashed)
    out.rewrite(_BRACKET_AT, _as("@"))
    out.rewrite(_BRACKET_DOT, _as(_SAID_DOT))
    out.rewrite(_BARE_DOT, _as(_SAID_DOT))
    out.rewrite(_BARE_AT, _as("@"))
    out.rewrite(_SPACED_AT, _as("@"))
    out.rewrite(_PLAIN_AT, _plain_at)
    out.text = out.text.replace(_SAID_DOT, ".")
    return out


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text as (kind, start, end, base), by kind and start. A null or empty text has none."""
    if not text:
        return []
    base = detect(text)
    found = [(*s, True) for s in base]
    if disguised(text):
        norm = normalise(text)
        if norm.text != text:
            for kind, a, b in detect(norm.text):
                a, b = norm.start[a], norm.end[b - 1]
                if not any(k == kind and x <= a and b <= y for k, x, y in base):
                    found.append((kind, a, b, False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str | None, found: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by its first kind in brackets."""
    if not found:
        return text
    parts, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def find_personal_data(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array of struct(kind, start, end, base), by kind (email, ip, card, phone) and start.

    Null and empty texts have no spans. A column that already has the name is replaced; all others stay as they are.
    """
    attach(df.sparkSession)
    as_dict = lambda s: {"kind": s[0], "start": s[1], "end": s[2], "base": s[3]}
    return with_columns(df, lambda: lambda texts: ([[as_dict(s) for s in spans(t)] for t in texts],), [T.StructField(out, SPAN, False)], text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace column ``text`` by its redacted form; nulls stay null. All other columns stay as they are, in place."""
    attach(df.sparkSession)
    columns = df.columns
    return with_columns(df, lambda: lambda texts: ([redacted(t, spans(t)) for t in texts],), [T.StructField(text, T.StringType())], text).select(*[F.col(f"`{c}`") for c in columns])


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
