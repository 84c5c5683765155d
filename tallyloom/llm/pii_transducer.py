"""Personal data in texts: plain identifiers, and disguised ones found after offset-preserving normalisation.

Plain identifiers (email, ip, card, phone) come from fixed rules. The transducers then rewrite disguises - homoglyphs, spelled
digits, "at", "dot" and "plus" words - while keeping for every rewritten character the source span that it stands for; the same
detectors run over the rewritten text, and what they find there is carried back to source characters.

Edge cases: null or empty text has no spans; offsets are code points with exclusive ends; a found span that overlaps a plain one
of any kind is dropped, so plain spans always stay; equal texts give equal spans, so repeated rows do. Spans that begin at one place are listed in the order of
KINDS, plain before disguised. Very long texts are searched whole. An empty table gives no rows, and columns other than the id and the text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.arrow_text import column, map_text, texts

KINDS = ("email", "ip", "card", "phone")
FOUND = {k: f"hidden_{k}" for k in KINDS}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){3,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @: the run of local characters before it (not into an earlier match), then a dotted domain."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, start)
        at = text.find("@", max(at + 1, floor))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """All identifiers by the fixed rules, by start, then by kind as listed."""
    found = [(k, s, e) for k in KINDS for s, e in DETECTORS[k](text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# Characters that look like the ASCII character they are read as.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "ԛ": "q", "ѡ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@",
}
# Fixed rule: full-width forms U+FF01..U+FF5E stand for U+0021..U+007E; invisible characters stand for nothing.
FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
INVISIBLE = {"​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": ""}
LETTERS = HOMOGLYPHS | FULL_WIDTH | INVISIBLE
# Digits as words, by language.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: A run of spelled digits is rewritten from this many on: shorter runs are ordinary prose.
LEAST_SPELLED = 4

_LETTER = re.compile("[" + re.escape("".join(LETTERS)) + "]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORDS})(?:(?:\s*[-,.]\s*|\s+)(?:(?:{_WORDS})(?!\w)|[0-9](?![0-9]))){{{LEAST_SPELLED - 1},}}", re.IGNORECASE)
_SPELLED_PART = re.compile(r"\w+")
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_DOT = rf"(?:{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}|\s+(?:dot|punkt|point|punto)\s+|\.)"
_AT = r"(?:at|arobase|arroba|klammeraffe|@)"
_HOST = rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"
#: A disguised address: a name, a bracketed or bare at-word, and a domain with at least one dot or dot-word.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?<![A-Za-z0-9_%+-]\.)(?P<name>[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*?)"
    rf"(?P<at>{_OPEN}{_AT}{_CLOSE}|\s+{_AT}\s+|@)(?P<domain>{_HOST})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
#: Without an at-word before a domain, no address is tried.
_AT_HINT = re.compile(rf"(?:[\[({{<]\s*{_AT}{_CLOSE}|(?<=\s){_AT}\s+|@){_HOST}", re.IGNORECASE)
_DOT_WORD = re.compile(_DOT, re.IGNORECASE)
_OCTET = rf"(?:[0-9]{{1,3}}|(?:{_WORDS})(?:[\s-]+(?:{_WORDS})){{0,2}})"
#: Four octets, plain or spelled, between dots, plain or disguised; no further digits on either side.
_OCTETS = re.compile(rf"(?<![\w.]){_OCTET}(?:{_DOT}{_OCTET}){{3}}(?!\w)(?!(?:\s*[-,.]\s*|\s+)(?:[0-9]|(?:{_WORDS})(?!\w)))", re.IGNORECASE)
_OCTET_PART = re.compile(rf"(?P<dot>{_DOT})|(?P<digits>\w+)", re.IGNORECASE)
#: A plus-word before digits, plain or spelled.
_PLUS = re.compile(rf"(?<!\w)(?:plus|más|mas)\s+(?=[0-9]|(?:{_WORDS})(?!\w))(?P<number>(?:[0-9]+|(?:{_WORDS}))(?!\w)(?:(?:\s*[-,.()]\s*|\s+)(?:[0-9]+|(?:{_WORDS}))(?!\w))*)", re.IGNORECASE)

Edit = tuple[int, int, str]


def letter_edits(text: str) -> list[Edit]:
    """Look-alike and invisible characters, read as what they look like."""
    return [] if text.isascii() else [(m.start(), m.end(), LETTERS[m[0]]) for m in _LETTER.finditer(text)]


def digit_edits(text: str) -> list[Edit]:
    """Runs of spelled digits, each word read as its digit and the separators dropped."""
    out: list[Edit] = []
    for m in _SPELLED.finditer(text):
        at = m.start()
        for w in _SPELLED_PART.finditer(text, m.start(), m.end()):
            if w.start() > at:
                out.append((at, w.start(), ""))
            out.append((w.start(), w.end(), DIGIT_WORDS.get(w[0].lower(), w[0])))
            at = w.end()
    return out


def dot_edits(text: str) -> list[Edit]:
    """Dot-words, bracketed dots and spelled octets between four digit groups, read as '.' and digits."""
    out: list[Edit] = []
    for m in _OCTETS.finditer(text):
        at = m.start()
        for part in _OCTET_PART.finditer(text, m.start(), m.end()):
            if part.start() > at:
                out.append((at, part.start(), ""))
            new = "." if part["dot"] else DIGIT_WORDS.get(part[0].lower(), part[0])
            if new != part[0]:
                out.append((part.start(), part.end(), new))
            at = part.end()
    return out


def plus_edits(text: str) -> list[Edit]:
    """Plus-words before digits, read as +, and the spelled digits after them, read as digits."""
    out: list[Edit] = []
    for m in _PLUS.finditer(text):
        out.append((m.start(), m.start("number"), "+"))
        at = m.start("number")
        for w in _SPELLED_PART.finditer(text, m.start("number"), m.end()):
            if w.start() > at:
                out.append((at, w.start(), ""))
            if w[0].lower() in DIGIT_WORDS:
                out.append((w.start(), w.end(), DIGIT_WORDS[w[0].lower()]))
            at = w.end()
    return out


def address_edits(text: str) -> list[Edit]:
    """At-words and dot-words inside a disguised address, read as @ and '.'.

    The hint's whole lines and their neighbours are scanned, once. A bare at-word counts where a side holds a dot-word, or where a
    dotted name stands before the domain ("look at example.com" is prose).
    """
    out: list[Edit] = []
    floor = scanned = 0
    for hint in _AT_HINT.finditer(text):
        if hint.start() < scanned:
            continue
        low = max(floor, text.rfind("\n", 0, max(0, text.rfind("\n", 0, hint.start()))) + 1)
        high = text.find("\n", hint.end())
        high = text.find("\n", high + 1) if high >= 0 else -1
        scanned = len(text) if high < 0 else high
        for m in _ADDRESS.finditer(text, low, scanned):
            dots = [d for part in ("name", "domain") for d in _DOT_WORD.finditer(text, *m.span(part))]
            bare = m["at"] != "@" and m["at"].strip()[:1] not in "[({<"
            if bare and all(d[0] == "." for d in dots) and "." not in m["name"]:
                continue
            if m["at"] != "@":
                out.append((*m.span("at"), "@"))
            out += [(*d.span(), ".") for d in dots if d[0] != "."]
            floor = m.end()
    return sorted(out)


class Rewritten:
    """A text after some edits, with the way back: edits must be sorted and must not overlap."""

    def __init__(self, text: str, edits: list[Edit]) -> None:
        parts, self.dst, self.src, self.length = [], [0], [0], []
        at = done = 0
        for start, end, new in edits:
            parts += [text[at:start], new]
            # from dst[i] on, source starts at src[i]; a replaced stretch maps whole
            self.length.append(0)
            done += start - at
            self.dst.append(done)
            self.src.append(start)
            self.length.append(end - start)
            done += len(new)
            self.dst.append(done)
            self.src.append(end)
            at = end
        self.length.append(0)
        parts.append(text[at:])
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of text[start:end]."""
        return self._source(start, False), self._source(end - 1, True)

    def _source(self, pos: int, last: bool) -> int:
        i = bisect_left(self.dst, pos + 1) - 1
        if self.length[i]:
            return self.src[i] + self.length[i] if last else self.src[i]
        return self.src[i] + pos - self.dst[i] + (1 if last else 0)


def hidden_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that only the normalised text shows, as source spans; none overlaps `taken`."""
    layers, now = [], text
    for edits in (letter_edits, dot_edits, plus_edits, digit_edits, address_edits):
        found = edits(now)
        if found:
            layers.append(Rewritten(now, found))
            now = layers[-1].text
    if not layers:
        return []
    busy: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if busy and s < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(e, busy[-1][1]))
        else:
            busy.append((s, e))
    out = []
    for kind in KINDS:
        for start, end in DETECTORS[kind](now):
            for layer in reversed(layers):
                start, end = layer.source(start, end)
            i = bisect_left(busy, (end, -1))
            if i and busy[i - 1][1] > start:
                continue
            out.append((kind, start, end))
    kept: list[tuple[str, int, int]] = []
    for kind, start, end in sorted(out, key=lambda x: (x[1], KINDS.index(x[0]))):
        if not kept or start >= kept[-1][2]:
            kept.append((FOUND[kind], start, end))
    return kept


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (plain and hidden, by start), n_hidden."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden")}
        for t in texts(part, text):
            base = plain_spans(t)
            more = hidden_spans(t, base)
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(said(base).encode()).hexdigest())
            order = [*KINDS, *FOUND.values()]
            out["spans"].append(said(sorted(base + more, key=lambda x: (x[1], order.index(x[0])))))
            out["n_hidden"].append(len(more))
        return out | {id_col: column(part, id_col)}

    schema = f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_hidden bigint"
    return map_text(docs, [id_col], schema, rows, text)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = "<{kind}>") -> str:
    """The text with each span replaced by its mask."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], mask.format(kind=kind)]
            at = end
    return "".join([*out, text[at:]])
