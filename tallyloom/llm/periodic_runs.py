"""Periodic runs of words, by an online sparse diagonal DP.

A run is a maximal stretch of words with smallest period q (words q apart are identical) of at least max(LEAST, TIMES * q) words. On the
diagonal of lag q it is a stretch of matches: each word matches the word q before it. Word by word, an earlier occurrence lengthens the match of
its lag or begins one; a diagonal that ends is a run, emitted there and then, if it is long enough.

Taken literally that costs the square of a word's frequency. The diagonals are kept sparse without losing one: lags are treated in octaves
(g/2, g] for g = 1, 2, 4, ..., and in the octave of g a position's symbol is the name of the g words that end there. Inside a run with
smallest period q in that octave, the nearest earlier occurrence of such a symbol is exactly q back (a nearer one, d, would give g + d words
with both periods d and q, so by Fine and Wilf a period smaller than q). And a stretch of equal nearest lags d that makes
max(LEAST, TIMES * d) words has no smaller period and cannot be extended, by the same argument. So each position feeds at most one diagonal of
an octave, the one of its nearest occurrence, and a diagonal of M symbols is a stretch of M + g - 1 matches. Names are exact: numbers of distinct
words, then of pairs of names. An octave looks only at symbols whose halves occur at least twice, and the octaves end when none is
left or g/2 reaches a quarter of the text, so ordinary prose costs a few sorts of its words and any text O(n log n).

Words are the stretches without space and U+0009 to U+000D. A text is one piece of work: its runs may be as long as the text; held are 8 to some
60 bytes a word beside its distinct words, not the words themselves.

Defined results: a null text counts as empty; without words there are no runs, and the collapsed text is empty. Ties of the greatest exponent,
compared as an exact fraction, go to the smallest start, then the smallest period. Rows are judged one by one, so repeated rows give repeated results, an
empty table none, and other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_texts, column, map_text

#: Words of a run at least, and periods of a run at least.
LEAST = 6
TIMES = 4
#: Bytes of a text whose words are looked up at once.
PIECE = 1 << 20

# The white space between words (bytes.split() cuts at the same six).
SPACES = b" \t\n\x0b\x0c\r"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end]
        at = end


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The number of each word of all texts, one after another; the index of each text's first word (n + 1 values); the distinct words."""
    names: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    parts, bounds = [], [0]
    for text in texts:
        found = [np.fromiter(map(names.__getitem__, piece.split()), np.int64) for piece in _pieces(text)]
        parts += found
        bounds.append(bounds[-1] + sum(map(len, found)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(bounds), list(names)


def runs(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in the text), length and period of every run, by text, start and period."""
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    most = (sizes // TIMES)[of]  # the longest period that a text can hold
    # the symbols of the octave: their places (where they end), ascending, and their names, different in different texts
    at = np.flatnonzero(most >= 1)
    name = np.unique(of[at] * (int(symbols.max(initial=0)) + 1) + symbols[at], return_inverse=True)[1]
    found, g = [], 1
    while len(at):
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
        live = np.flatnonzero((lag > g // 2) & (lag <= g))
        if len(live):
            where, d = at[live], lag[live]
            first = np.flatnonzero(np.diff(where, prepend=-2) * (np.diff(d, prepend=0) == 0) != 1)
            matches = np.diff(np.append(first, len(live)))
            where, d = where[first], d[first]
            length, start = matches + g - 1 + d, where - (g - 1) - d
            fit = length >= np.maximum(LEAST, TIMES * d)
            found.append(np.stack([of[where], start - bounds[of[where]], length, d], 1)[fit])
        # symbols of twice the length: both halves occur twice, and their texts can hold a period of the next octave
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= most[at] > g
        name_at = np.full(len(symbols), -1, np.int64)
        name_at[at[twice]] = name[twice]
        at = at[twice]
        at = at[at - g >= bounds[of[at]]]
        at = at[name_at[at - g] >= 0]
        if len(at):
            name = np.unique(name_at[at - g] * (int(name.max()) + 1) + name_at[at], return_inverse=True)[1]
        g *= 2
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def looped(symbols: np.ndarray, start: int, period: int) -> np.ndarray:
    """The words with those from `start` on replaced by repeats of the `period` words there."""
    return np.concatenate([symbols[:start], symbols[start + np.arange(len(symbols) - start) % period]])


def collapsed(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words are kept: those in no run beyond its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] == 0


def best_of(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest length / period, then the smallest start, then the smallest period."""
    top = np.flatnonzero(length / period >= (length / period).max() * (1 - 1e-12))
    return min(top.tolist(), key=lambda i: (-Fraction(int(length[i]), int(period[i])), int(start[i]), int(period[i])))


SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, loop: tuple[Column, Column] | None = None) -> DataFrame:
    """doc_id and SCHEMA of every row.

    loop: start (as g; taken modulo the number of words) and a divisor, from which a text is made periodic before it is judged; a null start leaves
    it alone. The query states them; without, texts are judged as they are.
    """
    start, parts = loop or (F.lit(None), F.lit(None))
    rows = docs.select("doc_id", F.col("text").alias("text"), start.cast("bigint").alias("__start"), parts.cast("bigint").alias("__parts"))

    def judged(part: pa.RecordBatch) -> dict[str, object]:
        symbols, bounds, vocabulary = numbered_words(byte_texts(part))
        for i, (g, cut) in enumerate(zip(column(part, "__start").to_pylist(), column(part, "__parts").to_pylist(), strict=True)):
            n = int(bounds[i + 1] - bounds[i])
            if g is not None and n:
                symbols[bounds[i] : bounds[i + 1]] = looped(symbols[bounds[i] : bounds[i + 1]], g % n, 1 + (n - g % n) // cut)
        text, start, length, period = runs(symbols, bounds)
        limits = np.searchsorted(text, np.arange(part.num_rows + 1))
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for i in range(part.num_rows):
            own = slice(limits[i], limits[i + 1])
            s, k, p = start[own], length[own], period[own]
            words = symbols[bounds[i] : bounds[i + 1]]
            best = best_of(s, k, p) if len(s) else None
            top = (None,) * 4 if best is None else (int(s[best]), int(k[best]), int(p[best]), 1000 * int(k[best]) // int(p[best]))
            lines = hashlib.sha256()
            for row in zip(s.tolist(), k.tolist(), p.tolist(), strict=True):
                lines.update(b"%d,%d,%d\n" % row)
            kept = words[collapsed(len(words), s, k, p)] if len(s) else words
            body = b" ".join(map(vocabulary.__getitem__, kept.tolist()))
            for c, v in zip(out, (len(s), *top, lines.hexdigest(), hashlib.sha256(body).hexdigest()), strict=True):
                out[c].append(v)
        return out | {"doc_id": column(part, "doc_id")}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_text(rows, ["doc_id", "__start", "__parts"], f"doc_id {kind}, {SCHEMA}", judged)


def without_repeats(text: str) -> str:
    """The text's words joined by one space, each run cut down to its first period."""
    symbols, bounds, vocabulary = numbered_words([text.encode()])
    _, start, length, period = runs(symbols, bounds)
    return b" ".join(vocabulary[i] for i in symbols[collapsed(len(symbols), start, length, period)].tolist()).decode()
