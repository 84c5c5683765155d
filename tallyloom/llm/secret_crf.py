"""Secrets in texts: fixed rules, and a linear-chain conditional random field over all tokens of each line.

Every token of a text (a run of secret characters, or of characters beyond ASCII) stands in a chain, one chain a line, and may be
tagged begin (B), inside (I) or outside (O). Features are the token's length and shape, the tokens and signs around it, and figures
of the whole text (the "file"); scores are summed for whole batches. Decoding is exact: a token that no path of the best score can
tag B or I, by a bound over its own and the next token's scores, is outside and splits its chain; Viterbi runs over what is left.
The field learns from tokens that the fixed rules mark, whatever their length or signs, in a bounded sample of documents (windows
with a mark, and weighted windows without), with features dropped at random, so that shape and context each carry weight; on demand also from
lines whose secret was exchanged for others, with and without a word that announces it, and from windows without neighbours. It adds spans that the rules miss.

Edge cases: null or empty text has no spans; offsets are code points, ends exclusive; an added span that overlaps a rule's span is
dropped; with no sample (an empty table) or no marked token the field tags nothing. Very long texts are searched whole; of tags with
equal scores the first in the order outside, begin, inside is taken; repeated rows come out once each; columns other than the id and
the text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_view, column, in_one_task, lowered, map_text, mix, prefix_sums, span_hash

KINDS = ("assign", "access", "hex")
ADDED = "field"
#: Documents that the field is fitted on, at most about; windows of chains used, at most; tokens of a window; one document in PLAIN gives a window without a mark.
SAMPLE_DOCS, SAMPLE_CHAINS, WINDOW, PLAIN = 20_000, 40_000, 8, 4
#: Hashed feature values, and features of a token.
SIZE, SLOTS = 1 << 13, 18
#: The slots that tell of a token's neighbours; the share of chains that are learnt without them where tokens shall be found by themselves.
AROUND, ALONE = (10, 11, 12, 16), 0.5
#: Varied lines for each mark, and the weight of a window of one.
VARIANTS, VARIANT_WEIGHT = 6, 2.0
# The alphabets of keys: hexadecimal, letters and digits, capitals and digits, base 64 with its signs, small letters and digits.
ALPHABETS = (
    "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-0123456789", "abcdefghijklmnopqrstuvwxyz0123456789",
)

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")

_CHAR = np.zeros(256, dtype=bool)
_CHAR[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def rule_spans(data: bytes) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) in bytes, by start, then kind as listed."""
    low = data.lower()
    out = [("assign", *m.span(), m.start(1)) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span(), m.start()) for m in _ACCESS.finditer(data)]
    out += [("hex", *m.span(), m.start()) for m in _HEX.finditer(data)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def chains(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of all texts, and True where a chain begins (a new text or line)."""
    n = len(data)
    kind = np.where(data >= 0x80, 2, _CHAR[data]).astype(np.int8)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts, ends = np.flatnonzero(edge[:-1] & (kind > 0)), np.flatnonzero(edge[1:] & (kind > 0)) + 1
    opens = np.ones(len(starts), dtype=bool)
    if len(starts) > 1:
        lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
        owner = np.searchsorted(offsets, starts, side="right")
        opens[1:] = (owner[1:] != owner[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
    return starts, ends, opens


def _bins(x: np.ndarray) -> np.ndarray:
    return (np.log2(x + 1) * 2).astype(np.int64)


def _file_columns(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    size = np.diff(offsets) + 1
    out = []
    for signs in (b"\n", b"=:", b"{;"):
        seen = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(signs, np.uint8)))))[offsets]
        n = np.diff(seen)
        out.append(_bins(n if signs == b"\n" else 1000 * n / size))
    return out


def file_features(data: bytes) -> list[int]:
    """Figures of a whole text."""
    return [int(x[0]) for x in _file_columns(np.frombuffer(data, np.uint8), np.array([0, len(data)]))]


_VOWEL = np.zeros(256, dtype=bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_HEXA = np.zeros(256, dtype=bool)
_HEXA[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
#: 1 digit, 2 upper case, 3 lower case, 4 any other.
_CLASS = np.full(256, 4, dtype=np.int8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 1, 2, 3
_PLAIN_DIGIT = np.arange(256, dtype=np.int64)
_PLAIN_DIGIT[0x30:0x3A] = 0x30


def feature_columns(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, file: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashed feature values of all tokens, one column a slot."""
    n, m = len(data), len(starts)
    size = ends - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    low, high = offsets[owner], offsets[owner + 1]
    kind = _CLASS[data]

    def held(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    def byte(at: np.ndarray) -> np.ndarray:
        return np.where((at >= low) & (at < high), _PLAIN_DIGIT[data[np.clip(at, 0, max(n - 1, 0))]], 0)

    change = np.zeros(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    turns = held(change) - change[starts]
    digits, upper, signs = held(kind == 1), held(kind == 2), held(kind == 4)
    head = np.zeros(m, dtype=np.int64)
    for k in range(4):
        head = head * 256 + np.where(starts + k < ends, byte(starts + k), 0)
    # a neighbour is named in lower case, without one closing sign
    trim = ends - ((size > 1) & np.isin(data[ends - 1], np.frombuffer(b"=.-", np.uint8)))
    names = span_hash(prefix_sums(lowered(data)), starts, trim).astype(np.int64)

    def neighbour(k: int) -> np.ndarray:
        at = np.arange(m) + k
        ok = (at >= 0) & (at < m)
        at = np.clip(at, 0, max(m - 1, 0))
        return np.where(ok & (owner[at] == owner), names[at], 0)

    around = byte(starts - 2) * 65536 + byte(starts - 1) * 256 + byte(ends)
    columns = [
        lambda: np.zeros(m, dtype=np.int64),
        lambda: _bins(size),
        lambda: 8 * digits // size,
        lambda: 8 * upper // size,
        lambda: 8 * signs // size,
        lambda: _bins(turns),
        lambda: 8 * held(_VOWEL[data]) // size,
        lambda: (held(_HEXA[data]) == size) * 2 + (size >= 16),
        lambda: head,
        lambda: np.minimum(held(data == 0x2E), 9) * 2 + (held(data == 0x2D) > 0),
        lambda: neighbour(-1),
        lambda: neighbour(-2),
        lambda: around,
        *[lambda f=f: f[owner] for f in file],
        lambda: neighbour(1),
        lambda: (digits > 0) * 4 + (size >= 8) * 2 + (size >= 6),
    ]
    for i, make in enumerate(columns):
        value = make().astype(np.uint64) * np.uint64(64) + np.uint64(i)
        yield (mix(value) % np.uint64(SIZE - 1)).astype(np.int16) + np.int16(1)


def token_features(data: bytes, start: int, end: int, file: list[int]) -> list[int]:
    """Hashed feature values of the token data[start:end] in its text; SLOTS of them."""
    body = np.frombuffer(data, np.uint8)
    offsets = np.array([0, len(body)])
    starts, ends, _ = chains(body, offsets)
    at = int(np.searchsorted(starts, start))
    return [int(x[at]) for x in feature_columns(body, offsets, starts, ends, [np.array([f]) for f in file])]


#: Tags: 0 outside, 1 begin, 2 inside. Outside can't be followed by inside, nor can a chain open with it.
_BARRED = -1e4


def _start_scores() -> np.ndarray:
    return np.array([0.0, 0.0, _BARRED])


def _steps(moves: np.ndarray) -> np.ndarray:
    out = moves.copy()
    out[0, 2] = _BARRED
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4, drop: float = 0.3, seed: int = 7, alone: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE x 3) and moves (3 x 3) that maximise the likelihood of the tags; each group holds chains of one length.

    groups: (features n x length x SLOTS, tags n x length, weights n). Gradients are exact (forward and backward sums), steps are AdaGrad's.
    Features are dropped at random; in a share `alone` of the chains all that tells of neighbours is dropped at once, so that a token's own shape is learnt as a reason by itself.
    """
    rng = np.random.default_rng(seed)
    w, moves = np.zeros((SIZE, 3)), np.zeros((3, 3))
    gw, gm = np.full_like(w, 1e-12), np.full_like(moves, 1e-12)
    total, number = sum(float(k.sum()) for _, _, k in groups), sum(len(k) for _, _, k in groups)
    if not total:
        w[:, 1:] = _BARRED
        return w, moves
    for _ in range(rounds):
        dw, dm = np.zeros_like(w), np.zeros_like(moves)
        for x, y, weight in groups:
            n, length, _ = x.shape
            x = np.where(rng.random(x.shape) < drop, 0, x)
            if alone:
                bare = np.flatnonzero(rng.random(n) < alone)
                x[np.ix_(bare, np.arange(length), AROUND)] = 0
            score = w[x].sum(axis=2) * (x > 0).any(axis=2, keepdims=True)
            step = _steps(moves)
            ahead = np.empty((n, length, 3))
            back = np.zeros((n, length, 3))
            ahead[:, 0] = _start_scores() + score[:, 0]
            for t in range(1, length):
                ahead[:, t] = score[:, t] + _logsum(ahead[:, t - 1, :, None] + step[None], 1)
            for t in range(length - 2, -1, -1):
                back[:, t] = _logsum(step[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            z = _logsum(ahead[:, -1], 1)
            p = np.exp(ahead + back - z[:, None, None])
            err = (np.eye(3)[y] - p) * weight[:, None, None]
            flat = x.reshape(-1)
            each = np.repeat(err.reshape(-1, 3), SLOTS, axis=0)
            for k in range(3):
                dw[:, k] += np.bincount(flat, each[:, k], minlength=SIZE)
            for t in range(1, length):
                pair = np.exp(ahead[:, t - 1, :, None] + step[None] + (score[:, t] + back[:, t])[:, None, :] - z[:, None, None])
                dm -= (pair * weight[:, None, None]).sum(axis=0)
                np.add.at(dm, (y[:, t - 1], y[:, t]), weight)
        dw[0] = 0
        dw, dm = dw / total - decay * number / total * w, dm / total - decay * number / total * moves
        gw += dw**2
        gm += dm**2
        w += rate * dw / np.sqrt(gw)
        moves += rate * dm / np.sqrt(gm)
    return w, moves


def viterbi(score: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of one chain, from its scores (length x 3)."""
    step = _steps(moves)
    best, came = _start_scores() + score[0], []
    for row in score[1:]:
        ways = best[:, None] + step
        came.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tags = [int(best.argmax())]
    for back in reversed(came):
        tags.append(int(back[tags[-1]]))
    return tags[::-1]


def decoded(score: np.ndarray, opens: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of all chains (score: tokens x 3, opens: True where a chain begins)."""
    n, step = len(score), _steps(moves)
    tags = np.zeros(n, dtype=np.int8)
    if not n:
        return tags
    # Tagging a token O instead changes two steps, and a third where a following I must become B.
    swing = 3 * (moves.max() - moves.min())
    follow = np.zeros(n)
    follow[:-1] = np.where(opens[1:], 0, np.maximum(0, score[1:, 2] - score[1:, 1]))
    open_ = np.flatnonzero(score[:, 1:].max(axis=1) - score[:, 0] + follow + swing >= 0)
    if not len(open_):
        return tags
    cut = np.concatenate(([True], (np.diff(open_) > 1) | opens[open_[1:]]))
    first = open_[cut]
    size = np.diff(np.concatenate((np.flatnonzero(cut), [len(open_)])))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best = np.where(opens[first][:, None], _start_scores(), step[0]) + score[first]
    ends, came = np.zeros((len(first), 3)), []
    after = first + size
    goes_on = (after < n) & ~opens[np.minimum(after, n - 1)]
    for t in range(1, int(size[0]) + 1):
        live = int(np.searchsorted(-size, -t, side="right"))
        done = np.flatnonzero(size[:live] == t)
        ends[done] = best[done] + np.where(goes_on[done][:, None], step[:, 0], 0)
        live = int(np.searchsorted(-size, -t, side="left"))
        if not live:
            break
        ways = best[:live, :, None] + step
        came.append(ways.argmax(axis=1).astype(np.int8))
        best = ways.max(axis=1) + score[first[:live] + t]
    tag = ends.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        tags[first[:live] + t] = tag[:live]
        if t:
            tag[:live] = came[t - 1][np.arange(live), tag[:live]]
    return tags


def _marks(raw: bytes, offsets: np.ndarray) -> list[list[tuple[str, int, int, int]]]:
    return [rule_spans(raw[int(a) : int(b)]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _found(part: pa.RecordBatch, text: str, model: tuple[np.ndarray, np.ndarray]):
    """For each text: its bytes, rule spans, and the field's spans, in bytes of the text."""
    w, moves = model
    data, offsets = byte_view(part, text)
    raw = data.tobytes()
    starts, ends, opens = chains(data, offsets)
    score = np.zeros((len(starts), 3))
    if len(starts):
        for column_ in feature_columns(data, offsets, starts, ends, _file_columns(data, offsets)):
            score += w[column_]
    tags = decoded(score, opens, moves)
    hits = np.flatnonzero(tags)
    at = np.searchsorted(starts[hits], offsets)
    for i, rules in enumerate(_marks(raw, offsets)):
        base = int(offsets[i])
        spans: list[list[int]] = []
        for k in hits[at[i] : at[i + 1]]:
            if tags[k] == 1:
                spans.append([int(starts[k]) - base, int(ends[k]) - base])
            else:
                spans[-1][1] = int(ends[k]) - base
        yield raw[base : int(offsets[i + 1])], rules, spans


def varied(line: bytes, start: int, end: int, rng: random.Random) -> tuple[bytes, int, int]:
    """A line whose secret is another one, of any usual alphabet and length, announced by its old neighbours, by another word or by none; and where it stands now."""
    alphabet = rng.choice(ALPHABETS)
    size = rng.randint(10, 48)
    value = [rng.choice(alphabet) for _ in range(size)]
    value[rng.randrange(size)] = rng.choice(alphabet[-10:])  # each alphabet ends with its digits, or with letters where it has none
    before, after = line[:start], line[end:]
    if rng.random() < 0.7:  # without what announced it: words of the line itself stand before it
        words = before.split()[:-2] or [b""]
        before = b" ".join(words) + (b" " if words[-1:] != [b""] else b"") + rng.choice((b"", b"", b"key ", b"is ", b"auth: ", b"id=", b'"'))
    return before + "".join(value).encode() + after, len(before), len(before) + size


def _windows(x: np.ndarray, tags: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of windows of at most WINDOW tokens of a chain, and which hold a mark."""
    chain = np.cumsum(opens) - 1
    place = np.arange(len(tags)) - np.flatnonzero(opens)[chain]
    begins = np.flatnonzero(place % WINDOW == 0)
    return begins, np.append(begins[1:], len(tags)), np.add.reduceat(tags > 0, begins) > 0


def _varied_windows(raw: bytes, offsets: np.ndarray, marks: list, out: dict[str, list]) -> None:
    """Windows of VARIANTS varied lines for each mark, as if they stood in their texts."""
    lines, spans, of = [], [], []
    for i, rules in enumerate(marks):
        body = raw[int(offsets[i]) : int(offsets[i + 1])]
        for _, _, end, own in rules:
            low, high = body.rfind(b"\n", 0, own) + 1, body.find(b"\n", end)
            low, high = max(low, own - 80), min(len(body) if high < 0 else high, end + 80)
            rng = random.Random(hashlib.blake2b(body[low:high], digest_size=8).digest())
            for _ in range(VARIANTS):
                line, a, b = varied(body[low:high], own - low, end - low, rng)
                lines.append(line)
                spans.append((a, b))
                of.append(i)
    if not lines:
        return
    data, bounds = np.frombuffer(b"".join(lines), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    starts, ends, opens = chains(data, bounds)
    file = [f[np.array(of)] for f in _file_columns(np.frombuffer(raw, np.uint8), offsets)]
    x = np.stack(list(feature_columns(data, bounds, starts, ends, file)), axis=1)
    tags = np.zeros(len(starts), dtype=np.int64)
    for base, (a, b) in zip(bounds, spans, strict=False):
        tags[np.searchsorted(ends, base + a, side="right") : np.searchsorted(starts, base + b)] = 1
    tags[1:][(tags[1:] > 0) & (tags[:-1] > 0) & ~opens[1:]] = 2
    begins, stops, marked = _windows(x, tags, opens)
    for a, b in zip(begins[marked], stops[marked], strict=True):
        own = tags[a:b].copy()
        own[0] = 1 if own[0] == 2 else own[0]
        out["x"].append(x[a:b].reshape(-1).astype(np.int32))
        out["y"].append(own)
        out["k"].append(VARIANT_WEIGHT)


def marked_chains(docs: DataFrame, text: str = "text", vary: bool = False) -> DataFrame:
    """One row a window of a chain: `x` (features, flat), `y` (tags by the fixed rules) and `k` (its weight).

    All windows with a mark; of those without one, by a hash of the text, one window of one text in PLAIN, which stands for all. With `vary`, also windows of
    lines in which the marked secret was exchanged for others (see `varied`).
    """

    def rows(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"x": [], "y": [], "k": []}
        data, offsets = byte_view(part, text)
        raw = data.tobytes()
        starts, ends, opens = chains(data, offsets)
        if not len(starts):
            return out
        x = np.stack(list(feature_columns(data, offsets, starts, ends, _file_columns(data, offsets))), axis=1)
        tags = np.zeros(len(starts), dtype=np.int64)
        marks = _marks(raw, offsets)
        if vary:
            _varied_windows(raw, offsets, marks, out)
        for base, rules in zip(offsets, marks, strict=False):
            for _, _, end, own in rules:
                a, b = np.searchsorted(ends, base + own, side="right"), np.searchsorted(starts, base + end)
                tags[a:b] = 1
        tags[1:][(tags[1:] > 0) & (tags[:-1] > 0) & ~opens[1:]] = 2
        begins, stops, marked = _windows(x, tags, opens)
        owner = np.searchsorted(offsets, starts[begins], side="right") - 1
        weight = marked.astype(np.float64)
        for i in range(len(offsets) - 1):
            plain = np.flatnonzero((owner == i) & ~marked) if len(begins) else []
            pick = int.from_bytes(hashlib.blake2b(raw[int(offsets[i]) : int(offsets[i + 1])], digest_size=8).digest(), "little")
            if len(plain) and pick % PLAIN == 0:
                weight[plain[pick // PLAIN % len(plain)]] = PLAIN * len(plain)
        for k in np.flatnonzero(weight):
            a, b = begins[k], stops[k]
            own = tags[a:b].copy()
            if own[0] == 2:
                own[0] = 1
            out["x"].append(x[a:b].reshape(-1).astype(np.int32))
            out["y"].append(own)
            out["k"].append(float(weight[k]))
        return out

    return map_text(docs, [], "x array<int>, y array<int>, k double", rows, text, 1 << 20)


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, alone: float = 0.0, vary: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fit the field on windows of about `sample_docs` documents, chosen by the hash of their ids.

    alone: the share of windows that are learnt without a token's neighbours (see `fit`); vary: learn other secrets in the places of marked ones too (see `varied`).
    With both, secrets of other alphabets and such that no keyword announces are found.
    """
    share = max(1, docs.count() // sample_docs)
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(share)) == 0)
    return in_one_task(marked_chains(some, text, vary).orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_CHAINS), lambda rows: _fitted(rows, alone))


def _fitted(got: pa.Table, alone: float) -> tuple[np.ndarray, np.ndarray]:
    """The field of windows (x, y, k), taken by length and in order of their values, whatever order they came in."""
    flat = [got[c].combine_chunks() for c in ("x", "y")]
    x, y = (np.asarray(c.flatten()) for c in flat)
    weight = got["k"].to_numpy()
    sizes = np.asarray(flat[1].value_lengths()).astype(np.int64)
    if not y.any():
        return fit([])
    ends, groups = np.cumsum(sizes), []
    for length in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == length)
        at = (ends[pick] - length)[:, None] + np.arange(length)
        xs, ys, ks = x.reshape(-1, SLOTS)[at].reshape(len(pick), -1), y[at], weight[pick]
        order = np.lexsort([ks, *ys.T[::-1], *xs.T[::-1]])
        groups.append((xs[order].reshape(-1, length, SLOTS), ys[order].astype(np.int64), ks[order]))
    return fit(groups, alone=alone)


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (rules and field, by start), n_field.

    The model is broadcast: SIZE x 3 weights, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field")}
        for body, rules, added in _found(part, text, shared.value):
            added = [(ADDED, s, e) for s, e in added if not any(a < e and s < b for _, a, b, _ in rules)]
            base = [(k, a, b) for k, a, b, _ in rules]
            spans = sorted(base + added, key=lambda x: (x[1], [*KINDS, ADDED].index(x[0])))
            if spans and not body.isascii():
                lead = np.concatenate(([0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)))
                spans = [(k, int(lead[a]), int(lead[b])) for k, a, b in spans]
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in spans))
            out["base_sha256"].append(hashlib.sha256(said([x for x in spans if x[0] != ADDED]).encode()).hexdigest())
            out["spans"].append(said(spans))
            out["n_field"].append(len(added))
        return out | {id_col: column(part, id_col)}

    schema = f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_field bigint"
    return map_text(docs, [id_col], schema, rows, text)


def redacted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", id_col: str = "doc_id", mask: str = "<secret>") -> DataFrame:
    """docs with every found span of `text` replaced by the mask; other columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    keep = [c for c in docs.columns if c != text]

    def rows(part: pa.RecordBatch) -> dict:
        out = []
        for (body, rules, found), known in zip(_found(part, text, shared.value), column(part, text).is_valid().to_pylist(), strict=True):
            cuts = [(a, b) for _, a, b, _ in rules] + [(a, b) for a, b in found]
            text_out, at = [], 0
            for a, b in sorted(cuts):
                if b <= at:
                    continue
                if a >= at:
                    text_out += [body[at:a], mask.encode()]
                at = b
            out.append((b"".join([*text_out, body[at:]])).decode() if known else None)
        return {c: column(part, c) for c in keep} | {text: out}

    schema = ", ".join(f"`{c}` {kinds[c] if c != text else 'string'}" for c in [*keep, text])
    return map_text(docs, keep, schema, rows, text).select(*docs.columns)
