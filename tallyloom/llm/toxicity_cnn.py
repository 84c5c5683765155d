"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is a run of letters and digits in lower case; its vector is the sum of three hashed embeddings (the word, its first 4 and
its first 6 bytes), of which only those seen in several training texts are used. Filters of several widths slide over the words of
the whole text, each keeps its maximum, and a logistic layer scores the maxima. It is trained on three quarters of all labelled rows, in rounds:
each part of the rows takes steps of its own from the same model, in numpy, and the mean of what the parts made is the next round's model. Every row
is drawn at least once: a small table's rows in each round, a large table's in one round, so that work grows with the rows and not with
the number of partitions they come in. All other labelled rows are kept aside to set a threshold for each language; language never enters the score.

Edge cases: null or empty text is scored from filters at rest; a text shorter than a filter is padded; labels that are null are
not used, and a document with several labels counts as toxic if any says so; with no labelled rows of both kinds every score is 0;
a language without enough marked rows takes the threshold of all languages together. Very long texts are learnt and
scored whole. Rows that repeat an id each get the score of their own text, so equal texts get equal scores; extra columns aren't read
unless kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_view, column, map_text, mix, prefix_sums, slices, span_hash
from tallyloom.llm.sketches import Members, counted
from tallyloom.session import cut

#: Rows of a block (a part learns from two of them), and parts at most (which then hold more blocks).
BLOCK_ROWS, MOST_PARTS = 6_000, 256
#: Rounds, steps of all parts in a round at least, and rows of a step.
ROUNDS, STEPS, BATCH = 4, 250, 48
#: Numbers of a model that are summed at once; steps of the score in which rows kept aside are counted.
PIECE, BINS = 1 << 16, 1 << 16
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 16
LEAST_TEXTS = 4
LEAST_MARKED = 12

_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x30:0x3A] = _SOLID[0x41:0x5B] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three bucket numbers for each word of all texts (n x 3), and each text's first word (texts + 1 values)."""
    low = _LOWER[data]
    if len(low) > 1:  # capital letters with accents (U+00C0..U+00DE but for the sign U+00D7) to small ones
        second = low[1:]
        capital = (low[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[capital] += 0x20
    solid = _SOLID[low]
    n = len(low)
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] |= solid[cuts]
        last[cuts - 1] |= solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(low)
    out = np.empty((len(starts), 3), dtype=np.int32)
    for k, reach in enumerate((None, 4, 6)):
        stop = ends if reach is None else np.minimum(ends, starts + reach)
        out[:, k] = (mix(span_hash(sums, starts, stop) + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS
    return out, np.searchsorted(starts, offsets)


@dataclass
class Model:
    """rows: bucket number to row of `embed` (row 0 is nought); filters: width x (DIM, FILTERS) for each width."""

    rows: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """Maxima before the bias (texts x all filters); with `places`, also where each maximum starts in the padded words."""
        sizes = np.diff(bounds)
        most = max(WIDTHS)
        starts = bounds[:-1] + most * np.arange(len(sizes))
        at = np.arange(len(ids)) + most * np.repeat(np.arange(len(sizes)), sizes)
        x = np.zeros((len(ids) + most * len(sizes) + most, DIM), dtype=np.float32)
        x[at] = self.embed[self.rows[ids]].sum(axis=1)
        best, where = [], []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            n = len(x) - most
            conv = x[:n] @ f[0]
            for j in range(1, width):
                conv += x[j : n + j] @ f[j]
            # windows that begin at a word of the text, or at its first padding when it has none
            ends = starts + np.maximum(sizes, 1)
            cuts = np.stack([starts, ends], axis=1).ravel()
            best.append(np.maximum.reduceat(conv, cuts, axis=0)[::2] if len(starts) else np.zeros((0, FILTERS), np.float32))
            if places:
                where.append(np.stack([s + conv[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)]))
        return np.concatenate(best, axis=1), (np.concatenate(where, axis=1) if places else None), x, at

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(ids, bounds)[0] + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))

    def limit(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.threshold)


def _never() -> Model:
    return Model(np.zeros(3 * BUCKETS, np.int32), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), -60.0, {}, 1.0)


def _dense(m: Model) -> list[np.ndarray]:
    return [*m.filters, m.bias, m.out, np.array([m.out_bias])]


def _begun(seen: np.ndarray, mean: float, seed: int = 11) -> tuple[Model, list[np.ndarray]]:
    """A model before its first step, and the sums of squares of AdaGrad: one for each row of `embed`, then those of _dense()."""
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    rows = np.zeros(3 * BUCKETS, dtype=np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    total = FILTERS * len(WIDTHS)
    m = Model(
        rows,
        rng.normal(0, 0.1, (len(used) + 1, DIM)).astype(np.float32),
        [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, total).astype(np.float32),
        float(np.log(mean / (1 - mean))),
    )
    m.embed[0] = 0
    return m, [np.full(p.shape, 1e-3) for p in (m.embed[:, :1], *_dense(m))]


def _turns(rng: np.random.Generator, rows: np.ndarray) -> Iterator[int]:
    """All rows in random order, again and again."""
    while True:
        yield from rng.permutation(rows)


def _marked_of(labels: np.ndarray) -> int:
    """Marked rows of a batch, which holds more of the rarer kind than the rows do."""
    mean = labels.mean()
    return round(BATCH * (np.clip(mean, 0.25, 0.75) if 0 < mean < 1 else mean))


def steps_for(labels: np.ndarray, share: float) -> int:
    """Steps that draw every row at least once, and no fewer than the rows' share of STEPS."""
    k, marked = _marked_of(labels), int(labels.sum())
    once = [-(-n // each) for n, each in ((marked, k), (len(labels) - marked, BATCH - k)) if n]
    return max(int(np.ceil(STEPS * share)), *once)


def _descend(m: Model, squares: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray, steps: int, rng: np.random.Generator, rate: float = 0.1, decay: float = 2e-4, drop: float = 0.25) -> None:
    """AdaGrad on the logistic loss, in place; the gradient reaches only the windows that hold a filter's maximum."""
    esq, parts = squares[0], _dense(m)
    mean, k = labels.mean(), _marked_of(labels)
    shift = 0.0
    if 0 < mean < 1:
        share = np.clip(mean, 0.25, 0.75)
        shift = np.log(share / (1 - share)) - np.log(mean / (1 - mean))
    marked, plain = _turns(rng, np.flatnonzero(labels == 1)), _turns(rng, np.flatnonzero(labels == 0))
    for _ in range(steps):
        pick = np.array([*islice(marked, k), *islice(plain, BATCH - k)])
        ids = np.concatenate([texts[i] for i in pick]).reshape(-1, 3)
        bounds = np.concatenate(([0], np.cumsum([len(texts[i]) // 3 for i in pick])))
        best, where, x, at = m.pooled(ids, bounds, places=True)
        a = best + m.bias
        keep = (rng.random(a.shape) >= drop) / (1 - drop)
        h = np.maximum(a, 0) * keep
        p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias + shift, -30, 30)))
        e = (p - labels[pick]) / len(pick)
        back = (e[:, None] * m.out * keep * (a > 0)).astype(np.float32)
        dx = np.zeros_like(x)
        grads = []
        for q, width in enumerate(WIDTHS):
            cols = slice(q * FILTERS, (q + 1) * FILTERS)
            g, w = back[:, cols], where[:, cols]
            df = np.zeros_like(m.filters[q])
            for j in range(width):
                df[j] = np.einsum("bfd,bf->df", x[w + j], g)
                np.add.at(dx, w + j, g[..., None] * m.filters[q][j].T[None])
            grads.append(df + decay * m.filters[q])
        hit = np.flatnonzero(np.any(dx[at] != 0, axis=1))
        touched, place = np.unique(m.rows[ids[hit]], return_inverse=True)
        de = decay * m.embed[touched]
        np.add.at(de, place.reshape(-1), np.repeat(dx[at[hit]], 3, axis=0))
        de[touched == 0] = 0
        esq[touched] += (de**2).mean(axis=1, keepdims=True)
        m.embed[touched] -= (rate * de / np.sqrt(esq[touched])).astype(np.float32)
        grads = [*grads, back.sum(axis=0), h.T @ e + decay * m.out, np.array([e.sum()])]
        for p_, s, g in zip(parts, squares[1:], grads, strict=True):
            s += g**2
            p_ -= (rate * g / np.sqrt(s)).astype(p_.dtype)
        m.out_bias = float(parts[-1][0])


def fit(texts: list[np.ndarray], labels: np.ndarray, steps: int = ROUNDS * STEPS, seed: int = 11) -> Model:
    """A model of texts that one process holds."""
    if not 0 < labels.sum() < len(labels):
        return _never()
    seen = np.zeros(3 * BUCKETS, dtype=np.int32)
    for t in texts:
        seen[np.unique(t)] += 1
    m, squares = _begun(seen, labels.mean(), seed)
    _descend(m, squares, texts, labels, steps, np.random.default_rng(seed))
    return m


def best_threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The middle of the widest gap between groups of scores at which F1 is best; groups (least and greatest score, rows, marked rows) come from the top down."""
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + max(1, hits.sum()))
    gaps = low - np.append(high[1:], 0.0)
    gap, i = max((gaps[i], i) for i in np.flatnonzero(f1 >= f1.max() - 1e-12))
    return float(low[i] - gap / 2)


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """__doc, lang, toxic, text of every labelled id, and whether it is kept `aside` for thresholds, dealt into one part for about `block_rows` rows (MOST_PARTS at most).

    An id stands once, however many rows have it: the text with the smallest hash (then the smallest text, the smallest language) is taken.
    """
    kind = docs.schema[id_col].dataType
    marked = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast(kind).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    parts = min(MOST_PARTS, max(1, -(-marked.count() * 3 // (4 * block_rows))))
    # texts that a sketch of fixed size rules out are not moved
    near = docs.select(F.col(id_col).alias("__doc"), F.col(text).alias(text), F.col(lang).cast("string").alias(lang)).where(Members(marked.select(F.xxhash64("__id"))).column(F.xxhash64("__doc")))
    rows = near.repartition(parts, "__doc").join(marked, F.col("__doc") == F.col("__id"))
    order = F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.groupBy("__doc").agg(F.max("toxic").alias("toxic"), F.min(order).alias("o")).select("__doc", F.col("o.l").alias(lang), F.col("o.t").alias(text), "toxic")
    return rows.withColumn("aside", F.pmod(F.xxhash64(F.col("__doc"), F.lit(3)), F.lit(4)) == 0)


def labelled_ids(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """labelled() with hashed word ids for the text."""

    def ids(part: pa.RecordBatch) -> dict:
        flat, bounds = word_ids(*byte_view(part, text))
        return {c: column(part, c) for c in (lang, "toxic", "aside", "__doc")} | {"ids": pa.ListArray.from_arrays(pa.array(bounds * 3, pa.int32()), pa.array(flat.reshape(-1)))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(labelled(docs, labels, text, id_col, lang), [lang, "toxic", "aside", "__doc"], f"{lang} string, toxic int, aside boolean, __doc {kind}, ids array<int>", ids, text)


def _blocks(batches: Iterator[pa.RecordBatch], text: str, block_rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """A part's texts, as flat word ids, and their labels, some block_rows at a time."""
    texts: list[np.ndarray] = []
    marks: list[int] = []
    for part in slices(batches, text):
        ids, bounds = word_ids(*byte_view(part, text))
        texts += [ids[a:b].reshape(-1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        marks += column(part, "toxic").to_pylist()
        if len(texts) >= 2 * block_rows:
            yield texts, np.array(marks, dtype=np.int64)
            texts, marks = [], []
    if texts:
        yield texts, np.array(marks, dtype=np.int64)


def _packed(m: Model, squares: list[np.ndarray], was: Model, had: list[np.ndarray]) -> np.ndarray:
    """What a part made of a model: changes of the rows of `embed`, of their squares, and whether they changed; all other numbers; 1."""
    rows = np.concatenate([m.embed - was.embed, squares[0] - had[0], squares[0] != had[0]], axis=1)
    return np.concatenate([rows.ravel(), *[x.ravel() for x in (*_dense(m), *squares[1:])], [1.0]]).astype(np.float32)


def _averaged(total: np.ndarray, m: Model, squares: list[np.ndarray]) -> None:
    """Take over the sum of all parts' _packed(): a row's change is the mean over the parts that changed it, all other numbers are means over all."""
    size = m.embed.shape[0] * (DIM + 2)
    rows = total[:size].reshape(-1, DIM + 2)
    of = np.maximum(rows[:, -1:], 1)
    m.embed += (rows[:, :DIM] / of).astype(np.float32)
    squares[0] += rows[:, DIM : DIM + 1] / of
    rest, dense = total[size:-1] / total[-1], _dense(m)
    for x in (*dense, *squares[1:]):
        x[...] = rest[: x.size].reshape(x.shape)
        rest = rest[x.size :]
    m.out_bias = float(dense[-1][0])


def _round(rows: DataFrame, count: float, text: str, m: Model, squares: list[np.ndarray], turn: int, block_rows: int) -> None:
    """One round over about `count` rows: every part goes on from the same model with its own rows, and the mean of what they make is taken over."""
    shared = rows.sparkSession.sparkContext.broadcast((m, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, learnt = TaskContext.get().partitionId(), deepcopy(shared.value), 0
        rng = np.random.default_rng([turn, part])
        for texts, marks in _blocks(batches, text, block_rows):
            learnt += len(texts)
            _descend(*own, texts, marks, steps_for(marks, len(texts) / count), rng)
        if learnt:
            flat = _packed(*own, *shared.value)
            pieces = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(pieces)), pa.int32()), "part": pa.array([part] * len(pieces), pa.int32()), "body": pa.array(pieces, pa.binary())})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        bodies = group.sort_values("part")["body"]
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "body": [sum(np.frombuffer(b, np.float32).astype(np.float64) for b in bodies).tobytes()]})

    sums = rows.select("toxic", text).mapInArrow(run, "piece int, part int, body binary").groupBy("piece").applyInPandas(add, "piece int, body binary").collect()
    shared.unpersist()
    _averaged(np.concatenate([np.frombuffer(r.body) for r in sorted(sums, key=lambda r: r.piece)]), m, squares)


def _set_limits(rows: DataFrame, text: str, lang: str, m: Model) -> None:
    """Thresholds for each language and for all, from the scores of all rows kept aside, counted in BINS steps of the score."""
    shared = rows.sparkSession.sparkContext.broadcast(m)
    scores = lambda part: {c: column(part, c) for c in (lang, "toxic")} | {"score": shared.value.score(*word_ids(*byte_view(part, text)))}
    scored = map_text(rows, [lang, "toxic"], f"`{lang}` string, toxic int, score double", scores, text)
    step = F.floor(F.col("score") * BINS).alias("bin")
    own = scored.groupBy(F.coalesce(F.col(lang), F.lit("")).alias("of"), step).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high")).withColumn("every", F.lit(False))
    every = scored.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high")).withColumn("every", F.lit(True)).withColumn("of", F.lit(""))

    def limit(group: pd.DataFrame) -> pd.DataFrame:  # BINS + 1 rows at most
        g = group.sort_values("bin", ascending=False)
        found = [best_threshold(*(g[c].to_numpy() for c in ("low", "high", "n", "hits")))] if g["hits"].sum() >= LEAST_MARKED else []
        return pd.DataFrame({"every": g["every"].iloc[: len(found)].to_numpy(), "of": g["of"].iloc[: len(found)].to_numpy(), "found": np.array(found, dtype=np.float64)})

    for r in own.unionByName(every).groupBy("every", "of").applyInPandas(limit, "every boolean, of string, found double").collect():  # a row for each language
        if r.every:
            m.threshold = r.found
        else:
            m.thresholds[r.of] = r.found


def parts_for(count: int, block_rows: int = BLOCK_ROWS) -> int:
    """Parts that learn apart from `count` rows."""
    return min(MOST_PARTS, max(1, -(-count // (2 * block_rows))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", block_rows: int = BLOCK_ROWS) -> Model:
    """Fit on three quarters of all labelled rows, by rounds over parts; set the thresholds, by language, on all the others."""
    rows = labelled(docs, labels, text, id_col, lang, block_rows)
    rows = cut(rows.sortWithinPartitions(F.xxhash64("__doc"), "__doc"))
    kinds = {r.toxic: r["count"] for r in rows.where("not aside").groupBy("toxic").count().collect()}
    marked, plain = kinds.get(1, 0), kinds.get(0, 0)
    if not (marked and plain):
        return _never()
    count = marked + plain
    learnt, aside = rows.where("not aside"), rows.where("aside")
    # joins deal rows into the session's number of partitions; the parts that learn are as many as the rows ask for
    parts = learnt.coalesce(parts_for(count, block_rows))
    # from so many rows on that a round's steps cannot draw all of them, a round takes its own share of the rows
    folds = max(1, min(ROUNDS, count // (STEPS * BATCH)))
    fold = F.pmod(F.xxhash64(F.col("__doc"), F.lit(5)), F.lit(folds))

    def once(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Each bucket once for each text that holds it."""
        for part in slices(iter([batch]), text):
            ids, bounds = word_ids(*byte_view(part, text))
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            yield np.unique(owner[:, None] * np.int64(3 * BUCKETS) + ids) % (3 * BUCKETS)

    m, squares = _begun(counted(learnt.select(text), 3 * BUCKETS, once), marked / count)
    for turn in range(ROUNDS):
        _round(parts.where(fold == turn % folds), count / folds, text, m, squares, turn, block_rows)
    if len(m.embed) > 1:
        _set_limits(aside, text, lang, m)
    return m


def toxicity(docs: DataFrame, model: Model, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """docs(keep...) with score, threshold (of the row's language) and rejected. The model is broadcast; its size is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    frame = docs.withColumn("__lang", F.col(lang).cast("string"))

    def rows(part: pa.RecordBatch) -> dict:
        m = shared.value
        score = m.score(*word_ids(*byte_view(part, text)))
        limit = np.array([m.limit(x) for x in column(part, "__lang").to_pylist()])
        return {c: column(part, c) for c in keep} | {"__score": score, "__threshold": limit, "__rejected": score >= limit}

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["__score double", "__threshold double", "__rejected boolean"])
    return map_text(frame, [*keep, "__lang"], schema, rows, text)
