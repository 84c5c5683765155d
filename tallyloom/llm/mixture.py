"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Documents fall into cells (source, language, topic). The tokens of the cells are raked until their sums agree with target shares
for each source, each language and each topic; a cell's probability is its raked share of a token budget over its tokens, capped at
one, with the cap's loss spread over the other cells. A document is kept by a fixed hash of its id against its cell's probability, so
a rerun keeps the same documents.

Cells are summed by Spark. Up to CELL_BOUND of them are raked in numpy on the driver; above, the same steps, with the same number of
sweeps and tolerance, run as joins and sums with checkpoints. Topics, where the table has none, are clusters of hashed word counts:
centres are fitted on all documents in rounds of sums, and every document is given its nearest centre from its whole text.

Edge cases: null source, language or topic is a value of its own; a document without tokens (null or empty text) has its cell's
probability, and one where the cell has no tokens; targets of values that no cell has are left out and the rest scaled up; empty
tables give no rows. Very long texts count whole. Repeated rows of an id are each given the same verdict where their cells agree; a
tie between centres goes to the first. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_view, column, lowered, map_text, run_lengths, word_hashes, words
from tallyloom.session import cut, discard, stored

AXES = ("source", "lang", "topic")
#: Topics; hashed dimensions; rounds of fitting their centres, at most; candidates for each first centre.
TOPICS, DIMS, ROUNDS, SPREAD = 8, 256, 10, 16
#: Cells that may be brought to the driver (and broadcast): about 100 bytes each.
CELL_BOUND = 100_000
SWEEPS, TOLERANCE = 200, 1e-9
NONE = "\x00none"


@dataclass
class Centres:
    """Unit centres (topics x dims), and the mean that is taken off first."""

    mean: np.ndarray
    centres: np.ndarray


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed log word counts of each text as unit rows, and the number of words."""
    low = lowered(data)
    starts, ends, bounds = words(low, offsets)
    sizes = np.diff(bounds)
    owner, _ = run_lengths(sizes)
    cell = (word_hashes(low, starts, ends) % np.uint64(DIMS)).astype(np.int64)
    x = np.log1p(np.bincount(owner * DIMS + cell, minlength=len(sizes) * DIMS).reshape(len(sizes), DIMS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), sizes


#: Whole numbers stand for vector entries, so that sums don't depend on the order of tasks: entries of stored vectors, and of the rows summed.
STORED, SUMMED = 10_000, 1_000_000
#: Vectors that a task unpacks at once.
BLOCK = 1024


def _scaled_sums(frame: DataFrame, size: int, rows: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums over all stored vectors of what `rows` gives: for each, a slot and a row of whole numbers; `size` slots of DIMS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, DIMS), dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = np.frombuffer(b"".join(b.column(0).slice(at, BLOCK).to_pylist()), dtype=np.int16).reshape(-1, DIMS)
                slot, own = rows(x.astype(np.float64) / STORED)
                for k in range(size):
                    total[k] += own[slot == k].sum(axis=0)
        flat = total.reshape(-1)
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(flat[cell])], names=["cell", "x"])

    out = np.zeros(size * DIMS)
    for r in frame.mapInArrow(run, "cell int, x bigint").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # size x DIMS rows at most
        out[r.cell] = r.x
    return out.reshape(size, DIMS) / SUMMED


def fit_topics(docs: DataFrame, text: str = "text", id_col: str = "doc_id", topics: int = TOPICS, rounds: int = ROUNDS) -> Centres:
    """Spherical k-means over the hashed counts of all documents: each round sums the rows of each centre in Spark.

    The first centres are spread out among the documents of least text hash.
    """

    def rows(part: pa.RecordBatch) -> dict:
        x = np.round(_counts(*byte_view(part, text))[0] * STORED).astype(np.int16)
        return {"x": [r.tobytes() for r in x], "pick": column(part, "pick")}

    picked = docs.select(F.col(text).alias(text), F.xxhash64(F.col(text).cast("string"), F.lit(3)).alias("pick"))
    vectors = stored(map_text(picked, ["pick"], "x binary, pick bigint", rows, text), "vectors")
    number = vectors.count()
    if not number:
        discard(vectors)
        return Centres(np.zeros(DIMS), np.zeros((1, DIMS)))
    mean = _scaled_sums(vectors.select("x"), 1, lambda x: (np.zeros(len(x), np.int64), np.round(x * SUMMED).astype(np.int64)))[0] / number

    def unit(x: np.ndarray) -> np.ndarray:
        x = x - mean
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    some = vectors.select("pick", "x").distinct().orderBy("pick", "x").limit(SPREAD * topics).collect()
    first = unit(np.stack([np.frombuffer(r.x, dtype=np.int16) for r in some]).astype(np.float64) / STORED)
    near, chosen = np.full(len(first), -2.0), [0]
    while len(chosen) < min(topics, len(first)):
        near = np.maximum(near, first @ first[chosen[-1]])
        chosen.append(int(near.argmin()))
    centres = first[chosen]
    for _ in range(rounds):
        now = centres

        def own(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = unit(x)
            return (x @ now.T).argmax(axis=1), np.round(x * SUMMED).astype(np.int64)

        sums = _scaled_sums(vectors.select("x"), len(now), own)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-12), now)
        if np.abs(centres - now).max() < 1e-4:
            break
    discard(vectors)
    return Centres(mean, centres)


def with_topics(docs: DataFrame, model: Centres, keep: list[str], text: str = "text") -> DataFrame:
    """docs(keep...) with __topic (t0, t1, ...) and __tokens (words of the whole text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def rows(part: pa.RecordBatch) -> dict:
        m = shared.value
        x, sizes = _counts(*byte_view(part, text))
        near = ((x - m.mean) @ m.centres.T).argmax(axis=1)
        return {c: column(part, c) for c in keep} | {"__topic": [f"t{k}" for k in near], "__tokens": sizes}

    return map_text(docs, keep, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["__topic string", "__tokens bigint"]), rows, text)


def flattened(shares: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares that lie between the given ones (power 1) and equal ones (power 0)."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Shares of the cells whose sums over each axis are the targets (scaled to what the cells can reach)."""
    w = tokens / max(tokens.sum(), 1e-300)
    for _ in range(SWEEPS if len(tokens) else 0):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, w, minlength=len(target))
            goal = np.where(now > 0, target, 0)
            goal = goal / max(goal.sum(), 1e-300)
            off = max(off, float(np.abs(now - goal).max()))
            w = w * np.where(now > 0, goal / np.maximum(now, 1e-300), 0)[code]
        if off < TOLERANCE:
            break
    return w


def probabilities(tokens: np.ndarray, shares: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * share * budget / tokens) with the scale at which the expected tokens are the budget, or all of it can give."""
    want = np.where(tokens > 0, shares * budget / np.maximum(tokens, 1), 0)
    p = np.minimum(want, 1)
    for _ in range(SWEEPS):
        free = (p < 1) & (want > 0)
        left, reach = budget - tokens[~free & (want > 0)].sum(), (want * tokens)[free].sum()
        if reach <= 0 or left <= 0:
            break
        new = np.where(free, np.minimum(1, want * left / reach), np.where(want > 0, 1.0, 0.0))
        if np.allclose(new, p, atol=1e-12):
            break
        p = new
    return np.where(tokens > 0, p, 1.0)


def _raked_here(cells: DataFrame, targets: dict[str, dict[str, float]], fraction: float) -> DataFrame:
    got = cells.orderBy(*AXES).toPandas()
    tokens = got["tokens"].to_numpy(dtype=np.float64)
    codes, goals = [], []
    for axis in AXES:
        values, code = np.unique(got[axis].to_numpy(dtype=str), return_inverse=True)
        codes.append(code)
        goals.append(np.array([targets[axis].get(v, 0.0) for v in values]))
    shares = rake(tokens, codes, goals)
    got["weight"] = shares * tokens.sum() / np.maximum(tokens, 1e-300) * (tokens > 0)
    got["probability"] = probabilities(tokens, shares, fraction * tokens.sum())
    return cells.sparkSession.createDataFrame(got[[*AXES, "weight", "probability"]], "source string, lang string, topic string, weight double, probability double")


def _raked_by_joins(cells: DataFrame, targets: dict[str, DataFrame], fraction: float, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cut(cells.withColumn("w", F.col("tokens") / F.lit(max(total, 1.0))))
    for _ in range(sweeps):
        worst = F.lit(0.0)
        for axis in AXES:
            sums = now.groupBy(axis).agg(F.sum("w").alias("sum")).where("sum > 0").join(targets[axis], axis, "left").na.fill(0.0, ["target"])
            sums = cut(sums)
            reach = float(sums.agg(F.sum("target")).first()[0] or 1.0)
            goal = sums.select(axis, "sum", (F.col("target") / F.lit(reach)).alias("goal"))
            now = now.join(goal, axis, "left").withColumn("off", F.greatest(worst if "off" not in now.columns else F.col("off"), F.coalesce(F.abs(F.col("sum") - F.col("goal")), F.lit(0.0))))
            now = now.withColumn("w", F.coalesce(F.col("w") * F.col("goal") / F.col("sum"), F.lit(0.0))).drop("sum", "goal")
        now = cut(now)
        off = float(now.agg(F.max("off")).first()[0] or 0)
        now = now.drop("off")
        if off < tolerance:
            break
    budget = fraction * total
    scale, capped = 1.0, None
    want = F.when(F.col("tokens") > 0, F.col("w") * budget / F.col("tokens")).otherwise(0.0)
    for _ in range(sweeps):
        full = want * scale >= 1
        row = now.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, want * F.col("tokens"))).alias("reach"), F.count(F.when(full, 1)).alias("n")).first()
        if row.n == capped or not row.reach or budget <= (row.full or 0):
            break
        capped, scale = row.n, (budget - (row.full or 0)) / row.reach
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), want * scale)).otherwise(1.0)
    return now.select(*AXES, F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(0.0).alias("weight"), p.alias("probability"))


def mixed(
    docs: DataFrame,
    fraction: float = 0.9,
    powers: Mapping[str, float] | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    text: str = "text",
    id_col: str = "doc_id",
    topic: str | None = None,
    seed: int = 17,
    cell_bound: int = CELL_BOUND,
) -> DataFrame:
    """For each row of docs: id_col, source, lang, topic, n_tokens, weight, probability, kept.

    targets gives shares by axis and value; an axis without them takes its present shares raised to its power and scaled.
    """
    powers = {"source": 0.8, "lang": 0.9, "topic": 0.8} | dict(powers or {})
    model = Centres(np.zeros(DIMS), np.zeros((1, DIMS))) if topic else fit_topics(docs, text, id_col)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    frame = docs.select(F.col(id_col), value("source").alias("source"), value("lang").alias("lang"), value(topic).alias("__given") if topic else F.lit(None).cast("string").alias("__given"), F.col(text).cast("string").alias(text))
    rows = with_topics(frame, model, [id_col, "source", "lang", "__given"], text)
    rows = stored(rows.select(id_col, "source", "lang", F.coalesce("__given", "__topic").alias("topic"), F.col("__tokens").alias("n_tokens")), "cells")
    cells = cut(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")))
    number = cells.count()
    if number <= cell_bound:
        goal: dict[str, dict[str, float]] = {}
        for axis in AXES:
            sums = {r[0]: float(r[1]) for r in cells.groupBy(axis).agg(F.sum("tokens")).collect()}
            goal[axis] = dict(targets[axis]) if targets and axis in targets else flattened(sums, powers[axis])
        raked = F.broadcast(_raked_here(cells, goal, fraction))  # at most cell_bound rows
    else:
        frames = {}
        for axis in AXES:
            if targets and axis in targets:
                frames[axis] = docs.sparkSession.createDataFrame(list(targets[axis].items()), f"{axis} string, target double")
            else:
                frames[axis] = cut(cells.groupBy(axis).agg(F.pow(F.sum("tokens").cast("double"), powers[axis]).alias("target")))
        raked = _raked_by_joins(cells, frames, fraction)
    unit = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = rows.join(raked, list(AXES))
    null = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return out.select(id_col, null("source"), null("lang"), null("topic"), "n_tokens", "weight", "probability", (unit < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that the mixture keeps, columns unchanged. Ids decide: rows that share an id are kept if any of them is."""
    kept = mixed(docs, text=text, id_col=id_col, **how).where("kept").select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")
