"""Approximate nearest neighbours by a hash-prefix forest (cosine).

Each tree gives a vector a long string of bits, the signs of random projections; the sorted array of a tree's strings is dealt by
ranges into blocks of about INDEX_BLOCK vectors. A query descends in each tree to its longest match, in the block that its string
falls into, and takes the NEAR rows or more that come to share the longest prefixes. The k-th cosine found so far says to which depth
all trees must ascend until a row as near as that is missed by all of them with a probability below `miss`; in a second round every
row that shares so short a prefix is scored, in all blocks that its range touches. So a query meets only the blocks of its own
prefixes: few where it has near neighbours, more where all rows are about equally far.

Equal vectors are indexed once, with the k + 1 smallest of their ids (no neighbour list can hold more of them), and asked once.
A block's rows are held by the task that reads it, the queries that visit it stream past. Shuffled are each distinct vector once per
tree and round, and each query once per block that it visits.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; only vectors of equal length
are compared; a row is no neighbour of its own; rows that repeat both id and vector are one row, rows that repeat an id with another
vector are rows of their own, as queries too; fewer than k candidates give fewer rows; ties go to the smaller id; an empty table
gives no rows; other columns aren't read, whatever their names. A vector is a few hundred numbers; a block holds INDEX_BLOCK of them,
more where more distinct vectors share all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

TREES, BITS = 32, 48
#: Distinct vectors of a block, and queries whose ranges are looked up together.
INDEX_BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Rows that a query takes from each tree in its first round.
NEAR = 64
#: Most blocks of a tree: their bounds (a number each) go to every task; beyond it blocks grow.
MOST_BLOCKS = 4_096


def planes(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """The projections of all trees (dim x trees * bits), the same wherever they are drawn."""
    return np.random.default_rng([dim, trees, bits]).normal(size=(dim, trees * bits))


def strings(x: np.ndarray, p: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Bit strings (rows x trees) as numbers below 2**bits, first bit highest."""
    signs = (x @ p > 0).reshape(len(x), trees, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def exact_cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows x with one vector q, in double precision; equal rows give equal numbers wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def depth_needed(cosine: np.ndarray, trees: int, miss: float, bits: int) -> np.ndarray:
    """The deepest prefix at which a row of this cosine is missed by all trees with a probability of at most `miss`; 0 for no cosine."""
    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    with np.errstate(divide="ignore"):
        depth = np.floor(np.log(1 - miss ** (1 / trees)) / np.minimum(np.log(agree), -1e-12))
    return np.where(np.isnan(cosine), 0, np.clip(depth, 0, bits)).astype(np.int64)


class Block:
    """One block of a tree: rows sorted by string."""

    def __init__(self, rows: pd.DataFrame, bits: int = BITS) -> None:
        rows = rows.sort_values("s", kind="stable")
        self.bits, self.keys, self.hash, self.ids = bits, rows["s"].to_numpy(), rows["h"].to_numpy(), rows["ids"].to_list()
        self.x = np.stack(rows["x"].to_numpy()).astype(np.float64)
        self.unit = self.x / np.sqrt((self.x * self.x).sum(axis=1, keepdims=True))

    def longest(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each string the rows (from, to) of the deepest prefix that NEAR rows of this block share with it (all, if fewer)."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.keys), np.int64)
        open_ = np.arange(len(keys))
        for depth in range(self.bits, 0, -1):
            shift = self.bits - depth
            start = keys[open_] >> shift << shift
            a, b = np.searchsorted(self.keys, start), np.searchsorted(self.keys, start + ((1 << shift) - 1), side="right")
            full = b - a >= NEAR
            low[open_[full]], high[open_[full]] = a[full], b[full]
            open_ = open_[~full]
            if not len(open_):
                break
        return low, high

    def best(self, q: np.ndarray, low: int, high: int, floor: float, k: int) -> list[tuple[int, int, float]]:
        """(hash of the vector, id, cosine) of the k + 1 nearest rows of a range that are no farther than floor."""
        near = self.unit[low:high] @ (q / np.sqrt((q * q).sum()))
        least = floor - 1e-11
        if len(near) > k + 1:  # rows as near as the last stay, so that ties are decided by id
            least = max(least, np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-11)
        at = low + np.flatnonzero(near >= least)
        found = [(int(self.hash[r]), int(i), float(c)) for r, c in zip(at, exact_cosine(self.x[at], q), strict=True) for i in self.ids[r]]
        return sorted(found, key=lambda f: (-f[2], f[1]))[: k + 1]

    def answer(self, asks: pd.DataFrame, k: int) -> Iterator[tuple]:
        for from_ in range(0, len(asks), QUERY_BLOCK):
            part = asks.iloc[from_ : from_ + QUERY_BLOCK]
            low, high = np.searchsorted(self.keys, part["s"].to_numpy()), np.searchsorted(self.keys, part["e"].to_numpy(), side="right")
            first = np.flatnonzero(part["floor"].isna().to_numpy())
            low[first], high[first] = self.longest(part["s"].to_numpy()[first])
            floors = part["floor"].fillna(-2.0).to_numpy()
            for i, (h, g, x) in enumerate(zip(part["h"], part["g"], part["x"], strict=True)):
                if high[i] > low[i]:
                    for row in self.best(np.asarray(x, dtype=np.float64), int(low[i]), int(high[i]), float(floors[i]), k):
                        yield (h, g, *row)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def coded(rows: DataFrame) -> DataFrame:
    """dim, s: the length and the strings (one a tree) of each vector x, beside the columns that are there."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, np.ndarray] = {}
        for pdf in batches:
            sizes = pdf["x"].map(len).to_numpy()
            keys = np.zeros((len(pdf), TREES), dtype=np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                if dim not in drawn:
                    drawn = {int(dim): planes(int(dim))}
                for a in range(0, len(at), QUERY_BLOCK):
                    some = at[a : a + QUERY_BLOCK]
                    keys[some] = strings(np.stack(pdf["x"].iloc[some].to_numpy()).astype(np.float64), drawn[int(dim)], TREES, BITS)
            yield pdf.assign(dim=sizes.astype(np.int32), s=list(keys))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(work, f"{schema}, dim int, s array<bigint>")


def bounds_of(index: DataFrame, blocks: int) -> dict[tuple[int, int], np.ndarray]:
    """The strings at which the blocks of each (dim, tree) begin, but for the first: quantiles of its strings, MOST_BLOCKS at most."""
    parts = min(blocks, MOST_BLOCKS)
    if parts < 2:
        return {}
    each = index.select("dim", F.posexplode("s").alias("tree", "s"))
    cuts = each.groupBy("dim", "tree").agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], 4 * parts).alias("cuts"))
    return {(r.dim, r.tree): np.unique(np.array(r.cuts, dtype=np.int64)) for r in cuts.collect()}


def routed(rows: DataFrame, bounds: dict[tuple[int, int], np.ndarray], miss: float) -> DataFrame:
    """A row for each block of each tree that a vector lies in or asks for.

    Without a floor that is the block its string falls into, with one all blocks that the range s to e of the needed prefix touches.
    Python sees each vector's strings only; the vectors themselves are repeated by Spark.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bounds)
    none = np.zeros(0, dtype=np.int64)
    lists = ["trees", "blocks", "lows", "highs"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), QUERY_BLOCK):
                pdf = whole.iloc[a : a + QUERY_BLOCK]
                keys = np.stack(pdf["s"].to_numpy())
                floor = pdf["floor"].to_numpy(dtype=np.float64, na_value=np.nan)
                shift = np.where(np.isnan(floor), 0, BITS - depth_needed(floor, TREES, miss, BITS))[:, None]
                low = keys >> shift << shift
                high = low + (np.int64(1) << shift) - 1
                first, last = np.zeros_like(low), np.zeros_like(low)
                for dim in pdf["dim"].unique():
                    at = (pdf["dim"] == dim).to_numpy()
                    for tree in range(TREES):
                        cuts = sent.value.get((int(dim), tree), none)
                        first[at, tree] = np.searchsorted(cuts, low[at, tree], side="right")
                        last[at, tree] = np.searchsorted(cuts, high[at, tree], side="right")
                many = last - first + 1
                found: dict[str, list[np.ndarray]] = {name: [] for name in lists}
                for i, each in enumerate(many):
                    tree = np.repeat(np.arange(TREES), each)
                    step = np.arange(len(tree)) - np.repeat(np.cumsum(each) - each, each)
                    for name, value in zip(lists, (tree, first[i, tree] + step, low[i, tree], high[i, tree]), strict=True):
                        found[name].append(value)
                yield pdf[kept].assign(**found)

    kept = ["dim", "kind", "h", "g", "ids", "x", "floor"]
    element = rows.schema["x"].dataType.simpleString()
    listed = "trees array<bigint>, blocks array<bigint>, lows array<bigint>, highs array<bigint>"
    found = rows.mapInPandas(work, f"dim int, kind int, h bigint, g bigint, ids array<bigint>, x {element}, floor double, {listed}")
    each = found.select(*kept, F.explode(F.arrays_zip(*lists)).alias("at"))
    return each.select("dim", F.col("at.trees").cast("int").alias("tree"), F.col("at.blocks").alias("block"), "kind", F.col("at.lows").alias("s"), F.col("at.highs").alias("e"), "h", "g", "ids", "x", "floor")


def visited(index: DataFrame, asks: DataFrame, bounds: dict[tuple[int, int], np.ndarray], k: int, miss: float) -> DataFrame:
    """h, g, ch, vec_id, score: what the asks (h, g) find in the blocks that they visit."""
    keys = ["dim", "tree", "block"]
    both = index.withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1)))
    met = routed(both, bounds, miss).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, block = None, [], None
        for pdf in batches:
            code = pdf[[*keys, "kind"]].to_numpy()
            edges = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1), len(pdf)]
            out: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if tuple(code[a, :3]) != key:
                    key, rows, block = tuple(code[a, :3]), [], None
                if code[a, 3] == 0:
                    rows.append(pdf.iloc[a:b])
                elif rows:
                    if block is None:
                        block = Block(pd.concat(rows))
                    out += block.answer(pdf.iloc[a:b], k)
            yield pd.DataFrame(out, columns=["h", "g", "ch", "vec_id", "score"]).astype({"h": "int64", "g": "int64", "ch": "int64", "vec_id": "int64", "score": "float64"})

    return met.mapInPandas(work, "h bigint, g bigint, ch bigint, vec_id bigint, score double")


def nearest_of(found: DataFrame, most: int) -> DataFrame:
    """The `most` nearest of each asked vector, each candidate once."""
    each = found.groupBy("h", "g", "ch", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("h", "g").orderBy(F.desc("score"), F.asc("vec_id"))
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def neighbours(vectors: DataFrame, queries: Column, k: int = 5, miss: float = 0.02, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `queries` holds, of all other rows."""
    rows = vectors.where(queries | F.lit(True)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("x")) & F.col("id").isNotNull()).withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64(F.lit(1), "x"))
    single = rows.groupBy("h", "g", "id", "x").agg(F.max("asks").alias("asks"))
    by_vector = Window.partitionBy("h", "g").orderBy("id")
    members = single.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    classes = members.groupBy("h", "g").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = single.where("asks")
    no_floor = F.lit(None).cast("double").alias("floor")
    index = cut(coded(classes.select("h", "g", "x", "ids"))).select("*", no_floor)
    bounds = bounds_of(index, -(-index.count() // INDEX_BLOCK))
    alone = asked.groupBy("h", "g").agg(F.first("x").alias("x"))
    asks = cut(coded(alone.withColumn("ids", F.lit(None).cast("array<bigint>"))))

    first = cut(nearest_of(visited(index, asks.select("*", no_floor), bounds, k, miss), k + 1).drop("place"))
    floors = first.groupBy("h", "g").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    again = asks.join(floors, ["h", "g"], "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    best = nearest_of(first.unionByName(visited(index, again, bounds, k, miss)), k + 1)

    # one vector may be asked by many ids: its few answers are dealt over salts
    salts = 16
    whose = asked.select(F.col("id").alias("query_id"), "h", "g", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    answers = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    ranked = whose.join(answers, ["h", "g", "salt"]).where(~((F.col("ch") == F.col("h")) & (F.col("vec_id") == F.col("query_id"))))
    order = Window.partitionBy("query_id", "h", "g").orderBy(F.desc("score"), F.asc("vec_id"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
