"""A Merkle manifest of a table, its nodes stored in van Emde Boas order.

Every group (language) has a tree over its rows in order of doc_id, every eight neighbours under one node, and the groups' roots have such a
tree of their own; its root names the table. A tree is cut at half its height, and each part again, until parts are BLOCK levels high at
most. Such a part is an aligned subtree: a block, built by one task from the digests of its leaves and stored as one row whose nodes lie in van
Emde Boas order. Addresses in it are plain arithmetic (`address`), used to place nodes and to fetch siblings alike. The roots of blocks
are the leaves of the tier above, where the same is done again until one node of each tree is left. A block has 8**BLOCK leaves at most, so
no task holds more of a tree than that, however many rows a group has; the number of tiers is the logarithm of the largest group's size.

Places in a group are found by ranges: rows are dealt out by (group, doc_id, digest, row), numbered in their range and shifted by the rows
of the group in the ranges before, so one group, one doc_id or one repeated row may hold any share of the table. Proofs go down the same
tiers: a block hands each of its leaves the siblings above it, and the lowest tier writes a row for every leaf.

Defined results: null is a value of its own ("-") in a digest and a group of its own, which comes first; a null doc_id stands first in its
group and is never tampered. Rows that share a doc_id are leaves of their own, in order of their digests; whole repeats have equal leaves in
neighbouring places, so which of them stands first changes nothing but the place. A group of one row is its own root, and so is a table
of one group; a proof without siblings is the digest of the empty text. An empty table has no root and gives no rows. Columns other than
the five do not count, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import column
from tallyloom.operators.surface import numbered
from tallyloom.session import discard, stored

#: Children of a node.
FAN = 8
#: Most levels of a block above its leaves.
BLOCK = 4
_SIZE = 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(row: dict[str, Column]) -> Column:
    """The digest of a leaf: each value with its length in bytes before it, null as "-"."""
    said = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[said(row[c].cast("string")) for c in FIELDS]), 256))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """group, doc_id, leaf, and `seen`: the leaf as it is found later where the text's A-Z were lower-cased meanwhile, else null."""
    row = {c: F.col(c) for c in FIELDS}
    seen = F.when(tampered, digest_of(row | {"text": _lowered(F.col("text").cast("string"))}))
    return docs.select(*FIELDS).select(F.col("lang").cast("string").alias("group"), F.col("doc_id").cast("bigint").alias("doc_id"), digest_of(row).alias("leaf"), seen.alias("seen"))


def height_of(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def cuts(height: int) -> list[int]:
    """The heights of the tiers of blocks, lowest first: the tree is cut at half its height, and each part again."""
    if height <= BLOCK:
        return [height]
    return cuts(height - height // 2) + cuts(height // 2)


@cache
def address(levels: int, depth: int) -> np.ndarray:
    """Addresses of the nodes `depth` below the root of a complete tree of `levels` levels, in van Emde Boas order.

    The upper half of the levels comes first, then the subtrees below it, one after another, each laid out in the same way.
    """
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth)
    sizes = [(FAN**k - 1) // (FAN - 1) for k in (top, levels - top)]
    subtrees = np.arange(FAN**top, dtype=np.int64)[:, None]
    return (sizes[0] + subtrees * sizes[1] + address(levels - top, depth - top)[None, :]).reshape(-1)


class Block:
    """An aligned subtree of `height` levels over m leaves."""

    def __init__(self, height: int, m: int, nodes: np.ndarray) -> None:
        self.height, self.m, self.nodes = height, m, nodes

    @classmethod
    def built(cls, height: int, leaves: np.ndarray) -> Block:
        """From digests, one row of bytes each."""
        out = cls(height, len(leaves), np.zeros(((FAN ** (height + 1) - 1) // (FAN - 1), _SIZE), np.uint8))
        out.nodes[out.where(0)] = leaves
        for up in range(1, height + 1):
            below = out.said(up - 1)
            above = b"".join(hashlib.sha256("".join(below[i : i + FAN]).encode()).digest() for i in range(0, len(below), FAN))
            out.nodes[out.where(up)] = np.frombuffer(above, np.uint8).reshape(-1, _SIZE)
        return out

    @classmethod
    def read(cls, height: int, m: int, nodes: bytes) -> Block:
        return cls(height, m, np.frombuffer(nodes, np.uint8).reshape(-1, _SIZE))

    def where(self, up: int) -> np.ndarray:
        """Addresses of the nodes that stand `up` levels above the leaves."""
        return address(self.height + 1, self.height - up)[: -(-self.m // FAN**up)]

    def said(self, up: int) -> list[str]:
        text = self.nodes[self.where(up)].tobytes().hex()
        return [text[i : i + 2 * _SIZE] for i in range(0, len(text), 2 * _SIZE)]

    def root(self) -> bytes:
        return self.nodes[self.where(self.height)].tobytes()

    def sides(self) -> list[list[tuple[str, str]]]:
        """Of each level, for each node: its siblings to the left and to the right, as text."""
        out = []
        for up in range(self.height):
            now = self.said(up)
            out.append([("".join(now[i - i % FAN : i]), "".join(now[i + 1 : i - i % FAN + FAN])) for i in range(len(now))])
        return out

    def path(self, sides: list[list[tuple[str, str]]], i: int) -> list[tuple[str, str]]:
        """The siblings of leaf i, level by level."""
        return [level[i // FAN**up] for up, level in enumerate(sides)]


def _split(path: str, *trees: tuple[int, int]) -> list[tuple[str, str]]:
    """A written path as siblings to the left and right of each level, for (place, size) in each of the trees that it climbs."""
    out, at = [], 0
    for place, n in trees:
        while n > 1:
            left = place % FAN
            right = min(FAN, n - (place - left)) - left - 1
            mid, end = at + left * 2 * _SIZE, at + (left + right) * 2 * _SIZE
            out.append((path[at:mid], path[mid:end]))
            at, place, n = end, place // FAN, -(-n // FAN)
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each group in a sorted partition: adds `part` and `place`."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = column(batch, "group").dictionary_encode(null_encoding="encode")
        new = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1) != 0)
        first = codes.dictionary[codes.indices[0].as_py()].as_py()
        lengths = np.diff(np.append(new, batch.num_rows))
        starts = np.zeros(len(new), np.int64)
        if last == (first,):
            starts[0] = count
        place = np.arange(batch.num_rows) - np.repeat(new - starts, lengths)
        count, last = int(place[-1]) + 1, (codes.dictionary[codes.indices[-1].as_py()].as_py(),)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(tree, n, pos, doc_id, leaf, seen) of every leaf; (group, n, tree) of every group, numbered from 0 in the order of groups; and the stored tables behind the first."""
    rows = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part bigint, place bigint"
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_places, schema), "placed")
    discard(rows)
    # a row for each group of each range
    counts = stored(ranged.groupBy("group", "part").agg(F.count(F.lit(1)).alias("here")), "counts")
    trees = numbered(counts.groupBy("group").agg(F.sum("here").alias("n")), "number", F.asc_nulls_first("group"))
    trees = stored(trees.select("group", "n", (F.col("number") - 1).cast("bigint").alias("tree")), "trees")
    before = F.sum("here").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    shift = shift.join(trees.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select(F.col("group").alias("of"), F.col("part").alias("at"), "before", "n", "tree")
    out = ranged.join(shift, F.col("group").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return out.select("tree", "n", (F.col("place") + F.col("before")).alias("pos"), "doc_id", "leaf", "seen"), trees, [ranged, counts]


BLOCKS = "tree bigint, block bigint, n bigint, height int, m int, nodes binary, root binary"
_HELD = ", ids array<bigint>, seen array<binary>"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another, of a partition sorted by tree and block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([*held, batch]).combine_chunks()
        names = [both.column(c).to_numpy() for c in ("tree", "block")]
        ends = np.flatnonzero((np.diff(names[0]) != 0) | (np.diff(names[1]) != 0)) + 1
        start = 0
        for end in ends.tolist():
            yield both.slice(start, end - start)
            start = end
        held = both.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _bytes_of(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, _SIZE)


def blocks(nodes: DataFrame, height: int, held: bool) -> DataFrame:
    """One tier: nodes (tree, n, pos, digest, and doc_id and seen where `held`) as blocks of `height` levels; a tree that fits into one block has as many levels as it needs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = BLOCKS + _HELD * held
    arrow, size = to_arrow_schema(StructType.fromDDL(schema)), FAN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches):
            tree, block, n = (part.column(c)[0].as_py() for c in ("tree", "block", "n"))
            made = Block.built(height if n > size else height_of(n), _bytes_of(part.column("digest")))
            row = {"tree": [tree], "block": [block], "n": [n], "height": [made.height], "m": [made.m], "nodes": [made.nodes.tobytes()], "root": [made.root()]}
            if held:
                row |= {"ids": [part.column("doc_id").to_pylist()], "seen": [part.column("seen").to_pylist()]}
            yield pa.RecordBatch.from_pydict(row, schema=arrow)

    more = ["doc_id", "seen"] if held else []
    cells = nodes.select("tree", "n", "pos", "digest", *more).withColumn("block", F.floor(F.col("pos") / size))
    return cells.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, schema)


def _tiers(nodes: DataFrame, most: int, held: bool) -> list[DataFrame]:
    """The tiers of trees of which the largest has `most` leaves, lowest first; all but the lowest hold trees of several blocks only."""
    out: list[DataFrame] = []
    for height in cuts(height_of(most)):
        out.append(stored(blocks(nodes, height, held and not out), "tier"))
        size = FAN**height
        nodes = out[-1].where(F.col("n") > size).select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest"))
    return out


def _roots(tiers: list[DataFrame], most: int) -> DataFrame:
    """tree and root of every tree."""
    out = None
    for tier, height in zip(tiers, cuts(height_of(most)), strict=True):
        done = tier.where(F.col("n") <= FAN**height).select("tree", "root")
        out = done if out is None else out.unionByName(done)
    return out


_ABOVE = "tree bigint, block bigint, path string, subroot binary"


def _handed(tier: DataFrame) -> DataFrame:
    """For each leaf of blocks that know what is above them: the siblings above the leaf. Without a subroot, the leaf is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = Block.read(row["height"], row["m"], row["nodes"])
                sides, first = made.sides(), row["block"] * FAN ** row["tier"]
                paths = ["".join(left + right for left, right in made.path(sides, i)) + row["path"] for i in range(made.m)]
                roots = [row["subroot"]] * made.m if row["subroot"] is not None else [made.nodes[a].tobytes() for a in made.where(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * made.m, pa.int64()), pa.array(range(first, first + made.m), pa.int64()), pa.array(paths, pa.string()), pa.array(roots, pa.binary())], names=["tree", "block", "path", "subroot"]
                )

    return tier.select("tree", "block", "height", "m", "nodes", "path", "subroot", "tier").mapInArrow(run, _ABOVE)


def _down(tiers: list[DataFrame], most: int, tops: DataFrame) -> DataFrame:
    """What is above each block of the lowest tier; tops: what is above each tree, as its block 0."""
    heights, known = cuts(height_of(most)), None
    for tier, height in reversed([*zip(tiers, heights, strict=True)][1:]):
        last = tier.where(F.col("n") <= FAN**height).join(tops, ["tree", "block"])
        rows = last if known is None else last.unionByName(tier.where(F.col("n") > FAN**height).join(known, ["tree", "block"]))
        known = _handed(rows.withColumn("tier", F.lit(height)))
    single = tiers[0].where(F.col("n") <= FAN ** heights[0]).select("tree", "block").join(tops, ["tree", "block"])
    return single if known is None else single.unionByName(known)


@dataclass
class Manifest:
    """The stored blocks: `tiers` of the groups' trees (the lowest with the rows' ids), `top` of the tree over groups; and `trees` (group, n, tree)."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame
    most: int
    n_trees: int
    root: str | None


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (group, doc_id, leaf, seen)."""
    rows, trees, scratch = placed(leaves)
    most, n_trees = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    tiers = _tiers(rows.withColumnRenamed("leaf", "digest"), most, True)
    discard(*scratch)
    subroots = _roots(tiers, most).select(F.lit(0).cast("bigint").alias("tree"), F.lit(n_trees).cast("bigint").alias("n"), F.col("tree").alias("pos"), F.col("root").alias("digest"))
    top = _tiers(subroots, n_trees, False)
    root = _roots(top, n_trees).first()
    return Manifest(tiers, top, trees, most, n_trees, root and bytes(root["root"]).hex())


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(made: Manifest) -> DataFrame:
    """Every leaf with its proof, and the root that its later state gives with its original siblings."""
    start = made.trees.sparkSession.createDataFrame([(0, 0, "", None)], _ABOVE)
    n_trees, root, height = made.n_trees, made.root, cuts(height_of(made.most))[0]
    heights = cuts(height_of(n_trees))
    under = _down(made.top, n_trees, start)
    tops = _handed(made.top[0].join(under, ["tree", "block"]).withColumn("tier", F.lit(heights[0]))).select(F.col("block").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path", "subroot")
    above = stored(_down(made.tiers, made.most, tops), "above")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: column(batch, c)[i].as_py() for c in batch.schema.names if c != "seen"}
                one = Block.read(row["height"], row["m"], row["nodes"])
                seen, sides = column(batch, "seen")[i].as_py(), one.sides()
                size = FAN**height
                higher = (row["block"], -(-row["n"] // size)) if row["n"] > size else (0, 1)
                beyond = _split(row["path"], higher, (row["tree"], n_trees))
                leaf, hashes, ends = one.said(0), [], []
                for j in range(one.m):
                    path = one.path(sides, j) + beyond
                    hashes.append(hashlib.sha256("".join([x for pair in path for x in pair]).encode()).hexdigest())
                    ends.append(folded(seen[j].hex() if seen[j] is not None else leaf[j], path))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(leaf), pa.array([row["subroot"].hex()] * one.m), pa.array([root] * one.m), pa.array(hashes), pa.array(ends), pa.array([x == root for x in ends])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    lowest = made.tiers[0].join(above, ["tree", "block"]).drop("root")
    return lowest.mapInArrow(run, PROOFS)


def audited(docs: DataFrame, tampered: Column) -> DataFrame:
    """Proof and verdict of every row; where `tampered` holds, the row is later found with its text's A-Z lower-cased."""
    made = manifest(leaves_of(docs, tampered))
    if made.root is None:
        discard(*made.tiers, *made.top, made.trees)
        return docs.sparkSession.createDataFrame([], PROOFS)
    out = stored(proofs(made), "proofs")
    discard(*made.tiers, *made.top, made.trees)
    return out
