"""N-gram Jaccard join of documents: a size-aware join of shingle sets in two forms, light and heavy.

Small sets are joined by enumerated subsets: two sets of n and m shingles reach the threshold exactly when they share a subset of
c(n, m) shingles, so each small set emits its subsets of every such size. Large sets are joined by scanning inverted lists. A list
belongs to a pair of shingles that follow each other in a set's order by hash: where sets of n and m shingles share o and differ in d,
the d part the shared ones into at most d + 1 runs, so at least o - (d + 1) such pairs are common to both, and the first of them
in any fixed order bring two sets that reach the threshold together. A pair of shingles is rare where one shingle is not, so lists hold
near copies and little else at any size of the corpus, without counts of shingles. The size up to which sets are small is the one of
least estimated cost.

Equal sets (known by two 64-bit sums of scrambled hashes, and their size) form one class and join as one node. A list's members are
written as pairs with its first node, so lists of the same family fall together, and all members of one first node are compared in
blocks of bounded size: by parity bits first (each shingle of only one set flips one bit, so more differing bits than the
threshold allows differing shingles rule a pair out for certain), then on whole sets, which are read again for such documents only.
Of the pairs that parities leave, a spanning forest of each block is decided first, then each node's nearest in other components, then
all that join different components: every link between different texts is either decided or implied.

Edge cases: null or empty text, and text without words, has no set: it is its own component. Fewer words than a shingle holds make
one shingle of the whole sequence. Very long texts are one set each (some 100 bytes of arrays for each byte while it is made).
Repeated rows of an id come out once each with the same component; ties don't arise, as components don't depend on order. An empty
table gives no rows. Columns other than the id and the text aren't read, whatever their names. Ids may be of any type with order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_view, column, lowered, map_text, mix, ranked, run_lengths, window_hashes, word_hashes, words
from tallyloom.llm.components import components
from tallyloom.llm.sketches import Members, counted
from tallyloom.session import discard, stored

#: Cells of the sketch that tells hot lists.
HOT_CELLS = 1 << 16
#: Parity words (64 bits each) of a set: by its size, up to the given one.
PARITY = ((4_000, 32), (16_000, 128), (1 << 62, 256))
#: Sizes among which the boundary is chosen.
LARGEST_SMALL = 40
#: Members of one first node that a task compares at once, about; more are cut into blocks that meet in twos.
LARGE_PART = 1024
#: Nearest members of other components that a node is tried with before all are.
NEAREST = 2


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and their bounds (texts + 1 values)."""
    low = lowered(data)
    starts, ends, bounds = words(low, offsets)
    hashes = word_hashes(low, starts, ends)
    sizes = np.diff(bounds)
    owner, place = run_lengths(sizes)
    whole = window_hashes(hashes, width)
    at = np.flatnonzero(place[: len(whole)] + width <= sizes[owner[: len(whole)]]) if len(whole) else np.zeros(0, np.int64)
    values, owners = whole[at], owner[at]
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(few):
        extra = np.zeros(len(few), dtype=np.uint64)
        for k in range(width - 1):
            has = sizes[few] > k
            extra[has] = mix(extra[has] + hashes[bounds[:-1][few][has] + k] + np.uint64(k + 1))
        values, owners = np.concatenate([values, extra]), np.concatenate([owners, few])
    order = ranked(owners, values)
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(sizes) + 1))


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        #: Shingles in a key of an inverted list: two, unless the threshold is so low that no pair need be shared.
        self.run = 2 if all(self._common(n, 2) > 0 for n in range(2, 200)) else 1

    def least_partner(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def most_partner(self, n: int) -> int:
        return self.den * n // self.num

    def overlap(self, n: int, m: int) -> int:
        """The least number of shared shingles with which sizes n and m reach the threshold."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def _common(self, n: int, run: int) -> int:
        """Keys of `run` shingles that a set of n surely shares with any that reaches the threshold."""
        m = np.arange(max(1, self.least_partner(n)), self.most_partner(n) + 1)
        shared = -(-self.num * (n + m) // (self.num + self.den))
        ok = shared <= np.minimum(n, m)
        return int((shared - (run - 1) * (n + m - 2 * shared + 1))[ok].min())

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def prefix(self, n: int) -> int:
        """How many of its keys, in a fixed order, a set of n shingles writes: the first that it shares with a partner are among them."""
        keys = n - self.run + 1
        return max(0, min(keys, keys - self._common(n, self.run) + 1)) if n else 0

    def subset_sizes(self, n: int, largest: int) -> list[int]:
        """Subset sizes that a small set of n shingles emits for partners up to `largest`; equal sets need none."""
        out = {self.overlap(n, m) for m in range(self.least_partner(n), min(self.most_partner(n), largest) + 1)}
        return sorted(c for c in out if c <= n and not (c == n and self.most_partner(n) == n))

    def boundary(self, histogram: np.ndarray) -> int:
        """The size up to which subsets cost less than inverted lists; cost: keys that are written and scanned."""
        best, cost, total = 0, 0.0, 0.0
        for n in range(1, min(len(histogram), LARGEST_SMALL + 1)):
            light = sum(_choose(n, c) for c in self.subset_sizes(n, LARGEST_SMALL))
            total += float(histogram[n]) * (light - self.prefix(n))
            if total < cost:
                best, cost = n, total
        return best

    def allowed(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The most shingles in which sets of n and m may differ; below nought where their sizes rule the threshold out."""
        most = n + m - 2 * -(-self.num * (n + m) // (self.num + self.den))
        return np.where(self.num * np.maximum(n, m) <= self.den * np.minimum(n, m), most, -1)


@lru_cache(maxsize=4096)
def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def subset_keys(values: np.ndarray, sizes: list[int]) -> list[int]:
    """A 64-bit key for each subset of the given sizes; the same subset has the same key in any set."""
    mixed = [int(x) for x in mix(values)]
    total, n, out = sum(mixed), len(mixed), []
    for c in sizes:
        out += [(total - sum(gone)) % (1 << 64) ^ c for gone in combinations(mixed, n - c)]
    return out


def list_keys(values: np.ndarray, bounds: np.ndarray, t: Threshold, floor: int) -> list[np.ndarray]:
    """The inverted lists in which each set of at least `floor` shingles stands."""
    n = np.diff(bounds)
    many = np.array([t.prefix(int(x)) if x >= floor else 0 for x in n], dtype=np.int64)
    keys = window_hashes(values, t.run)
    owner, place = run_lengths(n)
    ok = place[: len(keys)] + t.run <= n[owner[: len(keys)]] if len(keys) else np.zeros(0, bool)
    keys, owner = keys[ok], owner[: len(keys)][ok]
    order = ranked(owner, keys)
    keys, owner = keys[order], owner[order]
    _, place = run_lengths(np.bincount(owner, minlength=len(n)))
    first = place < many[owner]
    cuts = np.concatenate(([0], np.cumsum(many)))
    keys = _signed(mix(keys[first] + np.uint64(0x51ED270B)))
    return [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sum_groups(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _names(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _signed(_sum_groups(mix(values + np.uint64(1)), bounds)), _signed(_sum_groups(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds))


def _parities(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The parity words of each set; a set of twice as many words folds onto one of half as many by exclusive or."""
    sizes = np.diff(bounds)
    longs = np.zeros(len(sizes), dtype=np.int64)
    for limit, count in reversed(PARITY):
        longs[sizes <= limit] = count
    longs[sizes == 0] = 0
    first = np.concatenate(([0], np.cumsum(longs)))
    owner, _ = run_lengths(sizes)
    bit = (values & (longs[owner].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    odd = (np.bincount(first[:-1][owner] * 64 + bit, minlength=int(first[-1]) * 64) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").view(np.int64)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


class Family:
    """Sets that are compared with each other: their sizes and parities."""

    def __init__(self, n: np.ndarray, parity: pa.Array, t: Threshold) -> None:
        self.n, self.t = n, t
        self.width = np.diff(np.asarray(parity.offsets))
        flat = np.asarray(parity.values).view(np.uint64)
        cuts = np.asarray(parity.offsets)
        self.place, self.rows = np.zeros(len(n), dtype=np.int64), {}
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.rows[int(w), int(w)] = flat[cuts[own][:, None] + np.arange(w)]

    def _folded(self, w: int, k: int) -> np.ndarray:
        if (w, k) not in self.rows:
            x = self.rows[w, w]
            self.rows[w, k] = np.bitwise_xor.reduce(x.reshape(len(x), w // k, k), axis=1)
        return self.rows[w, k]

    def slack(self, u: int) -> np.ndarray:
        """For each set: how many differing bits fewer than allowed it has against set u; below nought where it can't reach the threshold."""
        out = self.t.allowed(self.n, self.n[u])
        maybe = out >= 0
        own = int(self.width[u])
        for w in np.unique(self.width[maybe]):
            k = min(int(w), own)
            pick = np.flatnonzero(maybe & (self.width == w))
            differ = self._folded(int(w), k)[self.place[pick]] ^ self._folded(own, k)[self.place[u]]
            out[pick] -= np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return out


Chooser = Callable[[Family, np.ndarray, np.ndarray], Iterator[tuple[int, int]]]


def forest(family: Family, part: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the possible links, from the first member on."""
    left = np.ones(len(part), dtype=bool)
    for start in range(len(part)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            if not left.any():
                return
            for v in np.flatnonzero((family.slack(u) >= 0) & left):
                left[v] = False
                queue.append(int(v))
                yield u, int(v)


def _others(family: Family, part: np.ndarray, side: np.ndarray, u: int) -> np.ndarray:
    """Slack where a member may link u from another component (and side, where a group has two), -1 elsewhere."""
    ok = part != part[u]
    if side.any():
        ok &= side != side[u]
    return np.where(ok, family.slack(u), -1) if ok.any() else np.full(len(part), -1)


def nearest(family: Family, part: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each member's likeliest links into other components."""
    for u in range(len(part)):
        slack = _others(family, part, side, u)
        for v in np.argsort(-slack, kind="stable")[:NEAREST]:
            if slack[v] >= 0:
                yield u, int(v)


def every(family: Family, part: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """All possible links between components."""
    for u in range(len(part)):
        for v in np.flatnonzero(_others(family, part, side, u)[u + 1 :] >= 0):
            yield u, u + 1 + int(v)


def _word_histogram(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """About how many documents have each small set size, by the number of words of short texts; it only sets the boundary."""
    body = F.col(text).cast("string")
    n = F.size(F.split(F.trim(body), "[ \\t-\\r]+"))
    short = docs.where(F.octet_length(body) <= 16 * (LARGEST_SMALL + width)).select(F.greatest(n - width + 1, F.lit(1)).alias("n")).where(F.col("n") <= LARGEST_SMALL)
    out = np.zeros(LARGEST_SMALL + 1)
    for row in short.groupBy("n").count().collect():  # at most LARGEST_SMALL rows
        out[row.n] = row["count"]
    return out


def _indexed(docs: DataFrame, id_col: str, text: str, width: int, t: Threshold, small: int) -> DataFrame:
    """Each row's id, text hash, set size n, set name (f1, f2), join keys, parities and number."""
    kind = docs.schema[id_col].dataType.simpleString()
    floor = t.least_partner(small + 1)

    def rows(part: pa.RecordBatch) -> dict:
        values, bounds = shingle_sets(*byte_view(part, text), width)
        n = np.diff(bounds)
        f1, f2 = _names(values, bounds)
        keys = list_keys(values, bounds, t, floor)
        for i in np.flatnonzero((n > 0) & (n <= small)):
            more = subset_keys(values[bounds[i] : bounds[i + 1]], t.subset_sizes(int(n[i]), small))
            keys[i] = np.concatenate([keys[i], _signed(np.array(more, dtype=np.uint64))]) if more else keys[i]
        return {"id": column(part, "id"), "th": column(part, "th"), "n": n, "f1": f1, "f2": f2, "keys": keys, "parity": _parities(values, bounds)}

    body = F.col(text).cast("string")
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("th"), body.alias(text))
    out = map_text(frame, ["id", "th"], f"id {kind}, th bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>, parity array<bigint>", rows, text)
    return out.withColumn("row", F.monotonically_increasing_id())


def _entries(indexed: DataFrame, classes: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, node, hot: the keys of one row of each class. Rows that a sketch of fixed size knows to be alone of their class aren't moved."""
    again = Members(indexed.where("n > 0").select("row", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "node"), ["n", "f1", "f2"]).where("row <> node").select("row"))

    def exploded(batch: pa.RecordBatch, pick: np.ndarray) -> pa.RecordBatch:
        keys = column(batch, "keys").filter(pa.array(pick))
        flat = np.asarray(keys.flatten())
        node = np.repeat(np.asarray(column(batch, "row"))[pick], np.asarray(keys.value_lengths()))
        return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node), pa.array(hot[_cells(flat)])], names=["key", "node", "hot"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield exploded(b, ~again.has(np.asarray(column(b, "row"))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield exploded(b, np.ones(b.num_rows, dtype=bool))

    schema = "key bigint, node bigint, hot boolean"
    rows = indexed.where("n > 0").select("row", "keys")
    rest = rows.where(again.column(F.col("row"))).join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    return rows.mapInArrow(alone, schema).unionByName(rest.select("row", "keys").mapInArrow(first, schema))


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - HOT_CELLS.bit_length() + 1)).astype(np.int64)


def _hot_cells(indexed: DataFrame) -> np.ndarray:
    """True for the cells of keys whose list is surely or maybe long; only the way in which such lists are dealt out depends on it."""

    def cells(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _cells(np.asarray(batch.column(0).flatten()))

    count = counted(indexed.select("keys"), HOT_CELLS, cells)
    return count > 2 * count.mean() + 4 * LARGE_PART


def _stars(entries: DataFrame, any_hot: bool) -> DataFrame:
    """head, node: each member of a list with the list's first node, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = None
        for b in batches:
            if not b.num_rows:
                continue
            k, v = np.asarray(b.column(0)), np.asarray(b.column(1))
            new = np.ones(len(k), dtype=bool)
            new[1:] = k[1:] != k[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            own = v[begin]
            if key is not None and k[0] == key:
                own = np.where(begin == 0, head, own)
            key, head = k[-1], own[-1]
            both = np.unique(np.stack([own, v], axis=1)[own != v], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["head", "node"])

    schema = "head bigint, node bigint"
    stars = entries.where("not hot").select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, schema)
    if any_hot:  # a long list's first node is a sum by parts, and its members meet it by a join that can be split
        long = entries.where("hot").select("key", "node")
        heads = long.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("key", "head")
        stars = stars.unionByName(long.join(heads, "key").where("head <> node").select("head", "node"))
    return stars.distinct()


def _pairs(members: DataFrame, nodes: DataFrame, t: Threshold, choose: Chooser) -> DataFrame:
    """Pairs (a, b), chosen inside each group of members(g, node, part, side)."""

    def judged(block: pa.Table) -> Iterator[tuple[int, int]]:
        node = block["node"].to_numpy()
        own = Family(block["n"].to_numpy(), block["parity"].combine_chunks(), t)
        for u, v in choose(own, block["part"].to_numpy(), block["side"].to_numpy()):
            yield min(node[u], node[v]), max(node[u], node[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(batch: pa.RecordBatch | None) -> set[tuple[int, int]]:
            """The pairs of the groups that end before batch does."""
            table = pa.Table.from_batches(held)
            g = table["g"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            held[:] = [] if batch is None else table.slice(cuts[-2]).combine_chunks().to_batches()
            stop = len(cuts) - (1 if batch is None else 2)
            return {p for i in range(stop) for p in judged(table.slice(cuts[i], cuts[i + 1] - cuts[i]))}

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            ends = held[0].column(0)[0].as_py() != b.column(0)[b.num_rows - 1].as_py()
            if ends and (found := done(b)):
                yield packed(found)
        if held and (found := done(None)):
            yield packed(found)

    def packed(found: set[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    full = members.join(nodes.select("node", "n", "parity"), "node").select("g", "node", "part", "side", "n", "parity")
    return full.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def _first_groups(stars: DataFrame, t: Threshold) -> DataFrame:
    """Members by first node; of a first node with too many, blocks, each with the first node in it."""
    blocks = stars.groupBy("head").count().where(F.col("count") > LARGE_PART).select("head", F.ceil(F.col("count") / LARGE_PART).alias("blocks"))
    own = stars.join(blocks, "head", "left").withColumn("g", F.xxhash64("head", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))))
    both = own.select("g", "node").unionByName(own.select("g", F.col("head").alias("node")).distinct())
    return both.select("g", "node", F.col("node").alias("part"), F.lit(0).alias("side"))


def _mixed_groups(placed: DataFrame) -> DataFrame:
    """Groups of placed(head, node, part), such that members of different parts meet in one; parts of a first node with many members are cut
    into blocks, and blocks meet in twos, but for those of one part."""
    many = placed.groupBy("head").count().where(F.col("count") > LARGE_PART).select("head")
    plain = placed.join(many, "head", "left_anti").select(F.col("head").alias("g"), "node", "part", F.lit(0).alias("side"))

    wide = placed.join(many, "head")
    size = wide.groupBy("head", "part").agg(F.count(F.lit(1)).alias("own"))
    size = size.withColumn("bulk", F.col("own") > LARGE_PART // 2)
    small = size.where("not bulk").groupBy("head").agg(F.sum("own").alias("rest"))
    size = size.join(small, "head", "left")
    wide = wide.join(size, ["head", "part"])
    block = F.when(F.col("bulk"), F.xxhash64(F.lit(1), "part", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / LARGE_PART))))
    block = block.otherwise(F.xxhash64(F.lit(2), F.pmod(F.xxhash64("part"), F.ceil(F.col("rest") / LARGE_PART))))
    wide = wide.select("head", "node", "part", block.alias("block"), F.when(F.col("bulk"), F.col("part")).alias("only"))
    blocks = wide.select("head", "block", "only").distinct()
    other = blocks.select(F.col("head").alias("o_head"), F.col("block").alias("o_block"), F.col("only").alias("o_only"))
    # Blocks, not members, meet in twos: a first node has its members / LARGE_PART of them.
    meets = blocks.join(other, F.col("head") == F.col("o_head")).where("block <= o_block and not coalesce(only = o_only, false)")
    meets = meets.select("head", "block", "o_block", F.xxhash64("head", "block", "o_block").alias("g"))
    left = wide.join(meets, ["head", "block"]).select("g", "node", "part", F.lit(0).alias("side"))
    other = meets.where("block <> o_block").select("head", F.col("o_block").alias("block"), "g")
    right = wide.join(other, ["head", "block"]).select("g", "node", "part", F.lit(1).alias("side"))
    return plain.unionByName(left).unionByName(right)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """node and its whole set, for the nodes of wanted(node, id, f1, f2); one document of each class is read for it."""
    among = Members(wanted.select(F.xxhash64("id")))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        part = part.filter(pa.array(among.has(np.asarray(column(part, "h")))))
        values, bounds = shingle_sets(*byte_view(part, text), width)
        f1, f2 = _names(values, bounds)
        return {"s_id": column(part, "id"), "s_f1": f1, "s_f2": f2, "items": [_signed(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.col(text).alias(text))
    found = map_text(frame, ["id", "h"], f"s_id {kind}, s_f1 bigint, s_f2 bigint, items array<bigint>", rows, text)
    return wanted.join(found, (F.col("f1") == F.col("s_f1")) & (F.col("f2") == F.col("s_f2")) & F.expr("id <=> s_id")).select("node", "items").dropDuplicates(["node"])


class _Trials:
    """Pairs that were decided, and the sets read for them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, t: Threshold, id_col: str, text: str, width: int) -> None:
        self.docs, self.nodes, self.t, self.how = docs, nodes, t, (id_col, text, width)
        self.sets: list[DataFrame] = []
        self.pairs: list[DataFrame] = []

    def add(self, pairs: DataFrame) -> bool:
        """Decide those of pairs(a, b) that are new; whether any of them is linked."""
        for known in self.pairs:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for known in self.sets:
            need = need.join(known, "node", "left_anti")
        need = stored(self.nodes.join(need, "node", "left_semi").select("node", "id", "f1", "f2"), "need")
        if not need.isEmpty():
            self.sets.append(stored(_sets(self.docs, need, *self.how), "sets"))
        if not self.sets or pairs.isEmpty():
            return False
        sets = self.sets[0]
        for more in self.sets[1:]:
            sets = sets.unionByName(more)
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
        both = F.size(F.array_intersect("a_items", "b_items"))
        union = F.size("a_items") + F.size("b_items") - both
        self.pairs.append(stored(pairs.join(left, "a").join(right, "b").select("a", "b", (self.t.den * both >= self.t.num * union).alias("linked")), "tried"))
        discard(pairs, need)
        return not self.pairs[-1].where("linked").isEmpty()

    def links(self) -> DataFrame:
        out = self.pairs[0]
        for more in self.pairs[1:]:
            out = out.unionByName(more)
        return out.where("linked").select("a", "b")


def _components(docs: DataFrame, width: int, t: Threshold, text: str, id_col: str) -> DataFrame:
    """For each row of docs: id, th (hash of the text), n, part (null for a row without a set): rows of one component have one part."""
    small = t.boundary(_word_histogram(docs, width, text))
    indexed = stored(_indexed(docs, id_col, text, width, t, small), "indexed")
    classes = stored(indexed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("row").alias("node"), F.min("id").alias("id")), "classes")
    hot = _hot_cells(indexed)
    stars = stored(_stars(_entries(indexed, classes, hot), bool(hot.any())), "stars")
    met = stars.select("node").union(stars.select("head")).distinct()
    nodes = indexed.select(F.col("row").alias("node"), "parity").join(met, "node", "left_semi").join(classes, "node")
    nodes = stored(nodes.select("node", "id", "f1", "f2", "n", "parity"), "nodes")
    rows = stored(indexed.select("id", "th", "n", "f1", "f2"), "rows")
    discard(indexed)

    trials = _Trials(docs, nodes, t, id_col, text, width)
    labels = None
    if trials.add(_pairs(_first_groups(stars, t), nodes, t, forest)):
        labels = components(trials.links())
    both = stars.unionByName(stars.select("head", F.col("head").alias("node")).distinct())
    for choose in (nearest, every):
        if not trials.pairs:
            break
        placed = both.withColumn("part", F.col("node")) if labels is None else both.join(labels, "node", "left").select("head", "node", F.coalesce("label", "node").alias("part"))
        mixed = placed.groupBy("head").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("head")
        placed = stored(placed.join(mixed, "head", "left_semi"), "placed")
        if trials.add(_pairs(_mixed_groups(placed), nodes, t, choose)):
            labels = components(trials.links())
        discard(placed)

    place = classes if labels is None else classes.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
    place = place.select(F.col("n").alias("r_n"), F.col("f1").alias("r_f1"), F.col("f2").alias("r_f2"), F.col("node").alias("part"), F.col("id").alias("low_id"))
    same = (F.col("f1") == F.col("r_f1")) & (F.col("f2") == F.col("r_f2")) & (F.col("n") == F.col("r_n"))
    out = stored(rows.join(place, same, "left").select("id", "th", "n", "part", "low_id"), "components")
    discard(rows, stars, nodes, classes, *trials.sets, *trials.pairs)
    return out


def joined(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row of docs: id_col, n_shingles, component_id (smallest id linked with it, over any number of links)."""
    rows = _components(docs, width, Threshold(num, den), text, id_col)
    lowest = rows.where("part is not null").groupBy(F.col("part").alias("of")).agg(F.min("low_id").alias("component_id"))
    return rows.join(lowest, F.col("part") == F.col("of"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs without near copies: of each component the row of smallest id stays (a null id comes last; of equal ids, by the text's hash).

    A row is told by its id and its text, so different texts under one id are judged apart. Rows without words are no copies and stay.
    """
    found = _components(docs, width, Threshold(num, den), text, id_col)
    told = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    kept = found.where("part is not null").groupBy("part").agg(F.min(told).alias("one"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    judged = stored(found.join(kept.drop("rows"), "part").select("id", "th", (told == F.col("one")).alias("stays")), "judged")
    lost = judged.where("not stays").select("id", "th").distinct()
    again = judged.where("stays").groupBy("id", "th").count().where("count > 1").select("id", "th")
    moved = stored(lost.withColumn("lost", F.lit(True)).unionByName(again.withColumn("lost", F.lit(False))), "moved")
    # Only rows that a sketch of fixed size takes for lost or repeated ones are moved to be compared.
    among = Members(moved.select(F.xxhash64("id", "th")))
    body = F.xxhash64(F.col(text).cast("string"))
    marked = docs.withColumn("__near", among.column(F.xxhash64(F.col(id_col), body)))
    near = marked.where("__near").drop("__near").withColumn("__th", body)
    near = near.join(moved.withColumnsRenamed({"id": "__id", "th": "__m_th", "lost": "__lost"}), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__m_th")), "left")
    near = near.where("not coalesce(__lost, false)")
    # Rows that repeat an id and text are the exception: only they are compared with each other.
    once = near.where("__lost is not null").dropDuplicates([id_col, "__th"])
    near = near.where("__lost is null").unionByName(once)
    return marked.where("not __near").drop("__near").unionByName(near.select(*docs.columns))
