"""Suffix-array dedup of exact substrings: every byte covered by a LENGTH-byte string that also starts elsewhere is removed.

The method is bucket-pointer refinement over a sparse set of suffixes. Every LENGTH-byte string names one q-gram inside it, its
anchor: of the q-grams that begin in its first WINDOW bytes the one of least hash, and of equals the leftmost. Equal strings have
equal anchors at equal places, so suffixes are bucketed by their anchor's q-gram first, and consecutive starts of one anchor are a run:

1. Initial buckets: runs with the same q-gram, counted by Spark. A bucket of one run holds no repeat. Runs that agree in all the
   bytes their strings span are repeats as a whole; one of them stays as the others' stand-in.
2. Refinement: in a bucket that holds unequal runs, each start's bucket is split by sorting on the bucket identifiers of later
   offsets: names of STEP bytes, then of 2, 4 and 8 STEP = LENGTH bytes, each from the pair (own bucket, bucket that far on) of the
   round before, all starts reusing the same updates. Only members of buckets of two or more stay in the game.
3. A bucket with more than HOT unequal runs is not gathered. Its runs are cut into cells of CELL starts, at places that the anchor fixes.
   Cells are counted by the name of the bytes that all their strings share (alone: no repeat) and by that of all their bytes
   (repeated: all are); only the starts of cells between the two are named one by one, and counted.

Names are 64-bit polynomial hashes of exact bytes. Intervals meet their texts at the end; texts that a sketch of fixed size rules out are not moved.

Edge cases: null or empty texts and texts below LENGTH lose nothing; strings never cross documents; overlapping repeats count; rows that
repeat an id and text are repeats of one another, each with a row of its own; ids may be of any type. Very long texts are cut nowhere: a text is
one row, and takes some 100 bytes of arrays for each of its bytes while it is read. Of anchors with equal hashes the leftmost counts; which of
repeated runs stands in for the others changes no result. An empty table gives no rows, and columns other than the id and the text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_view, column, map_text, mix, prefix_sums, run_lengths, span_hash
from tallyloom.llm.sketches import Members
from tallyloom.session import stored

LENGTH, STEP, GRAM = 400, 50, 145
WINDOW = LENGTH - GRAM + 1
#: Unequal runs that one bucket may hold before it is counted instead of gathered; runs refined at once.
HOT, BLOCK = 512, 1024
#: Bytes of text whose q-grams a task names at once (some 100 bytes of arrays for each).
SLICE = 1 << 19
#: Starts that a large bucket's runs are first cut into.
CELL = 16
_PLACE_BITS = 31


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    n = max(0, len(x) - width + 1)
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of starts with one anchor: its text, first and last start and anchor (within the text), q-gram name, span name."""
    size = np.diff(offsets)
    sums = prefix_sums(data)
    starts = max(0, len(data) - GRAM + 1)
    at = np.arange(starts)
    name = span_hash(sums, at, at + GRAM)
    owner = np.repeat(np.arange(len(size)), size)
    inside = at + LENGTH <= offsets[1:][owner[:starts]] if starts else np.zeros(0, bool)
    packed = (name >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    least = _window_min(packed, WINDOW)
    ok = np.flatnonzero(inside[: len(least)])
    anchor = (least[ok] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(ok), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(ok)]))[: len(first)] - 1
    a, b, p = ok[first], ok[last], anchor[first]
    text = owner[a]
    base = offsets[:-1][text]
    span = mix(span_hash(sums, a, b + LENGTH) + (p - a).astype(np.uint64))
    return text, a - base, b - base, p - base, name[p].view(np.int64), span.view(np.int64)


def repeated_starts(bucket: np.ndarray, spans: list[bytes], before: np.ndarray) -> np.ndarray:
    """Refine the starts of unequal runs: True at [run, k] where the string k bytes before the anchor also is another run's.

    bucket: the initial bucket of each run; spans: its bytes, from its first start to its last string's end; before: anchor minus first start.
    """
    reach = WINDOW - 1
    width = reach + LENGTH
    rows = len(spans)
    x = np.zeros((rows, width), dtype=np.uint8)
    size = np.array([len(s) for s in spans])
    _, place = run_lengths(size)
    x[np.repeat(np.arange(rows), size), place + np.repeat(reach - before, size)] = np.frombuffer(b"".join(spans), np.uint8)
    _, home = np.unique(bucket, return_inverse=True)
    sums = prefix_sums(x.reshape(-1))
    columns = width - STEP + 1
    at = (np.arange(rows)[:, None] * width + np.arange(columns)[None]).reshape(-1)
    where = (home[:, None] * np.int64(width) + np.arange(columns)[None]).reshape(-1).astype(np.uint64)
    pointer = _buckets(mix(span_hash(sums, at, at + STEP) + mix(where + np.uint64(1)))).reshape(rows, columns)
    step = STEP
    while step < LENGTH:
        own, later = pointer[:, : pointer.shape[1] - step], pointer[:, step:]
        live = (own >= 0) & (later >= 0)
        step *= 2
        if step == LENGTH:  # column of the start k bytes before the anchor: reach - k; only the run's own starts count
            k = reach - np.arange(own.shape[1])[None]
            live &= (k <= before[:, None]) & (k >= (before - size + LENGTH)[:, None])
        refined = np.full(own.shape, -1, dtype=np.int64)
        refined[live] = _buckets(own[live] * (pointer.max(initial=0) + 1) + later[live])
        pointer = refined
    return pointer[:, ::-1] >= 0


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Bucket numbers by sorting; -1 for a key that stands alone."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(counts[inverse] > 1, inverse, -1)


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))


def _row_hash() -> Column:
    return F.xxhash64("id", "th")


def _runs_of(keyed: DataFrame, kind: str) -> DataFrame:
    def rows(part: pa.RecordBatch) -> dict:
        text, a, b, p, gram, span = runs(*byte_view(part, "text"))
        take = pa.array(text)
        return {"id": column(part, "id").take(take), "th": column(part, "th").take(take), "a": a, "b": b, "p": p, "gram": gram, "span": span}

    return map_text(keyed, ["id", "th"], f"id {kind}, th bigint, a int, b int, p int, gram bigint, span bigint", rows, limit=SLICE)


def _spans_of(keyed: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """wanted(id, th, a, b, p, gram, lone, hot) with the bytes of each run, read from one row of its text."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b", "p", "gram", "lone", "hot")).alias("runs"))
    near = keyed.where(Members(wanted.select(_row_hash())).column(_row_hash()))
    found = near.withColumnsRenamed({"id": "t_id", "th": "t_th"}).join(lists, F.expr("id <=> t_id") & (F.col("th") == F.col("t_th"))).select("id", "th", "text", "runs").dropDuplicates(["id", "th"])

    def rows(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("pick", "a", "b", "p", "gram", "lone", "hot", "body")}
        data, offsets = byte_view(part, "text")
        for i, given in enumerate(column(part, "runs").to_pylist()):
            for r in given:
                out["pick"].append(i)
                for c in ("a", "b", "p", "gram", "lone", "hot"):
                    out[c].append(r[c])
                out["body"].append(data[offsets[i] + r["a"] : offsets[i] + r["b"] + LENGTH].tobytes())
        take = pa.array(out.pop("pick"), pa.int64())
        return out | {"id": column(part, "id").take(take), "th": column(part, "th").take(take)}

    return map_text(found, ["id", "th", "runs"], f"id {kind}, th bigint, a int, b int, p int, gram bigint, lone boolean, hot boolean, body binary", rows)


def _refined(spans: DataFrame, kind: str) -> DataFrame:
    """Intervals (id, th, s, e) of repeats inside buckets that are gathered: each bucket in one task, at most HOT runs of it."""

    def judge(block: pa.Table) -> pa.RecordBatch:
        a, p = block["a"].to_numpy(), block["p"].to_numpy()
        flags = repeated_starts(block["gram"].to_numpy(), block["body"].to_pylist(), p - a)
        pick, s, e = [], [], []
        for i in np.flatnonzero(block["lone"].to_numpy(zero_copy_only=False) & flags.any(axis=1)):
            for k0, k1 in _stretches(flags[i]):
                pick.append(i)
                s.append(p[i] - k1)
                e.append(p[i] - k0 + LENGTH)
        some = block.select(["id", "th"]).take(pa.array(pick, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([_flat(some["id"]), _flat(some["th"]), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            gram = batch.column(batch.schema.get_field_index("gram")).to_numpy()
            edges = np.flatnonzero(gram[1:] != gram[:-1]) + 1 if len(gram) else np.zeros(0, np.int64)
            done = 0
            if held and len(gram) and held[-1].column(held[-1].schema.get_field_index("gram"))[-1].as_py() != gram[0] and sum(h.num_rows for h in held) >= BLOCK:
                yield judge(pa.Table.from_batches(held))
                held = []
            for edge in edges:
                if sum(h.num_rows for h in held) + edge - done >= BLOCK:
                    held.append(batch.slice(done, edge - done))
                    yield judge(pa.Table.from_batches(held))
                    held, done = [], int(edge)
            held.append(batch.slice(done))
        if sum(h.num_rows for h in held):
            yield judge(pa.Table.from_batches(held))

    cold = spans.where(~F.col("hot")).repartition("gram").sortWithinPartitions("gram")
    return cold.mapInArrow(run, f"id {kind}, th bigint, s int, e int")


def _flat(chunked: pa.ChunkedArray) -> pa.Array:
    return chunked.combine_chunks() if isinstance(chunked, pa.ChunkedArray) else chunked


def _cells_of(spans: DataFrame, kind: str) -> DataFrame:
    """The cells of runs in large buckets: starts s .. s + n - 1, the names of their core and of all their bytes, and these bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("pick", "s", "n", "core", "whole", "body")}
            a, b, p = (column(batch, c).to_pylist() for c in ("a", "b", "p"))
            for i, body in enumerate(column(batch, "body").to_pylist()):
                sums = prefix_sums(np.frombuffer(body, np.uint8))
                for cell in range((p[i] - b[i]) // CELL, (p[i] - a[i]) // CELL + 1):
                    first, last = max(a[i], p[i] - CELL * cell - CELL + 1), min(b[i], p[i] - CELL * cell)
                    core = p[i] - CELL * cell - a[i]
                    names = span_hash(sums, np.array([core, first - a[i]]), np.array([core + LENGTH - CELL + 1, last - a[i] + LENGTH]))
                    names = mix(names + np.array([cell, p[i] - first], dtype=np.uint64)).view(np.int64)
                    for c, v in zip(out, (i, first, last - first + 1, int(names[0]), int(names[1]), body[first - a[i] : last - a[i] + LENGTH]), strict=True):
                        out[c].append(v)
            take = pa.array(out["pick"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id").take(take), column(batch, "th").take(take), column(batch, "lone").take(take), pa.array(out["s"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["core"], pa.int64()), pa.array(out["whole"], pa.int64()), pa.array(out["body"], pa.binary())],
                names=["id", "th", "lone", "s", "n", "core", "whole", "body"],
            )

    return spans.where("hot").mapInArrow(run, f"id {kind}, th bigint, lone boolean, s int, n int, core bigint, whole bigint, body binary")


def _counted(spans: DataFrame, kind: str) -> DataFrame:
    """Intervals of repeats inside buckets too large to gather, from counts of cells, then of the starts that cells leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = (column(batch, c).to_numpy() for c in ("s", "n"))
            names = []
            for body in column(batch, "body").to_pylist():
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                names.append(span_hash(prefix_sums(data), at, at + LENGTH).view(np.int64))
            owner, place = run_lengths(n)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id").take(take), column(batch, "th").take(take), column(batch, "lone").take(take), pa.array((s[owner] + place).astype(np.int32)), pa.array(np.concatenate(names) if names else np.zeros(0, np.int64))],
                names=["id", "th", "lone", "s", "name"],
            )

    cells = stored(_cells_of(spans, kind), "cells")
    often = lambda df, c: df.groupBy(c).count().where("count > 1").select(c)
    live = stored(cells.join(often(cells, "core"), "core", "left_semi"), "live")
    whole = stored(often(live, "whole"), "whole")
    settled = live.where("lone").join(whole, "whole", "left_semi").select("id", "th", "s", (F.col("s") + F.col("n") - 1 + LENGTH).alias("e"))
    stand = live.join(whole, "whole", "left_semi").groupBy("whole").agg(F.min_by(F.struct("id", "th", "s", "n", "body"), F.struct("id", "th", "s")).alias("r"))
    open_cells = live.join(whole, "whole", "left_anti").select("id", "th", "lone", "s", "n", "body").unionByName(stand.select("r.id", "r.th", F.lit(False).alias("lone"), "r.s", "r.n", "r.body"))
    starts = stored(open_cells.mapInArrow(run, f"id {kind}, th bigint, lone boolean, s int, name bigint"), "starts")
    single = starts.where("lone").join(often(starts, "name"), "name", "left_semi").select("id", "th", "s", (F.col("s") + LENGTH).alias("e"))
    return settled.unionByName(single)


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, th (hash of the text), s, e: byte intervals, which together cover what is to be removed of each text."""
    keyed = _keyed(docs, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()
    found = stored(_runs_of(keyed, kind), "runs")
    equal = found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "a", "b", "p")).alias("stand"))
    equal = stored(equal, "equal")
    buckets = equal.groupBy("gram").agg(F.count(F.lit(1)).alias("unequal"), F.sum((F.col("n") == 1).cast("int")).alias("lone")).where("unequal > 1 and lone > 0").select("gram", (F.col("unequal") > HOT).alias("hot"))
    wanted = equal.join(buckets, "gram").select("stand.*", "gram", (F.col("n") == 1).alias("lone"), "hot")
    wanted = stored(wanted, "wanted")
    spans = stored(_spans_of(keyed, wanted, kind), "spans")
    whole = found.join(equal.where("n > 1").select("gram", "span"), ["gram", "span"], "left_semi").select("id", "th", F.col("a").alias("s"), (F.col("b") + LENGTH).alias("e"))
    return whole.unionByName(_refined(spans, kind)).unionByName(_counted(spans, kind))


def _merged(intervals: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in intervals or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(body[at:s])
        at = e
    return b"".join([*parts, body[at:]])


def removed(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For each row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = _keyed(docs, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()
    lists = stored(repeats(docs, text, id_col).groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "intervals")
    among = Members(lists.select(_row_hash()))
    hashed = keyed.withColumn("row", _row_hash())

    def digest(part: pa.RecordBatch) -> dict:
        data, offsets = byte_view(part, "text")
        out = {id_col: column(part, "id"), "n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept_sha256": []}
        for i, given in enumerate(column(part, "spans").to_pylist()):
            spans = _merged(given)
            out["n_removed"].append(sum(e - s for s, e in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(_kept(data[offsets[i] : offsets[i + 1]].tobytes(), spans)).hexdigest())
        return out

    def digest_others(part: pa.RecordBatch) -> dict:
        return digest(part.filter(pa.array(~among.has(np.asarray(column(part, "row"))))))

    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    none = F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans")
    untouched = hashed.select("id", "row", "text", none)
    mine = lists.withColumnsRenamed({"id": "l_id", "th": "l_th"})
    near = hashed.where(among.column(F.col("row")))
    touched = near.join(mine, F.expr("id <=> l_id") & (F.col("th") == F.col("l_th")), "left").select("id", "text", "spans")
    return map_text(untouched, ["id", "row", "spans"], schema, digest_others).unionByName(map_text(touched, ["id", "spans"], schema, digest))
