"""Work on text columns inside Arrow batches: bounded slices, byte views and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut each batch into runs of rows with at most `limit` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        start = base = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts as Python strings; null counts as empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column(batch, name).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def byte_view(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column in one array, and n + 1 offsets into it; null counts as empty."""
    a = pc.fill_null(column(batch, name).cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    body = a.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# The white space that ends a word, and the lower case of A-Z.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
POWERS_KEPT = 1 << 21


def _power(which: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown as needed and kept up to POWERS_KEPT."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.uint64(_BASE if which == "up" else _INVERSE)
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = base
        have = np.multiply.accumulate(have)
        if size <= POWERS_KEPT:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that sums and orders of hashes are not those of the polynomial."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (data[k] + 1) * base**k over i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of data[start:end], the same wherever those bytes stand."""
    return mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and for each text the index of its first word (n + 1 values)."""
    solid = ~_IS_SPACE[data]
    n = len(data)
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] |= solid[cuts]
        last[cuts - 1] |= solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), starts, ends)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The name of each run of `width` consecutive word hashes (text ends are the caller's matter)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def ranked(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by owner, then by 64-bit value; of one owner equal values stand together."""
    bits = max(1, int(owner.max(initial=0)).bit_length())
    packed = owner.astype(np.uint64) << np.uint64(64 - bits) | values >> np.uint64(bits)
    order = np.argsort(packed)
    packed, sorted_values = packed[order], values[order]
    if np.any((packed[1:] == packed[:-1]) & (sorted_values[1:] != sorted_values[:-1])):  # values that differ in their last bits only
        return np.lexsort((values, owner))
    return order


def run_lengths(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid out one after another: each element's group, and its place in the group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return group, place


def in_one_task(sample: DataFrame, work: Callable[[pa.Table], object]) -> object:
    """What `work` makes of a sample of bounded size, in one task. Only the result comes to the driver, not the sample or what work needs besides."""
    import pickle

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work(pa.Table.from_batches(list(batches), schema))
        yield pa.RecordBatch.from_pydict({"body": pa.array([pickle.dumps(made)], pa.binary())})

    return pickle.loads(sample.repartition(1).mapInArrow(run, "body binary").first()["body"])


def map_text(
    docs: DataFrame, keep: list[str], schema: str, rows: Callable[[pa.RecordBatch], dict[str, object]], text: str = "text", limit: int = SLICE_BYTES
) -> DataFrame:
    """Apply `rows` to slices of docs(keep..., text) of at most `limit` bytes of text; it returns the columns of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, limit):
            out = rows(part)
            yield pa.RecordBatch.from_arrays(
                [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow
            )

    return docs.select(*dict.fromkeys([*keep, text])).withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema)
