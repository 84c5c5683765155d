"""Counting sketches of a fixed size, filled in tasks and summed in rounds of bounded groups."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial sketches that one task sums at once, and cells in a piece.
FAN_IN, PIECE = 64, 1 << 16


def _merged(frame: DataFrame, size: int, kind: type, combine: np.ufunc, fill: Callable[[np.ndarray, pa.RecordBatch], None], pack: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One array, made by `fill` in each task from `size` zeros of `kind`, packed, and combined over all tasks in rounds of FAN_IN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, dtype=kind)
        for batch in batches:
            fill(total, batch)
        packed = pack(total)
        pieces = [(i, packed[at : at + PIECE]) for i, at in enumerate(range(0, len(packed), PIECE))]
        pieces = [(i, zlib.compress(x.tobytes(), 1)) for i, x in pieces if x.any()]
        if pieces:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i for i, _ in pieces], pa.int32()), "part": pa.array([part] * len(pieces), pa.int64()), "body": pa.array([b for _, b in pieces], pa.binary())})

    shape = pack(np.zeros(size, dtype=kind))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(zlib.decompress(group["body"].iloc[0]), dtype=dtype).copy()
        for body in group["body"].iloc[1:]:
            combine(total, np.frombuffer(zlib.decompress(body), dtype=dtype), out=total)
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "part": group["part"].iloc[:1] // FAN_IN, "body": [zlib.compress(total.tobytes(), 1)]})

    schema, dtype = "piece int, part bigint, body binary", shape.dtype
    sums = frame.mapInArrow(run, schema)
    parts = frame.rdd.getNumPartitions()
    while parts > 1:
        sums = sums.groupBy("piece", F.expr(f"part div {FAN_IN}").alias("__to")).applyInPandas(add, schema)
        parts = -(-parts // FAN_IN)
    for row in sums.collect():  # the packed array, whatever the table's size
        x = np.frombuffer(zlib.decompress(row.body), dtype=dtype)
        shape[row.piece * PIECE : row.piece * PIECE + len(x)] = x
    return shape


def counted(frame: DataFrame, cells: int, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Count, for each cell below `cells`, how often `values` names it over all of frame. The result (cells x 8 bytes) is bounded by design."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for cell in values(batch):
            total += np.bincount(cell, minlength=cells)

    return _merged(frame, cells, np.int64, np.add, fill, lambda x: x)


def marked(frame: DataFrame, cells: int, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """A bit for each cell below `cells` (a multiple of 8): whether `values` names it anywhere in frame; packed, cells / 8 bytes."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for cell in values(batch):
            total[cell] = True

    return _merged(frame, cells, np.bool_, np.bitwise_or, fill, np.packbits)


class Members:
    """Answers, for 64-bit numbers, whether they are among those of values' only column: always yes for these, seldom for others while these are few.

    The broadcast bits (cells / 8 bytes) do not grow with the data; beyond their capacity more numbers pass, none is lost.
    """

    def __init__(self, values: DataFrame, cells: int = 1 << 22) -> None:
        self.shift = 64 - cells.bit_length() + 1

        def names(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            yield (np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(shift)).astype(np.int64)

        shift = self.shift
        self.bits = values.sparkSession.sparkContext.broadcast(marked(values, cells, names))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        cell = (numbers.view(np.uint64) >> np.uint64(self.shift)).astype(np.int64)
        return (self.bits.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)

    def column(self, number: Column) -> Column:
        has = self.has

        @F.pandas_udf("boolean")
        def among(x: pd.Series) -> pd.Series:
            return pd.Series(has(x.to_numpy()))

        return among(number)
