"""Flat exports of nested rows, driven by their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tallyloom.functions.text import csv_line


def cells(schema: StructType, joiner: str = "; ") -> list[tuple[str, Column]]:
    """A name and a text for every cell of a flat row: structs are taken apart (a.b), lists of plain values joined, lists of structs and maps written as JSON."""
    out: list[tuple[str, Column]] = []

    def walk(name: str, kind: DataType, value: Column) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}" if name else f.name, f.dataType, value[f.name] if name else F.col(f"`{f.name}`"))
        elif isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StructType, ArrayType, MapType)):
            out.append((name, F.array_join(F.transform(value, lambda x: x.cast("string")), joiner)))
        elif isinstance(kind, (ArrayType, MapType)):
            out.append((name, F.to_json(value)))
        else:
            out.append((name, value.cast("string")))

    walk("", schema, F.lit(None))
    return out


def flat(df: DataFrame) -> DataFrame:
    """One text column for every cell of df's rows."""
    return df.select(*[value.alias(name) for name, value in cells(df.schema)])


def csv(df: DataFrame) -> tuple[str, DataFrame]:
    """The header and `line` for each row, cells quoted and safe for a sheet. Rows may be exploded before (`by_entry`), one line for each entry."""
    found = cells(df.schema)
    return ",".join(f'"{name}"' for name, _ in found), df.select(csv_line(*[value for _, value in found]).alias("line"))


def by_entry(df: DataFrame, column: str) -> DataFrame:
    """A row for each entry of an array of structs, with its place (`pos`, from 0) and its fields beside the other columns; rows without entries stay, with nulls."""
    fields = df.schema[column].dataType.elementType.names
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode_outer(column).alias("pos", "__entry"))
    return out.select(*rest, "pos", *[F.col("__entry")[f].alias(f"{column}_{f}") for f in fields])


def with_sources(rows: DataFrame, key: str, edges: DataFrame, sources: DataFrame, source_key: str, shown: list[str]) -> DataFrame:
    """rows with `sources`: structs of the shown columns, in the order of edges(key, source_key, pos), each source once at its first place; unknown sources are left out.

    An entry's sources are bounded by what a reader is shown; edges are reduced to one for each (row, source) before they meet the sources.
    """
    first = edges.groupBy(key, source_key).agg(F.min("pos").alias("pos"))
    packed = F.array_sort(F.collect_list(F.struct("pos", F.col(source_key), F.struct(*shown).alias("s"))))
    listed = first.join(sources, source_key).groupBy(key).agg(F.transform(packed, lambda x: x["s"]).alias("sources"))
    return rows.join(listed, key, "left").withColumn("sources", F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)))
