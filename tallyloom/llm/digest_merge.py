"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations alone.

Every input partition is cut into runs of at most RUN_ROWS rows. A run holds, sorted, one row for each digest: how many rows have it, and the
smallest identifier among them. In each round of the tree FAN neighbouring runs (FAN is a power of two, so a round is log2(FAN) rounds of a
binomial tree) meet under their parent: Spark's sort aggregate sorts and combines each run before it is sent and merges what arrives, so a
level has one row for each digest of a parent, and no digest brings more than FAN rows to one place, however many copies a text has. A level's
rows are dealt by parent and digest, never by parent alone, so the last levels are as wide as the first. Results then go down the same
tree: each level joins its parent's rows, FAN children at most, and the rows of a run join their run. So a text that stands on a third of all
rows is spread over all runs at the bottom and is a few rows everywhere above.

Two texts are equal when they are identical after white space (space and U+0009 to U+000D) is deleted. Digests are SHA-256; equal digests
merge only where the normalised texts' length in bytes and a second, independent 64-bit hash agree too, at every level.

Defined results: a null text counts as empty, and all texts without a letter are one group. Of equal texts the row with the most code points
before normalisation stays, then the smallest doc_id (null last), then, among repeated rows, the first in the order of the stored rows, so
exactly one row of a group stays. Texts of any length are one digest. An empty table gives an empty result. Other columns take no part,
and columns of the table whose names are the same as the result's are not read unless they are doc_id or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import discard, stored

#: Runs that meet in one round: 2**5, five rounds of a binomial tree at once.
FAN = 32
#: Rows of a run.
RUN_ROWS = 1 << 15

# The white space that the comparison leaves out.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_KEY = ("digest", "n_bytes", "second")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest, n_bytes, second, n_points of each row: the only pass over texts. `row` is unique in the table as it is written."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("body", normalised(F.col("text")))
    row = text.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.octet_length("body").cast("bigint").alias("n_bytes"),
        F.xxhash64("body").alias("second"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_points"),
    )
    return stored(row, "digests")


def numbered_runs(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with `run`, and the number of run names; pieces beyond the first of a partition follow all partitions, so the numbers stay dense."""
    # the upper bits of `row` are the input partition, the lower ones the place in it
    rows = rows.withColumn("part", F.shiftright("row", 33)).withColumn("piece", F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / RUN_ROWS))
    parts, pieces = rows.agg(F.coalesce(F.max("part") + 1, F.lit(0)), F.coalesce(F.max("piece") + 1, F.lit(0))).first()
    return rows.withColumn("run", F.col("piece") * F.lit(parts) + F.col("part")).drop("part", "piece"), parts * pieces


def _smallest() -> Column:
    """Orders the rows of a group: the longest original first, then the smallest doc_id, then the first row."""
    return F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def merged_runs(runs: DataFrame, parent: Column) -> DataFrame:
    """One level of the tree: the digests of runs with equal `parent`, each with its number of rows and its smallest identifier."""
    return runs.withColumn("run", parent).groupBy("run", *_KEY).agg(F.sum("size").alias("size"), F.min("best").alias("best"))


def groups(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All rows of docs as (row, doc_id, digest, n_bytes, best, size), and the stored tables that the caller discards."""
    digests = digest_rows(docs)
    rows, count = numbered_runs(digests)
    runs = rows.select("run", *_KEY, F.lit(1).cast("bigint").alias("size"), _smallest().alias("best"))
    levels = [stored(merged_runs(runs, F.col("run")), "runs")]
    while count > 1:
        count = -(-count // FAN)
        levels.append(stored(merged_runs(levels[-1], F.floor(F.col("run") / FAN)), "runs"))
    settled = levels[-1]
    for level in reversed(levels[:-1]):
        below = level.select(F.floor(F.col("run") / FAN).alias("parent"), *_KEY, F.col("run").alias("child"))
        above = settled.withColumnRenamed("run", "parent")
        settled = below.join(above, ["parent", *_KEY]).select(F.col("child").alias("run"), *_KEY, "size", "best")
    out = rows.select("run", *_KEY, "row", "doc_id").join(settled, ["run", *_KEY])
    return out.select("row", "doc_id", "digest", "n_bytes", "size", "best"), [digests, *levels]


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    found, tables = groups(docs)
    out = stored(
        found.select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("size").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        ),
        "duplicates",
    )
    discard(*tables)
    return out
