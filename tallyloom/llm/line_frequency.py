"""Quality by cross-document line frequency: lines that too many documents of a host share are removed, and a document of which
too little is left is rejected. Word figures of the whole text add a plain rule.

A line counts where it holds a word; it is compared in normal form (lower case, digits as one sign, white space collapsed).
Frequency is the number of documents of the host that hold the line: distinct ids (a document without an id is told by its text),
or, where by_id is false, distinct texts, so that exact copies count once. A line is common above a fixed number of them, whatever the
host's size, or above a share of the host's, with a floor for small hosts. Partial counts are made before each shuffle, so a line
that a third of all rows holds is summed, not gathered.

Edge cases: null or empty text has no words and fails the plain rule; a null host is a host of its own; repeated rows of one id
keep a row each; a document whose lines are all common is rejected. A line that stands exactly at a limit is not common, and a document of which exactly the least
share is left is kept. Very long texts are read whole, lines of any length too. An empty table gives no rows, and columns other than those named are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.arrow_text import byte_view, column, map_text, run_lengths, texts, window_hashes, word_hashes, words

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line is common where more documents of its host hold it than LINE_LIMIT, or than both LINE_FLOOR and LINE_SHARE of the host's documents.
LINE_LIMIT, LINE_SHARE, LINE_FLOOR = 50, 0.02, 10
#: A document is depleted where less than this share of its words is left.
LEAST_LEFT = 0.3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SPACES = re.compile(r"[ \t-\r]+")
_DIGITS = re.compile(r"[0-9]+")


def normal_line(line: str) -> str:
    return _DIGITS.sub("0", _SPACES.sub(" ", line.strip(SPACE)).lower())


def line_hash(normal: str) -> int:
    return int.from_bytes(hashlib.blake2b(normal.encode(), digest_size=8).digest(), "little", signed=True)


def repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text (words bounds[i]:bounds[i+1]) the words that stand in a WINDOW-word run found twice or more in it."""
    sizes = np.diff(bounds)
    owner, place = run_lengths(sizes)
    whole = window_hashes(hashes, WINDOW)
    starts = np.flatnonzero(place[: len(whole)] + WINDOW <= sizes[owner[: len(whole)]]) if len(whole) else np.zeros(0, np.int64)
    order = np.lexsort((whole[starts], owner[starts]))
    s = starts[order]
    same = (owner[s][1:] == owner[s][:-1]) & (whole[s][1:] == whole[s][:-1])
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    marks = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(marks, s[twice], 1)
    np.add.at(marks, s[twice] + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(marks[:-1]) > 0)))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def word_figures(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: the word figures, the text's hash, and its distinct lines (normal form's hash, words in all)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> dict:
        data, offsets = byte_view(part, text)
        starts, ends, bounds = words(data, offsets)
        solid = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        chars = np.concatenate(([0], np.cumsum(solid[ends] - solid[starts])))
        signs = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        out = {
            "n_words": np.diff(bounds),
            "word_chars": chars[bounds[1:]] - chars[bounds[:-1]],
            "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
            "n_repeat_words": repeated_words(word_hashes(data, starts, ends), bounds),
            "n_dup_lines": [],
            "text_hash": [],
            "lines": [],
        }
        for t in texts(part, text):
            seen: set[str] = set()
            again = 0
            own: dict[int, int] = {}
            for line in t.split("\n"):
                if not line.strip(SPACE):
                    continue
                if line in seen:
                    again += 1
                seen.add(line)
                normal = normal_line(line)
                h = line_hash(normal)
                own[h] = own.get(h, 0) + normal.count(" ") + 1
            out["n_dup_lines"].append(again)
            out["text_hash"].append(line_hash(t))
            out["lines"].append([{"h": h, "w": w} for h, w in own.items()])
        return out | {id_col: column(part, id_col), "host": column(part, host)}

    schema = f"`{id_col}` {kind}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, text_hash bigint, lines array<struct<h: bigint, w: bigint>>"
    return map_text(docs.withColumn(host, F.col(host).cast("string")), [id_col, host], schema, rows, text)


def common_lines(figures: DataFrame, limit: int = LINE_LIMIT, share: float = LINE_SHARE, floor: int = LINE_FLOOR, by: str = "text_hash") -> DataFrame:
    """host, h, n: the lines that more than `limit` documents, or more than `floor` and `share` of the host's documents, hold.

    Documents are distinct values of figures' column `by`; one that is null is told by its text.
    """
    document = F.struct(F.col(by), F.when(F.col(by).isNull(), F.col("text_hash")))
    hosts = figures.groupBy("host").agg(F.count_distinct(document).alias("n_docs"))
    lines = figures.select("host", document.alias("document"), F.explode("lines.h").alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count_distinct("document").alias("n")).where(F.col("n") > min(limit, floor))
    common = (F.col("n") > limit) | ((F.col("n") > floor) & (F.col("n") > share * F.col("n_docs")))
    return counts.alias("c").join(hosts.alias("o"), F.expr("c.host <=> o.host")).where(common).select("c.host", "h", "n")


def line_verdicts(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    id_col: str = "doc_id",
    limit: int = LINE_LIMIT,
    share: float = LINE_SHARE,
    least_left: float = LEAST_LEFT,
    floor: int = LINE_FLOOR,
    by_id: bool = False,
) -> DataFrame:
    """For each row of docs: the figures, base_failed, n_common_lines, n_left_words, kept.

    by_id: a line's documents are counted by id, so that copies count; otherwise by text.
    """
    from tallyloom.session import stored

    figures = stored(word_figures(docs, host, text, id_col).withColumn("row", F.monotonically_increasing_id()), "lines")
    common = common_lines(figures, limit, share, floor, id_col if by_id else "text_hash").select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))
    lines = figures.select("row", "host", F.inline("lines"))
    lost = (
        lines.join(common, F.expr("host <=> c_host") & (F.col("h") == F.col("c_h")))
        .groupBy("row")
        .agg(F.sum("w").alias("lost_words"), F.count(F.lit(1)).alias("n_common_lines"))
    )
    whole = figures.drop("lines", "text_hash").join(lost, "row", "left").na.fill(0, ["lost_words", "n_common_lines"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    return whole.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= least_left * F.col("n_words"))).alias("kept"),
        "n_common_lines",
        left.alias("n_left_words"),
    )


def without_common_lines(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id", limit: int = LINE_LIMIT, share: float = LINE_SHARE) -> DataFrame:
    """docs with each common line of its host taken out of `text` (a text of which all lines are common becomes empty)."""
    from tallyloom.session import stored

    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    figures = stored(word_figures(numbered.withColumn("__id", F.col("__row")), host, text, "__id"), "lines")
    common = common_lines(figures, limit, share).select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))
    gone = (
        figures.select("__id", "host", F.inline("lines")).join(common, F.expr("host <=> c_host") & (F.col("h") == F.col("c_h")))
        .groupBy("__id").agg(F.collect_list("h").alias("__gone"))
    )
    joined = numbered.join(gone, numbered["__row"] == gone["__id"], "left").drop("__id")
    keep = [c for c in docs.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def rows(part: pa.RecordBatch) -> dict:
        out = []
        for t, ids in zip(column(part, text).to_pylist(), column(part, "__gone").to_pylist(), strict=True):
            drop = set(ids or ())
            out.append(t if not drop else "\n".join(x for x in t.split("\n") if not x.strip(SPACE) or line_hash(normal_line(x)) not in drop))
        return {c: column(part, c) for c in keep} | {text: out}

    schema = ", ".join(f"`{c}` {kinds[c] if c != text else 'string'}" for c in [*keep, text])
    return map_text(joined, [*keep, "__gone"], schema, rows, text).select(*docs.columns)
