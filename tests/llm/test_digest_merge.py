import hashlib
import re

import duckdb
import pytest

from tallyloom.llm import digest_merge
from tallyloom.llm.queries import ORACLE_SQL, QUERIES


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = [None] * len(rows)
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (m[4], best[4], len(members), m is best, hashlib.sha256(body.encode()).hexdigest())
    return out


def said(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()), key=repr)


ROWS = [
    (5, "a b"), (3, "ab"), (9, " a\tb\r\n"), (1, "ab\x0b\x0c"), (2, "a b"), (4, None), (6, ""), (7, " \t"), (8, "Ab"), (10, "é é"), (11, "éé"),
    (12, "x" * 300000 + " y"), (13, "x" * 300000 + "y"), (14, "same"), (14, "same"), (14, "same "), (None, "n u l l"), (None, "null"), (20, "n ull"),
]


@pytest.mark.parametrize(("fan", "run_rows", "parts"), [(32, 1 << 15, 3), (2, 2, 7), (4, 1, 5)])
def test_rows_equal_brute_force(spark, monkeypatch, fan, run_rows, parts):
    monkeypatch.setattr(digest_merge, "FAN", fan)
    monkeypatch.setattr(digest_merge, "RUN_ROWS", run_rows)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(parts)
    got = said(digest_merge.duplicates(docs))
    want = brute(ROWS)
    # which of wholly equal rows stays is open; that one does is not
    assert got == sorted(want, key=repr)
    assert sum(r[3] for r in got) == len({r[4] for r in got})


def test_hot_text_is_spread_and_counted(spark, monkeypatch):
    monkeypatch.setattr(digest_merge, "RUN_ROWS", 50)
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = said(digest_merge.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)))
    assert got == sorted(brute(rows), key=repr)
    assert [r for r in got if r[0] == 2997][0][1:4] == (0, 1000, False)


def test_texts_with_equal_digests_merge_only_when_verified(spark):
    runs = spark.createDataFrame([(0, "d", 3, 1, 1, 7), (1, "d", 3, 1, 1, 5), (1, "d", 4, 1, 1, 1)], "run bigint, digest string, n_bytes bigint, second bigint, size bigint, best bigint")
    from pyspark.sql import functions as F

    got = sorted((r.n_bytes, r.size, r.best) for r in digest_merge.merged_runs(runs, F.lit(0)).collect())
    assert got == [(3, 2, 5), (4, 1, 1)]


def test_empty_table_and_clashing_columns(spark):
    assert digest_merge.duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a", 5, "x", True, 0, "r"), (2, "a ", 6, "y", False, 1, "s")], "doc_id bigint, text string, row int, digest string, kept boolean, size int, run string")
    assert said(digest_merge.duplicates(docs)) == sorted(brute([(1, "a"), (2, "a ")]), key=repr)


def test_main_path_runs_no_python(spark):
    plan = digest_merge.duplicates(spark.range(5).selectExpr("id as doc_id", "string(id) as text"))._jdf.queryExecution().toString()
    rows, _ = digest_merge.numbered_runs(digest_merge.digest_rows(spark.range(5).selectExpr("id as doc_id", "string(id) as text")))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in rows._jdf.queryExecution().toString()


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_digest_merge"]).df()
    got = QUERIES["op13_digest_merge"](spark, folder).toPandas()
    assert sorted(got[sorted(want)].itertuples(index=False, name=None)) == sorted(want[sorted(want)].itertuples(index=False, name=None))
