import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import periodic_runs as pr
from tallyloom.llm.queries import ORACLE_SQL, QUERIES


def plain_runs(w):
    """(start, length, period) by the definition: every period, every stretch."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            length = i - start
            smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k - p] for k in range(start + p, i)))
            if length >= max(6, 4 * q) and smallest == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        said = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        body = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        out.append((doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], said, body))
    return sorted(out, key=repr)


def judged(docs):
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    return sorted((tuple(r) for r in pr.periodic_runs(docs, (F.when(h % 10 == 0, g), 3 + g % 8)).collect()), key=repr)


def symbols_of(texts):
    return np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=40), st.tuples(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(3, 7), st.lists(st.integers(0, 3), max_size=5)).map(lambda x: x[0] + x[1] * x[2] + x[3])), max_size=4))
def test_runs_equal_their_definition(texts):
    got = list(zip(*[x.tolist() for x in pr.runs(*symbols_of(texts))], strict=True))
    assert got == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_nested_and_long_runs_stay_linear():
    inner = ([1] * 7 + [2, 3]) * 6 + [4]
    text = inner * 5 + [5] * 30000 + list(range(10, 3010)) * 4
    _, start, length, period = pr.runs(*symbols_of([text]))
    found = set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert {(0, len(inner) * 5, len(inner)), (len(inner) * 5, 30000, 1), (len(inner) * 5 + 30000, 12000, 3000), (0, 7, 1)} <= found
    assert (0, 54, 9) in found and len(found) == 30 + 5 + 1 + 1 + 1


def test_rows_equal_brute_force(spark):
    rng = random.Random(5)
    words = "a b c dd ee".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(1000 + i, "  ".join([" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))] * rng.randrange(3, 8))) for i in range(100)]
    rows += [(5, "x y z  é\x1cé"), (2000, None), (2001, ""), (2002, " \t\n"), (2003, "x " * 5), (2004, "x\n" * 6), (2005, "x y\r" * 4), (2005, "x y\r" * 4), (None, "q " * 9), (2006, "r " * 6 + "s " * 6)]
    rows += [(3000, "long word" + "s" * 70000 + " " + "ab cd " * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert judged(docs) == brute(rows)
    assert any(r[1] > 1 for r in brute(rows)) and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 20


def test_pieces_of_a_long_text_cut_no_word(spark, monkeypatch):
    monkeypatch.setattr(pr, "PIECE", 5)
    text = "ab abcdefgh ab ab  abcdefghijkl\nab"
    symbols, bounds, names = pr.numbered_words([text.encode(), b"", b"zz"])
    assert [names[i].decode() for i in symbols] == [*text.split(), "zz"] and bounds.tolist() == [0, 6, 6, 7]


def test_ties_clashing_columns_and_empty_table(spark):
    rows = [(1, "x " * 6 + "y " * 6, 7, "r"), (2, None, 8, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, runs_sha256 string")
    got = judged(docs)
    assert got == brute([r[:2] for r in rows]) and got[0][1:5] == (2, 0, 6, 1)
    assert judged(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_without_repeats():
    assert pr.without_repeats("say  it\nsay it say it say it now") == "say it now"
    assert pr.without_repeats("say it say it") == "say it say it"


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op11_periodic_runs"]).df()
    got = QUERIES["op11_periodic_runs"](spark, folder).toPandas()
    plain = lambda f: sorted((tuple(None if pd.isna(v) else v for v in r) for r in f[sorted(want)].astype(object).itertuples(index=False, name=None)), key=repr)
    assert plain(got) == plain(want)
