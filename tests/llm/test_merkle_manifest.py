import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle_manifest as mm
from tallyloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    for level in levels[:-1]:
        yield "".join(level[i - i % 8 : i]), "".join(level[i + 1 : i - i % 8 + 8])
        i //= 8


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = climbed([leaf_of(*r) for r in by_lang[lang]])
    top = climbed([trees[lang][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            path = [*sides(trees[lang], i), *sides(top, t)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf_of(r[0], r[1] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:]) if tampered else leaf_of(*r)
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], leaf_of(*r), trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def said(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def run(docs):
    return said(mm.audited(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0))


def test_addresses_are_a_permutation_with_subtrees_together():
    for levels in range(1, 6):
        flat = np.concatenate([mm.address(levels, d) for d in range(levels)])
        assert sorted(flat.tolist()) == list(range((8**levels - 1) // 7))
    # four levels: the top two first, then 64 subtrees of two levels, each root followed by its children
    assert mm.address(4, 0).tolist() == [0] and mm.address(4, 1).tolist() == list(range(1, 9))
    assert mm.address(4, 2)[:3].tolist() == [9, 18, 27] and mm.address(4, 3)[:9].tolist() == [*range(10, 18), 19]


def test_trees_are_cut_at_half_their_height():
    assert mm.cuts(0) == [0] and mm.cuts(4) == [4] and mm.cuts(5) == [3, 2] and mm.cuts(8) == [4, 4] and mm.cuts(13) == [4, 3, 3, 3]
    assert [mm.height_of(n) for n in (1, 2, 8, 9, 64, 65)] == [0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize(("block", "sizes"), [(1, [1, 2, 8, 9, 65, 70]), (2, [64, 65, 513, 3]), (4, [1, 700])])
def test_proofs_equal_brute_force(spark, monkeypatch, block, sizes):
    monkeypatch.setattr(mm, "BLOCK", block)
    rows = [(i * 10 + k, f"Text {i} " * (i % 4) if i % 7 else None, f"l{k}" if k else None, f"s{i % 3}", i if i % 5 else None) for k, n in enumerate(sizes) for i in range(n)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_edges(spark):
    rows = [
        (7, "A" * 400000 + "é", "en", "s", 1), (7, "other", "en", "s", 1), (7, "other", "en", "s", 1), (None, "Null Id", "en", None, None), (9, "", "", "", 0), (9, None, "", None, None),
        (3, "x", "zz", "s", 1), (3, "x", "é", "s", 1), (3, "x", None, "s", 1),
    ]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert run(spark.createDataFrame(rows[:1], SCHEMA)) == brute(rows[:1])
    assert run(spark.createDataFrame([], SCHEMA)) == []
    clash = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], SCHEMA + ", leaf string, pos int, seen binary")
    assert run(clash) == brute(rows)


def test_tampering_is_found_and_only_that(spark):
    rows = [(i, "Abc" if i % 2 else "abc", "en", "s", 3) for i in range(600)]
    for doc_id, *_, verified in run(spark.createDataFrame(rows, SCHEMA)):
        assert verified == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op12_merkle_manifest"]).df()
    got = QUERIES["op12_merkle_manifest"](spark, folder).toPandas()
    assert sorted(got[sorted(want)].itertuples(index=False, name=None)) == sorted(want[sorted(want)].itertuples(index=False, name=None))
