import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import lsh_forest as L


def brute(ids, x, asked, k=5):
    out = {}
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        s = L.exact_cosine(x, x[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, x, more=()):
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as x", "3 as rank")


def test_recall_and_order_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "INDEX_BLOCK", 700)
    monkeypatch.setattr(L, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    clustered = centres[rng.integers(0, 30, 1000)] + 0.4 * rng.normal(size=(1000, 24))
    x = np.concatenate([clustered, rng.normal(size=(800, 24))]).astype(np.float32).astype(float)
    ids = np.arange(len(x))
    asked = ids[ids % 50 == 0]
    want = brute(ids, x, asked)
    got = {}
    for r in L.neighbours(frame(spark, ids, x), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q in got:
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - L.exact_cosine(x[[v]], x[q])[0]) < 1e-12 for _, v, s in found)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)).astype(np.float32).astype(float)
    x[10:30] = x[0]
    ids = np.arange(40)
    more = [(50, None, 0), (100, [0.0] * 8, 0), (150, [float("nan")] + [1.0] * 7, 0), (200, [None] + [1.0] * 7, 0), (250, [1.0, 2.0], 0), (300, [], 0), (0, [float(v) for v in x[0]], 0)]
    got = L.neighbours(frame(spark, ids, x, more), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 10), (0, 11), (0, 12), (0, 13), (0, 14)]
    assert L.neighbours(frame(spark, ids, x).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = L.neighbours(frame(spark, ids[:3], x[:3]), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_repeated_ids_clusters_and_scaled_vectors(spark, monkeypatch):
    monkeypatch.setattr(L, "INDEX_BLOCK", 40)
    monkeypatch.setattr(L, "NEAR", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    x[100:200] = x[100] + 1e-3 * rng.normal(size=(100, 8)).astype(np.float32)
    x[200:250] = x[200]
    x[250:280] = x[100] * rng.integers(1, 4, 30)[:, None]
    x = x.astype(np.float32).astype(float)
    ids = np.arange(300)
    more = [(0, [float(v) for v in x[1]], 0), (0, [float(v) for v in x[0]], 0)]
    got = {}
    for r in L.neighbours(frame(spark, ids, x, more), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [v for _, v, _ in got[200]] == [201, 202, 203, 204, 205]
    assert len(got[0]) == 10 and sorted(r for r, _, _ in got[0]) == sorted([1, 2, 3, 4, 5] * 2)
    assert sum(v == 1 and s == L.exact_cosine(x[[1]], x[1])[0] for _, v, s in got[0]) == 1
    want = brute(ids, x, np.array([50, 150, 250]))
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 14


def test_depth_follows_the_stop_rule():
    for cosine in (-0.5, 0.0, 0.3, 0.7, 0.99):
        depth = int(L.depth_needed(np.array([cosine]), 32, 0.02, 48)[0])
        agree = 1 - np.arccos(cosine) / np.pi
        assert depth == 0 or (1 - agree**depth) ** 32 <= 0.02
        assert depth == 48 or (1 - agree ** (depth + 1)) ** 32 > 0.02
    assert L.depth_needed(np.array([1.0, np.nan]), 32, 0.02, 48).tolist() == [48, 0]
