import random

import numpy as np

from tallyloom.llm import mixture as M


def test_raking_reaches_marginals_and_equals_plain_loops():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, 24).astype(float)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    w = M.rake(tokens, codes, targets)
    for c, t in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(c, w), t, atol=1e-6)
    v = (tokens / tokens.sum()).tolist()
    for _ in range(300):
        for c, t in zip(codes, targets, strict=True):
            for k in range(len(t)):
                s = sum(x for x, i in zip(v, c, strict=True) if i == k)
                v = [x * t[k] / s if i == k else x for x, i in zip(v, c, strict=True)]
    assert np.allclose(v, w, atol=1e-6)
    p = M.probabilities(tokens, w, 0.6 * tokens.sum())
    assert (p <= 1).all() and np.isclose((p * tokens).sum(), 0.6 * tokens.sum())


def test_both_ways_agree_and_sampling_follows_probabilities(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice(["en", "en", "de"]), " ".join(r.choice(["x", "y", "zz"]) + str(r.randint(0, 50)) for _ in range(r.randint(0, 30)))) for i in range(3000)]
    rows += [(9000, "e", "xx", None), (9001, "e", "xx", ""), (9001, "e", "xx", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").selectExpr("*", "1 as weight", "2 as topic_x")
    here = M.mixed(docs, fraction=0.5).collect()
    joins = {x.doc_id: x for x in M.mixed(docs, fraction=0.5, cell_bound=0).collect()}
    assert len(here) == len(rows)
    assert all(abs(x.probability - joins[x.doc_id].probability) < 1e-3 for x in here)
    total = sum(x.n_tokens for x in here)
    assert abs(sum(x.n_tokens for x in here if x.kept) / total - 0.5) < 0.05
    assert [x.kept for x in here if x.doc_id >= 9000] == [True] * 3
    targets = {"source": {"a": 0.25, "b": 0.25, "c": 0.25, M.NONE: 0.25}, "lang": {"en": 0.5, "de": 0.5}}
    got = M.mixed(docs, fraction=0.3, targets=targets).collect()
    expected = {}
    for x in got:
        expected[x.source] = expected.get(x.source, 0) + x.probability * x.n_tokens
    assert max(expected[s] for s in ("a", "b", "c", None)) < 1.02 * min(expected[s] for s in ("a", "b", "c", None))
    kept = {x.doc_id for x in got if x.kept}
    out = M.sampled(docs, fraction=0.3, targets=targets)
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == kept
    assert M.mixed(docs.limit(0)).count() == 0
