import random

import numpy as np

from tallyloom.llm import toxicity_cnn as T


def _rows(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstnl") for _ in range(r.randint(2, 7)))
    for i in range(n):
        bad = r.random() < 0.2
        lang = r.choice(["en", "de"])
        w = [word() for _ in range(r.randint(3, 150))]
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randint(0, len(w)), r.choice(["VILE!", "nasty,", "grobes"]) if lang == "en" else "grob" + word())
        yield i, " ".join(w), lang, int(bad)


def test_scores_equal_brute_force_pooling():
    m = T.fit([np.arange(30, dtype=np.int32) % 7, np.arange(9, dtype=np.int32)] * 8, np.array([1, 0] * 8), steps=5)
    ids, bounds = T.word_ids(np.frombuffer(b"one two three" + b"x", np.uint8), np.array([0, 13, 13, 14]))
    assert list(bounds) == [0, 3, 3, 4]
    m.rows = np.random.default_rng(0).integers(0, len(m.embed), 3 * T.BUCKETS).astype(np.int32)
    got = m.pooled(ids, bounds)[0]
    for i in range(3):
        x = np.concatenate([m.embed[m.rows[ids[bounds[i] : bounds[i + 1]]]].sum(axis=1), np.zeros((3, T.DIM), np.float32)])
        for q, w in enumerate(T.WIDTHS):
            n = max(1, bounds[i + 1] - bounds[i])
            best = np.max([sum(x[s + j] @ m.filters[q][j] for j in range(w)) for s in range(n)], axis=0)
            assert np.allclose(best, got[i, q * T.FILTERS : (q + 1) * T.FILTERS], atol=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    train = list(_rows(1500, 1))
    docs = spark.createDataFrame([x[:3] for x in train], "doc_id long, text string, lang string").selectExpr("*", "1 as toxic", "2 as ids")
    labels = spark.createDataFrame([(x[0], x[3]) for x in train] + [(5, None)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert set(model.thresholds) <= {"en", "de"} and model.thresholds
    held = list(_rows(800, 2))
    rows = [x[:3] for x in held] + [(9000, None, None), (9001, "", "xx"), (9001, "", "xx"), (9002, "fine words " * 5000, "en")]
    out = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, ["doc_id"]).collect()
    got = {x.doc_id: x for x in out}
    assert len(out) == len(rows) and all(0 <= x["__score"] <= 1 for x in out)
    right = sum(got[x[0]]["__rejected"] == bool(x[3]) for x in held)
    assert right / len(held) > 0.95
    assert not got[9001]["__rejected"] and not got[9002]["__rejected"]
    none = T.train(docs, labels.limit(0))
    assert {x["__score"] for x in T.toxicity(docs, none, ["doc_id"]).limit(20).collect()} == {x["__score"] for x in T.toxicity(docs, none, ["doc_id"]).limit(1).collect()}
    assert not any(x["__rejected"] for x in T.toxicity(docs, none, ["doc_id"]).collect())


def test_an_id_that_many_rows_share_is_learnt_once(spark):
    rows = [(7, f"text number {i} of one id", "en") for i in range(500)] + [(8, "another text", "de"), (8, None, None), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (9, 1), (10, 1)], "doc_id long, toxic int")
    got = {x["__doc"]: x for x in T.labelled_ids(docs, labels).collect()}
    again = {x["__doc"]: x for x in T.labelled_ids(docs.repartition(2), labels).collect()}
    assert set(got) == {7, 8, 9} and got[7].toxic == 1 and len(got[7].ids) == 18 and got == again


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.toxicity(docs, model, ["doc_id"]).count() == 0


def test_every_labelled_row_is_learnt_from(spark):
    n = 13_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text number ', id) as text", "'en' as lang")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 7 = 0 as int) as toxic")
    got = T.labelled(docs, labels)
    assert got.count() == n and got.rdd.getNumPartitions() == 2
    assert T.labelled_ids(docs, labels).count() == n


def test_parts_are_fitted_apart_and_averaged(spark):
    train, held = list(_rows(3000, 1)), list(_rows(800, 2))
    docs = spark.createDataFrame([x[:3] for x in train], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in train], "doc_id long, toxic int")
    model = T.train(docs, labels, block_rows=500)
    out = T.toxicity(spark.createDataFrame([x[:3] for x in held], "doc_id long, text string, lang string"), model, ["doc_id"]).collect()
    got = {x.doc_id: x["__rejected"] for x in out}
    assert sum(got[x[0]] == bool(x[3]) for x in held) / len(held) > 0.95


def test_threshold_lies_in_the_widest_gap_between_bins():
    low, high = np.array([0.9, 0.5, 0.1]), np.array([0.95, 0.6, 0.2])
    assert abs(T.best_threshold(low, high, np.array([2, 3, 9]), np.array([2, 3, 0])) - 0.35) < 1e-12


def test_work_of_a_training_grows_with_the_rows_and_not_with_their_partitions(spark, monkeypatch):
    n = 3000
    docs = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 7 = 0, 'vile text ', 'fine text '), id) as text", "'en' as lang")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 7 = 0 as int) as toxic")
    taken, once = [], T._round

    def counted(rows, *rest):
        taken.append((rows.rdd.getNumPartitions(), {r["__doc"] for r in rows.select("__doc").collect()}))
        once(rows, *rest)

    monkeypatch.setattr(T, "_round", counted)
    monkeypatch.setattr(T, "STEPS", 8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        T.train(docs, labels, block_rows=400)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    learnt = {r["__doc"] for r in T.labelled(docs, labels).where("not aside").collect()}
    assert {parts for parts, _ in taken} == {T.parts_for(len(learnt), 400)} == {3}
    # each row in one of the rounds
    assert set().union(*[ids for _, ids in taken]) == learnt and sum(len(ids) for _, ids in taken) == len(learnt)


def test_steps_draw_every_row():
    for marked, plain in ((1, 900), (300, 600), (5, 0), (0, 7)):
        labels = np.array([1] * marked + [0] * plain)
        k, steps = T._marked_of(labels), T.steps_for(labels, 0.001)
        assert steps * k >= marked and steps * (T.BATCH - k) >= plain
    assert T.steps_for(np.array([1, 0, 0, 0]), 1.0) == T.STEPS
