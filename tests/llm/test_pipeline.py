import hashlib

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from tests.llm.test_jaccard_join import brute
from tests.llm.test_toxicity_cnn import _rows


def test_stages_take_effect_and_agree_with_brute_force(spark, tmp_path):
    made = list(_rows(600, 3))
    copies = [(1000 + i, made[i][1] + " extra", made[i][2], made[i][3]) for i in range(0, 40)]
    secret = [(2000, "plain words here token = \"0123456789abcdef0123456789abcdef\" and more words", "en", 0), (2001, None, None, 0), (2002, "", "en", 0)]
    rows = made + copies + secret
    docs = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": [f"s{r[0] % 3}" for r in rows], "n_chars": [len(r[1] or "") for r in rows]}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [r[0] for r in made], "quality": [1] * len(made), "toxic": [r[3] for r in made]}), tmp_path / "labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    toxic = {r[0]: r[3] for r in rows}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "token_ids":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name == "toxicity":
            lost = {r.doc_id for r in before.collect()} - set(seen[name])
            assert sum(toxic[i] for i in lost) >= 0.95 * len(lost) and sum(toxic.values()) - sum(toxic[i] for i in lost) <= 0.1 * sum(toxic.values())
        if name == "near_copies":
            want = {i for i, _, c in brute([(r.doc_id, r.text) for r in before.collect()], 5, 8, 10) if i == c}
            assert set(seen[name]) == want
    assert seen["secrets"][2000].text == 'plain words here <secret>" and more words' and seen["secrets"][2000].n_chars == len(seen["secrets"][2000].text)
    assert all(seen["secrets"][i].text == text[i] for i in seen["secrets"] if i != 2000)
    assert set(seen["mix"]) <= set(seen["secrets"]) and len(seen["mix"]) > 0.7 * len(seen["secrets"])
    assert set(seen["token_ids"]) == set(seen["mix"])
    for i, r in seen["token_ids"].items():
        assert r.decoded_sha256 == hashlib.sha256((seen["mix"][i].text or "").encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_stages_hand_rows_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    docs = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "'a b' as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    try:
        spark.conf.set(key, 10_000)
        dict(corpus_pipeline.STAGES)["token_ids"](spark, docs, "")
        found = [x.n for x in docs.mapInArrow(sizes, "n bigint").collect()]
        assert sum(found) == 5000 and max(found) <= 1000
        spark.conf.set(key, 300)  # a smaller number stays
        dict(corpus_pipeline.STAGES)["token_ids"](spark, docs, "")
        assert spark.conf.get(key) == "300"
    finally:
        spark.conf.set(key, was)
