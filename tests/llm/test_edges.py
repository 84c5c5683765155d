"""Very long texts, ties, empty tables, clashing names and repeated rows, across operators and through the pipeline."""

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq

from tallyloom.llm import exact_substrings, jaccard_join, line_frequency, mixture, pii_transducer, secret_crf
from tests.llm.test_toxicity_cnn import _rows

LONG = " ".join(f"word{i}" for i in range(150_000))  # 1.5 MB
HOST = "doc_id long, text string, source string, lang string"


def test_very_long_texts_are_read_whole(spark):
    docs = spark.createDataFrame([(1, LONG + " é token=abcdef123456", "s", "en"), (2, LONG + " other end", "s", "en"), (3, "short", "s", "en")], HOST)
    secrets = {r.doc_id: r for r in secret_crf.secret_spans(docs, secret_crf.train(docs)).collect()}
    start = len(LONG) + len(" é ")
    assert secrets[1].n_assign == 1 and f"assign:{start}:{start + 18}" in secrets[1].spans and secrets[2].n_assign == 0
    gone = {r.doc_id: r for r in exact_substrings.removed(docs).collect()}
    assert gone[1].n_removed >= len(LONG) and gone[1].n_spans == gone[2].n_spans == 1 and gone[3].n_removed == 0
    joined = {r.doc_id: r for r in jaccard_join.joined(docs).collect()}
    assert joined[1].component_id == joined[2].component_id == 1 and joined[1].n_shingles == 150_000
    figures = {r.doc_id: r for r in line_frequency.line_verdicts(docs).collect()}
    assert figures[1].n_words == 150_002 and figures[1].kept and not figures[3].kept
    tokens = {r.doc_id: r.n_tokens for r in mixture.mixed(docs).collect()}
    assert tokens[1] == 150_002 and tokens[3] == 1
    private = {r.doc_id: r for r in pii_transducer.personal_spans(docs).collect()}
    assert set(private) == {1, 2, 3}


def test_ties(spark):
    # a line in exactly as many documents as the floor is not common, in one more it is
    body = "some words of a document that has enough of them to pass the plain rule for words {0} {0} a b c d e f g"
    rows = lambda n: [(i, f"{body.format(chr(97 + i))}\nthe shared line", "s", "en") for i in range(n)]
    common = lambda n: line_frequency.common_lines(line_frequency.word_figures(spark.createDataFrame(rows(n), HOST))).count()
    assert [common(line_frequency.LINE_FLOOR), common(line_frequency.LINE_FLOOR + 1)] == [0, 1]
    said = "mail a@b.co or +1 555 555 55555, token=abcdef1"
    same, at = spark.createDataFrame([(5, said, "s", "en")] * 3, HOST), said.index("token")
    spans = {r.spans for r in pii_transducer.personal_spans(same).collect()}
    assert len(spans) == 1 and {r.spans for r in secret_crf.secret_spans(same, secret_crf.train(same)).collect()} == {f"assign:{at}:{at + 13}"}


def write(folder, rows, extra=()):
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([f"s{(r[0] or 0) % 3}" for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    pq.write_table(pa.table(table | {name: pa.array([i] * len(rows), pa.int64()) for i, name in enumerate(extra)}), f"{folder}/documents.parquet")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    write(tmp_path, [])
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int64()), "toxic": pa.array([], pa.int64())}), tmp_path / "labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_pipeline_with_clashing_columns_repeated_rows_and_long_texts(spark, tmp_path):
    made = [r[:3] for r in _rows(200, 4)]
    rows = [*made, made[0], made[0], (5000, LONG, "en"), (5001, None, None), (None, "a text without an id but with quite a few words in it", "en")]
    extra = ("toxic", "score", "kept", "node", "part", "spans", "topic", "weight", "ids", "row", "id")
    write(tmp_path, rows, extra)
    pq.write_table(pa.table({"doc_id": [r[0] for r in made], "quality": [1] * len(made), "toxic": [x[3] for x in _rows(200, 4)]}), tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        if name == "near_copies":
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids)) and {5000, 5001, None} <= set(ids)
    assert {r.doc_id for r in docs.collect()} <= {*(r[0] for r in rows)}
