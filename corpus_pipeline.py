"""A corpus pipeline of five stages: toxicity, near copies, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each as Parquet in the shared folder and reads it as the
next stage's documents. All but the last return the columns of documents.

Defined results: a null or empty text is not toxic, has no copies and no secret, and goes on as it is; its ids are empty. Very long texts go through
every stage whole. Rows that repeat an id and its text become one in near_copies; rows that share an id with different texts are judged apart there, and kept or left out
together by the mixture. Of near copies the smallest id stays (a null id comes last). Without labels of both kinds nothing is toxic. An empty
table of documents gives an empty result. Further columns of documents, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, jaccard_join, mixture, secret_crf, toxicity_cnn
from tallyloom.session import stored

#: Rows that a task hands to Python at once. Of texts, Spark's own 10,000 are tens of MB several times over, in the JVM's native memory and in each worker.
BATCH_ROWS = 1_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with at most BATCH_ROWS rows in an Arrow batch; its table is computed later, so the session keeps that number. A smaller one stays."""

    @wraps(stage)
    def small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return small


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below their language's threshold; all of them where there is nothing to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity_cnn.train(docs, labels)
    return toxicity_cnn.toxicity(docs, model, docs.columns).where(~F.col("__rejected")).select(*docs.columns)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 over five-word shingles; documents without words all stay."""
    return jaccard_join.one_of_each(docs)


@in_small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mask; a null text stays null."""
    clean = secret_crf.redacted(docs, secret_crf.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else clean


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics weigh as wanted; null is a value of its own on each axis."""
    return mixture.sampled(docs)


@in_small_batches
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of the ids and of the bytes that they decode to; a null text counts as empty."""
    import public_tokenizers

    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("secrets", secrets), ("mix", mix), ("token_ids", token_ids)]

#: Trained classifiers and the tokeniser have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
