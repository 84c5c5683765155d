import hashlib

import public_tokenizers
import tiktoken
from tallyloom.llm import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None,
    "",
    " ",
    "plain words, and 1234 numbers  with   spaces\n\n\ttabs\r\nlines",
    "It's we'll they've I'M HE'D naïve café Straße 漢字かな交じり文 🙂🙃 е́   x\x85y",
    "x" * 5000,
    "word " * 20_000,
    "".join(chr(c) for c in range(1, 0x250)),
    "<|endoftext|> is text",
    "\x00\x01￾\U0010ffff",
]


def reference():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(VOCABULARY))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_the_usual_library(spark):
    known = reference()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens", "'z' as ids_sha256").repartition(3)
    want = []
    for i, t in rows:
        ids = known.encode(t or "", disallowed_special=())
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.token_digests(frame, VOCABULARY, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert byte_bpe.token_digests(frame.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_ids_decode_to_the_text_through_the_pieces_of_the_model(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = byte_bpe.encode_documents(frame, VOCABULARY, public_tokenizers.PATTERN).select("doc_id", "ids")
    back = {r.doc_id: r.text for r in byte_bpe.decode_ids(ids, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    codec = byte_bpe.Codec(byte_bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    assert codec.pieces == byte_bpe.read_ranks(VOCABULARY)
