"""Registered queries of the operators in this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and verdict of every document."""
    from tallyloom.llm.mixture import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    from tallyloom.llm.byte_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed rules, and the field fitted on a bounded sample, in part without neighbours and on varied secrets."""
    from tallyloom.llm.secret_crf import ALONE, secret_spans, train

    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, train(docs, alone=ALONE, vary=True))


def op4_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    from tallyloom.llm.exact_substrings import removed

    return removed(table(spark, sf_dir, "documents"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a classifier that never sees the held-out fifth of the labels."""
    from tallyloom.llm.toxicity_cnn import toxicity, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
        F.col("__threshold").alias("threshold"),
        F.col("__rejected").alias("rejected"),
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and verdict of every page's URL."""
    from tallyloom.llm.url_rules import judged

    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, plain and disguised."""
    from tallyloom.llm.pii_transducer import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.9 over three-word shingles."""
    from tallyloom.llm.jaccard_join import joined

    return joined(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    from tallyloom.llm.lsh_forest import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word figures and verdict of every document; a line's documents are distinct ids."""
    from tallyloom.llm.line_frequency import line_verdicts

    return line_verdicts(table(spark, sf_dir, "documents"), by_id=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document; a tenth of the documents, by hash, is made periodic from some word on."""
    from tallyloom.llm.periodic_runs import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    return periodic_runs(table(spark, sf_dir, "documents"), (F.when(h % 10 == 0, g), 3 + g % 8))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document against the root of the whole table; a third of the documents is tampered with."""
    from tallyloom.llm.merkle_manifest import audited

    return audited(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op13_digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of each group of texts that are equal without white space."""
    from tallyloom.llm.digest_merge import duplicates

    return duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixture": op1_mixture,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_crf": op3_secret_crf,
    "op4_exact_substrings": op4_exact_substrings,
    "op5_toxicity_cnn": op5_toxicity_cnn,
    "op6_url_rules": op6_url_rules,
    "op7_pii_transducer": op7_pii_transducer,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_lsh_forest": op9_lsh_forest,
    "op10_line_frequency": op10_line_frequency,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_digest_merge": op13_digest_merge,
}

#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))"""


def _said(*values: str) -> str:
    """The digest of values, each with its length in bytes."""
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::varchar)::varchar || ':' || {v}::varchar, '-')" for v in values) + ")"

ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": f"""
        with found as (select row_number() over () as r, doc_id, {_CRC} as h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as plain from documents),
        cut as (select *, len(plain) as n, if(h % 10 = 0 and len(plain) > 0, (h // 10) % len(plain), len(plain)) as a from found),
        texts as (select r, doc_id, n, list_transform(range(n), lambda i: plain[1 + if(i < a, i, a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)))]) as words from cut),
        words as (select r, n, unnest(words) as word, unnest(range(n)) as i from texts),
        -- every run has five matches in a row, so equal stretches of five words find all of its diagonal
        fives as (select r, n, i, word || ' ' || lead(word, 1) over w || ' ' || lead(word, 2) over w || ' ' || lead(word, 3) over w || ' ' || lead(word, 4) over w as five
            from words window w as (partition by r order by i)),
        diagonals as (select b.r, b.i - a.i as period, b.i, b.i - row_number() over (partition by b.r, b.i - a.i order by b.i) as island
            from fives a join fives b on a.r = b.r and a.five = b.five and a.i < b.i and 4 * (b.i - a.i) <= a.n),
        stretches as (select r, period, min(i) - period as start, count(*) + 4 + period as length from diagonals group by r, period, island),
        runs as (select r, start, length, min(period) as period from stretches where length >= greatest(6, 4 * period) group by r, start, length),
        lines as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by r),
        top as (select * from runs qualify row_number() over (partition by r order by length::decimal(18, 0) / period desc, start, period) = 1),
        kept as (select r, string_agg(word, ' ' order by i) as body from words w
            where not exists (select 1 from runs where runs.r = w.r and i >= start + period and i < start + length) group by r)
        select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(body, '')) as collapsed_sha256
        from texts left join lines using (r) left join top using (r) left join kept using (r)
    """,
    "op12_merkle_manifest": f"""
        with recursive
        found as (select doc_id, lang, {_said("doc_id", "source", "lang", "n_chars", "text")} as leaf, {_CRC} % 3 = 0 as tampered,
            {_said("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as lowered from documents),
        leaves as (select doc_id, leaf, if(coalesce(tampered, false), lowered, leaf) as seen, dense_rank() over (order by lang nulls first) - 1 as tree,
            row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from found),
        grown as (select tree, 0 as lvl, pos, n, leaf as h from leaves
            union all select tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from grown where n > 1 group by tree, lvl, pos // 8, n),
        subroots as (select tree, h from grown where n = 1),
        above as (select 0 as lvl, tree as pos, (select count(*) from subroots) as n, h from subroots
            union all select lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from above where n > 1 group by lvl, pos // 8, n),
        nodes as (select 0 as scope, tree, lvl, pos, n, h from grown union all select 1, 0, lvl, pos, n, h from above),
        sides as (select *, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
            coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r from nodes
            window w as (partition by scope, tree, lvl, pos // 8 order by pos)),
        climb as (select doc_id, leaf, tree as of_tree, 0 as scope, tree, 0 as lvl, pos, seen as h, '' as proof, false as done from leaves
            union all select doc_id, leaf, of_tree, if(s.n > 1, c.scope, 1), if(s.n > 1, c.tree, 0), if(s.n > 1, c.lvl + 1, 0), if(s.n > 1, c.pos // 8, c.tree),
                if(s.n > 1, sha256(l || c.h || r), c.h), if(s.n > 1, proof || l || r, proof), s.n = 1 and c.scope = 1
            from climb c join sides s on c.scope = s.scope and c.tree = s.tree and c.lvl = s.lvl and c.pos = s.pos where not done)
        select doc_id, leaf, b.h as subroot, t.h as root, sha256(proof) as proof_sha256, c.h as folded_root, c.h = t.h as verified
        from climb c join subroots b on b.tree = of_tree, (select h from above where n = 1) t where done
    """,
    "op13_digest_merge": """
        with bodies as (select doc_id, coalesce(length(text), 0) as points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body from documents),
        placed as (
            select doc_id, body, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by body) as group_size
            from bodies window w as (partition by body order by points desc, doc_id nulls last)
        )
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from placed
    """,
}
