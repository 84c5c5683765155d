"""Queries on rows that the given tables lack: ties, years in paths, long lines."""

from pyspark.sql import functions as F

from tallyloom.plans import registry


def test_a_score_halfway_goes_to_the_even_one(spark, tmp_path):
    spark.createDataFrame([(1, 12500.0), (2, 17500.0), (3, 302500.0)], "o_orderkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.event_id: r.score for r in registry.QUERIES["e14_legacy_import"](spark, str(tmp_path)).collect()} == {1: 2, 2: 4, 3: 60}


def test_a_first_line_is_cut_by_its_own_length(spark, tmp_path):
    texts = ["x" * 8000 + "\nmore", "y" * 7990 + " " * 20 + "\nmore", "Menu\n " + "z" * 8001, "share\n \n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.first_line for r in registry.QUERIES["p9_first_line"](spark, str(tmp_path)).collect()}
    assert got == {0: "x" * 8000, 1: "y" * 7990, 2: "z" * 8000 + "…", 3: None, 4: None}


def test_a_page_number_is_no_year(spark, tmp_path):
    spark.range(1920, 1928).select(F.col("id").alias("page_id")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.link, r.score) for r in registry.QUERIES["s5_listing_forms"](spark, str(tmp_path)).collect()}
    assert got == {n: ("https://accesswire.com/1924/news" if n == 1924 else f"https://s{n}.example.com/newsroom/{n}", 5) for n in (1920, 1921, 1922, 1924, 1926)}
