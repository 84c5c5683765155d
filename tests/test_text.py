from pyspark.sql import functions as F

from tallyloom.functions import scoring, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_canonical_urls_and_quarantine(spark):
    urls = ["https://user:pw@x.com/a", "https://x.com/?token=1", "https://x.com/" + "a" * 2100, "ftp://x.com", None, "HTTPS://WWW.X.com//a//b/?utm_x=1&b=2&a=1&ref=q&a=0#f", "http://x.com"]
    good, bad = text.canonical_urls(spark.createDataFrame(list(enumerate(urls)), "i int, url string"))
    assert {r.i: r.canonical_url for r in good.collect()} == {5: "https://x.com/a/b?a=1&a=0&b=2", 6: "http://x.com"}
    assert {r.i: r.reject_reason for r in bad.collect()} == {0: "user_info", 1: "secret_parameter", 2: "too_long", 3: "not_http", 4: "missing"}


def test_dates_names_and_titles(spark):
    day = lambda s: one(spark, text.latest_date(F.col("t"), F.lit("2026-01-01")), t=s)
    assert day("on 2023-12-20T00:00 and 2030-01-01") == "2023-12-20"
    assert day("发布于2025年6月4日") == day("June 4, 2025 x") == day("x 4 June 2025") == "2025-06-04"
    assert day("2025-02-31") is None
    path = lambda s: one(spark, text.path_date(F.col("t"), F.lit("2026-01-01")), t=s)
    assert path("https://x.com/2023/12/20") == "2023-12-20" and path("https://x.com/2023/06/20/a") == "2023-06-20"
    assert one(spark, text.norm_name(F.col("t")), t="Galleri™ Test") == "galleritm test"
    assert one(spark, text.norm_entity(F.col("t")), t="Galleri™, Inc.") == "galleri"
    assert one(spark, text.clean_title(F.col("t")), t="A new thing... | Site | Home") == "A new thing…"
    assert one(spark, text.sheet_safe(F.col("t")), t="\t@x") == "'\t@x" and one(spark, text.sheet_safe(F.col("t")), t="x=1") == "x=1"
    assert one(spark, text.error_code(F.col("t")), t="secret=1 got 503") == "http_503"


def test_content_and_facts(spark):
    body = "Menu\nShare\nBody line\n\n\n\nmore\nRelated articles\ngone"
    assert one(spark, text.clean_content(F.col("t")), t=body) == "Body line\n\nmore"
    a = F.create_map(F.lit(" Key"), F.lit("a  b"), F.lit("n"), F.lit(""))
    b = F.create_map(F.lit("key "), F.lit(" a b"))
    assert one(spark, text.fact_hash(a), t="") == one(spark, text.fact_hash(b), t="")
    assert one(spark, text.fact_hash(a, True), t="") != one(spark, text.fact_hash(b, True), t="")
    assert one(spark, text.fact_hash(F.create_map(F.lit("k"), F.lit(""))), t="") is None
    assert one(spark, scoring.classify(F.col("t")), t="FDA approval of a study") == "regulatory_decision"
    assert one(spark, scoring.classify(F.col("t"), F.lit("research")), t="plain words") == "publication"
    bad = scoring.importance(spark.createDataFrame([(5, 15, 10), (30, 50, 20)], "relevance int, impact int, actionability int")).collect()
    assert bad[0].total is None and bad[0].level is None and bad[1].level == "L1"
