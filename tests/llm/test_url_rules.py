import random

from pyspark.sql import functions as F

from tallyloom.llm import url_rules as U


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    k = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:k]


def brute_rule(host, path):
    fit = [(len(h) + len(p), h + p, v) for v, h, p in U.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_parts_and_base_rules_equal_brute_force(spark):
    r = random.Random(2)
    urls = [None, "", "nothing", "a://", "://x", "HTTP://A.Net/En/x?y#z", "http://net/", "http://example.net/en/", "http://notexample.net", "http://x.example.net/en/a", "http://example.com?x=/de/", "http://www.example.com/de/1", "x://É.org/fr/#", "a://b://c.org/fr/1"]
    for _ in range(500):
        urls.append("".join(r.choice(["http://", "www.", "example", ".com", ".net", ".org", "/", "/en/", "/fr/", "/de/", "?", "#", "A", ":"]) for _ in range(r.randint(0, 9))))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as items", "3 as row")
    out = U.judged(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(urls)
    for x in out:
        host, path = brute_host_path(urls[x.page_id])
        rule, verdict = brute_rule(host, path)
        assert (x.host, x.path, x.rule, x.verdict) == (host, path, rule, verdict or "allow"), urls[x.page_id]


def test_mined_rules_equal_brute_force_and_match(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        spam = r.random() < 0.3
        host = r.choice(["cheap-pills", "casino-win"]) if spam else r.choice(["alpha", "beta", "gamma", "delta"])
        path = r.choice(["en", "fr"]) + "/" + str(r.randint(1, 99))
        rows.append((i, f"http://{r.choice(['www.', 'm.', ''])}{host}.example.biz/{path}"))
        if i % 2:
            labels.append((i, 0 if spam else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (3, None, None)], "doc_id long, quality int, toxic int")
    out = {x.page_id: x for x in U.judged(pages, marks).collect()}
    wrong = [i for i, u in rows if (out[i].verdict == "block") != ("pills" in u or "casino" in u)]
    assert len(wrong) < 12 and len(out) == len(rows)
    urls = pages.select(F.col("page_id").alias("row"), U.items_of(U.host_of(F.col("url")), U.path_of(F.col("url"))).alias("items"))
    marked = urls.join(marks, F.col("row") == F.col("doc_id")).where("quality is not null").select("items", F.when(F.col("quality") == 0, "block").otherwise("allow").alias("verdict"))
    rules = U.mined_rules(marked)
    given = [(set(x["items"]), x.verdict) for x in marked.collect()]
    found = rules.collect()
    for x in found:
        has = [v for items, v in given if set(x["items"]) <= items]
        assert abs(sum(v == x.verdict for v in has) / len(has) - x.confidence) < 1e-9 and abs(sum(v == x.verdict for v in has) / len(given) - x.support) < 1e-9
        assert x.confidence >= U.CONFIDENCE and x.support >= U.SUPPORT
    got = {x.row: x.mined for x in U.matched(urls, rules).collect()}
    for x in urls.collect():
        fit = [(f.confidence, f.support) for f in found if set(f["items"]) <= set(x["items"])]
        assert (max(fit) if fit else None) == ((got[x.row].confidence, got[x.row].support) if x.row in got else None)


def test_every_rule_stands_once_in_the_index_under_its_least_shared_item(spark):
    rules = [(["site=com", f"word=w{i}"], "block", 0.9, 0.1) for i in range(40)] + [(["ending=php", "site=com", "word=w0"], "allow", 0.8, 0.1), (["site=com"], "allow", 0.7, 0.5)]
    frame = spark.createDataFrame(rules, "items array<string>, verdict string, confidence double, support double")
    index = U.index_of(frame).collect()
    assert sorted((x.rule_items, x.rule_verdict) for x in index) == sorted((r[0], r[1]) for r in rules)
    under = {tuple(x.rule_items): x.item for x in index}
    assert under[("site=com",)] == "site=com" and under[("ending=php", "site=com", "word=w0")] == "ending=php"
    assert all(under[("site=com", f"word=w{i}")] == f"word=w{i}" for i in range(40))


def test_long_urls_ties_and_an_empty_table(spark):
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    url = [f"http://h{i % 2}.biz/" + "x/" * (20_000 if i == 7 else 3) for i in range(40)]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(url)] + [(3, url[3], 1, 2)], "page_id long, url string, verdict int, rule int")
    out = U.judged(pages, labels).collect()
    assert len(out) == 41 and all(x.verdict == ("block" if x.page_id % 2 else "allow") for x in out)
    assert max(len(x.path) for x in out) == 40_001
    assert U.judged(pages.limit(0), labels).count() == 0


def test_urls_of_hundreds_of_segments_do_not_multiply(spark):
    # the same long URL in 1 % of the rows, and a family of long URLs that share parts of their paths
    long = "/".join(f"seg{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))
    rows = [(i, f"http://spam.biz/{long}" if i % 100 == 0 else f"http://h{i % 7}.biz/{'/'.join(f'p{chr(97 + (i * k) % 19)}' for k in range(i % 90))}") for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 100 != 0), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    out = {x.page_id: x.verdict for x in U.judged(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all((out[i] == "block") == (i % 100 == 0) for i, _ in rows)


def test_a_rule_needs_five_labelled_urls(spark):
    marked = lambda n: spark.createDataFrame([(i, f"{'one' if i < n else 'many'}.biz", f"/x{chr(97 + i % 26)}", "block" if i < n else "allow") for i in range(300)], "row long, host string, path string, verdict string").select(U.items_of(F.col("host"), F.col("path")).alias("items"), "verdict")
    assert [any("domain=one.biz" in x["items"] for x in U.mined_rules(marked(n)).collect()) for n in (4, 5)] == [False, True]


def test_hosts_of_very_many_labels(spark):
    items = spark.range(1).select(U.items_of(F.lit(".".join(["a"] * 5000)), F.lit("/")).alias("items")).first()["items"]
    assert len(items) < 140 and "site=" + ".".join(["a"] * 5000) in items and "domain=a.a" in items


def test_no_table_of_urls_is_sent_to_the_driver(spark):
    # the files of these URLs take a small part of what their rows take in memory; a broadcast table takes a page of up to 64 MB, beyond 100 MB it is refused here
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.format_string("http://blog.h%s.example.biz/en/some/longer/path/%s.html", F.col("id") % 7, "id").alias("url"))
    labels = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "cast(id % 7 = 3 as int) as toxic", "1 as quality")
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(100 << 20))
    try:
        out = U.judged(pages, labels).groupBy("verdict").agg(F.count("*"), F.min(F.col("page_id") % 7), F.max(F.col("page_id") % 7)).collect()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)
    found = {x[0]: tuple(x)[1:] for x in out}
    assert found["block"] == (5714, 3, 3) and found["allow"] == (34_286, 0, 6)
