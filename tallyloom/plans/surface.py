"""Queries of filters, matrices, rankings and quality rules over the dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import filters, health
from tallyloom.operators import surface as S
from tallyloom.plans.registry import query
from tallyloom.sources import adapters as A


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND contains(lower(c_name || ' ' || n_name), 'in')")
def f3_feed_filter(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").where("c_acctbal > 0 and c_mktsegment = 'BUILDING'").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(A.table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.where(F.lower(F.concat_ws(" ", "c_name", "n_name")).contains("in")).select("c_custkey", "c_name", "n_name")


@query("WITH p AS (SELECT l_orderkey AS product, list_distinct(list(l_returnflag)) AS routes FROM lineitem GROUP BY 1) SELECT product FROM p WHERE list_contains(routes, 'A') AND list_contains(routes, 'R') AND product IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def f4_product_board(spark: SparkSession, d: str) -> DataFrame:
    """Products that have all selected routes (flags are summed, not gathered), semi-joined with matching studies."""
    has = lambda x: F.max((F.col("l_returnflag") == x).cast("int"))
    p = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("product")).agg(has("A").alias("a"), has("R").alias("r")).where("a = 1 and r = 1")
    named = A.table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("product"))
    return p.join(named, "product", "left_semi").select("product")


@query("SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 40 THEN 'none' ELSE p_brand END) = 'none' AND contains(lower(p_type || ' ' || p_name), 'a')")
def f5_faceted_filter(spark: SparkSession, d: str) -> DataFrame:
    """A facet that is null counts as "none"."""
    p = A.table(spark, d, "part").withColumn("facet", F.when(F.col("p_size") <= 40, F.col("p_brand")))
    return p.where((F.coalesce("facet", F.lit("none")) == "none") & F.lower(F.concat_ws(" ", "p_type", "p_name")).contains("a")).select("p_partkey")


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 100 = 7 THEN 'id' ELSE 'legacy' END AS found_by FROM orders WHERE o_orderkey % 100 IN (7, 8)")
def f6_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events by their id, else by a legacy id."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.array(F.col("o_orderkey") + 1_000_000_000).alias("legacy_ids"))
    wanted = o.where("event_id % 100 in (7, 8)").select(F.when(F.col("event_id") % 100 == 7, F.col("event_id")).otherwise(F.col("event_id") + 1_000_000_000).alias("name"))
    names = o.select("event_id", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("event_id").alias("name")), F.struct(F.lit(1).alias("rank"), F.col("legacy_ids")[0].alias("name")))).alias("n")).select("event_id", "n.*")
    best = wanted.join(names, "name").groupBy("name").agg(F.min(F.struct("rank", "event_id")).alias("m"))
    return best.select(F.col("m.event_id").alias("event_id"), F.when(F.col("m.rank") == 0, "id").otherwise("legacy").alias("found_by"))


@query("(SELECT 'item' AS kind, p_partkey AS id FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_retailprice DESC, p_partkey LIMIT 10) UNION ALL (SELECT 'event', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)")
def f7_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten items and ten events for a query."""
    p = A.table(spark, d, "part").where(F.lower("p_name").contains("a")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.lit("item").alias("kind"), F.col("p_partkey").alias("id"))
    o = A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select(F.lit("event").alias("kind"), F.col("o_orderkey").alias("id"))
    return p.unionByName(o)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 25 AND l_discount IS NOT NULL")
def f10_performance_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").where("l_returnflag = 'N' and l_linestatus = 'O' and l_quantity > 25 and l_discount is not null").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_partkey")


@query("SELECT count(*) AS companies, count(*) FILTER (WHERE c_acctbal > 0) AS positive, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(DISTINCT c_nationkey) AS nations FROM customer")
def g6_board_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_distinct("c_nationkey").alias("nations"))


@query("SELECT 'route' AS facet, p_brand AS value, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'stage', p_type, count(DISTINCT p_partkey) FROM part GROUP BY p_type UNION ALL SELECT 'kind', l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)")
def g7_topic_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each facet's values: one exploded pass over parts, one over lines."""
    pairs = F.explode(F.array(F.struct(F.lit("route").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("stage").alias("facet"), F.col("p_type").alias("value")))).alias("p")
    parts = A.table(spark, d, "part").select("p_partkey", pairs).groupBy("p.facet", "p.value").agg(F.count_distinct("p_partkey").alias("n"))
    kinds = A.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("facet"), "value", "n")
    return parts.unionByName(kinds)


@query(
    """WITH f AS (SELECT CAST(n_name AS VARCHAR) AS company, max(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BUILDING, max(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS MACHINERY,
max(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END) AS FURNITURE FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY 1),
r AS (SELECT *, BUILDING + MACHINERY + FURNITURE AS total FROM f) SELECT * FROM r UNION ALL SELECT 'all', CAST(sum(BUILDING) AS INT), CAST(sum(MACHINERY) AS INT), CAST(sum(FURNITURE) AS INT), CAST(sum(total) AS INT) FROM r"""
)
def g8_coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").where("c_acctbal > 5000").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.coverage(c.select(F.col("n_name").alias("company"), F.col("c_mktsegment").alias("cancer")), "company", "cancer", ["BUILDING", "MACHINERY", "FURNITURE"])


@query(
    """WITH r AS (SELECT DISTINCT l_suppkey AS company, l_returnflag AS regulator, l_linestatus AS status FROM lineitem)
SELECT company, string_agg(status, ',' ORDER BY status) FILTER (WHERE regulator = 'A') AS a, string_agg(status, ',' ORDER BY status) FILTER (WHERE regulator = 'N') AS n, string_agg(status, ',' ORDER BY status) FILTER (WHERE regulator = 'R') AS r FROM r GROUP BY 1"""
)
def g9_regulatory_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of each company and regulator in rank order. Statuses are a short list, so sets of them are bounded."""
    r = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("regulator"), F.col("l_linestatus").alias("status"))
    one = lambda x: F.array_sort(F.collect_set(F.when(F.col("regulator") == x, F.col("status"))))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return r.groupBy("company").agg(one("A").alias("a"), one("N").alias("n"), one("R").alias("r")).select("company", text("a").alias("a"), text("n").alias("n"), text("r").alias("r"))


@query("SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def g10_by_year_and_month(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, ts, event_id AS seq, event_type AS status, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS p FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p DESC, ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY day) AS runs FROM r) SELECT day, runs, status, seq FROM n WHERE k = 1"""
)
def g11_day_roll_up(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).alias("is_pipeline"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return health.rolled_days(runs)


@query(
    """WITH c AS (SELECT l_returnflag AS cancer, l_linestatus AS stage, count(*) AS n, count(*) FILTER (WHERE l_quantity > 20) AS k FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
SELECT coalesce(cancer, 'all') AS cancer, coalesce(stage, 'all') AS stage, k, n, round(100.0 * k / n, 1) AS pct, CASE WHEN k / n < 0.2 THEN 0 WHEN k / n < 0.4 THEN 1 WHEN k / n < 0.6 THEN 2 WHEN k / n < 0.8 THEN 3 WHEN k / n < 0.9 THEN 4 ELSE 5 END AS heat FROM c"""
)
def g15_stage_table(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_quantity") > 20).alias("k"), F.count(F.lit(1)).alias("n"))
    share = F.col("k") / F.col("n")
    return c.select(F.coalesce("l_returnflag", F.lit("all")).alias("cancer"), F.coalesce("l_linestatus", F.lit("all")).alias("stage"), "k", "n", F.round(100 * share, 1).alias("pct"), S.heat_bin(share).alias("heat"))


@query("SELECT p_partkey, p_brand, p_type, rank() OVER (PARTITION BY p_brand, p_type ORDER BY p_size) AS place FROM part WHERE p_size IS NOT NULL")
def g17_comparable_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Readings rank only within one category and one scale."""
    return A.table(spark, d, "part").where("p_size is not null").select("p_partkey", "p_brand", "p_type", F.rank().over(Window.partitionBy("p_brand", "p_type").orderBy("p_size")).alias("place"))


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'vendor' ELSE 'peer' END AS weight, count(*) AS n, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1")
def g16_evidence_weight(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").groupBy(F.when(F.col("l_returnflag") == "R", "vendor").otherwise("peer").alias("weight")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("sources"))


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS with_lod, count(*) FILTER (WHERE p_retailprice > 1000) AS with_price FROM part GROUP BY 1")
def g13_tiles(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("with_lod"), F.count_if(F.col("p_retailprice") > 1000).alias("with_price"))


@query("SELECT s_nationkey AS kind, count(*) AS n FROM supplier GROUP BY 1")
def g14_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_STUDIES = """st AS (SELECT l_suppkey AS company, l_orderkey * 10 + l_linenumber AS study_id, l_linestatus = 'O' AS in_scope, CAST(l_linenumber AS INT) % 6 AS design_rank,
CASE WHEN l_tax > 0 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS filled, CAST(l_shipdate AS DATE) AS day, l_quantity > 5 AS has_numbers, l_quantity AS sens FROM lineitem)"""


def _studies(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("study_id"), (F.col("l_linestatus") == "O").alias("in_scope"), (F.col("l_linenumber") % 6).cast("int").alias("design_rank"),
        ((F.col("l_tax") > 0).cast("int") + (F.col("l_discount") > 0).cast("int")).alias("filled"), F.to_date("l_shipdate").alias("day"), (F.col("l_quantity") > 5).alias("has_numbers"), F.col("l_quantity").alias("sens"),
    )


@query(f"WITH {_STUDIES}, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY in_scope DESC, design_rank, filled DESC, day DESC, study_id) AS n FROM st WHERE has_numbers) SELECT company, study_id, design_rank FROM r WHERE n = 1")
def w5_headline_study(spark: SparkSession, d: str) -> DataFrame:
    return S.headline(_studies(spark, d))


@query(f"WITH {_STUDIES}, r AS (SELECT company, study_id, row_number() OVER (PARTITION BY company ORDER BY design_rank, day DESC, study_id) AS place FROM st) SELECT company, study_id, place FROM r")
def w6_study_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("company").orderBy("design_rank", F.desc("day"), "study_id")
    return _studies(spark, d).withColumn("place", F.row_number().over(w)).select("company", "study_id", "place")


@query(f"WITH {_STUDIES} SELECT study_id, sens, row_number() OVER (ORDER BY design_rank, coalesce(sens, -1) DESC, study_id) AS place FROM st WHERE in_scope")
def w7_performance_sort(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered(_studies(spark, d).where("in_scope"), "place", F.asc("design_rank"), F.coalesce("sens", F.lit(-1)).desc(), F.asc("study_id")).select("study_id", "sens", "place")


@query("SELECT p_partkey AS study_id, row_number() OVER (ORDER BY p_size, p_partkey) AS place, p_brand AS company FROM part WHERE p_size > 5")
def w9_prospective(spark: SparkSession, d: str) -> DataFrame:
    """The studies of the prospective comparison, in the order that they state."""
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("study_id"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("order"), F.col("p_brand").alias("company"))
    return S.in_stated_order(p, F.col("order"), F.asc("study_id")).select("study_id", "place", "company")


@query("SELECT conv_id AS event_id, max(turn) AS rev_no, max_by(role, turn) AS facts, count(*) AS revisions FROM conversations GROUP BY 1")
def w10_latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("event_id")).agg(F.max("turn").alias("rev_no"), F.max_by("role", "turn").alias("facts"), F.count(F.lit(1)).alias("revisions"))


@query("SELECT o_orderkey AS event_id, array_to_string(list_transform(range(6, -1, -1), lambda i: CASE WHEN i = date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') THEN 1 ELSE 0 END), '') AS spark FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-20'")
def w11_day_vector(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-07-20")).select(F.col("o_orderkey").alias("event_id"), "o_orderdate")
    return S.age_vector(o, "event_id", F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date"), 7).select("event_id", F.array_join(F.transform("spark", lambda x: x.cast("string")), "").alias("spark"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q1_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.unique_keys(A.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def q2_referential_closure(spark: SparkSession, d: str) -> DataFrame:
    return S.dangling(A.table(spark, d, "labels").select("doc_id"), "doc_id", A.table(spark, d, "pages"), "page_id")


@query("SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q3_uncited(spark: SparkSession, d: str) -> DataFrame:
    edges = A.event_evidence(spark, d)
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")).join(edges, "event_id", "left_anti")


@query("SELECT page_id, (url IS NOT NULL AND length(html) > 4000) AS both_kinds FROM pages WHERE (url IS NOT NULL) = (length(html) > 4000)")
def q4_link_or_document(spark: SparkSession, d: str) -> DataFrame:
    """A source is a link or a rebuilt document, never both or neither."""
    link, body = F.col("url").isNotNull(), F.length("html") > 4000
    return A.table(spark, d, "pages").where(link == body).select("page_id", (link & body).alias("both_kinds"))


@query("SELECT p_partkey, 'size_without_price' AS rule FROM part WHERE p_size > 40 AND p_retailprice < 1000 UNION ALL SELECT p_partkey, 'brand_form' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-4][0-9]$')")
def q6_domain_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array_compact(F.array(F.when((F.col("p_size") > 40) & (F.col("p_retailprice") < 1000), "size_without_price"), F.when(~F.col("p_brand").rlike("^Brand#[0-4][0-9]$"), "brand_form")))
    return A.table(spark, d, "part").select("p_partkey", F.explode(rules).alias("rule"))


@query("WITH w AS (SELECT unnest(['F', 'O', 'P', 'Q']) AS o_orderstatus), v AS (SELECT DISTINCT o_orderpriority FROM orders UNION SELECT '6-NONE') SELECT o_orderstatus, o_orderpriority FROM w CROSS JOIN v WHERE (o_orderstatus, o_orderpriority) NOT IN (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) AND o_orderpriority IN ('1-URGENT', '2-HIGH', '6-NONE')")
def q9_required_combinations(spark: SparkSession, d: str) -> DataFrame:
    return S.missing_combinations(A.table(spark, d, "orders"), ("o_orderstatus", ["F", "O", "P", "Q"]), ("o_orderpriority", ["1-URGENT", "2-HIGH", "6-NONE"]))


_BOARD = """b AS (SELECT p_partkey AS id, p_name, p_brand AS region, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size > 25 AS mced, p_type, p_size % 5 AS st FROM part),
s AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity = 50)"""


@query(
    f"""WITH {_BOARD} SELECT 'routes' AS filter, id FROM b WHERE a AND b UNION ALL SELECT 'mced', id FROM b WHERE mced UNION ALL SELECT 'cancer', id FROM b WHERE p_type = (SELECT min(p_type) FROM part)
UNION ALL SELECT 'status', id FROM b WHERE st = 3 UNION ALL SELECT 'region and route', id FROM b WHERE region = (SELECT min(p_brand) FROM part) AND a
UNION ALL SELECT 'keyword', id FROM b WHERE contains(lower(p_name), 'an') OR id IN (SELECT id FROM s) UNION ALL SELECT 'none', id FROM b"""
)
def f4_board_facets(spark: SparkSession, d: str) -> DataFrame:
    """Each facet of the board apart, two together, and none."""
    size = F.col("p_size")
    routes = F.array_compact(F.array(F.when(size % 2 == 0, "a"), F.when(size % 3 == 0, "b")))
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_brand").alias("region"), routes.alias("routes"), (size > 25).alias("mced"), F.array("p_type").alias("cancers"), F.array((size % 5).cast("string")).alias("status_keys"))
    studies = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.when(F.col("l_quantity") == 50, "PANEL").otherwise("other").alias("name"))
    low = A.table(spark, d, "part").agg(F.min("p_type").alias("t"), F.min("p_brand").alias("b")).first()
    some = {"routes": {"routes": ("a", "b")}, "mced": {"cancer": "MCED"}, "cancer": {"cancer": low.t}, "status": {"status": "3"}, "region and route": {"region": low.b, "routes": ("a",)}, "keyword": {"keyword": "AN", "fields": ("p_name",), "studies": studies}, "none": {}}
    frames = [filters.board_filter(part, "id", **how).select(F.lit(name).alias("filter"), "id") for name, how in some.items()]
    return S.timeline(frames)


@query(
    """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size <= 40 THEN p_brand END AS approach, CAST(p_size % 4 AS VARCHAR) AS tissue, lower(p_name || ' ' || p_type || ' cancer ' || p_size % 7) AS t FROM part)
SELECT 'null facet' AS filter, id FROM p WHERE coalesce(approach, 'none') = 'none' UNION ALL SELECT 'two facets', id FROM p WHERE approach = (SELECT min(p_brand) FROM part) AND tissue = '1'
UNION ALL SELECT 'nested', id FROM p WHERE contains(t, 'cancer 3') UNION ALL SELECT 'off', id FROM p"""
)
def f5_all_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets together with a keyword over fields and a nested array; null is "none", "all" is off."""
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("approach"), (F.col("p_size") % 4).alias("tissue"), "p_name", "p_type", F.array(F.struct(F.concat(F.lit("Cancer "), (F.col("p_size") % 7).cast("string")).alias("cancer"))).alias("clinical"))
    low = A.table(spark, d, "part").agg(F.min("p_brand").alias("b")).first().b
    nested = F.transform("clinical", lambda s: s["cancer"])
    some = {"null facet": ({"approach": "none", "tissue": "all"}, None), "two facets": ({"approach": low, "tissue": "1"}, " "), "nested": ({}, " CANCER 3 "), "off": ({"approach": "", "tissue": None}, None)}
    return S.timeline([filters.facet_filter(part, facets, q, ("p_name", "p_type"), nested).select(F.lit(name).alias("filter"), "id") for name, (facets, q) in some.items()])


@query(
    """WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS design, l_linestatus AS scope, l_quantity > 45 AS diagnostic, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS sens, CASE WHEN l_linenumber <> 4 THEN l_discount END AS spec FROM lineitem)
SELECT 'plain' AS filter, id, line FROM r WHERE design IN ('A', 'N') UNION ALL SELECT 'design', id, line FROM r WHERE design = 'R' AND scope = 'F' UNION ALL SELECT 'all', id, line FROM r WHERE scope = 'O'
UNION ALL SELECT 'scatter', id, line FROM r WHERE scope = 'F' AND NOT diagnostic AND sens IS NOT NULL AND spec IS NOT NULL"""
)
def f10_performance_table(spark: SparkSession, d: str) -> DataFrame:
    """Prospective rows only unless a design or the tier "all" is given; the points of the scatter."""
    n = F.col("l_linenumber")
    r = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("line"), F.col("l_returnflag").alias("design"), F.col("l_linestatus").alias("scope"), (F.col("l_quantity") > 45).alias("diagnostic"), F.when(n != 3, F.col("l_quantity")).alias("sens"), F.when(n != 4, F.col("l_discount")).alias("spec"))
    ahead = ("A", "N")
    frames = {"plain": filters.performance_rows(r, ahead), "design": filters.performance_rows(r, ahead, scope="F", design="R", tier="all"), "all": filters.performance_rows(r, ahead, scope="O", tier="all"), "scatter": filters.scatter_rows(r, "F")}
    return S.timeline([f.select(F.lit(name).alias("filter"), "id", "line") for name, f in frames.items()])


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY coalesce(CASE WHEN p_size <> 7 THEN p_size END, -1), p_partkey) AS place FROM part")
def w7_sorted_by_figure(spark: SparkSession, d: str) -> DataFrame:
    """The table by one figure, the lowest first; none counts as -1."""
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 7, F.col("p_size")).alias("n"))
    return S.numbered(p, "place", *filters.performance_order("n", -1), F.asc("id")).select("id", "place")
