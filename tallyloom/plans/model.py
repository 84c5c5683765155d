"""Queries of the public model, exports and remaining projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import scoring
from tallyloom.functions import text as X
from tallyloom.operators import adjudicate, evidence, health
from tallyloom.operators.registry import registry_faults
from tallyloom.operators.surface import numbered
from tallyloom.plans.base import EVENTS, REGISTRY
from tallyloom.plans.registry import query
from tallyloom.sources import adapters as A


@query(
    f"""WITH {REGISTRY} SELECT source_id, 'interval_without_tier' AS rule FROM registry WHERE poll_interval_hours > 36 AND tier = 'discovery'
UNION ALL SELECT source_id, 'disabled_authority' FROM registry WHERE NOT enabled AND tier = 'authoritative' UNION ALL SELECT source_id, 'scope' FROM registry WHERE scope NOT IN ('1', '2', '3', '4')"""
)
def s1_registry_rules(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the registry's rules."""
    rules = F.array_compact(F.array(
        F.when((F.col("poll_interval_hours") > 36) & (F.col("tier") == "discovery"), "interval_without_tier"), F.when(~F.col("enabled") & (F.col("tier") == "authoritative"), "disabled_authority"),
        F.when(~F.col("scope").isin("1", "2", "3", "4"), "scope"),
    ))
    return A.registry(spark, d).select("source_id", F.explode(rules).alias("rule"))


@query(f"WITH {EVENTS} SELECT event_id, status = 'O' OR level = 'L1' IS TRUE OR event_type = '1-URGENT' OR total >= 80 AS second_opinion FROM ledger")
def e9_route_review(spark: SparkSession, d: str) -> DataFrame:
    """Which events need a second opinion."""
    risky = evidence.high_risk(F.col("level"), F.col("event_type"), ("1-URGENT",))
    return A.ledger_events(spark, d).select("event_id", adjudicate.needs_review(F.col("status") == "O", risky, F.lit(True), F.col("total")).alias("second_opinion"))


@query(f"WITH {EVENTS} SELECT review_status, status, count(*) AS n FROM ledger GROUP BY ALL")
def e5_review_outcome(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger_events(spark, d).groupBy("review_status", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j8_company_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Companies with their place; the small dimensions are left to the optimiser, which knows their size."""
    places = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return A.table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("WITH v AS (SELECT o_orderpriority AS view, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders) SELECT view, pos, event_id, o_orderstatus AS status FROM v JOIN orders ON event_id = o_orderkey")
def j14_view_join(spark: SparkSession, d: str) -> DataFrame:
    """Ordered id lists of views joined back to their stories."""
    o = A.table(spark, d, "orders")
    view = numbered(o.select(F.col("o_orderpriority").alias("view"), F.col("o_orderkey").alias("event_id"), "o_totalprice"), "at", F.asc("view"), F.desc("o_totalprice"), F.asc("event_id"))
    begins = view.groupBy("view").agg(F.min("at").alias("first"))
    flat = view.join(begins, "view").select("view", (F.col("at") - F.col("first") + 1).alias("pos"), "event_id")
    return flat.join(o, F.col("event_id") == F.col("o_orderkey")).select("view", "pos", "event_id", F.col("o_orderstatus").alias("status"))


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN d.source END, 'from ' || b.item_id, 'none') AS content FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def j15_bridged_content(spark: SparkSession, d: str) -> DataFrame:
    """Missing content is taken from the story item of the same id."""
    docs, items = A.table(spark, d, "documents"), A.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("from "), F.col("item_id").cast("string")).alias("story"))
    return docs.join(items, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("source")), "story", F.lit("none")).alias("content"))


@query("SELECT p_partkey, p_name || '…' AS title FROM part")
def p11_clean_title(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", X.clean_title(F.concat("p_name", F.lit("... | News | Example Site"))).alias("title"))


@query(r"SELECT s_suppkey, regexp_replace(lower(s_name), '[\s\-_.,#]+', '', 'g') AS entity FROM supplier")
def p12_norm_entity(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.translate("s_name", "#", " "), F.lit("™ Co., Ltd."))
    return A.table(spark, d, "supplier").select("s_suppkey", X.norm_entity(named).alias("entity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 30 THEN l_quantity WHEN l_quantity > 10 THEN l_quantity / 2 END AS early, CASE WHEN l_quantity > 30 THEN 'early' WHEN l_quantity > 10 THEN 'precancer' END AS label FROM lineitem")
def p18_early_reading(spark: SparkSession, d: str) -> DataFrame:
    """The early reading, else the one before cancer, else none, with its label."""
    early, before = F.when(F.col("l_quantity") > 30, F.col("l_quantity")), F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 2)
    one = F.coalesce(F.when(early.isNotNull(), F.struct(early.alias("v"), F.lit("early").alias("l"))), F.when(before.isNotNull(), F.struct(before.alias("v"), F.lit("precancer").alias("l"))))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", one["v"].alias("early"), one["l"].alias("label"))


@query("SELECT metric, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem WHERE l_discount > 0 UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY metric")
def p19_long_readings(spark: SparkSession, d: str) -> DataFrame:
    """Metrics in long form, blanks dropped."""
    wide = A.table(spark, d, "lineitem").select(F.col("l_orderkey"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot("l_orderkey", ["quantity", "discount", "tax"], "metric", "value").where("value is not null")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH k AS (SELECT l_orderkey AS study, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS journal, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS conf, min(l_linenumber) AS design FROM lineitem GROUP BY 1)
SELECT study, CASE WHEN journal = 1 THEN 'publication' WHEN conf = 1 THEN 'conference' ELSE 'readout' END AS kind, CASE WHEN design <= 1 THEN 'L1' WHEN design <= 3 THEN 'L2' ELSE 'L3' END AS level FROM k"""
)
def p22_study_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kind and level of a study from its sources and design."""
    has = lambda x: F.max((F.col("l_returnflag") == x).cast("int")) == 1
    g = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study")).agg(has("A").alias("journal"), has("R").alias("conf"), F.min("l_linenumber").alias("design"))
    kind = F.when(F.col("journal"), "publication").when(F.col("conf"), "conference").otherwise("readout")
    return g.select("study", kind.alias("kind"), F.when(F.col("design") <= 1, "L1").when(F.col("design") <= 3, "L2").otherwise("L3").alias("level"))


@query("SELECT l_suppkey AS anchor, round(avg(l_quantity), 4) AS sens, row_number() OVER (ORDER BY avg(l_quantity) DESC, l_suppkey) AS place FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def w8_anchor_ranking(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("anchor")).agg(F.avg("l_quantity").alias("s"))
    return numbered(g, "place", F.desc("s"), F.asc("anchor")).select("anchor", F.round("s", 4).alias("sens"), "place")


@query(f"WITH {EVENTS}, i AS (SELECT event_id, level, is_public AND publication_state = 'first' AND level IN ('L1', 'L2') AS daily, row_number() OVER (ORDER BY level_rank DESC, total DESC, strftime(occurred_at, '%Y-%m-%d') DESC, event_id) AS place FROM pub WHERE is_public AND publication_state = 'first' AND occurred_at >= TIMESTAMP '2001-01-01') SELECT event_id, level, daily, place FROM i WHERE place <= 10")
def w13_daily_issue(spark: SparkSession, d: str) -> DataFrame:
    """The top ten stories of the current issue, in ledger order."""
    e = A.ledger_events(spark, d).where(evidence.is_public() & (F.col("publication_state") == "first") & (F.col("occurred_at") >= F.lit("2001-01-01")))
    order = [scoring.level_rank(F.col("level")).desc(), F.desc("total"), F.date_format("occurred_at", "yyyy-MM-dd").desc(), F.asc("event_id")]
    top = e.orderBy(*order).limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("event_id", "level", evidence.is_daily().alias("daily"), "place")


@query("SELECT l_orderkey AS event_id, count(DISTINCT l_suppkey) AS evidence, min(l_suppkey) AS low, max(l_suppkey) AS high FROM (SELECT l_orderkey, l_suppkey FROM lineitem UNION SELECT o_orderkey, o_custkey % 10 + 1 FROM orders) GROUP BY 1")
def u2_evidence_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of two evidence edge tables, each pair once."""
    a = A.event_evidence(spark, d).select("event_id", "source_id")
    b = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 10 + 1).alias("source_id"))
    return a.unionByName(b).distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("evidence"), F.min("source_id").alias("low"), F.max("source_id").alias("high"))


@query("SELECT DISTINCT a.l_orderkey AS event_id FROM lineitem a JOIN orders o ON o.o_custkey * 2 = a.l_partkey WHERE a.l_returnflag = 'R'")
def u4_shared_ids(spark: SparkSession, d: str) -> DataFrame:
    """Events that share an id with another table: the ids are exploded and joined by equality."""
    mine = A.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"), F.explode(F.array(F.col("l_partkey"))).alias("name"))
    theirs = A.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("name"))
    return mine.join(theirs, "name", "left_semi").select("event_id").distinct()


@query("SELECT v AS name, CASE v WHEN 'FURNITURE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 100 END AS place FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')")
def u5_universe(spark: SparkSession, d: str) -> DataFrame:
    """The values in use, fixed ones first, without the catch-all."""
    used = A.table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.col("c_mktsegment").alias("name")).distinct()
    return used.withColumn("place", F.when(F.col("name") == "FURNITURE", 1).when(F.col("name") == "MACHINERY", 2).otherwise(100))


@query(f"WITH {EVENTS} SELECT l_orderkey AS event_id, l_linenumber AS pos, l_suppkey AS source_id, l_extendedprice AS price, strftime(coalesce(CASE WHEN status <> 'P' THEN occurred_at END, l_shipdate), '%Y-%m-%d') AS day FROM lineitem JOIN pub ON event_id = l_orderkey WHERE is_public")
def r3_evidence_items(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of public events; an item's day is the event's, else its own."""
    line = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("source_id"), F.col("l_extendedprice").alias("price"), "l_shipdate")
    e = A.ledger_events(spark, d).where(evidence.is_public()).select("event_id", F.when(F.col("status") != "P", F.col("occurred_at")).alias("at"))
    return line.join(e, "event_id").select("event_id", "pos", "source_id", "price", F.date_format(F.coalesce("at", "l_shipdate"), "yyyy-MM-dd").alias("day"))


@query(
    """WITH t AS (SELECT l_orderkey AS study, l_linenumber AS n, l_suppkey AS company, l_returnflag AS stage FROM lineitem) SELECT CASE stage WHEN 'A' THEN 'regulatory' WHEN 'N' THEN 'launch' ELSE 'readout' END AS kind, n_name AS place, count(*) AS n
FROM t JOIN supplier ON s_suppkey = company JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"""
)
def r4_archive_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Archive rows as kinds of events, by place of the company."""
    kind = F.when(F.col("l_returnflag") == "A", "regulatory").when(F.col("l_returnflag") == "N", "launch").otherwise("readout")
    rows = A.table(spark, d, "lineitem").groupBy("l_suppkey", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))  # summed before the joins
    place = A.table(spark, d, "supplier").join(A.table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("kind", F.col("n_name").alias("place")).agg(F.sum("n").alias("n"))


@query(f"WITH {EVENTS} SELECT event_id, 'Order ' || event_id AS title, strftime(occurred_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, sources FROM pub WHERE is_public")
def r5_monitor_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Public stories as timeline events, by the day at +08:00."""
    title = X.clean_title(F.concat(F.lit("Order "), F.col("event_id").cast("string"), F.lit(" | Site")))
    day = F.date_format(F.from_utc_timestamp(F.col("occurred_at").cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd")
    return A.ledger_events(spark, d).where(evidence.is_public()).select("event_id", title.alias("title"), day.alias("day"), "sources")


@query(
    """WITH s AS (SELECT l_orderkey AS event_id, l_suppkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL) SELECT event_id, count(*) AS n, string_agg(s_name || ':' || pos, ';' ORDER BY pos, s_suppkey) AS sources FROM s JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"""
)
def r6_api_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their resolved sources nested in order."""
    s = A.event_evidence(spark, d).groupBy("event_id", "source_id").agg(F.min("pos").alias("pos"))
    named = s.join(A.table(spark, d, "supplier"), F.col("source_id") == F.col("s_suppkey"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "s_suppkey", "s_name")))
    return named.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(packed, lambda x: F.concat(x["s_name"], F.lit(":"), x["pos"].cast("string"))), ";").alias("sources"))


@query(
    """WITH o AS (SELECT user_id AS source_id, ts, event_id, event_type = 'error' AS failed FROM events), g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS grp FROM o),
l AS (SELECT source_id, max(grp) AS lg FROM g GROUP BY 1), c AS (SELECT g.source_id, count(*) FILTER (WHERE failed AND grp = lg) AS f FROM g JOIN l USING (source_id) GROUP BY 1),
h AS (SELECT CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 3 THEN 'failed' WHEN f > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM supplier LEFT JOIN c ON source_id = s_suppkey)
SELECT count(*) AS sources, count(*) FILTER (WHERE health = 'failed') AS failed, CASE WHEN count(*) FILTER (WHERE health <> 'unknown') = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE health = 'failed') * 2 > count(*) THEN 'down' WHEN count(*) FILTER (WHERE health IN ('failed', 'degraded')) > 0 THEN 'degraded' ELSE 'ok' END AS state FROM h"""
)
def r8_monitor_health(spark: SparkSession, d: str) -> DataFrame:
    """One row: the monitor's state from its sources'."""
    runs = A.table(spark, d, "events").select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    s = health.status(A.registry(spark, d), health.run_state(runs))
    n = lambda *x: F.count_if(F.col("health").isin(*x))
    c = s.agg(F.count(F.lit(1)).alias("sources"), n("failed").alias("failed"), n("failed", "degraded").alias("ill"), n("failed", "degraded", "healthy").alias("known"))
    state = F.when(F.col("known") == 0, "unknown").when(2 * F.col("failed") > F.col("sources"), "down").when(F.col("ill") > 0, "degraded").otherwise("ok")
    return c.select("sources", "failed", state.alias("state"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL")
def g12_day_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each day by kind."""
    return A.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    """WITH s AS (SELECT CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 10 = 1 THEN CAST(s_suppkey - 1 AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS source_id, s_suppkey AS k FROM supplier),
a AS (SELECT CAST(s_suppkey AS VARCHAR) AS source_id, s_suppkey AS k, unnest([1, 2]) AS n FROM supplier WHERE s_suppkey % 9 <> 0),
w AS (SELECT DISTINCT source_id FROM s WHERE k % 3 = 0 AND source_id IS NOT NULL)
SELECT source_id, 'missing_id' AS rule FROM s WHERE source_id IS NULL UNION ALL SELECT source_id, 'missing_owner' FROM s WHERE k % 7 = 0 UNION ALL SELECT source_id, 'tier' FROM s WHERE k % 5 = 4
UNION ALL SELECT source_id, 'event_types' FROM s WHERE k % 6 = 0 UNION ALL SELECT source_id, 'enabled' FROM s WHERE k % 19 = 0 UNION ALL SELECT source_id, 'interval' FROM s WHERE k % 4 = 0
UNION ALL SELECT source_id, 'account_tier' FROM s WHERE k % 3 = 0 AND k % 5 NOT IN (2, 3) UNION ALL SELECT source_id, 'url' FROM s WHERE k % 13 < 2
UNION ALL SELECT source_id, 'repeated_id' FROM s WHERE source_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT source_id, 'no_accounts' FROM w WHERE source_id NOT IN (SELECT source_id FROM a)
UNION ALL SELECT source_id, 'account_username' FROM a WHERE n = 2 AND k % 2 = 1 AND source_id IN (SELECT source_id FROM w) UNION ALL SELECT DISTINCT source_id, 'repeated_account' FROM a WHERE k % 2 = 0 AND source_id IN (SELECT source_id FROM w)"""
)
def s1_registry_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of a registry with faults of all kinds."""
    k, name = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    source = F.when(k % 17 == 0, None).when(k % 10 == 1, (k - 1).cast("string")).otherwise(name)
    tier = F.element_at(F.array(*[F.lit(x) for x in ("authoritative", "trusted", "discovery", "discovery", "other")]), (k % 5 + 1).cast("int"))
    url = F.when(k % 13 == 0, "ftp://x.example.com").when(k % 13 == 1, "https://u:p@x.example.com/").otherwise(F.concat(F.lit("https://s"), name, F.lit(".example.com/")))
    types = F.when(k % 6 == 0, F.array(F.lit("approval"), F.lit("odd"))).otherwise(F.array(F.lit("approval")))
    t = A.table(spark, d, "supplier")
    sources = t.select(
        source.alias("source_id"), F.when(k % 7 != 0, "owner").alias("editorial_owner"), tier.alias("tier"), F.when(k % 3 == 0, "posts").otherwise("html").alias("type"), url.alias("url"), types.alias("event_types"),
        F.when(k % 19 != 0, True).alias("enabled"), F.when(k % 4 == 0, -1.0).when(k % 4 == 1, 6.0).alias("poll_interval_hours"),
    )
    users = F.array(F.concat(F.lit("gh_"), name), F.when(k % 2 == 0, F.concat(F.lit("gh_"), name)).otherwise(F.concat(F.lit("bad-"), name)))
    accounts = t.where("s_suppkey % 9 <> 0").select(name.alias("source_id"), F.lit("account").alias("name"), F.explode(users).alias("username"))
    return registry_faults(sources, accounts, ("approval",), "posts")
