"""Queries of facets, matrices, the daily issue and links, each with the order and groups that a reader sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.scoring import level_rank
from tallyloom.operators import evidence, resolve
from tallyloom.operators import surface as S
from tallyloom.plans.base import EVENTS, REGISTRY
from tallyloom.plans.registry import query
from tallyloom.sources import adapters as A


@query(
    """WITH p AS (SELECT p_partkey, p_brand AS route, [p_type, CASE WHEN p_size > 25 THEN 'LARGE' END] AS stages, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM part),
r AS (SELECT route AS value, count(DISTINCT p_partkey) AS n FROM p GROUP BY 1), s AS (SELECT value, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(stages) AS value FROM p) WHERE value IS NOT NULL GROUP BY 1),
k AS (SELECT kind AS value, count(DISTINCT p_partkey) AS n FROM p GROUP BY 1)
SELECT 'route' AS facet, v AS value, coalesce(n, 0) AS n, i AS place FROM (SELECT unnest(['Brand#3', 'Brand#1', 'Brand#99']) AS v, unnest(range(3)) AS i) LEFT JOIN r ON value = v
UNION ALL SELECT 'kind', v, n, 1000000 + i FROM (SELECT unnest(['odd', 'none', 'even']) AS v, unnest(range(3)) AS i) JOIN k ON value = v
UNION ALL SELECT 'stage', value, n, 2000000 + row_number() OVER (ORDER BY n DESC, value) - 1 FROM s"""
)
def g7_ordered_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets in their order: routes keep zeros, kinds drop them, stages come by number."""
    kind = F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")
    stages = F.array(F.col("p_type"), F.when(F.col("p_size") > 25, "LARGE"))
    return S.facet_counts(A.table(spark, d, "part"), "p_partkey", {"route": (F.col("p_brand"), ["Brand#3", "Brand#1", "Brand#99"], False), "kind": (kind, ["odd", "none", "even"], True), "stage": (stages, None, True)})


_SEGMENTS = ["BUILDING", "MACHINERY", "FURNITURE"]


@query(
    """WITH f AS (SELECT r_name AS region, n_name AS company, max((c_mktsegment = 'BUILDING')::INT) AS BUILDING, max((c_mktsegment = 'MACHINERY')::INT) AS MACHINERY, max((c_mktsegment = 'FURNITURE')::INT) AS FURNITURE
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), t AS (SELECT *, BUILDING + MACHINERY + FURNITURE AS total FROM f)
SELECT * FROM t UNION ALL SELECT region, 'all', sum(BUILDING)::INT, sum(MACHINERY)::INT, sum(FURNITURE)::INT, sum(total)::INT FROM t GROUP BY 1"""
)
def g8_grouped_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of segments by company, a matrix for each region, over all customers."""
    c = A.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))  # summed before the joins
    c = c.join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.grouped_coverage(c.select(F.col("r_name").alias("region"), F.col("n_name").alias("company"), "c_mktsegment"), "region", "company", "c_mktsegment", _SEGMENTS)


@query(
    """WITH r AS (SELECT DISTINCT n_regionkey AS region, l_suppkey AS company, l_returnflag AS regulator, l_linestatus || (l_linenumber % 3) AS status FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
k AS (SELECT *, CASE status WHEN 'O2' THEN 1 WHEN 'F1' THEN 2 WHEN 'F0' THEN 3 ELSE 1048576 END AS p FROM r)
SELECT region, company, string_agg(status, ',' ORDER BY p, status) FILTER (WHERE regulator = 'A') AS "A", string_agg(status, ',' ORDER BY p, status) FILTER (WHERE regulator = 'N') AS "N", string_agg(status, ',' ORDER BY p, status) FILTER (WHERE regulator = 'R') AS "R" FROM k GROUP BY 1, 2"""
)
def g9_ranked_regulatory(spark: SparkSession, d: str) -> DataFrame:
    """Statuses by company and regulator in order of their stage, companies by region."""
    r = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company"), F.col("l_returnflag").alias("regulator"), F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("status")).distinct()
    place = A.table(spark, d, "supplier").join(A.table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("company"), F.col("n_regionkey").alias("region"))
    return S.ranked_matrix(r.join(place, "company"), ["region", "company"], "regulator", ["A", "N", "R"], "status", {"O2": 1, "F1": 2, "F0": 3})


@query(
    f"""WITH {EVENTS}, e AS (SELECT event_id, level, level_rank, total, strftime(occurred_at, '%Y-%m-%d') AS date_key, occurred_at, publication_state = 'first' AND event_id % 3 = 0 AS current, publication_state = 'first' AND level IN ('L1', 'L2') AS daily FROM pub WHERE is_public),
c AS (SELECT *, row_number() OVER (ORDER BY level_rank DESC, total DESC, event_id) AS n FROM e WHERE current), y AS (SELECT *, row_number() OVER (ORDER BY level_rank DESC, total DESC, event_id) AS n FROM e WHERE current AND daily),
f AS (SELECT *, row_number() OVER (ORDER BY date_key DESC, level_rank DESC, total DESC, event_id) AS n FROM e WHERE level IN ('L1', 'L2') AND date_diff('day', occurred_at::DATE, DATE '2001-07-31') BETWEEN 0 AND 31)
SELECT 'daily' AS list, event_id, date_key, n AS place FROM y WHERE n <= 5 UNION ALL SELECT 'top', event_id, date_key, n FROM c WHERE n <= 10 UNION ALL SELECT 'featured', event_id, date_key, n FROM f"""
)
def w13_issue_lists(spark: SparkSession, d: str) -> DataFrame:
    """The daily issue: five of the day, ten stories, and all featured events of 31 days."""
    e = A.ledger_events(spark, d).where(evidence.is_public()).withColumn("date_key", F.date_format("occurred_at", "yyyy-MM-dd")).withColumn("current", (F.col("publication_state") == "first") & (F.col("event_id") % 3 == 0))
    order = [level_rank(F.col("level")).desc(), F.desc("total"), F.asc("event_id")]
    return S.daily_issue(e, F.lit("2001-07-31").cast("date"), evidence.is_daily(), order).select("list", "event_id", "date_key", "place")


@query("""WITH m AS (SELECT DISTINCT user_id % 7 AS channel, event_type FROM events WHERE event_type <> 'error') SELECT channel, count(*) AS kinds FROM m GROUP BY 1""")
def w13_manual_channels(spark: SparkSession, d: str) -> DataFrame:
    """The different channels of manual tasks, and how many kinds of task each has."""
    tasks = A.table(spark, d, "events").where("event_type <> 'error'").select((F.col("user_id") % 7).alias("channel"), "event_type").distinct()
    return tasks.groupBy("channel").agg(F.count(F.lit(1)).alias("kinds"))


@query(
    f"""WITH {EVENTS}, l AS (SELECT l_orderkey AS event_id, l_linenumber AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 'https://www.' ELSE 'http://' END || 'source' || l_suppkey % 20 || '.example.com/' || l_partkey AS url, 'source' || l_suppkey % 20 || '.example.com' AS host FROM lineitem JOIN pub ON l_orderkey = event_id WHERE is_public),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id, host ORDER BY pos, url) AS n FROM l) SELECT event_id, host, url, row_number() OVER (PARTITION BY event_id ORDER BY pos, url) AS place FROM o WHERE n = 1"""
)
def r5_story_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of a story on the timeline: one for each host, in order."""
    host = F.concat(F.lit("source"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example.com/"), F.col("l_partkey").cast("string"))
    links = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("pos"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "https://www.").otherwise("http://"), host).alias("url"))
    shown = A.ledger_events(spark, d).where(evidence.is_public()).select("event_id")
    return S.host_links(links.join(shown, "event_id"), "event_id")


@query(
    """SELECT 'study:' || o_orderkey AS id, 'readout' AS kind, o_custkey AS company, strftime(o_orderdate, '%Y-%m-%d') AS date_key, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'status:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'regulatory', o_custkey, strftime(l_shipdate, '%Y-%m-%d'), l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'
UNION ALL SELECT 'milestone:' || p_partkey, 'launch', p_size, (1995 + p_size % 6)::VARCHAR || '-00-00', p_name FROM part"""
)
def r4_archive_events(spark: SparkSession, d: str) -> DataFrame:
    """The archive as events: studies, statuses and milestones, each with an id of its own; a milestone may know its year only."""
    day, text = lambda c: F.date_format(c, "yyyy-MM-dd"), lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    o = A.table(spark, d, "orders")
    rows = lambda df, id_, kind, company, date, title: df.select(id_.alias("id"), F.lit(kind).alias("kind"), company.cast("bigint").alias("company"), date.alias("date_key"), title.alias("title"))
    studies = rows(o.where("o_orderstatus = 'F'"), text(F.lit("study"), F.col("o_orderkey")), "readout", F.col("o_custkey"), day("o_orderdate"), F.col("o_orderpriority"))
    lines = A.table(spark, d, "lineitem").where("l_returnflag = 'A'").join(o.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    statuses = rows(lines, text(F.lit("status"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")), "regulatory", F.col("o_custkey"), day("l_shipdate"), F.col("l_returnflag"))
    parts = A.table(spark, d, "part")
    milestones = rows(parts, text(F.lit("milestone"), F.col("p_partkey")), "launch", F.col("p_size"), F.concat((F.col("p_size") % 6 + 1995).cast("string"), F.lit("-00-00")), F.col("p_name"))
    return S.timeline([studies, statuses, milestones])


@query(
    f"""WITH {REGISTRY} SELECT o_orderkey AS hit_id, CASE WHEN o_orderkey % 4 = 0 THEN 'wire:' || lower(replace(c_name, '#', '-')) || '-co' ELSE 's' || source_id END AS source_id, CASE WHEN o_orderkey % 4 = 0 THEN c_name || ' & Co.' ELSE editorial_owner::VARCHAR END AS editorial_owner
FROM orders JOIN customer ON c_custkey = o_custkey JOIN registry ON source_id = o_orderkey % 10"""
)
def j3_press_wire(spark: SparkSession, d: str) -> DataFrame:
    """Releases on the wire count as their company's, each company a source and an owner of its own."""
    hits = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(A.registry(spark, d), F.col("source_id") == F.col("o_orderkey") % 10)
    hits = hits.withColumn("source_id", F.when(F.col("o_orderkey") % 4 == 0, "wire").otherwise(F.concat(F.lit("s"), F.col("source_id").cast("string")))).withColumn("editorial_owner", F.col("editorial_owner").cast("string"))
    return resolve.press_wire(hits, "wire", F.concat("c_name", F.lit(" & Co."))).select(F.col("o_orderkey").alias("hit_id"), "source_id", "editorial_owner")


@query(
    r"""SELECT conv_id, turn, sha256('{note=' || chr(10) || 'role=' || trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g'), ' ') || chr(10) || 'text=' || trim(regexp_replace(coalesce(CASE WHEN turn % 3 <> 0 THEN text END, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') || '}') AS facts_hash FROM conversations"""
)
def p4_facts_hash(spark: SparkSession, d: str) -> DataFrame:
    """The variant that keeps blank values, over every row: a fact without a value is a fact."""
    facts = F.create_map(F.lit(" Text "), F.when(F.col("turn") % 3 != 0, F.col("text")), F.lit("ROLE"), F.col("role"), F.lit("note"), F.lit(None).cast("string"))
    return A.table(spark, d, "conversations").select("conv_id", "turn", X.fact_hash(facts, keep_empty=True).alias("facts_hash"))
