"""Queries of the public report, the rule table and the exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import export, rules
from tallyloom.operators.report import Report, project_report
from tallyloom.plans.base import EVENTS
from tallyloom.plans.registry import query
from tallyloom.sources import adapters as A

_REPORT = f"""WITH {EVENTS}, r AS (SELECT *, strftime(occurred_at, '%Y-%m-%d') AS day, coalesce(is_public, false) AS eligible, coalesce(is_public, false) AND event_id % 10 < 4 AS shown FROM pub),
f AS (SELECT *, shown AND event_id % 2 = 0 AND publication_state = 'first' AND level IN ('L1', 'L2') AS daily, shown AND day >= '2001-06-30' AS hot FROM r)"""


def _report(spark: SparkSession, d: str) -> Report:
    """The report at a closed gate: four tenths of the events were released before."""
    events = A.ledger_events(spark, d).withColumn("released", F.col("event_id") % 10 < 4)
    edges = A.event_evidence(spark, d).join(A.registry(spark, d).select("source_id", "editorial_owner", "tier"), "source_id")
    return project_report(events, edges, events.where("event_id % 2 = 0"), F.lit("2001-07-31").cast("timestamp"), 31, gate_open=False)


@query(
    f"""{_REPORT}, e AS (SELECT l_orderkey AS event_id, count(*) AS n_items, count(DISTINCT editorial_owner) AS sources_count FROM lineitem JOIN registry ON source_id = l_suppkey GROUP BY 1)
SELECT event_id, level, total AS score, day, CASE publication_state WHEN 'first' THEN 'new' ELSE '' END AS badge, coalesce(n_items, 0) AS n_items, coalesce(sources_count, 0) AS sources_count, daily, hot, CASE WHEN epoch(TIMESTAMP '2001-07-31') - epoch(occurred_at) BETWEEN 0 AND 31 * 86400 - 1 THEN 30 - floor((epoch(TIMESTAMP '2001-07-31') - epoch(occurred_at)) / 86400)::BIGINT END AS spark_at,
row_number() OVER (ORDER BY level_rank DESC, total DESC, day DESC, event_id) AS place FROM f LEFT JOIN e USING (event_id) WHERE shown"""
)
def r1_stories(spark: SparkSession, d: str) -> DataFrame:
    """Every story of the public report, in its place."""
    return _report(spark, d).stories.select("event_id", "level", "score", "day", "badge", "n_items", "sources_count", "daily", "hot", "spark_at", "place")


@query(f"{_REPORT} SELECT event_id, l_linenumber AS pos, l_suppkey AS source_id, editorial_owner, tier, day FROM f JOIN lineitem ON l_orderkey = event_id JOIN registry ON source_id = l_suppkey WHERE shown")
def r1_items(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of evidence of a story."""
    return _report(spark, d).items


@query(f"{_REPORT} SELECT count(*) AS events, count_if(eligible)::BIGINT AS eligible, count_if(shown)::BIGINT AS shown, count_if(eligible AND NOT shown)::BIGINT AS held, count_if(daily)::BIGINT AS daily, count_if(hot)::BIGINT AS hot, count_if(review_status = 'pending')::BIGINT AS waits FROM f")
def r1_counts(spark: SparkSession, d: str) -> DataFrame:
    """What was shown and what was held back, as it was counted while the report was written."""
    counts = _report(spark, d).counts
    return spark.createDataFrame([counts], ", ".join(f"{c} bigint" for c in ("daily", "eligible", "events", "held", "hot", "shown", "waits"))).select("events", "eligible", "shown", "held", "daily", "hot", "waits")


_ENTRIES = """WITH l AS (SELECT l_orderkey, list({'qty': l_quantity, 'discount': l_discount}) AS lines, list(l_suppkey) AS suppliers FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS event_id, * FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
v AS (SELECT event_id, 'price_above_10000' AS rule, 1 AS times FROM o WHERE NOT o_totalprice > 10000
UNION ALL SELECT event_id, 'old_is_closed', 1 FROM o WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'O'
UNION ALL SELECT event_id, 'priority_form', 1 FROM o WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
UNION ALL SELECT event_id, 'has_lines', 1 FROM o WHERE lines IS NULL
UNION ALL SELECT event_id, 'few_pieces', len(list_filter(lines, lambda x: NOT x.qty <= 48))::INT FROM o
UNION ALL SELECT event_id, 'closed_without_discount', len(list_filter(lines, lambda x: NOT x.discount < 0.1))::INT FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT event_id, 'known_customer', 1 FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 7)
UNION ALL SELECT event_id, 'known_suppliers', len(list_filter(suppliers, lambda x: x % 20 = 3))::INT FROM o),
b AS (SELECT * FROM v WHERE times > 0)"""

#: Rules of single rows and of the entries in them.
RULES = [
    rules.Rule("price_above_10000", "o_totalprice > 10000"),
    rules.Rule("old_is_closed", "o_orderstatus <> 'O'", when="o_orderdate < '1996-01-01'"),
    rules.Rule("priority_form", "o_orderpriority rlike '^[1-4]-'"),
    rules.Rule("has_lines", "lines is not null"),
    rules.Rule("few_pieces", "x.qty <= 48", each="lines"),
    rules.Rule("closed_without_discount", "x.discount < 0.1", when="o_orderstatus = 'F'", each="lines"),
]


def _ruled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"))).alias("lines"), F.collect_list("l_suppkey").alias("suppliers"))
    o = A.table(spark, d, "orders").withColumn("event_id", F.col("o_orderkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    customers, suppliers = A.table(spark, d, "customer").where("c_custkey % 50 <> 7"), A.table(spark, d, "supplier").where("s_suppkey % 20 <> 3")
    return rules.checked(o, "event_id", RULES, [rules.Reference("known_customer", "o_custkey", customers, "c_custkey"), rules.Reference("known_suppliers", "suppliers", suppliers, "s_suppkey", many=True)])


@query(f"{_ENTRIES} SELECT event_id, rule, times FROM b")
def q7_rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the table that an event breaks, and how often."""
    return _ruled(spark, d)[0]


@query(f"{_ENTRIES} SELECT o.event_id, (SELECT count(*) FROM b WHERE b.event_id = o.event_id) AS broken, NOT EXISTS (SELECT 1 FROM b WHERE b.event_id = o.event_id) AS clean FROM o")
def q6_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Events that break a rule go to quarantine, the others on."""
    _, held, clean = _ruled(spark, d)
    return held.select("event_id", F.size("broken").cast("bigint").alias("broken"), F.lit(False).alias("clean")).unionByName(clean.select("event_id", F.lit(0).cast("bigint").alias("broken"), F.lit(True).alias("clean")))


def _products(spark: SparkSession, d: str) -> DataFrame:
    """part as nested products with their sources in order."""
    p = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("mark"), F.col("p_size").alias("size")).alias("brand")).alias("product"), F.array("p_type", F.lit("=risky")).alias("tags")
    )
    edges = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("s_suppkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    sources = A.table(spark, d, "supplier").where("s_suppkey % 10 <> 0").select("s_suppkey", F.col("s_name").alias("label"), F.col("s_nationkey").alias("kind"))
    return export.with_sources(p, "id", edges, sources, "s_suppkey", ["label", "kind"])


_SOURCED = """s AS (SELECT l_partkey AS id, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL),
j AS (SELECT id, list({'label': s_name, 'kind': s_nationkey} ORDER BY pos, s_suppkey) AS sources FROM s JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 10 <> 0 GROUP BY 1)"""


@query(
    f"""WITH {_SOURCED} SELECT '"' || p_partkey || '","' || p_name || '","' || p_brand || '","' || p_size || '","' || p_type || '; =risky","' || replace(coalesce(to_json(sources)::VARCHAR, '[]'), '"', '""') || '"' AS line FROM part LEFT JOIN j ON id = p_partkey"""
)
def k4_export_products(spark: SparkSession, d: str) -> DataFrame:
    """The products' export: nested cells taken apart by the schema, sources in one cell."""
    return export.csv(_products(spark, d))[1]


@query(f"WITH {_SOURCED}, e AS (SELECT id, unnest(sources) AS s, unnest(range(len(sources))) AS pos FROM j) SELECT p_partkey AS id, p_name AS product_name, pos::INT AS pos, s.label AS sources_label, s.kind AS sources_kind FROM part LEFT JOIN e ON id = p_partkey")
def k4_export_entries(spark: SparkSession, d: str) -> DataFrame:
    """A row for each source of a product; products without sources stay."""
    rows = export.by_entry(_products(spark, d), "sources")
    return rows.select("id", F.col("product.name").alias("product_name"), "pos", "sources_label", "sources_kind")


@query(
    """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS stages, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS id, c_name AS name, n_name AS "place.country", r_name AS "place.region", coalesce(array_to_string(stages, '; '), '') AS stages, (coalesce(list_contains(stages, 'F'), false))::VARCHAR AS "has_f", coalesce(n, 0)::VARCHAR AS studies FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN s ON o_custkey = c_custkey"""
)
def r6_company_rows(spark: SparkSession, d: str) -> DataFrame:
    """Companies with their place, stages and number of studies, as flat rows."""
    c = A.table(spark, d, "customer").join(A.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(A.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("stages"), F.count(F.lit(1)).alias("studies"))
    none = F.array().cast("array<string>")
    rows = c.join(s, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("country"), F.col("r_name").alias("region")).alias("place"), F.coalesce("stages", none).alias("stages"),
        F.array_contains(F.coalesce("stages", none), "F").alias("has_f"), F.coalesce("studies", F.lit(0)).alias("studies"),
    )
    return export.flat(rows)


@query(
    """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS company, to_json({'priority': o_orderpriority, 'status': o_orderstatus})::VARCHAR AS metrics, '/studies/' || o_orderkey AS url, (o_orderdate::DATE)::VARCHAR AS date FROM orders"""
)
def r6_study_rows(spark: SparkSession, d: str) -> DataFrame:
    """Studies with their figures as one cell."""
    o = A.table(spark, d, "orders")
    metrics = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    return export.flat(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company"), metrics.alias("metrics"), F.concat(F.lit("/studies/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderdate").cast("date").alias("date")))
