"""Queries of the unified timeline, hot lists, exports and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scoring import level_rank
from tallyloom.functions.text import csv_line
from tallyloom.operators import evidence
from tallyloom.operators import surface as S
from tallyloom.plans.base import EVENTS
from tallyloom.plans.registry import query
from tallyloom.session import dealt
from tallyloom.sources import adapters as A

_LINE = f"""{EVENTS}, tl AS (
  SELECT 'm' || event_id AS id, strftime(occurred_at, '%Y-%m-%d') AS date_key, level, event_type AS kind, 'c' || company AS company, 'Order ' || event_id AS title, 'monitor' AS origin, CAST(total AS INT) AS score FROM pub WHERE is_public
  UNION ALL SELECT 's' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, strftime(l_shipdate, '%Y-%m') || '-00', CASE l_returnflag WHEN 'A' THEN 'L1' WHEN 'N' THEN 'L2' ELSE 'L3' END, 'study', 's' || l_suppkey, 'Line ' || l_partkey, 'archive', NULL FROM lineitem)"""


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    say = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    m = A.ledger_events(spark, d).where(evidence.is_public()).select(
        say("m", "event_id").alias("id"), F.date_format("occurred_at", "yyyy-MM-dd").alias("date_key"), "level", F.col("event_type").alias("kind"), say("c", "company").alias("company"),
        say("Order ", "event_id").alias("title"), F.lit("monitor").alias("origin"), F.col("total").cast("int").alias("score"),
    )
    level = F.when(F.col("l_returnflag") == "A", "L1").when(F.col("l_returnflag") == "N", "L2").otherwise("L3")
    a = A.table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))).alias("id"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-00")).alias("date_key"), level.alias("level"), F.lit("study").alias("kind"), say("s", "l_suppkey").alias("company"),
        say("Line ", "l_partkey").alias("title"), F.lit("archive").alias("origin"), F.lit(None).cast("int").alias("score"),
    )
    return S.timeline([m, a])


@query(f"WITH {_LINE} SELECT origin, kind, level, count(*) AS n, min(date_key) AS first, max(date_key) AS last FROM tl GROUP BY 1, 2, 3")
def u1_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).groupBy("origin", "kind", "level").agg(F.count(F.lit(1)).alias("n"), F.min("date_key").alias("first"), F.max("date_key").alias("last"))


@query(
    f"""WITH {_LINE}, f AS (SELECT * FROM tl WHERE level IN ('L1', 'L2') AND date_key >= '1997' AND contains(lower(title || ' ' || company || ' ' || kind), 'ine 1')),
r AS (SELECT id, date_key, level, row_number() OVER (ORDER BY date_key DESC, CASE level WHEN 'L1' THEN 3 WHEN 'L2' THEN 2 ELSE 1 END DESC, id) AS place, count(*) OVER () AS total FROM f)
SELECT * FROM r WHERE place > 10 AND place <= 40"""
)
def f1_timeline_query(spark: SparkSession, d: str) -> DataFrame:
    return S.timeline_query(_timeline(spark, d), levels=("L1", "L2"), since="1997", q="INE 1", offset=10, limit=30).select("id", "date_key", "level", F.col("place").cast("bigint").alias("place"), "total")


@query(
    f"""WITH {_LINE}, f AS (SELECT * FROM tl WHERE level = 'L1' AND date_key >= substr('1996-01-01T00:00:00Z', 1, 10)),
r AS (SELECT id, row_number() OVER (ORDER BY date_key DESC, id) AS place, count(*) OVER () AS total FROM f) SELECT * FROM r WHERE place <= 50"""
)
def f2_timeline_tool(spark: SparkSession, d: str) -> DataFrame:
    """The tool's variant: one level, fifty rows at most, and a day out of a longer time."""
    return S.timeline_query(_timeline(spark, d), levels=("L1",), since="1996-01-01T00:00:00Z"[:10], limit=400, most=50).select("id", F.col("place").cast("bigint").alias("place"), "total")


@query(f"WITH {_LINE} SELECT id, row_number() OVER (ORDER BY date_key DESC, CASE level WHEN 'L1' THEN 3 WHEN 'L2' THEN 2 WHEN 'L3' THEN 1 ELSE 0 END DESC, id) AS place FROM tl")
def w2_timeline_order(spark: SparkSession, d: str) -> DataFrame:
    """Every event's place in the timeline."""
    return S.numbered(_timeline(spark, d), "place", *S.timeline_order()).select("id", "place")


@query(f"WITH {_LINE} SELECT id, level FROM tl WHERE level IN ('L1', 'L2')")
def f12_featured(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).where(S.featured(F.col("level"))).select("id", "level")


@query(f"WITH {_LINE} SELECT id, date_key, level, score FROM tl WHERE origin = 'monitor' AND level IS NOT NULL AND date_diff('day', CAST(date_key AS DATE), DATE '2001-08-01') BETWEEN 0 AND 365 ORDER BY CASE level WHEN 'L1' THEN 3 WHEN 'L2' THEN 2 ELSE 1 END DESC, coalesce(score, 0) DESC, date_key DESC, id LIMIT 20")
def w3_hot_list(spark: SparkSession, d: str) -> DataFrame:
    return S.hot_list(_timeline(spark, d).where("origin = 'monitor'"), F.lit("2001-08-01").cast("date"), 365).select("id", "date_key", "level", "score")


@query(
    f"""WITH {_LINE}, a AS (SELECT id, date_key, level, score, date_diff('day', CAST(date_key AS DATE), DATE '2001-08-01') AS age FROM tl WHERE origin = 'monitor' AND level IS NOT NULL), c AS (SELECT least(5, count(*)) >= 3 AS enough FROM a WHERE age BETWEEN 0 AND 31)
SELECT id, level FROM a, c WHERE age BETWEEN 0 AND CASE WHEN enough THEN 31 ELSE 90 END ORDER BY CASE level WHEN 'L1' THEN 3 WHEN 'L2' THEN 2 ELSE 1 END DESC, coalesce(score, 0) DESC, date_key DESC, id LIMIT 5"""
)
def w4_hot_panel(spark: SparkSession, d: str) -> DataFrame:
    return S.widening(_timeline(spark, d).where("origin = 'monitor'"), F.lit("2001-08-01").cast("date")).select("id", "level")


@query(f"WITH {_LINE} SELECT id, title, CASE WHEN ends_with(date_key, '-00') THEN substr(date_key, 1, 8) || '01' ELSE date_key END AS day, 'https://example.com/items/' || id AS link FROM tl WHERE level IN ('L1', 'L2') ORDER BY date_key DESC, CASE level WHEN 'L1' THEN 3 ELSE 2 END DESC, id LIMIT 30")
def k5_feed_table(spark: SparkSession, d: str) -> DataFrame:
    """The newest thirty events of note; a month without a day becomes its first."""
    t = _timeline(spark, d).where("level in ('L1', 'L2')").orderBy(*S.timeline_order()).limit(30)
    return t.select("id", "title", F.regexp_replace("date_key", "-00$", "-01").alias("day"), F.concat(F.lit("https://example.com/items/"), "id").alias("link"))


@query(f"WITH {EVENTS} SELECT event_id, level, total, row_number() OVER (PARTITION BY company ORDER BY level_rank DESC, total DESC, strftime(occurred_at, '%Y-%m-%d') DESC, event_id) AS place FROM pub WHERE is_public")
def w1_ledger_order(spark: SparkSession, d: str) -> DataFrame:
    """Ledger order within each company."""
    from pyspark.sql import Window

    w = Window.partitionBy("company").orderBy(level_rank(F.col("level")).desc(), F.desc("total"), F.date_format("occurred_at", "yyyy-MM-dd").desc(), "event_id")
    e = dealt(A.ledger_events(spark, d).where(evidence.is_public()).select("event_id", "level", "total", "company", "occurred_at"), "company")
    return e.select("event_id", "level", "total", F.row_number().over(w).alias("place"))


@query(
    """WITH s AS (SELECT l_orderkey AS event_id, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS sources FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT '"' || o_orderkey || '","' || o_orderstatus || '","' || coalesce(sources, '') || '"' AS line FROM orders LEFT JOIN s ON event_id = o_orderkey WHERE o_orderpriority = '1-URGENT'"""
)
def k4_export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an export with their sources joined in one cell."""
    s = A.event_evidence(spark, d).join(A.table(spark, d, "supplier"), F.col("source_id") == F.col("s_suppkey")).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("s_name")), "; ").alias("sources"))
    o = A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(s, F.col("o_orderkey") == F.col("event_id"), "left")
    return o.select(csv_line(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("sources")).alias("line"))


@query(
    f"""WITH {EVENTS}, e AS (SELECT l_orderkey AS event_id, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS evidence, count(DISTINCT editorial_owner) AS owners FROM lineitem JOIN registry ON source_id = l_suppkey GROUP BY 1)
SELECT p.event_id, level, evidence, owners, level || '/' || evidence_confidence AS badge FROM pub p JOIN e USING (event_id) WHERE is_public"""
)
def r2_stories(spark: SparkSession, d: str) -> DataFrame:
    """Public stories with their evidence in order."""
    edges = A.event_evidence(spark, d).join(A.registry(spark, d).select("source_id", "editorial_owner"), "source_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_id"))), lambda x: x["source_id"].cast("string")), ",")
    e = edges.groupBy("event_id").agg(listed.alias("evidence"), F.count_distinct("editorial_owner").alias("owners"))
    return A.ledger_events(spark, d).where(evidence.is_public()).join(e, "event_id").select("event_id", "level", "evidence", "owners", F.concat_ws("/", "level", "evidence_confidence").alias("badge"))
