"""Queries of the evidence gate, scoring, review, release and the public report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.scoring import bands_of_score, importance, level_rank
from tallyloom.operators import evidence
from tallyloom.operators.surface import numbered
from tallyloom.plans.base import EVENTS, REGISTRY
from tallyloom.plans.registry import query
from tallyloom.session import dealt, looked_up
from tallyloom.sources import adapters as A


@query(f"WITH {EVENTS} SELECT event_id, evidence_confidence, sources FROM conf")
def e1_evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    edges = A.event_evidence(spark, d).join(A.registry(spark, d), "source_id").join(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type")), "event_id")
    return evidence.confidence(edges.withColumn("in_scope", F.col("scope") == F.substring("event_type", 1, 1)), "event_id")


@query(
    f"""WITH {REGISTRY}, cand AS (
  SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_partkey % 500 || '-' || l_returnflag AS fingerprint,
    CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS INT) % 3 END AS fact, tier, editorial_owner, scope = substr(l_shipdate::VARCHAR, 4, 1) AS in_scope
  FROM lineitem JOIN registry ON l_suppkey = source_id),
keyed AS (SELECT *, fingerprint || '|' || coalesce(CAST(fact AS VARCHAR), 'own:' || candidate_id) AS support FROM cand),
c AS (SELECT support, CASE WHEN max(CASE WHEN tier = 'authoritative' AND in_scope THEN 1 ELSE 0 END) = 1 THEN 'high'
    WHEN count(DISTINCT CASE WHEN tier = 'trusted' THEN editorial_owner END) >= 2 THEN 'medium' ELSE 'low' END AS evidence_confidence,
    count(DISTINCT editorial_owner) AS sources FROM keyed GROUP BY support)
SELECT candidate_id, evidence_confidence, sources FROM (SELECT DISTINCT candidate_id, support FROM keyed) JOIN c USING (support)"""
)
def e2_corroborate(spark: SparkSession, d: str) -> DataFrame:
    line = A.table(spark, d, "lineitem").join(A.registry(spark, d), F.col("l_suppkey") == F.col("source_id"))
    fact = F.when(F.col("l_linenumber") % 4 != 0, (F.col("l_quantity").cast("int") % 3).cast("string"))
    candidates = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), F.concat((F.col("l_partkey") % 500).cast("string"), F.lit("-"), "l_returnflag").alias("fingerprint"),
        fact.alias("material_hash"), "tier", "editorial_owner", (F.col("scope") == F.substring(F.col("l_shipdate").cast("string"), 4, 1)).alias("in_scope"),
    )
    return evidence.corroborated(candidates)


@query(
    f"""WITH {REGISTRY}, c AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'p' || l_partkey END AS fingerprint, l_shipdate AS shipped, tier, editorial_owner, scope = substr(l_shipdate::VARCHAR, 4, 1) AS in_scope FROM lineitem JOIN registry ON l_suppkey = source_id),
f AS (SELECT *, tier = 'trusted' AND row_number() OVER (PARTITION BY fingerprint, tier, editorial_owner ORDER BY shipped, candidate_id) = 1 AS one FROM c),
r AS (SELECT *, count(*) FILTER (WHERE one) OVER w AS owners, coalesce(bool_or(tier = 'authoritative' AND in_scope) OVER w, false) AS high FROM f WINDOW w AS (PARTITION BY fingerprint ORDER BY shipped, candidate_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT candidate_id, fingerprint, shipped, owners, CASE WHEN high THEN 'high' WHEN owners >= 2 THEN 'medium' ELSE 'low' END AS running_confidence FROM r)
SELECT candidate_id, owners, running_confidence, running_confidence <> 'low' AND coalesce(lag(running_confidence) OVER (PARTITION BY fingerprint ORDER BY shipped, candidate_id), 'low') = 'low' AS opens FROM s"""
)
def e2_running_support(spark: SparkSession, d: str) -> DataFrame:
    """The gate row by row: each candidate with the support set as of its place; a third of the rows share one fingerprint."""
    line = looked_up(A.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "source_id"), A.registry(spark, d).select("source_id", "tier", "editorial_owner", "scope"), "source_id")
    name = F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), name.alias("fingerprint"), F.col("l_shipdate").alias("at"), "tier", "editorial_owner", (F.col("scope") == F.substring(F.col("l_shipdate").cast("string"), 4, 1)).alias("in_scope"))
    return evidence.running_support(rows, "fingerprint", "at", "candidate_id").select("candidate_id", "owners", "running_confidence", "opens")


@query(f"WITH {EVENTS} SELECT event_id, relevance, impact, actionability, total, level FROM levelled")
def p6_importance(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger_events(spark, d).select("event_id", "relevance", "impact", "actionability", "total", "level")


@query(f"WITH {EVENTS} SELECT event_id, review_status, publication_state, is_public, is_public AND publication_state = 'first' AND level IN ('L1', 'L2') AS is_daily FROM pub")
def f8_public_flags(spark: SparkSession, d: str) -> DataFrame:
    e = A.ledger_events(spark, d)
    return e.select("event_id", "review_status", "publication_state", evidence.is_public().alias("is_public"), evidence.is_daily().alias("is_daily"))


@query(f"WITH {EVENTS} SELECT event_id, coalesce(level = 'L1', false) OR event_type = '1-URGENT' AS high_risk FROM ledger")
def f9_high_risk(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger_events(spark, d).select("event_id", evidence.high_risk(F.col("level"), F.col("event_type"), ("1-URGENT",)).alias("high_risk"))


@query(
    """WITH r AS (SELECT conv_id AS event_id, turn AS rev_no, sha256(text) AS fact_hash FROM conversations),
l AS (SELECT *, lag(fact_hash) OVER w AS before, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY event_id ORDER BY rev_no))
SELECT event_id, rev_no, CASE WHEN n = 1 THEN 'first' WHEN before IS NOT DISTINCT FROM fact_hash THEN 'duplicate' ELSE 'update' END AS state FROM l"""
)
def e4_publication_state(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations").select(F.col("conv_id").alias("event_id"), F.col("turn").alias("rev_no"), F.sha2("text", 256).alias("fact_hash"))
    return evidence.changed_revisions(c).select("event_id", "rev_no", "state")


@query(
    f"""WITH {EVENTS}, dec AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 7 = 0 THEN 'reject' ELSE 'approve' END AS decision FROM orders WHERE o_orderkey % 3 = 0)
SELECT e.event_id, CASE WHEN d.decision = 'reject' THEN 'rejected' WHEN d.decision = 'approve' AND review_status = 'pending' THEN 'approved' ELSE review_status END AS review_status
FROM ledger e LEFT JOIN dec d USING (event_id)"""
)
def e6_manual_review(spark: SparkSession, d: str) -> DataFrame:
    e = A.ledger_events(spark, d).withColumn("legacy_ids", F.array(F.concat(F.lit("old-"), F.col("event_id").cast("string"))))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.lit("old-"), F.col("o_orderkey").cast("string")))
    decisions = A.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(name.alias("event_id"), F.when(F.col("o_orderkey") % 7 == 0, "reject").otherwise("approve").alias("decision"))
    return evidence.manual_review(e, decisions)[0].select("event_id", "review_status")


@query(
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '1999-01-01' WHEN is_public THEN TIMESTAMP '2000-06-01' END AS released_at,
(event_id % 10 = 0 OR is_public) AND publication_state = 'first' AS current FROM pub"""
)
def e7_release(spark: SparkSession, d: str) -> DataFrame:
    e = A.ledger_events(spark, d).withColumn("released_at", F.when(F.col("event_id") % 10 == 0, F.lit("1999-01-01").cast("timestamp")))
    out = evidence.release(e, True, F.lit("2000-06-01").cast("timestamp"))
    issue = evidence.current_issue(out).withColumn("current", F.lit(True))
    return out.join(issue, "event_id", "left").select("event_id", F.col("released_at").cast("timestamp_ntz").alias("released_at"), F.coalesce("current", F.lit(False)).alias("current"))


@query(
    f"""WITH {EVENTS}, s AS (SELECT event_id, company, event_type, level, total, is_public,
  row_number() OVER (ORDER BY level_rank DESC, total DESC, strftime(occurred_at, '%Y-%m-%d') DESC, event_id) AS rank,
  strftime(occurred_at, '%Y-%m-%d') AS day FROM pub WHERE is_public AND strftime(occurred_at, '%Y-%m-%d') >= '2001-01-01')
SELECT event_id, company, event_type, level, total, day, rank FROM s"""
)
def r1_hot_view(spark: SparkSession, d: str) -> DataFrame:
    """The hot view of the public report: public events since a day, in ledger order."""
    e = A.ledger_events(spark, d).where(evidence.is_public()).withColumn("day", F.date_format("occurred_at", "yyyy-MM-dd")).where("day >= '2001-01-01'")
    order = [level_rank(F.col("level")).desc(), F.desc("total"), F.desc("day"), F.asc("event_id")]
    return numbered(e.select("event_id", "company", "event_type", "level", "total", "day"), "rank", *order)


@query(
    f"""WITH {EVENTS}, v AS (SELECT event_id, 'daily' AS view FROM pub WHERE is_public AND publication_state = 'first' AND level IN ('L1', 'L2') AND occurred_at >= TIMESTAMP '2001-07-01'
UNION ALL SELECT event_id, 'hot' FROM pub WHERE is_public AND occurred_at >= TIMESTAMP '2001-01-01'
UNION ALL SELECT event_id, 'all' FROM pub WHERE is_public) SELECT view, count(*) AS n, min(event_id) AS first_id FROM v GROUP BY view
UNION ALL SELECT 'held', count(*) FILTER (WHERE NOT is_public), min(event_id) FILTER (WHERE NOT is_public) FROM pub"""
)
def r1_project_report(spark: SparkSession, d: str) -> DataFrame:
    """The report's views and the events that are held back, as counts: one scan, rows exploded to their views."""
    day = F.col("occurred_at")
    views = F.array_compact(F.array(
        F.when(evidence.is_daily() & (day >= F.lit("2001-07-01")), "daily"), F.when(evidence.is_public() & (day >= F.lit("2001-01-01")), "hot"),
        F.when(evidence.is_public(), "all"), F.when(~F.coalesce(evidence.is_public(), F.lit(False)), "held"),
    ))
    return A.ledger_events(spark, d).select("event_id", F.explode(views).alias("view")).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    f"""WITH {EVENTS}, cats AS (SELECT unnest(['F', 'O', 'P', 'X']) AS category), days AS (SELECT DISTINCT strftime(occurred_at, '%Y-%m-%d') AS day FROM ledger WHERE occurred_at >= TIMESTAMP '2001-06-01'),
n AS (SELECT status AS category, strftime(occurred_at, '%Y-%m-%d') AS day, count(*) AS n FROM ledger GROUP BY ALL)
SELECT day, category, coalesce(n, 0) AS n FROM days CROSS JOIN cats LEFT JOIN n USING (day, category)"""
)
def g4_daily_categories(spark: SparkSession, d: str) -> DataFrame:
    """Counts per day over a fixed list of categories; zeros stay."""
    o = A.table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-06-01")).select(F.col("o_orderstatus").alias("category"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    n = o.groupBy("day", "category").agg(F.count(F.lit(1)).alias("n"))
    grid = o.select("day").distinct().select("day", F.explode(F.array(*[F.lit(c) for c in "FOPX"])).alias("category"))
    return grid.join(n, ["day", "category"], "left").na.fill(0, ["n"])


@query(
    f"""WITH {EVENTS} SELECT event_type, count(*) AS events, count(*) FILTER (WHERE publication_state = 'first') AS first_events,
count(*) FILTER (WHERE publication_state = 'backfill') AS backfill, count(*) FILTER (WHERE review_status = 'pending') AS review_backlog,
count(*) FILTER (WHERE level = 'L1') AS l1, count(DISTINCT company) AS companies, sum(sources) AS source_links FROM pub GROUP BY event_type"""
)
def g5_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    # companies are told apart by a sum for each of them, whose tasks grow in number with the tables
    one = dealt(A.ledger_events(spark, d), "event_type", "company").groupBy("event_type", "company").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("publication_state") == "first").alias("first_events"), F.count_if(F.col("publication_state") == "backfill").alias("backfill"),
        F.count_if(F.col("review_status") == "pending").alias("review_backlog"), F.count_if(F.col("level") == "L1").alias("l1"), F.sum("sources").alias("source_links"),
    )
    return one.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("events", "first_events", "backfill", "review_backlog", "l1")], F.count("company").alias("companies"), F.sum("source_links").alias("source_links"))


@query(
    """WITH s AS (SELECT o_orderkey AS event_id, CAST(o_totalprice / 5000 AS INT) AS score FROM orders),
b AS (SELECT event_id, score, CASE WHEN score >= 60 THEN 30 WHEN score >= 40 THEN 20 ELSE 10 END AS relevance,
CASE WHEN score >= 95 THEN 50 WHEN score >= 80 THEN 40 WHEN score >= 60 THEN 30 ELSE 15 END AS impact,
CASE WHEN score >= 90 THEN 20 WHEN score >= 80 THEN 10 WHEN score >= 70 THEN 10 WHEN score >= 60 THEN 0 WHEN score >= 40 THEN 10 ELSE 0 END AS actionability FROM s)
SELECT *, relevance + impact + actionability AS total, CASE WHEN relevance + impact + actionability >= 80 THEN 'L1' WHEN relevance + impact + actionability >= 60 THEN 'L2' WHEN relevance + impact + actionability >= 40 THEN 'L3' END AS level FROM b"""
)
def e14_legacy_import(spark: SparkSession, d: str) -> DataFrame:
    """Old scores as importance bands; a score halfway between two whole ones goes to the even one, as the SQL's cast does."""
    s = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.rint(F.col("o_totalprice") / 5000).cast("int").alias("score"))
    return importance(s.select("event_id", "score", bands_of_score(F.col("score")).alias("b")).select("event_id", "score", "b.*"))


@query(
    """WITH q AS (SELECT l_orderkey AS event_id, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, 'no_evidence' AS rule FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM q)
UNION ALL SELECT o_orderkey, 'price_not_positive' FROM orders WHERE o_totalprice <= 0
UNION ALL SELECT o_orderkey, 'open_but_old' FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01'"""
)
def q7_event_rules(spark: SparkSession, d: str) -> DataFrame:
    """Violations of rules on single events and on their evidence."""
    o = A.table(spark, d, "orders")
    rules = F.array_compact(F.array(F.when(F.col("o_totalprice") <= 0, "price_not_positive"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01")), "open_but_old")))
    own = o.select(F.col("o_orderkey").alias("event_id"), F.explode(rules).alias("rule"))
    bare = o.select(F.col("o_orderkey").alias("event_id")).join(A.event_evidence(spark, d), "event_id", "left_anti").withColumn("rule", F.lit("no_evidence"))
    return bare.unionByName(own)


