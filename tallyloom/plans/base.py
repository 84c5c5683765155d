"""The adapters in SQL, shared by the statements of several queries."""

REGISTRY = """registry AS (
  SELECT s_suppkey AS source_id, s_nationkey AS editorial_owner,
    CASE s_suppkey % 3 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'trusted' ELSE 'discovery' END AS tier,
    CAST(s_suppkey % 5 + 1 AS VARCHAR) AS scope, 'source' || s_suppkey || '.example.com' AS host,
    s_suppkey % 4 <> 0 AS enabled, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7 + 1) * 6.0 END AS poll_interval_hours
  FROM supplier)"""

EVENTS = (
    REGISTRY
    + """,
scored AS (
  SELECT o_orderkey AS event_id, o_custkey AS company, o_orderpriority AS event_type, o_orderdate AS occurred_at, o_orderstatus AS status,
    o_totalprice AS price, CAST(10 * (o_custkey % 4) AS INT) AS relevance,
    CAST(CASE o_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 30 WHEN 3 THEN 40 ELSE 50 END AS INT) AS impact,
    CAST(10 * (o_orderkey % 3) AS INT) AS actionability FROM orders),
levelled AS (
  SELECT *, relevance + impact + actionability AS total,
    CASE WHEN relevance + impact + actionability >= 80 THEN 'L1' WHEN relevance + impact + actionability >= 60 THEN 'L2'
         WHEN relevance + impact + actionability >= 40 THEN 'L3' END AS level FROM scored),
conf AS (
  SELECT l_orderkey AS event_id,
    CASE WHEN max(CASE WHEN tier = 'authoritative' AND scope = substr(event_type, 1, 1) THEN 1 ELSE 0 END) = 1 THEN 'high'
         WHEN count(DISTINCT CASE WHEN tier = 'trusted' THEN editorial_owner END) >= 2 THEN 'medium' ELSE 'low' END AS evidence_confidence,
    count(DISTINCT editorial_owner) AS sources
  FROM lineitem JOIN registry ON l_suppkey = source_id JOIN scored ON l_orderkey = event_id GROUP BY l_orderkey),
ledger AS (
  SELECT l.*, coalesce(c.evidence_confidence, 'low') AS evidence_confidence, coalesce(c.sources, 0) AS sources,
    CASE WHEN NOT (coalesce(level = 'L1', false) OR event_type = '1-URGENT') THEN 'not_required'
         WHEN status = 'F' THEN 'approved' ELSE 'pending' END AS review_status,
    CASE WHEN occurred_at < TIMESTAMP '1998-01-01' THEN 'backfill' ELSE 'first' END AS publication_state
  FROM levelled l LEFT JOIN conf c USING (event_id)),
pub AS (SELECT *, evidence_confidence <> 'low' AND level IS NOT NULL AND review_status IN ('approved', 'not_required') AS is_public,
    CASE level WHEN 'L1' THEN 3 WHEN 'L2' THEN 2 WHEN 'L3' THEN 1 ELSE 0 END AS level_rank FROM ledger)"""
)
