"""Queries of resolution, adjudication, acceptance, set operations and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import adjudicate, health, resolve
from tallyloom.operators.surface import numbered
from tallyloom.plans.base import EVENTS, REGISTRY
from tallyloom.plans.registry import query
from tallyloom.sources import adapters as A

#: Discovery queries that a configuration may hold.
TASKS = 1_000

_KEYS = """ck AS (
  SELECT l_orderkey * 10 + l_linenumber AS candidate_id, 'evidence' AS kind, 'p' || l_partkey AS key FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'url', 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'fingerprint', 'o' || l_orderkey % 1000 FROM lineitem),
ek AS (
  SELECT o_orderkey AS event_id, o_orderkey AS event_ord, 'evidence' AS kind, 'p' || o_custkey * 3 AS key FROM orders
  UNION ALL SELECT o_orderkey, o_orderkey, 'url', 's' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, o_orderkey, 'fingerprint', 'o' || o_orderkey % 2000 FROM orders)"""


@query(
    f"""WITH {_KEYS}, h AS (SELECT candidate_id, event_id, CASE kind WHEN 'evidence' THEN 1 WHEN 'url' THEN 2 WHEN 'fingerprint' THEN 4 END AS rank, kind, event_ord FROM ck JOIN ek USING (kind, key)),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY rank, event_ord) AS n FROM h)
SELECT candidate_id, event_id, kind AS tier FROM r WHERE n = 1"""
)
def j1_resolve_event(spark: SparkSession, d: str) -> DataFrame:
    line, orders = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    own = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    ck = line.select(own, F.explode(F.array_compact(F.array(
        F.when(F.col("l_returnflag") == "A", pair("evidence", name("p", F.col("l_partkey")))), F.when(F.col("l_returnflag") == "R", pair("url", name("s", F.col("l_suppkey")))),
        pair("fingerprint", name("o", F.col("l_orderkey") % 1000))))).alias("k")).select("candidate_id", "k.*")
    ek = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("event_ord"), F.explode(F.array_compact(F.array(
        pair("evidence", name("p", F.col("o_custkey") * 3)), F.when(F.col("o_orderpriority") == "1-URGENT", pair("url", name("s", F.col("o_custkey")))),
        pair("fingerprint", name("o", F.col("o_orderkey") % 2000))))).alias("k")).select("event_id", "event_ord", "k.*")
    return resolve.resolve_events(ck, ek)


@query(
    f"""WITH {EVENTS}, c AS (SELECT o_orderkey AS candidate_id, o_custkey AS company, o_orderstatus AS product, o_orderpriority AS event_type, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 5 = 0),
e AS (SELECT event_id, company, status AS product, event_type, CAST(occurred_at AS DATE) AS day, level_rank, total FROM pub WHERE event_id % 5 <> 0),
m AS (SELECT candidate_id, event_id, row_number() OVER (PARTITION BY candidate_id ORDER BY level_rank DESC, total DESC, e.day DESC, event_id) AS rank
  FROM c JOIN e ON c.company = e.company AND (c.product = e.product OR c.event_type = e.event_type) AND abs(date_diff('day', c.day, e.day)) <= 45)
SELECT * FROM m WHERE rank <= 8"""
)
def j2_recall_events(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.functions.scoring import level_rank

    o = A.table(spark, d, "orders").where("o_orderkey % 5 = 0")
    c = o.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("product"), F.col("o_orderpriority").alias("event_type"), F.to_date("o_orderdate").alias("day"))
    e = A.ledger_events(spark, d).where("event_id % 5 <> 0").select("event_id", "company", F.col("status").alias("product"), "event_type", F.to_date("occurred_at").alias("day"), level_rank(F.col("level")).alias("level_rank"), "total")
    return resolve.recall_events(c, e)


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query(
    f"""WITH u AS (SELECT page_id AS url_id, {_HOST} AS host FROM pages), reg AS (SELECT row_number() OVER (ORDER BY h) AS source_id, h AS r_host,
  CASE (row_number() OVER (ORDER BY h)) % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS t FROM (SELECT DISTINCT regexp_replace(host, '^(m|blog)\\.', '') AS h FROM u)),
m AS (SELECT url_id, host, source_id, t, row_number() OVER (PARTITION BY url_id ORDER BY t DESC NULLS LAST, source_id) AS n FROM u LEFT JOIN reg ON host = r_host OR ends_with(host, '.' || r_host) OR ends_with(r_host, '.' || host))
SELECT url_id, host, source_id, CASE t WHEN 3 THEN 'authoritative' WHEN 2 THEN 'trusted' ELSE 'discovery' END AS tier FROM m WHERE n = 1"""
)
def j3_attach_source(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    urls = A.table(spark, d, "pages").select(F.col("page_id").alias("url_id"), host.alias("host"))
    names = urls.select(F.regexp_replace("host", r"^(m|blog)\.", "").alias("host")).distinct()
    reg = numbered(names, "source_id", F.asc("host"))
    reg = reg.withColumn("tier", F.when(F.col("source_id") % 3 == 0, "authoritative").when(F.col("source_id") % 3 == 1, "trusted").otherwise("discovery"))
    return resolve.attach_sources(urls, reg)


@query(
    """WITH h AS (SELECT doc_id, sha256(trim(text, ' ')) AS k FROM documents), kn AS (SELECT sha256(trim(text, ' ')) AS k FROM benchmark UNION SELECT k FROM h WHERE doc_id % 3 = 0)
SELECT doc_id FROM h WHERE k NOT IN (SELECT k FROM kn)"""
)
def j4_known_anti_join(spark: SparkSession, d: str) -> DataFrame:
    h = A.table(spark, d, "documents").select("doc_id", F.sha2(F.trim("text"), 256).alias("k"))
    known = A.table(spark, d, "benchmark").select(F.sha2(F.trim("text"), 256).alias("k")).union(h.where("doc_id % 3 = 0").select("k"))
    return resolve.unknown(h, known, "k").select("doc_id")


@query(
    """WITH own AS (SELECT l_partkey AS evidence_id, min(l_orderkey) AS event_id FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
rev AS (SELECT l_orderkey AS event_id, max(l_linenumber) AS rev_no, max_by(l_shipdate, l_linenumber * 1000000 + l_partkey) AS d FROM lineitem GROUP BY 1)
SELECT p_partkey AS candidate_id, o.event_id, o_orderpriority AS event_type, rev_no FROM part JOIN own o ON p_partkey = evidence_id JOIN orders ON o_orderkey = o.event_id LEFT JOIN rev r ON r.event_id = o.event_id"""
)
def j5_evidence_shortcut(spark: SparkSession, d: str) -> DataFrame:
    line = A.table(spark, d, "lineitem")
    edges = line.where("l_linenumber = 1").select(F.col("l_partkey").alias("evidence_id"), F.col("l_orderkey").alias("event_id"))
    rev = line.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("rev_no"), F.col("l_shipdate").alias("facts"))
    c = A.table(spark, d, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_partkey").alias("evidence_id"))
    events = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"))
    return resolve.shortcut(c, edges, events, rev).select("candidate_id", "event_id", "event_type", "rev_no")


@query(
    """WITH f AS (SELECT o_orderkey AS event_id, unnest([o_custkey % 120 + 1, o_orderkey % 7 + 1, 9999]) AS source_id, unnest([0, 1, 2]) AS pos FROM orders)
SELECT event_id, string_agg(s_name, ';' ORDER BY pos) AS titles FROM f JOIN supplier ON s_suppkey = source_id GROUP BY 1"""
)
def j6_resolve_sources(spark: SparkSession, d: str) -> DataFrame:
    frame = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.array(F.col("o_custkey") % 120 + 1, F.col("o_orderkey") % 7 + 1, F.lit(9999).cast("bigint")).alias("ids"))
    sources = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("title"))
    return resolve.ordered_sources(frame, "ids", sources, "event_id").select("event_id", F.array_join("titles", ";").alias("titles"))


@query(
    """WITH c AS (SELECT DISTINCT 'line' AS kind, l_orderkey AS obj, l_suppkey AS source_id FROM lineitem UNION ALL SELECT DISTINCT 'order', o_orderkey, o_custkey % 50 FROM orders UNION ALL SELECT DISTINCT 'part', p_partkey, p_size FROM part)
SELECT source_id, count(*) FILTER (WHERE kind = 'line') AS line, count(*) FILTER (WHERE kind = 'order') AS "order", count(*) FILTER (WHERE kind = 'part') AS part FROM c GROUP BY 1"""
)
def j7_citations(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("obj"), F.col("l_suppkey").alias("source_id")).distinct()
    c = c.unionByName(A.table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("obj"), (F.col("o_custkey") % 50).alias("source_id")).distinct())
    c = c.unionByName(A.table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("obj"), F.col("p_size").cast("bigint").alias("source_id")).distinct())
    return c.groupBy("source_id").pivot("kind", ["line", "order", "part"]).count().na.fill(0)


@query("SELECT o_orderkey AS event_id, o_orderdate AS day FROM orders o WHERE NOT (o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM orders m WHERE m.o_orderstatus = 'F' AND m.o_custkey = o.o_custkey AND date_trunc('month', m.o_orderdate) = date_trunc('month', o.o_orderdate)))")
def j9_archive_override(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows go where a curated row of the same company and month exists; other rows stay."""
    o = A.table(spark, d, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    curated = o.where("o_orderstatus = 'F'").select("o_custkey", "m").distinct()
    derived = o.where("o_orderstatus = 'O'").join(curated, ["o_custkey", "m"], "left_anti")
    cols = [F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("day")]
    return derived.select(*cols).unionByName(o.where("o_orderstatus <> 'O'").select(*cols))


@query(f"WITH {REGISTRY} SELECT n_name || ' ' || r_name AS task, source_id FROM (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) CROSS JOIN (SELECT source_id FROM registry WHERE NOT enabled)")
def j10_manual_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Each discovery query for each manual source: the query list is configuration; beyond TASKS of them it is refused."""
    q = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(" ", "n_name", "r_name").alias("task"))
    tasks = [r.task for r in q.limit(TASKS + 1).collect()]
    if len(tasks) > TASKS:
        raise ValueError(f"more than {TASKS} discovery queries")
    return A.registry(spark, d).where("not enabled").select(F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"), "source_id")


@query(
    """WITH p AS (SELECT l_partkey AS product, l_shipdate AS pos, l_orderkey AS o, l_quantity AS sens, l_returnflag AS design FROM lineitem),
g AS (SELECT product, count(*) AS points, min_by(sens, (pos, o, sens)) FILTER (WHERE design = 'A') AS first_case, max_by(sens, (pos, o, sens)) FILTER (WHERE design = 'N') AS last_ahead FROM p GROUP BY 1)
SELECT product, points, first_case, last_ahead, first_case - last_ahead AS gap FROM g WHERE points >= 2 AND first_case IS NOT NULL AND last_ahead IS NOT NULL"""
)
def j11_lineage_gap(spark: SparkSession, d: str) -> DataFrame:
    """First reading of one design against the last of another, for each product with two readings."""
    p = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product"), F.struct("l_shipdate", "l_orderkey", "l_quantity").alias("at"), F.col("l_quantity").alias("sens"), F.col("l_returnflag").alias("design"))
    only = lambda x: F.when(F.col("design") == x, F.col("at"))
    g = p.groupBy("product").agg(F.count(F.lit(1)).alias("points"), F.min(only("A")).alias("a"), F.max(only("N")).alias("b"))
    g = g.where((F.col("points") >= 2) & F.col("a").isNotNull() & F.col("b").isNotNull())
    return g.select("product", "points", F.col("a.l_quantity").alias("first_case"), F.col("b.l_quantity").alias("last_ahead"), (F.col("a.l_quantity") - F.col("b.l_quantity")).alias("gap"))


@query("WITH r AS (SELECT a.o_orderkey AS event_id, b.o_orderkey AS other, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey) AS rank FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey) SELECT * FROM r WHERE rank <= 5")
def j13_related_events(spark: SparkSession, d: str) -> DataFrame:
    """Five other events of the same company, latest first. Each company's latest six are found first, so that no company's events all meet."""
    from pyspark.sql import Window

    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    top = o.withColumn("n", F.row_number().over(newest)).where("n <= 6").select("o_custkey", F.col("o_orderkey").alias("other"), "n")
    own = Window.partitionBy("event_id").orderBy("n")
    pairs = o.select(F.col("o_orderkey").alias("event_id"), "o_custkey").join(top, "o_custkey").where("event_id <> other")
    return pairs.withColumn("rank", F.row_number().over(own).cast("bigint")).where("rank <= 5").select("event_id", "other", "rank")


@query(
    """WITH p AS (SELECT doc_id, n_chars >= 400 AS pos FROM documents), j AS (SELECT l.doc_id, quality = 1 AS gold, pos FROM labels l JOIN p USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE gold AND pos) AS tp, count(*) FILTER (WHERE NOT gold AND pos) AS fp, count(*) FILTER (WHERE gold AND NOT pos) AS fn, count(*) FILTER (WHERE NOT gold AND NOT pos) AS tn FROM j)
SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp / (tp + fp) >= 0.98 AND tp / (tp + fn) >= 0.95 AS passed FROM c"""
)
def e12_acceptance(spark: SparkSession, d: str) -> DataFrame:
    pred = A.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") >= 400).alias("predicted"))
    gold = A.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("gold"))
    return adjudicate.acceptance(pred, gold)


@query(
    """WITH a AS (SELECT doc_id AS item_id, quality AS v FROM labels), b AS (SELECT doc_id AS item_id, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS v FROM documents WHERE doc_id % 4 <> 0), c AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' END AS pick FROM documents)
SELECT item_id, CASE WHEN a.v = b.v THEN 'agreed' WHEN a.v IS NULL OR b.v IS NULL THEN 'single' WHEN pick IS NULL THEN 'pending' ELSE 'arbiter' END AS outcome,
CASE WHEN a.v = b.v THEN a.v WHEN a.v IS NULL OR b.v IS NULL THEN NULL WHEN pick = 'A' THEN a.v WHEN pick = 'B' THEN b.v END AS value
FROM a FULL JOIN b USING (item_id) LEFT JOIN c USING (item_id)"""
)
def e8_adjudicate(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    a = A.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("value"))
    b = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") >= 400).cast("int").alias("value"))
    c = docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "B").alias("selected"))
    return adjudicate.adjudicated(a, b, c)


_JUDGED = """WITH o AS (SELECT o_orderkey AS item_id, ['extraction', 'importance', 'match'][1 + o_orderkey % 3] AS task, * FROM orders),
j AS (SELECT item_id, task, 'Firm ' || o_custkey % 9 || ' Inc.' AS a_company, CASE WHEN item_id % 5 = 0 THEN 'Firm ' || o_custkey % 8 ELSE 'FIRM-' || o_custkey % 9 END AS b_company, strftime(o_orderdate, '%Y-%m-%d') || 'T09:00' AS a_day,
  CASE WHEN item_id % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS b_day, (o_custkey % 4)::INT AS a_band, (CASE WHEN item_id % 4 = 0 THEN 3 ELSE o_custkey % 4 END)::INT AS b_band,
  CASE WHEN item_id % 8 < 4 THEN 'different_event' ELSE 'same_event' END AS a_rel, CASE WHEN item_id % 8 < 5 THEN 'different_event' ELSE 'same_event' END AS b_rel,
  CASE WHEN item_id % 8 >= 4 OR item_id % 11 = 0 THEN o_custkey END AS a_ev, CASE WHEN item_id % 8 >= 5 THEN o_custkey END AS b_ev,
  item_id % 13 <> 0 AS has_b, CASE item_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'pending' END AS pick FROM o),
e AS (SELECT *, CASE task WHEN 'extraction' THEN regexp_replace(a_company, '[^0-9]', '', 'g') = regexp_replace(b_company, '[^0-9]', '', 'g') AND left(a_day, 10) IS NOT DISTINCT FROM b_day
  WHEN 'importance' THEN a_band = b_band ELSE a_rel = b_rel AND a_ev IS NOT DISTINCT FROM b_ev END AS agreed FROM j),
c AS (SELECT *, CASE WHEN NOT has_b THEN 'single' WHEN agreed THEN 'agreed' WHEN pick IN ('A', 'B') THEN 'arbiter' ELSE 'pending' END AS first, CASE WHEN NOT has_b THEN NULL WHEN agreed THEN 'A' WHEN pick IN ('A', 'B') THEN pick END AS chosen FROM e),
v AS (SELECT *, CASE chosen WHEN 'A' THEN a_rel WHEN 'B' THEN b_rel END AS rel, CASE chosen WHEN 'A' THEN a_ev WHEN 'B' THEN b_ev END AS ev FROM c)"""


@query(
    f"""{_JUDGED}, k AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT *, task = 'match' AND chosen IS NOT NULL AND NOT CASE WHEN rel = 'different_event' THEN ev IS NULL ELSE ev IN (SELECT c_custkey FROM k) END AS refused FROM v)
SELECT item_id, task, CASE WHEN refused THEN 'pending' ELSE first END AS outcome, CASE WHEN NOT refused THEN CASE chosen WHEN 'A' THEN a_company WHEN 'B' THEN b_company END END AS company, CASE WHEN NOT refused THEN ev END AS event_id FROM r"""
)
def e8_adjudicate_by_task(spark: SparkSession, d: str) -> DataFrame:
    """Two judgements of each item, compared by its task's rules; the arbiter decides, and a match stands only if it names a known event."""
    o, key = A.table(spark, d, "orders"), F.col("o_orderkey")
    task = F.element_at(F.array(F.lit("extraction"), F.lit("importance"), F.lit("match")), (key % 3 + 1).cast("int"))
    text = lambda prefix, c, end="": F.concat(F.lit(prefix), c.cast("string"), F.lit(end))
    day, nothing = F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string")
    band = lambda c: [c.cast("int").alias("relevance"), F.lit(1).alias("impact"), F.lit(2).alias("actionability")]
    rest = [F.lit("p").alias("product"), F.lit("approval").alias("event_type"), nothing.alias("published_at")]
    relation = lambda n: F.when(key % 8 < n, "different_event").otherwise("same_event").alias("relation")
    a = F.struct(text("Firm ", F.col("o_custkey") % 9, " Inc.").alias("company"), *rest, F.concat(day, F.lit("T09:00")).alias("occurred_at"), *band(F.col("o_custkey") % 4), relation(4), F.when((key % 8 >= 4) | (key % 11 == 0), F.col("o_custkey")).alias("event_id"))
    b = F.struct(
        F.when(key % 5 == 0, text("Firm ", F.col("o_custkey") % 8)).otherwise(text("FIRM-", F.col("o_custkey") % 9)).alias("company"), *rest, F.when(key % 7 != 0, day).alias("occurred_at"),
        *band(F.when(key % 4 == 0, 3).otherwise(F.col("o_custkey") % 4)), relation(5), F.when(key % 8 >= 5, F.col("o_custkey")).alias("event_id"),
    )
    judged = lambda rows, x: rows.select(key.alias("item_id"), task.alias("task"), x.alias("judgement"))
    pick = o.select(key.alias("item_id"), task.alias("task"), F.when(key % 4 == 0, "A").when(key % 4 == 1, "B").when(key % 4 == 2, "pending").alias("selected"))
    known = A.table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("event_id"))
    out = adjudicate.adjudicated_by_task(judged(o, a), judged(o.where(key % 13 != 0), b), pick, known)
    return out.select("item_id", "task", "outcome", F.col("judgement.company").alias("company"), F.col("judgement.event_id").alias("event_id"))


@query(
    """WITH r AS (SELECT o_orderkey AS candidate_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 6 < 5),
h AS (SELECT o_orderkey AS candidate_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + least(500, (SELECT count(*) FROM r)) AS n FROM orders WHERE o_orderstatus <> 'O')
SELECT candidate_id, true AS replayed, CASE WHEN n <= 500 THEN n END AS place FROM r UNION ALL SELECT candidate_id, false, n FROM h"""
)
def s11_replay_before_hits(spark: SparkSession, d: str) -> DataFrame:
    """A run's queue: at most 500 candidates that are tried again, then the new hits; further retries wait."""
    o = A.table(spark, d, "orders").withColumns({"candidate_id": F.col("o_orderkey"), "seq": F.col("o_orderdate")})
    waiting = o.where("o_orderstatus = 'O'").withColumns({"retry_count": F.col("o_orderkey") % 6, "status": F.lit("pending"), "stage": F.col("o_orderpriority"), "has_payload": F.lit(True)})
    retries = waiting.where(adjudicate.retry_fate(("1-URGENT", "2-HIGH")) == "retry")
    return adjudicate.replay_first(retries.select("candidate_id", "seq"), o.where("o_orderstatus <> 'O'").select("candidate_id", "seq"))


@query(
    """WITH s AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7 + 1) * 6 END AS h FROM supplier),
r AS (SELECT user_id + 1 AS source_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_success FROM events GROUP BY 1)
SELECT source_id, h IS NULL OR last_success IS NULL OR TIMESTAMP '2024-01-31' >= last_success + to_hours(h) AS due FROM s LEFT JOIN r USING (source_id)"""
)
def s9_source_freshness(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select((F.col("user_id") + 1).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return health.freshness(A.registry(spark, d), runs, F.lit("2024-01-31").cast("timestamp")).select("source_id", "due")


@query(
    """WITH o AS (SELECT user_id AS source_id, ts, event_id, event_type = 'error' AS failed FROM events), g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS grp FROM o),
l AS (SELECT source_id, max(ts) FILTER (WHERE NOT failed) AS last_success, max(grp) AS last_grp FROM g GROUP BY 1)
SELECT l.source_id, last_success, count(*) FILTER (WHERE failed AND g.grp = l.last_grp) AS consecutive_failures, min(ts) FILTER (WHERE failed AND g.grp = l.last_grp) AS first_failure_at
FROM g JOIN l USING (source_id) GROUP BY 1, 2"""
)
def w12_source_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return health.run_state(runs).select("source_id", "last_success", "consecutive_failures", "first_failure_at")


@query(
    """WITH s AS (SELECT s_suppkey AS source_id, s_suppkey % 4 <> 0 AS enabled FROM supplier), o AS (SELECT user_id AS source_id, ts, event_id, event_type = 'error' AS failed FROM events),
g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS grp FROM o), l AS (SELECT source_id, max(grp) AS lg FROM g GROUP BY 1),
c AS (SELECT g.source_id, count(*) FILTER (WHERE failed AND grp = lg) AS f FROM g JOIN l USING (source_id) GROUP BY 1)
SELECT source_id, enabled, CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 3 THEN 'failed' WHEN f > 0 THEN 'degraded' ELSE 'healthy' END AS health, enabled AND coalesce(f, 0) >= 3 AS gap FROM s LEFT JOIN c USING (source_id)"""
)
def r7_system_status(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return health.status(A.registry(spark, d), health.run_state(runs)).select("source_id", "enabled", "health", "gap")


@query(
    """WITH l AS (SELECT l_suppkey AS source_id, l_linenumber * 1000000 + l_orderkey AS position, 'u' || l_partkey AS url FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position, url) AS n FROM l),
k AS (SELECT 'u' || p_partkey AS url FROM part WHERE p_size < 15), b AS (SELECT source_id, position, url, row_number() OVER (PARTITION BY source_id ORDER BY position, url) AS m FROM a WHERE n <= 12 AND url NOT IN (SELECT url FROM k))
SELECT source_id, position, url FROM b WHERE m <= 8"""
)
def s8_select_new(spark: SparkSession, d: str) -> DataFrame:
    links = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_linenumber") * 1000000 + F.col("l_orderkey")).alias("position"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"))
    known = A.table(spark, d, "part").where("p_size < 15").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"))
    return resolve.select_new(links, known).select("source_id", "position", "url")


@query(
    """SELECT o_orderkey AS candidate_id, o_orderkey % 6 AS retry_count, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 6 >= 5 THEN 'stalled' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'retry' ELSE 'kept' END AS fate FROM orders WHERE o_orderstatus = 'O'"""
)
def s11_retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """Pending candidates to replay, and those that have used up their attempts."""
    o = A.table(spark, d, "orders").where("o_orderstatus = 'O'")
    c = o.select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderkey") % 6).alias("retry_count"), F.lit("pending").alias("status"), F.col("o_orderpriority").alias("stage"), F.lit(True).alias("has_payload"))
    return c.select("candidate_id", "retry_count", adjudicate.retry_fate(("1-URGENT", "2-HIGH")).alias("fate"))


@query(
    """WITH c AS (SELECT o_orderkey AS candidate_id, o_orderkey % 4 AS n, 'pending' AS state FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT o_orderkey AS candidate_id, o_orderstatus <> 'P' AS counts FROM orders WHERE o_orderkey % 3 = 0)
SELECT candidate_id, coalesce(n, 0) + CASE WHEN counts THEN 1 ELSE 0 END AS retry_count FROM c FULL JOIN a USING (candidate_id)"""
)
def e10_retry_state(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    before = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderkey") % 4).alias("retry_count"))
    attempts = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderstatus") != "P").alias("counts"))
    return adjudicate.retry_state(before, attempts)


@query("WITH o AS (SELECT o_orderkey AS candidate_id, o_orderpriority AS run, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT candidate_id, run, n <= 100 AS now FROM o")
def e11_cap_batch(spark: SparkSession, d: str) -> DataFrame:
    """The first of each run go on, the rest stay as replayable rows: nothing is lost."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderpriority").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return adjudicate.cap_batch(o, 100).select("candidate_id", "run", "now")


@query("WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders), a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'P' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) SELECT id, b.s AS was, a.s AS now FROM b FULL JOIN a USING (id) WHERE b.s IS DISTINCT FROM a.s")
def u3_state_diff(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    before = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("was"))
    after = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "P").otherwise(F.col("o_orderstatus")).alias("now"))
    return before.join(after, "id", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("id", "was", "now")


@query("SELECT l_orderkey AS event_id, count(DISTINCT l_suppkey) AS sources, min(l_suppkey) AS first_source FROM lineitem GROUP BY 1")
def g3_independent_sources(spark: SparkSession, d: str) -> DataFrame:
    e = A.event_evidence(spark, d)
    return e.groupBy("event_id").agg(F.count_distinct("source_id").alias("sources"), F.min("source_id").alias("first_source"))


@query("SELECT page_id, url FROM pages WHERE url IS NULL OR length(url) < 5")
def p1_rejected_urls(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the canonical form refuses."""
    return X.canonical_urls(A.table(spark, d, "pages").select("page_id", "url"))[1].select("page_id", "url")


@query("SELECT o_orderkey AS candidate_id, o_orderkey % 9 AS retry_count FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 9 >= 5")
def f11_stalled(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that could be replayed but have used up their attempts."""
    status = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending").alias("status")
    c = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderkey") % 9).alias("retry_count"), status, F.col("o_orderpriority").alias("stage"), F.lit(True).alias("has_payload"))
    return c.where(adjudicate.retry_fate(("1-URGENT", "2-HIGH")) == "stalled").select("candidate_id", "retry_count")


@query(
    """WITH a AS (SELECT doc_id AS item_id, toxic AS a FROM labels WHERE doc_id % 5 <> 1), b AS (SELECT doc_id AS item_id, CAST(n_chars % 3 = 0 AS INT) AS b FROM documents WHERE doc_id % 7 <> 2)
SELECT item_id, a.a AS primary_value, b.b AS reviewer_value, a.a IS NOT NULL AND b.b IS NOT NULL AND a.a <> b.b AS disputed FROM a FULL JOIN b USING (item_id)"""
)
def j12_judgements(spark: SparkSession, d: str) -> DataFrame:
    """Two judges' values of each item side by side, whoever saw it."""
    a = A.table(spark, d, "labels").where("doc_id % 5 <> 1").select(F.col("doc_id").alias("item_id"), F.col("toxic").alias("value"))
    b = A.table(spark, d, "documents").where("doc_id % 7 <> 2").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") % 3 == 0).cast("int").alias("value"))
    return adjudicate.paired(a, b)
