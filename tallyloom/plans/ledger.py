"""Queries of the merge and of the streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import merge
from tallyloom.operators.ledger_store import IncrementalLedger
from tallyloom.operators.store import Store
from tallyloom.plans.base import REGISTRY
from tallyloom.plans.registry import query
from tallyloom.session import scratch_dir
from tallyloom.sources import adapters as A
from tallyloom.streaming import streams


def merged(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as candidates; every tenth part has an event in the ledger already."""
    line = A.table(spark, d, "lineitem").join(A.registry(spark, d), F.col("l_suppkey") == F.col("source_id"))
    part = F.col("l_partkey").cast("string")
    c = line.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), part, F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string")).alias("candidate_id"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("seq"), F.concat(F.lit("p"), part).alias("fingerprint"), F.concat_ws("-", part, F.col("l_suppkey").cast("string"), F.col("l_returnflag")).alias("evidence_id"),
        F.concat_ws("/", part, (F.col("l_suppkey") % 4).cast("string")).alias("url"), F.lit(None).cast("string").alias("legacy_id"), F.lit(None).cast("string").alias("verdict_event"),
        F.col("editorial_owner").cast("string").alias("owner"), "tier", (F.col("scope") == "1").alias("in_scope"), F.when(F.col("l_linenumber") % 6 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"),
        (F.col("l_linestatus") == "O").alias("has_cursor"), F.when(F.col("l_quantity") > 3, (F.col("l_quantity").cast("int") % 4).cast("string")).alias("facts"),
    )
    p = A.table(spark, d, "part").where("p_partkey % 10 = 0").select(
        F.concat(F.lit("old"), F.col("p_partkey").cast("string")).alias("event_id"), F.col("p_partkey").alias("event_ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("fingerprint"), F.lit("0").alias("facts"),
        F.concat(F.lit("seed"), F.col("p_partkey").cast("string")).alias("evidence_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("legacy_id"), F.lit("0").alias("owner"), F.lit("authoritative").alias("tier"), F.lit(True).alias("in_scope"),
    )
    return merge.merge_ledger(c, p, "1997-01-01")


@query()
def e3_merge_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate's outcome and every event after the fold (order decides, so there is no SQL; a test holds it against a plain fold)."""
    return merged(spark, d).drop("component")


@query()
def e3_merge_metrics(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_metrics(merged(spark, d))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = streams.hits(spark, f"{d}/events.parquet", A.table(spark, d, "events"))
    return e.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))


@query("SELECT user_id AS source_id, date_trunc('day', ts) AS day, count(*) AS hits, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY ALL")
def t2_stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of each source, by a stream run to its end; the last state of each window stands."""
    folder = _folder(spark, "t2")
    counts = streams.window_counts(_runs(spark, d), "ts", "1 day")
    streams.run_to_end(counts.select("source_id", F.col("w.start").alias("day"), "hits", "failures"), "update", folder)
    out = streams.latest(spark.read.parquet(f"{folder}/out"), "source_id", "day")
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    """WITH o AS (SELECT user_id AS source_id, ts, event_id, event_type = 'error' AS failed FROM events), g AS (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS grp FROM o),
l AS (SELECT source_id, max(ts) FILTER (WHERE NOT failed) AS last_success, max(grp) AS last_grp, count(*) AS runs FROM g GROUP BY 1)
SELECT l.source_id, runs, count(*) FILTER (WHERE failed AND g.grp = l.last_grp) AS consecutive_failures, count(*) FILTER (WHERE failed AND g.grp = l.last_grp) >= 3 AS gap FROM g JOIN l USING (source_id) GROUP BY 1, 2, last_success"""
)
def t3_stream_source_health(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "t3")
    streams.run_to_end(streams.source_health(_runs(spark, d).withColumn("hours", F.lit(None).cast("double"))), "update", folder)
    out = streams.latest(spark.read.parquet(f"{folder}/out").where("kind = 'state'"), "source_id")
    return out.select("source_id", "runs", "consecutive_failures", (F.col("consecutive_failures") >= 3).alias("gap"))


#: Events landed in four files, one after another, eight days each; every tenth event lands a file late.
_LANDED = """landed AS (SELECT *, least(3, (day(ts) - 1) // 8)::INT AS own, least(3, (day(ts) - 1) // 8 + (event_id % 10 = 0)::INT)::INT AS slipped FROM events)"""


_ROWS_A_FILE = 100_000


def _landed(spark: SparkSession, d: str, folder: str, late: bool) -> Callable[[], DataFrame]:
    """Opens a stream of the events in four batches of equally many files; a batch's files begin when those before it are complete, so batches follow time."""
    # the table is read once for each batch: only what some query on the landed rows uses
    e = A.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    own = F.floor((F.day("ts") - 1) / 8) + (F.when(F.col("event_id") % 10 == 0, 1).otherwise(0) if late else 0)
    part = F.least(F.lit(3), own).cast("int")
    fewest = [r["count"] for r in e.groupBy(part.alias("part")).count().collect()]
    # every file of a batch holds many rows, so that none is left out as empty
    files = max(1, min(fewest) // _ROWS_A_FILE) if len(fewest) == 4 else 1
    for k in range(4):
        rows = e.where(part == k)
        (rows.repartition(files, "event_id") if files > 1 else rows.coalesce(1)).write.mode("append").parquet(f"{folder}/hits")
    return lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/hits")


@query(
    f"""WITH {_LANDED}, e AS (SELECT user_id * 10 + event_id % 10 AS source_id, ts, event_id, own, event_type = 'error' AS failed FROM landed),
g AS (SELECT *, CASE WHEN source_id % 3 <> 0 THEN (source_id % 7 + 1) * 6 END AS hours, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY source_id ORDER BY ts, event_id) AS k FROM e),
f AS (SELECT source_id, k, min(ts) AS first_failure_at, min(ts) + to_hours(2 * any_value(hours)) AS alarm_at FROM g WHERE failed AND hours IS NOT NULL GROUP BY 1, 2),
s AS (SELECT f.*, min(own) FILTER (WHERE ts > alarm_at) AS shown, count(*) FILTER (WHERE NOT failed AND ts > first_failure_at AND ts <= alarm_at) AS off FROM f LEFT JOIN g ON f.source_id = g.source_id AND (g.k = f.k OR g.k = f.k + 1 AND NOT failed) GROUP BY ALL),
m AS (SELECT own, max(max(ts)) OVER (ORDER BY own) - INTERVAL 1 HOUR AS mark FROM e GROUP BY own),
t AS (SELECT s.*, (SELECT min(m.own) + 1 FROM m WHERE mark >= alarm_at) AS fired FROM s WHERE off = 0)
SELECT source_id, first_failure_at, alarm_at, shown IS NULL OR coalesce(shown > fired, false) AS by_timer FROM t WHERE shown IS NOT NULL OR fired IS NOT NULL"""
)
def t3_health_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Alarms of sources that fail for more than twice their interval; those of sources that fell silent come from timers."""
    folder = _folder(spark, "t3a")
    e = _landed(spark, d, folder, late=False)()
    source = F.col("user_id") * 10 + F.col("event_id") % 10
    runs = e.select(source.alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), F.when(source % 3 != 0, (source % 7 + 1) * 6.0).alias("hours"))
    streams.run_to_end(streams.source_health(runs), "update", folder)
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.parquet(f"{folder}/out").where("kind = 'alarm'").select("source_id", local("first_failure_at"), local("alarm_at"), "by_timer")


#: Which rows were behind the watermark when their file came: at or before the latest time of the files before it, less a day.
_LATE = f"""{_LANDED}, m AS (SELECT slipped, max(epoch_ms(max(ts))) OVER (ORDER BY slipped) - 86400000 AS mark FROM landed GROUP BY slipped),
marked AS (SELECT user_id % 50 AS source_id, ts, l.event_id, coalesce(epoch_us(ts) <= 1000 * m.mark, false) AS late FROM landed l LEFT JOIN m ON m.slipped = l.slipped - 1),
last AS (SELECT max(mark) AS mark FROM m)"""


def _by_fifty(open_stream: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    return lambda: open_stream().select((F.col("user_id") % 50).alias("source_id"), "ts", F.col("event_id").alias("seq"))


@query(
    f"""WITH {_LATE}, w AS (SELECT source_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS begins FROM marked WHERE NOT late)
SELECT source_id, begins, count(*) AS hits, false AS late FROM w GROUP BY ALL HAVING epoch_ms(begins + INTERVAL 2 DAY) <= (SELECT mark FROM last) UNION ALL SELECT source_id, ts, 1, true FROM marked WHERE late"""
)
def t2_sliding_windows_and_late(spark: SparkSession, d: str) -> DataFrame:
    """Two-day windows that slide by a day, written once they have ended, and the rows that came behind the watermark, by one query in append mode."""
    folder = _folder(spark, "t2w")
    rows = streams.windows_with_late(_by_fifty(_landed(spark, d, folder, late=True)), "1 day", lambda ts: F.window(ts, "2 days", "1 day"))
    streams.run_to_end(rows, "append", folder)
    return spark.read.parquet(f"{folder}/out").select("source_id", F.col("begins").cast("timestamp_ntz").alias("begins"), "hits", "late")


@query(
    f"""WITH {_LATE}, s AS (SELECT source_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY source_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM marked WHERE NOT late),
g AS (SELECT source_id, ts, sum(new) OVER (PARTITION BY source_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s)
SELECT source_id, min(ts) AS begins, count(*) AS hits, false AS late FROM g GROUP BY source_id, k HAVING epoch_us(max(ts) + INTERVAL 6 HOUR) <= 1000 * (SELECT mark FROM last) UNION ALL SELECT source_id, ts, 1, true FROM marked WHERE late"""
)
def t6_sessions_and_late(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that a gap of six hours ends, written once the watermark has passed their end, and the late rows, by one query in append mode."""
    folder = _folder(spark, "t6s")
    rows = streams.windows_with_late(_by_fifty(_landed(spark, d, folder, late=True)), "1 day", lambda ts: F.session_window(ts, "6 hours"))
    streams.run_to_end(rows, "append", folder)
    return spark.read.parquet(f"{folder}/out").select("source_id", F.col("begins").cast("timestamp_ntz").alias("begins"), "hits", "late")


@query("SELECT DISTINCT user_id * 1000 + event_id % 50 AS evidence_id FROM events")
def t1_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each evidence once: the watermark spans the whole table here, so the stream equals its batch twin."""
    folder = _folder(spark, "t1")
    e = _runs(spark, d).select((F.col("source_id") * 1000 + F.col("seq") % 50).alias("evidence_id"), "ts")
    streams.run_to_end(streams.deduplicated(e, "evidence_id", "ts", "400 days").select("evidence_id"), "append", folder)
    return spark.read.parquet(f"{folder}/out").select("evidence_id")


@query(
    f"""WITH {REGISTRY}, c AS (SELECT 'f' || event_id % 300 AS fingerprint, event_id AS candidate_id, tier, editorial_owner AS owner, scope = '1' AS in_scope FROM events JOIN registry ON source_id = user_id % 10 + 1),
o AS (SELECT *, min(candidate_id) FILTER (WHERE tier = 'authoritative' AND in_scope) OVER (PARTITION BY fingerprint) AS high_at, arg_min(owner, candidate_id) FILTER (WHERE tier = 'trusted') OVER (PARTITION BY fingerprint) AS first_owner FROM c),
s AS (SELECT fingerprint, any_value(high_at) AS high_at, min(candidate_id) FILTER (WHERE tier = 'trusted' AND owner <> first_owner) AS second_at FROM o GROUP BY 1)
SELECT fingerprint, least(high_at, second_at) AS candidate_id, CASE WHEN second_at IS NULL OR high_at <= second_at THEN 'high' ELSE 'medium' END AS confidence FROM s WHERE high_at IS NOT NULL OR second_at IS NOT NULL"""
)
def t4_stream_gate(spark: SparkSession, d: str) -> DataFrame:
    """The evidence gate as a stream: each fingerprint's promotion, once."""
    folder = _folder(spark, "t4")
    e = streams.hits(spark, f"{d}/events.parquet", A.table(spark, d, "events")).join(A.registry(spark, d), F.col("source_id") == F.col("user_id") % 10 + 1)
    rows = e.select(F.concat(F.lit("f"), (F.col("event_id") % 300).cast("string")).alias("fingerprint"), F.col("event_id").alias("candidate_id"), F.col("event_id").alias("seq"), "tier", F.col("editorial_owner").cast("bigint").alias("owner"), (F.col("scope") == "1").alias("in_scope"))
    # evidence is taken in order of arrival, and no fingerprint expires here
    rows = rows.withColumn("ts", F.timestamp_seconds("seq"))
    streams.run_to_end(streams.gate(rows, "40000 days"), "append", folder)
    return spark.read.parquet(f"{folder}/out").where("candidate_id = opened_by").select("fingerprint", "candidate_id", "confidence")


@query(
    f"""WITH {REGISTRY}, c AS (SELECT 'f' || event_id % 300 AS fingerprint, ts, event_id, tier, editorial_owner AS owner, scope = '1' AS in_scope FROM events JOIN registry ON source_id = user_id % 10 + 1),
n AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts, event_id) + INTERVAL 2 DAY THEN 1 ELSE 0 END AS new FROM c),
s AS (SELECT *, sum(new) OVER (PARTITION BY fingerprint ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM n),
o AS (SELECT *, row_number() OVER w AS place, first_value(CASE WHEN tier = 'trusted' THEN owner END IGNORE NULLS) OVER (PARTITION BY fingerprint, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_owner FROM s WINDOW w AS (PARTITION BY fingerprint, life ORDER BY ts, event_id)),
b AS (SELECT fingerprint, life, min(place) AS opens FROM o WHERE tier = 'authoritative' AND in_scope OR tier = 'trusted' AND owner <> first_owner GROUP BY 1, 2),
g AS (SELECT o.*, opens FROM o JOIN b USING (fingerprint, life) WHERE place <= opens)
SELECT fingerprint, event_id AS candidate_id, max(CASE WHEN place = opens THEN event_id END) OVER p AS opened_by, max(CASE WHEN place = opens THEN CASE WHEN tier = 'authoritative' THEN 'high' ELSE 'medium' END END) OVER p AS confidence,
  (SELECT count(DISTINCT owner) FROM g h WHERE h.fingerprint = g.fingerprint AND h.life = g.life) AS owners FROM g WINDOW p AS (PARTITION BY fingerprint, life)"""
)
def t4_gate_with_expiry(spark: SparkSession, d: str) -> DataFrame:
    """The gate with state that ends: a fingerprint silent for more than two days is forgotten, with what waited, and starts anew."""
    folder = _folder(spark, "t4e")
    e = _landed(spark, d, folder, late=False)().join(A.registry(spark, d), F.col("source_id") == F.col("user_id") % 10 + 1)
    rows = e.select(F.concat(F.lit("f"), (F.col("event_id") % 300).cast("string")).alias("fingerprint"), "ts", F.col("event_id").alias("candidate_id"), F.col("event_id").alias("seq"), "tier", F.col("editorial_owner").cast("bigint").alias("owner"), (F.col("scope") == "1").alias("in_scope"))
    streams.run_to_end(streams.gate(rows, "2 days"), "append", folder)
    return spark.read.parquet(f"{folder}/out").select("fingerprint", "candidate_id", "opened_by", "owners", "confidence")


@query("SELECT user_id AS source_id, max(ts) FILTER (WHERE event_type <> 'error') AS cursor_at FROM events GROUP BY 1 HAVING max(ts) FILTER (WHERE event_type <> 'error') IS NOT NULL")
def t7_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Each source's high-water mark after two runs over its log; only success moves it."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("source_id"), "ts", (F.col("event_type") == "error").alias("failed"))
    none = e.select("source_id", F.col("ts").alias("cursor_at")).limit(0)
    first = streams.advance_cursor(none, e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return streams.advance_cursor(first, e)


def _as_candidates(e: DataFrame) -> DataFrame:
    """Events joined with their sources, as candidates of 300 fingerprints."""
    say = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return e.select(
        say("c", F.col("event_id")).alias("candidate_id"), F.col("event_id").alias("seq"), say("f", F.col("event_id") % 300).alias("fingerprint"), say("e", F.col("event_id")).alias("evidence_id"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("legacy_id"), F.lit(None).cast("string").alias("verdict_event"), F.col("editorial_owner").cast("string").alias("owner"), "tier", (F.col("scope") == "1").alias("in_scope"),
        F.lit("2024-01-01").alias("day"), F.lit(False).alias("has_cursor"), F.lit("a").alias("facts"),
    )


def _streamed_ledger(spark: SparkSession, d: str) -> str:
    """The folder of a ledger that a stream of events, in four files, was merged into batch by batch."""
    folder = _folder(spark, "t5")
    A.table(spark, d, "events").repartitionByRange(4, "event_id").write.parquet(f"{folder}/hits")
    e = spark.readStream.schema(A.table(spark, d, "events").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/hits").join(A.registry(spark, d), F.col("source_id") == F.col("user_id") % 10 + 1)
    streams.run_to_end(_as_candidates(e), "append", folder, streams.ledger_sink(f"{folder}/ledger", "2020-01-01"))
    return f"{folder}/ledger"


_GATED = f"""WITH {REGISTRY}, c AS (SELECT 'f' || event_id % 300 AS fingerprint, tier, editorial_owner AS owner, scope = '1' AS in_scope FROM events JOIN registry ON source_id = user_id % 10 + 1),
g AS (SELECT fingerprint, count(*) AS n, coalesce(bool_or(tier = 'authoritative' AND in_scope), false) AS high, count(DISTINCT owner) FILTER (WHERE tier = 'trusted') >= 2 AS medium FROM c GROUP BY 1)"""


@query(f"{_GATED} SELECT fingerprint, n AS n_evidence FROM g WHERE high OR medium")
def t5_ledger_sink(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's events after the stream, and how much evidence each has."""
    edges = merge.current(spark, _streamed_ledger(spark, d), "evidence")
    return edges.groupBy("event_id", "fingerprint").agg(F.count_distinct("evidence_id").alias("n_evidence")).select("fingerprint", "n_evidence")


@query(f"{_GATED} SELECT fingerprint, n FROM g WHERE NOT (high OR medium)")
def k1_waiting_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that wait at the gate after the last committed batch, by fingerprint; a batch run again changes nothing."""
    root = _streamed_ledger(spark, d)
    merge.commit({"waiting": spark.range(3), "evidence": spark.range(3), "history": spark.range(3)}, root, "0000000000")  # an earlier run, repeated
    return merge.current(spark, root, "waiting").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def _incremental(spark: SparkSession, d: str) -> IncrementalLedger:
    """A ledger that a stream of events, in four files, was merged into, each batch at the cost of what it touches."""
    folder = _folder(spark, "t5i")
    e = _landed(spark, d, folder, late=False)().join(A.registry(spark, d), F.col("source_id") == F.col("user_id") % 10 + 1)
    ledger = IncrementalLedger(Store(spark, f"{folder}/ledger", 16), "2020-01-01")
    streams.run_to_end(_as_candidates(e), "append", folder, ledger.write)
    return ledger


@query(f"{_GATED} SELECT fingerprint, n AS n_evidence FROM g WHERE high OR medium")
def t5_incremental_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's events after the stream, each batch of which read and wrote the components that it touched."""
    edges = _incremental(spark, d).evidence()
    return edges.groupBy("event_id", "fingerprint").agg(F.count_distinct("evidence_id").alias("n_evidence")).select("fingerprint", "n_evidence")


@query(
    f"""WITH {REGISTRY}, {_LANDED}, c AS (SELECT 'f' || event_id % 300 AS fingerprint, tier, editorial_owner AS owner, scope = '1' AS in_scope FROM landed JOIN registry ON source_id = user_id % 10 + 1 WHERE own < 3),
g AS (SELECT fingerprint, count(*) AS n, coalesce(bool_or(tier = 'authoritative' AND in_scope), false) AS high, count(DISTINCT owner) FILTER (WHERE tier = 'trusted') >= 2 AS medium FROM c GROUP BY 1)
SELECT fingerprint, n, NOT (high OR medium) AS waits FROM g"""
)
def k1_verified_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as of its last whole version: a file of the last run is lost, so the version before it stands."""
    ledger = _incremental(spark, d)
    last = ledger.store.latest()
    bucket, parts = next((b, parts) for b, parts in last["tables"]["members"]["buckets"].items() if parts[-1][0].startswith(f"{last['run']:010d}"))
    lost, fs = ledger.store._path("members", f"run={parts[-1][0]}", f"bucket={bucket}")
    fs.delete(lost, True)
    whole = ledger.store.verified()
    rows = ledger.evidence(whole).select("fingerprint", "evidence_id", F.lit(False).alias("waits")).unionByName(ledger.waiting(whole).select("fingerprint", "evidence_id", F.lit(True).alias("waits")))
    return rows.groupBy("fingerprint", "waits").agg(F.count_distinct("evidence_id").alias("n")).select("fingerprint", "n", "waits")


@query("SELECT count(*) AS rows, sum(l_quantity)::BIGINT AS quantity, l_returnflag AS run FROM lineitem GROUP BY 3")
def k2_run_history(spark: SparkSession, d: str) -> DataFrame:
    """One line for each run, appended and read back."""
    folder = f"{_folder(spark, 'k2')}/history"
    runs = A.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    merge.append_history(runs.where("run < 'N'"), folder)
    merge.append_history(runs.where("run >= 'N'"), folder)
    return spark.read.schema("rows bigint, quantity bigint, run string").json(folder)


@query("SELECT ts < TIMESTAMP '2024-01-12' AS late, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def t6_late_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits from before the baseline go to a branch of their own; none is lost to a watermark."""
    folder = _folder(spark, "t6")
    e = streams.hits(spark, f"{d}/events.parquet", A.table(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = []
    for name, rows in zip(("now", "late"), streams.split_late(e, "ts", F.lit("2024-01-12").cast("timestamp")), strict=True):
        streams.run_to_end(rows.select("event_id"), "append", f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}/out").select(F.lit(name == "late").alias("late"), "event_id"))
    return out[0].union(out[1]).groupBy("late").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    """WITH s AS (SELECT user_id AS source_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT source_id, ts, sum(new) OVER (PARTITION BY source_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT source_id, min(ts) AS begins, count(*) AS hits FROM g GROUP BY source_id, k"""
)
def t2_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each source in sessions that a gap of six hours ends; the watermark spans the table, so all sessions are closed by the last row."""
    folder = _folder(spark, "t2s")
    e = _runs(spark, d)
    counts = streams.session_counts(e, "ts", "6 hours", "400 days")
    streams.run_to_end(counts.select("source_id", F.col("w.start").alias("begins"), "hits"), "complete", folder)
    out = spark.read.parquet(f"{folder}/out")
    return out.join(out.agg(F.max("batch").alias("batch")), "batch").select("source_id", F.col("begins").cast("timestamp_ntz").alias("begins"), "hits")
