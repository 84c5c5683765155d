"""The driver tables read as the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scoring import importance
from tallyloom.operators import evidence
from tallyloom.session import dealt, looked_up

BASELINE = "1998-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def registry(spark: SparkSession, d: str) -> DataFrame:
    """supplier as the source registry."""
    k = F.col("s_suppkey")
    tier = F.when(k % 3 == 0, "authoritative").when(k % 3 == 1, "trusted").otherwise("discovery")
    return table(spark, d, "supplier").select(
        k.alias("source_id"), F.col("s_nationkey").alias("editorial_owner"), tier.alias("tier"), (k % 5 + 1).cast("string").alias("scope"),
        F.concat(F.lit("source"), k.cast("string"), F.lit(".example.com")).alias("host"), (k % 4 != 0).alias("enabled"), F.when(k % 2 == 0, (k % 7 + 1) * 6.0).alias("poll_interval_hours"),
    )


def event_evidence(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as edges from events to the sources of their evidence."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("pos"))


def ledger_events(spark: SparkSession, d: str) -> DataFrame:
    """orders as ledger events, with importance, confidence of their evidence, review and publication state."""
    o = table(spark, d, "orders")
    impact = F.element_at(F.array(*[F.lit(x) for x in (0, 15, 30, 40, 50)]), (F.col("o_custkey") % 5 + 1).cast("int"))
    events = importance(
        o.select(
            F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderdate").alias("occurred_at"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
            (10 * (F.col("o_custkey") % 4)).cast("int").alias("relevance"), impact.cast("int").alias("impact"), (10 * (F.col("o_orderkey") % 3)).cast("int").alias("actionability"),
        )
    )
    # dealt by event before the join: the tasks of the join, the sums and the join after them grow in number with the tables
    edges = looked_up(event_evidence(spark, d), registry(spark, d).select("source_id", "tier", "editorial_owner", "scope"), "source_id").drop("pos", "source_id")
    scoped = dealt(edges, "event_id").join(events.select("event_id", "event_type"), "event_id")
    confidence = evidence.confidence(scoped.withColumn("in_scope", F.col("scope") == F.substring("event_type", 1, 1)), "event_id", in_order=True)
    full = events.join(confidence, "event_id", "left").na.fill({"evidence_confidence": "low", "sources": 0})
    risky = evidence.high_risk(F.col("level"), F.col("event_type"), ("1-URGENT",))
    full = full.withColumn("review_status", evidence.review_outcome(risky, F.col("status") == "F", F.col("status") != "O", F.col("status") != "O"))
    return full.withColumn("publication_state", evidence.publication_state(F.col("occurred_at"), F.lit(BASELINE).cast("timestamp")))
