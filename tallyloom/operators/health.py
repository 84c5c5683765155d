"""Source health from run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(registry: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """registry with last_success and due: no interval, never a success, or the interval has passed."""
    last = runs.where("not failed").groupBy("source_id").agg(F.max("ts").alias("last_success"))
    passed = F.timestamp_add("HOUR", F.col("poll_interval_hours").cast("int"), F.col("last_success")) <= now
    return registry.join(last, "source_id", "left").withColumn("due", F.col("poll_interval_hours").isNull() | F.col("last_success").isNull() | passed)


def run_state(runs: DataFrame) -> DataFrame:
    """source_id, last_success, consecutive_failures, first_failure_at from runs(source_id, ts, seq, failed).

    Failures after the last success: two partial aggregations and a join, no ordering of a source's whole log.
    """
    at = F.struct("ts", "seq")
    last = runs.groupBy("source_id").agg(F.max(F.when(~F.col("failed"), at)).alias("last"))
    since = runs.where("failed").join(last, "source_id").where(F.col("last").isNull() | (at > F.col("last")))
    failed = since.groupBy("source_id").agg(F.count(F.lit(1)).alias("consecutive_failures"), F.min("ts").alias("first_failure_at"))
    return last.join(failed, "source_id", "left").na.fill(0, ["consecutive_failures"]).withColumn("last_success", F.col("last.ts")).drop("last")


def status(registry: DataFrame, state: DataFrame, gap_at: int = 3) -> DataFrame:
    """registry with health (unknown, failed, degraded, healthy) and gap; private columns are the caller's to leave out."""
    f = F.col("consecutive_failures")
    health = F.when(f.isNull(), "unknown").when(f >= gap_at, "failed").when(f > 0, "degraded").otherwise("healthy")
    return registry.join(state, "source_id", "left").withColumn("health", health).withColumn("gap", F.col("enabled") & (F.coalesce(f, F.lit(0)) >= gap_at))


def interval_gap(last_success: Column, hours: Column, now: Column) -> Column:
    """A source with an interval has a gap once twice the interval has passed without success."""
    return hours.isNotNull() & (last_success.isNull() | (F.timestamp_add("HOUR", (2 * hours).cast("int"), last_success) < now))


def rolled_days(runs: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """day, runs and the day's last run: rows of the pipeline beat older kinds of row. runs(ts, is_pipeline, status, seq)."""
    day = F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd")
    best = F.max(F.struct(F.col("is_pipeline").cast("int").alias("p"), "ts", "seq", "status"))
    return runs.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("runs"), best.alias("b")).select("day", "runs", F.col("b.status").alias("status"), F.col("b.seq").alias("seq"))


