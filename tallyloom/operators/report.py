"""The public report: stories, items, views and queue written in one go, and what was held back counted on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.functions.scoring import level_rank
from tallyloom.operators import evidence as E
from tallyloom.operators.surface import numbered
from tallyloom.session import stored


@dataclass
class Report:
    """stories (a row each, by `place`), items (a row for each piece of evidence of a story), queue (events that wait for review), counts of the whole ledger."""

    stories: DataFrame
    items: DataFrame
    queue: DataFrame
    counts: dict[str, int]


def project_report(events: DataFrame, evidence: DataFrame, issue: DataFrame, now: Column, window_days: int = 31, gate_open: bool = True) -> Report:
    """Project the ledger.

    events: event_id, level, total, occurred_at, publication_state, evidence_confidence, review_status, released, and whatever else a story carries;
    evidence: event_id, pos, source_id, editorial_owner, tier; issue(event_id): the events of the current issue. While the gate is closed only released
    events are shown. The ledger is read once: its rows are counted as they pass (an observed metric), so held = eligible - shown costs no scan of its own.
    Items are rows and not lists inside a story, so a story may have any number of them.
    """
    seen = Observation("report")
    eligible = F.coalesce(E.is_public(), F.lit(False))
    day, age = F.date_format("occurred_at", "yyyy-MM-dd"), F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("occurred_at").cast("timestamp"))) / 86_400)
    since = F.date_format(F.date_sub(F.to_date(now), window_days), "yyyy-MM-dd")
    flags = events.join(issue.select("event_id").distinct().withColumn("__issue", F.lit(True)), "event_id", "left").withColumns(
        {
            "eligible": eligible,
            "shown": eligible & (F.lit(gate_open) | F.coalesce("released", F.lit(False))),
            "day": day,
            "waits": F.col("review_status") == "pending",
        }
    )
    flags = flags.withColumn("daily", F.col("shown") & F.coalesce("__issue", F.lit(False)) & F.coalesce(E.is_daily(), F.lit(False))).withColumn("hot", F.col("shown") & F.coalesce(F.col("day") >= since, F.lit(False))).drop("__issue")
    n = lambda c: F.count_if(F.col(c)).alias(c)
    kept = stored(flags.observe(seen, F.count(F.lit(1)).alias("events"), n("eligible"), n("shown"), n("daily"), n("hot"), n("waits")).where("shown or waits"), "report")
    counts = dict(seen.get)
    counts["held"] = counts["eligible"] - counts["shown"]

    shown = kept.where("shown").drop("shown", "eligible", "waits")
    of = shown.select("event_id", F.col("day").alias("day")).join(evidence, "event_id")
    items = stored(of.select("event_id", "pos", "source_id", "editorial_owner", "tier", "day"), "items")
    sums = items.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("editorial_owner").alias("sources_count"))
    badge = F.when(F.col("publication_state") == "first", "new").when(F.col("publication_state") == "update", "updated").otherwise("")
    spark_at = F.when((age >= 0) & (age < window_days), window_days - 1 - age)
    stories = shown.drop("sources").join(sums, "event_id", "left").na.fill(0, ["n_items", "sources_count"]).withColumns({"badge": badge, "score": F.col("total"), "spark_at": spark_at})
    order = [level_rank(F.col("level")).desc(), F.desc("total"), F.desc("day"), F.asc("event_id")]
    return Report(numbered(stories, "place", *order), items, kept.where("waits").select("event_id", "level", "total", "day"), counts)
