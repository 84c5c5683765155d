"""Adjudication of independent judgements, acceptance, and the retry queue."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import norm_entity
from tallyloom.operators.surface import numbered

MAX_RETRIES = 5


def paired(primary: DataFrame, reviewer: DataFrame) -> DataFrame:
    """item_id, primary_value, reviewer_value, disputed: both judgements of each item that either judge saw."""
    both = primary.withColumnRenamed("value", "primary_value").join(reviewer.withColumnRenamed("value", "reviewer_value"), "item_id", "full")
    return both.withColumn("disputed", F.coalesce(F.col("primary_value") != F.col("reviewer_value"), F.lit(False)))


def adjudicated(primary: DataFrame, reviewer: DataFrame, arbiter: DataFrame) -> DataFrame:
    """item_id, outcome, value: equal judgements stand; of different ones the arbiter picks A or B, or the item stays pending.

    primary and reviewer: (item_id, value); arbiter: (item_id, selected). An item that only one judge saw is "single", without a value.
    """
    both = primary.withColumnRenamed("value", "a").join(reviewer.withColumnRenamed("value", "b"), "item_id", "full").join(arbiter, "item_id", "left")
    agreed, single = F.col("a") == F.col("b"), F.col("a").isNull() | F.col("b").isNull()
    outcome = F.when(agreed, "agreed").when(single, "single").when(F.col("selected").isNull(), "pending").otherwise("arbiter")
    value = F.when(agreed, F.col("a")).when(single, None).when(F.col("selected") == "A", F.col("a")).when(F.col("selected") == "B", F.col("b"))
    return both.select("item_id", outcome.alias("outcome"), value.alias("value"))


def equal_by_task(task: Column, a: str, b: str) -> Column:
    """Whether two judgements (structs of that name) say the same, by the rules of their task; nulls are equal to nulls.

    extraction: companies and products by their normalised names, the type, and the days of both dates (what is no date is compared as it stands); importance: the three bands; match:
    relation and event. Other tasks have no equality (null).
    """
    both = lambda f, *names: functools.reduce(lambda x, y: x & y, [f(F.col(f"{a}.{n}")).eqNullSafe(f(F.col(f"{b}.{n}"))) for n in names])
    same, name, day = (lambda x: x), (lambda x: F.coalesce(norm_entity(x), F.lit(""))), lambda x: F.nullif(F.regexp_replace(F.trim(x), r"(?s)^(\d{4}-\d{2}-\d{2})[T\s].*$", "$1"), F.lit(""))
    fact = both(name, "company", "product") & both(same, "event_type") & both(day, "occurred_at", "published_at")
    return F.when(task == "extraction", fact).when(task == "importance", both(same, "relevance", "impact", "actionability")).when(task == "match", both(same, "relation", "event_id"))


def adjudicated_by_task(primary: DataFrame, reviewer: DataFrame, arbiter: DataFrame, known: DataFrame) -> DataFrame:
    """item_id, task, outcome, and `judgement`, the struct that stands (null where none does).

    primary and reviewer: (item_id, task, judgement), the fields of `equal_by_task` in the struct; arbiter: (item_id, task, selected): "A", "B" or
    neither. Of equal judgements the first stands; of different ones the arbiter's. A match stands only if it is consistent: "different_event" names
    no event, any other relation names one of known(event_id); else the item is pending, whoever chose it.
    """
    key = ["item_id", "task"]
    rows = primary.withColumnRenamed("judgement", "a").join(reviewer.withColumnRenamed("judgement", "b"), key, "full").join(arbiter, key, "left")
    agreed, single = equal_by_task(F.col("task"), "a", "b"), F.col("a").isNull() | F.col("b").isNull()
    rows = rows.select(*key, F.when(single, "single").when(agreed, "agreed").when(F.col("selected").isin("A", "B"), "arbiter").otherwise("pending").alias("outcome"), "a", "b", "selected")
    chosen = F.when(F.col("outcome") == "agreed", F.col("a")).when(F.col("outcome") == "arbiter", F.when(F.col("selected") == "A", F.col("a")).otherwise(F.col("b")))
    rows = rows.withColumn("judgement", chosen).join(known.select(F.col("event_id").alias("__known")).distinct(), F.col("judgement.event_id") == F.col("__known"), "left")
    usable = consistent_match(F.when(F.col("judgement.relation") == "different_event", "different").otherwise(F.col("judgement.relation")), F.col("judgement.event_id"), F.col("__known").isNotNull())
    refused = (F.col("task") == "match") & F.col("judgement").isNotNull() & ~F.coalesce(usable, F.lit(False))
    return rows.select(*key, F.when(refused, "pending").otherwise(F.col("outcome")).alias("outcome"), F.when(~refused, F.col("judgement")).alias("judgement"))


def consistent_match(relation: Column, event_id: Column, known: Column) -> Column:
    """A match verdict that can be used: "different" names no event, any other names a known one."""
    return F.when(relation == "different", event_id.isNull()).otherwise(event_id.isNotNull() & known)


def needs_review(uncertain: Column, risky: Column, consistent: Column, total: Column) -> Column:
    """Whether a second opinion is wanted."""
    return uncertain | risky | ~consistent | (total >= 80)


def acceptance(predicted: DataFrame, gold: DataFrame, precision: float = 0.98, recall: float = 0.95) -> DataFrame:
    """One row: the confusion matrix, precision and recall (0 where there is nothing to count), and whether both reach their limits."""
    n = lambda g, p: F.count_if((F.col("gold") == g) & (F.col("predicted") == p))
    c = gold.join(predicted, "item_id").agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    c = c.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
    return c.withColumn("passed", (F.col("precision") >= precision) & (F.col("recall") >= recall))


def retry_fate(stages: tuple[str, ...]) -> Column:
    """retry, stalled (attempts used up) or kept, of a candidate row."""
    ready = (F.col("status") == "pending") & F.col("stage").isin(*stages) & F.col("has_payload")
    return F.when(ready & (F.col("retry_count") < MAX_RETRIES), "retry").when(ready, "stalled").otherwise("kept")


def retry_state(before: DataFrame, attempts: DataFrame) -> DataFrame:
    """candidate_id, retry_count after attempts(candidate_id, counts): deferrals don't count, new candidates begin at nought."""
    both = before.join(attempts, "candidate_id", "full")
    return both.select("candidate_id", (F.coalesce("retry_count", F.lit(0)) + F.coalesce(F.col("counts").cast("int"), F.lit(0))).alias("retry_count"))


def replay_first(retries: DataFrame, hits: DataFrame, most: int = 500, budget: int | None = None) -> DataFrame:
    """candidate_id, replayed, place: the run's queue. The first `most` retries (by seq) come before all hits (by seq); the others have no place and wait for the next run.

    retries and hits: (candidate_id, seq). A queue above the budget is refused as a whole, so that no cursor moves past a hit that was left out.
    """
    first = retries.orderBy("seq", "candidate_id").limit(most).select("candidate_id", "seq", F.lit(0).alias("__turn"))
    queue = numbered(first.unionByName(hits.select("candidate_id", "seq", F.lit(1).alias("__turn"))), "place", F.asc("__turn"), F.asc("seq"), F.asc("candidate_id"))
    queue = queue.select("candidate_id", (F.col("__turn") == 0).alias("replayed"), "place")
    if budget is not None and (n := queue.count()) > budget:
        raise ValueError(f"{n} hits are above the budget of {budget}")
    rest = retries.join(first, "candidate_id", "left_anti").select("candidate_id", F.lit(True).alias("replayed"), F.lit(None).cast(queue.schema["place"].dataType).alias("place"))
    return queue.unionByName(rest)


def cap_batch(candidates: DataFrame, n: int) -> DataFrame:
    """candidates(run, at, ...) with `now`: whether the row is among the first n of its run; the others wait."""
    return candidates.withColumn("now", F.row_number().over(Window.partitionBy("run").orderBy("at")) <= n)
