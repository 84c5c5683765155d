"""The evidence gate: confidence, corroboration, review, release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import dealt, stored, tasks_for


def confidence(scoped: DataFrame, key: str, in_order: bool = False) -> DataFrame:
    """key, evidence_confidence, sources: from rows (key, tier, editorial_owner, in_scope), one for each piece of evidence.

    high: an authoritative source in scope; medium: two distinct trusted owners; else low. sources counts distinct owners.
    in_order, for rows that are dealt by key already: they are summed in their order (Spark sums texts so), which holds one row, not a table of keys.
    """
    one = F.lit(1).cast("string" if in_order else "int")
    trusted, strong = F.col("tier") == "trusted", (F.col("tier") == "authoritative") & F.col("in_scope")
    # owners are told apart by a sum before the sum, so no row is written out for each count of different values
    owners = scoped.groupBy(key, "editorial_owner").agg(F.max(F.when(trusted, one)).alias("__trusted"), F.max(F.when(strong, one)).alias("__strong"))
    known = F.col("editorial_owner").isNotNull()
    medium = F.count_if(known & F.col("__trusted").isNotNull()) >= 2
    return owners.groupBy(key).agg(
        F.when(F.max("__strong").isNotNull(), "high").when(medium, "medium").otherwise("low").alias("evidence_confidence"), F.count_if(known).alias("sources")
    )


def corroborated(candidates: DataFrame) -> DataFrame:
    """Candidates at the gate, each with the confidence of its support set: pending rows of equal fingerprint and material hash.

    candidates: (candidate_id, fingerprint, material_hash, tier, editorial_owner, in_scope), one row for each piece of evidence. A
    null hash supports only itself. Sums are by group, so a group's rows are never gathered.
    """
    group = F.coalesce(F.col("material_hash"), F.concat(F.lit("own:"), F.col("candidate_id").cast("string")))
    keyed = candidates.withColumn("support", F.concat_ws("|", "fingerprint", group))
    return keyed.select("candidate_id", "support").distinct().join(confidence(keyed, "support"), "support").drop("support")


def running_support(candidates: DataFrame, key: str, *order: str) -> DataFrame:
    """candidates with `owners` (distinct trusted owners so far), `running_confidence` of the support set so far, and `opens`: whether this row first lifts it above low.

    candidates: key, tier, editorial_owner, in_scope and the columns of a total order. A set's rows are dealt out by ranges of (key, order), so a hot key is
    spread over tasks: a range counts its own first occurrences, and what the ranges before it found is carried in as sums, one row for each key of a range.
    """
    tasks = tasks_for(candidates)
    ranges = candidates.repartitionByRange(tasks, key, *order) if tasks else candidates.repartitionByRange(key, *order)
    ranged = stored(ranges.withColumn("__part", F.spark_partition_id()), "support")
    trusted, at = dealt(ranged.where("tier = 'trusted'"), key, "editorial_owner"), F.struct(*order)
    # an owner counts in the range where it first stands, at its first row there
    first = trusted.groupBy(key, "editorial_owner").agg(F.min(F.struct("__part", *order)).alias("m"))
    first = first.select(F.col(key).alias("__key"), F.col("editorial_owner").alias("__owner"), F.col("m.__part").alias("__first"), F.struct(*[F.col(f"m.{c}") for c in order]).alias("__at"))
    strong = (F.col("tier") == "authoritative") & F.col("in_scope")
    sums = ranged.groupBy(key, "__part").agg(F.coalesce(F.max(strong), F.lit(False)).alias("__strong"))
    new = first.groupBy("__key", F.col("__first").alias("__in")).agg(F.count(F.lit(1)).alias("__new"))
    sums = sums.join(new, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__in")), "left").drop("__key", "__in")
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), F.coalesce(F.sum("__new").over(before), F.lit(0)).alias("__owners"), F.coalesce(F.max("__strong").over(before), F.lit(False)).alias("__had"))
    rows = dealt(ranged, key, "editorial_owner", "__part").join(first, (F.col(key) == F.col("__key")) & (F.col("editorial_owner") == F.col("__owner")) & (F.col("__part") == F.col("__first")) & (F.col("tier") == "trusted"), "left")
    rows = rows.withColumn("__one", F.coalesce(at == F.col("__at"), F.lit(False)).cast("int")).select(*candidates.columns, "__part", "__one")
    rows = dealt(rows, key, "__part").join(carried, (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__p")))
    here = Window.partitionBy("__part", key).orderBy(*order)
    upto, earlier = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    owners = lambda w: F.col("__owners") + F.coalesce(F.sum("__one").over(w), F.lit(0))
    had = lambda w: F.col("__had") | F.coalesce(F.max(strong).over(w), F.lit(False))
    word = lambda w: F.when(had(w), "high").when(owners(w) >= 2, "medium").otherwise("low")
    out = rows.select(*candidates.columns, owners(upto).alias("owners"), word(upto).alias("running_confidence"), word(earlier).alias("__was"))
    return out.withColumn("opens", (F.col("running_confidence") != "low") & (F.col("__was") == "low")).drop("__was")


def high_risk(level: Column, event_type: Column, risky_types: tuple[str, ...], flags: Column | None = None) -> Column:
    """An event of level L1, of a risky type, or with risk flags."""
    out = F.coalesce(level == "L1", F.lit(False)) | event_type.isin(*risky_types)
    return out | (F.size(flags) > 0) if flags is not None else out


def review_outcome(risky: Column, first: Column, second: Column, reviewer: Column) -> Column:
    """not_required without risk; approved where both reviews agreed and a reviewer is named; else pending."""
    return F.when(~risky, "not_required").when(first & second & reviewer, "approved").otherwise("pending")


def publication_state(occurred_at: Column, baseline: Column) -> Column:
    """backfill before the baseline; first otherwise, also without a date."""
    return F.when(occurred_at < baseline, "backfill").otherwise("first")


def is_public() -> Column:
    return (F.col("evidence_confidence") != "low") & F.col("level").isNotNull() & F.col("review_status").isin("approved", "not_required")


def is_daily() -> Column:
    return is_public() & F.col("publication_state").isin("first", "update") & F.col("level").isin("L1", "L2")


def is_released() -> Column:
    return F.col("released_at").isNotNull() | (F.col("publication_state") == "backfill")


def manual_review(events: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events after decisions(event_id, decision), and the decisions that could not be applied.

    approve applies to pending events only; reject to any; an id may be the event's own or one of its legacy_ids.
    """
    names = events.select("event_id", "review_status", F.explode(F.array_union(F.array(F.col("event_id").cast("string")), F.col("legacy_ids"))).alias("name"))
    found = decisions.withColumn("name", F.col("event_id").cast("string")).drop("event_id").join(names, "name", "left")
    ok = F.col("event_id").isNotNull() & ((F.col("decision") == "reject") | ((F.col("decision") == "approve") & (F.col("review_status") == "pending")))
    bad = found.where(~F.coalesce(ok, F.lit(False))).select("name", "decision")
    good = found.where(ok).groupBy("event_id").agg(F.max(F.when(F.col("decision") == "reject", "rejected").otherwise("approved")).alias("decided"))
    out = events.join(good, "event_id", "left").withColumn("review_status", F.coalesce("decided", "review_status")).drop("decided")
    return out, bad


def release(events: DataFrame, gate_open: bool, now: Column) -> DataFrame:
    """Stamps released_at where an event is public and not yet released and the gate is open; nothing is withdrawn."""
    stamp = F.when(F.lit(gate_open) & is_public() & F.col("released_at").isNull(), now).otherwise(F.col("released_at"))
    return events.withColumn("released_at", stamp)


def current_issue(events: DataFrame) -> DataFrame:
    """Ids of released events that came first or were updated."""
    return events.where(F.col("released_at").isNotNull() & F.col("publication_state").isin("first", "update")).select("event_id")


def changed_revisions(revisions: DataFrame) -> DataFrame:
    """revisions(event_id, rev_no, fact_hash) with their state: first, update (facts differ from the one before), duplicate."""
    w = Window.partitionBy("event_id").orderBy("rev_no")
    before = F.lag("fact_hash").over(w)
    state = F.when(F.row_number().over(w) == 1, "first").when(before.eqNullSafe(F.col("fact_hash")), "duplicate").otherwise("update")
    return revisions.withColumn("state", state)
