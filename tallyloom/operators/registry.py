"""Checks of a source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import canonical_urls

TIERS = ("authoritative", "trusted", "discovery")


def registry_faults(sources: DataFrame, accounts: DataFrame, event_types: tuple[str, ...], account_type: str) -> DataFrame:
    """source_id, rule: each broken rule of a source once for each of its rows; a registry without rows here is valid.

    sources: source_id, editorial_owner, tier, type, url, event_types, enabled, poll_interval_hours. accounts: source_id, name, username;
    sources of account_type need at least one account, each with a name and a user name of its own.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    hours = F.col("poll_interval_hours")
    odd = F.exists("event_types", lambda t: ~F.coalesce(t.isin(*event_types), F.lit(False)))
    own = F.array_compact(F.array(
        F.when(empty("source_id"), "missing_id"), F.when(empty("editorial_owner"), "missing_owner"), F.when(~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)), "tier"), F.when(empty("type"), "missing_type"),
        F.when(F.col("event_types").isNull() | odd, "event_types"), F.when(F.col("enabled").isNull(), "enabled"), F.when(F.isnan(hours) | (hours <= 0) | (hours == float("inf")), "interval"),
        F.when((F.col("type") == account_type) & ~F.col("tier").eqNullSafe(F.lit("discovery")), "account_tier"),
    ))
    out = sources.select("source_id", F.explode(own).alias("rule"))
    out = out.unionByName(canonical_urls(sources.select("source_id", "url"), "url")[1].select("source_id", F.lit("url").alias("rule")))
    named = sources.where(~empty("source_id"))
    again = named.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("repeated_id").alias("rule"))
    kept = named.where(F.col("type") == account_type).select("source_id").distinct()
    none = kept.join(accounts, "source_id", "left_anti").select("source_id", F.lit("no_accounts").alias("rule"))
    held = accounts.join(kept, "source_id", "left_semi")
    bad = F.array_compact(F.array(F.when(empty("name"), "account_name"), F.when(~F.coalesce(F.col("username").rlike("^gh_[A-Za-z0-9]+$"), F.lit(False)), "account_username")))
    twice = held.where("username is not null").groupBy("source_id", "username").count().where("count > 1").select("source_id", F.lit("repeated_account").alias("rule"))
    for more in (again, none, held.select("source_id", F.explode(bad).alias("rule")), twice):
        out = out.unionByName(more)
    return out
