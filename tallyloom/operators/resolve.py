"""Resolution: which event a candidate belongs to, which source a URL comes from, what is already known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import nfkc
from tallyloom.session import discard, stored

#: Order in which a candidate's keys decide: same evidence, same URL, shared legacy id, equal fingerprint, a matcher's verdict.
KEY_ORDER = ("evidence", "url", "legacy", "fingerprint", "verdict")


def resolve_events(candidate_keys: DataFrame, event_keys: DataFrame) -> DataFrame:
    """candidate_id, event_id, tier: the first event that shares the strongest key.

    candidate_keys(candidate_id, kind, key) and event_keys(event_id, event_ord, kind, key): each key is reduced to its first event before
    one equi-join over all kinds of key, so a key that many events share adds no rows; then the least (tier, ledger order) of a candidate.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KEY_ORDER]), F.col("kind"))
    first = event_keys.groupBy("kind", "key").agg(F.min(F.struct("event_ord", "event_id")).alias("e")).select("kind", "key", "e.event_ord", "e.event_id")
    hits = candidate_keys.join(first, ["kind", "key"]).groupBy("candidate_id").agg(F.min(F.struct(rank.alias("rank"), "event_ord", "event_id")).alias("m"))
    return hits.select("candidate_id", F.col("m.event_id").alias("event_id"), F.element_at(F.array(*[F.lit(k) for k in KEY_ORDER]), F.col("m.rank").cast("int")).alias("tier"))


def recall_events(candidates: DataFrame, events: DataFrame, days: int = 45, k: int = 8) -> DataFrame:
    """candidate_id, event_id, rank: up to k events of the company with equal product or type and a date near by (or none).

    Equi-joins on (company, product) or (company, type) and a span of `days`: a dated candidate looks into its own span and the two beside
    it, so that a large company's candidates meet events near by only. Rows without a date meet those of their company apart.
    """
    near = F.abs(F.datediff("c_day", "e_day")) <= days
    span = lambda day: F.floor(F.unix_date(day) / days)
    c = candidates.select("candidate_id", "company", "product", "event_type", F.col("day").alias("c_day"))
    e = events.select("event_id", "company", "product", "event_type", F.col("day").alias("e_day"), "level_rank", "total")
    cols = ["candidate_id", "event_id", "level_rank", "total", "e_day"]
    c_near = c.where("c_day is not null").withColumn("span", F.explode(F.array(*[span("c_day") + i for i in (-1, 0, 1)])))
    e_near = e.where("e_day is not null").withColumn("span", span("e_day"))
    found = []
    for own, other in (("product", "event_type"), ("event_type", "product")):
        found.append(c_near.drop(other).join(e_near.drop(other), ["company", own, "span"]).where(near))
        found.append(c.where("c_day is null").drop(other).join(e.drop(other), ["company", own]))
        found.append(c.where("c_day is not null").drop(other).join(e.where("e_day is null").drop(other), ["company", own]))
    both = found[0].select(cols)
    for more in found[1:]:
        both = both.unionByName(more.select(cols))
    both = both.distinct()
    order = Window.partitionBy("candidate_id").orderBy(F.desc("level_rank"), F.desc("total"), F.desc_nulls_last("e_day"), "event_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("candidate_id", "event_id", "rank")


def host_suffixes(host: Column) -> Column:
    """A host and all its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def attach_sources(urls: DataFrame, registry: DataFrame) -> DataFrame:
    """urls(url_id, host) with source_id and tier: a source whose host is equal, above or below; the best tier, then registry order.

    Both sides are exploded to their parent domains and joined by equality; hosts without a source become discovery sources of
    their own.
    """
    rank = {"authoritative": 3, "trusted": 2, "discovery": 1}
    tier = F.coalesce(*[F.when(F.col("tier") == t, n) for t, n in rank.items()])
    hosts = urls.select("host").distinct()
    reg = registry.select("source_id", "tier", F.col("host").alias("r_host"), tier.alias("t"))
    below = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("r_host")).join(reg, "r_host")
    above = reg.select("source_id", "tier", "t", F.explode(host_suffixes(F.col("r_host"))).alias("host")).join(hosts, "host")
    best = below.select("host", "source_id", "tier", "t").union(above.select("host", "source_id", "tier", "t")).groupBy("host").agg(F.max(F.struct("t", (-F.col("source_id")).alias("o"), "source_id", "tier")).alias("b"))
    return urls.join(best, "host", "left").select("url_id", "host", F.col("b.source_id").alias("source_id"), F.coalesce("b.tier", F.lit("discovery")).alias("tier"))


def slug(x: Column) -> Column:
    """Lower case, letters and digits, a hyphen for whatever stands between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(nfkc(x)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def press_wire(attached: DataFrame, wire: str, company: Column) -> DataFrame:
    """attached(source_id, editorial_owner, ...) where a company's release on the wire counts as the company's: the wire's id with its slug, the company as owner."""
    own = F.col("source_id") == wire
    return attached.withColumns({"source_id": F.when(own, F.concat_ws(":", "source_id", slug(company))).otherwise(F.col("source_id")), "editorial_owner": F.when(own, company).otherwise(F.col("editorial_owner"))})


def unknown(hits: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """hits whose key is not null and not in known(key)."""
    return hits.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")


def select_new(links: DataFrame, known: DataFrame, window: int = 12, most: int = 8) -> DataFrame:
    """Of each source's first `window` links by position, those not known, `most` of them at most."""
    first = Window.partitionBy("source_id").orderBy("position", "url")
    head = links.withColumn("n", F.row_number().over(first)).where(F.col("n") <= window)
    fresh = head.join(known.select("url").distinct(), "url", "left_anti")
    return fresh.withColumn("m", F.row_number().over(first)).where(F.col("m") <= most).drop("n", "m")


def shortcut(candidates: DataFrame, event_evidence: DataFrame, events: DataFrame, revisions: DataFrame) -> DataFrame:
    """Candidates whose evidence already belongs to an event, with that event's type and latest facts."""
    latest = revisions.groupBy("event_id").agg(F.max_by("facts", "rev_no").alias("facts"), F.max("rev_no").alias("rev_no"))
    owner = event_evidence.groupBy("evidence_id").agg(F.min("event_id").alias("event_id"))
    return candidates.join(owner, "evidence_id").join(events.select("event_id", "event_type"), "event_id").join(latest, "event_id", "left")


def ordered_sources(frame: DataFrame, ids: str, sources: DataFrame, key: str) -> DataFrame:
    """key and its sources in the order of the id array; unknown ids are dropped."""
    flat = frame.select(key, F.posexplode(ids).alias("pos", "source_id")).join(sources, "source_id")
    packed = F.array_sort(F.collect_list(F.struct("pos", "source_id", "title")))
    return flat.groupBy(key).agg(F.transform(packed, lambda x: x["title"]).alias("titles"))


def identity_components(keys: DataFrame) -> DataFrame:
    """node, component for keys(node, key): nodes that share a key, over any number of steps, fall into one component (its least node).

    Each round takes the least component over each key and back; both steps are partial aggregations, so a key that many nodes
    share is summed, not paired. Rounds go on until nothing moves; a round's table goes when the next one stands.
    """
    keys = stored(keys.select("node", "key").distinct(), "keys")
    now, old = keys.select("node").distinct().withColumn("component", F.col("node")), None
    while True:
        by_key = keys.join(now, "node").groupBy("key").agg(F.min("component").alias("component"))
        step = keys.join(by_key, "key").groupBy("node").agg(F.min("component").alias("low"))
        joined = step.join(now, "node")
        ends = now.select(F.col("node").alias("low"), F.col("component").alias("beyond"))
        new = stored(joined.join(ends, "low", "left").select("node", F.least("low", F.coalesce("beyond", "low")).alias("new"), "component"), "components")
        moved = not new.where("new <> component").isEmpty()
        discard(*([old] if old is not None else []))
        now, old = new.select("node", F.col("new").alias("component")), new
        if not moved:
            discard(keys)
            return now


def hub_components(rows: DataFrame) -> DataFrame:
    """hub, component for rows(hub, keys) whose hub shares a key with another hub, over any number of steps; other hubs are components of their own.

    A row's hub is one of its keys. A key is judged by the least and greatest hub of its rows, so the rounds meet only keys that link two hubs.
    """
    pairs = rows.select("hub", F.explode("keys").alias("key"))
    links = stored(pairs.groupBy("key").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).where("low <> high").select("key"), "links")
    out = identity_components(pairs.join(links, "key").select(F.col("hub").alias("node"), "key"))
    discard(links)
    return out.withColumnRenamed("node", "hub")
