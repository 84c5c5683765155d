"""The ledger merged batch by batch, at the cost of what a batch touches.

Two tables in a bucketed store (operators/store.py): `keys` says to which component a key belongs, `members` holds the components themselves:
their evidence and the candidates that wait. A batch looks up its keys, takes the components they name, joins them with its candidates into new
components (union-find over the batch's hubs and the components that its keys name, by joins), folds those, and adds what changed as a run. A component that was touched is written whole
under its new name with a mark of the batch, and its rows of earlier batches count no more; components that no key names are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import merge
from tallyloom.operators.resolve import identity_components
from tallyloom.operators.store import Store
from tallyloom.session import discard, stored

EDGES = ("event_id", "event_ord", "fingerprint", "facts", "evidence_id", "url", "legacy_id", "owner", "tier", "in_scope")
_WAITING = "candidate_id string, seq bigint, fingerprint string, evidence_id string, url string, legacy_id string, verdict_event string, owner string, tier string, in_scope boolean, day string, has_cursor boolean, facts string"
MEMBERS = f"component bigint, at bigint, kind string, event_id string, event_ord bigint, {_WAITING}"
KEYS = "key bigint, component bigint, at bigint"


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def latest_keys(keys: DataFrame) -> DataFrame:
    """The last component of each key."""
    return keys.groupBy("key", "bucket").agg(F.max(F.struct("at", "component")).alias("m")).select("key", "m.component", "m.at", "bucket")


def valid_members(members: DataFrame) -> DataFrame:
    """The rows of each component as of its last mark; a component that went into another has its mark and no rows."""
    marks = members.where("kind = 'mark'").groupBy(F.col("component").alias("of")).agg(F.max("at").alias("last"))
    return members.join(marks, (F.col("component") == F.col("of")) & (F.col("at") == F.col("last"))).drop("of", "last")


RULES = {"keys": latest_keys, "members": valid_members}


class IncrementalLedger:
    """The ledger under a store. `touched` says of the last batch how many rows of members and keys it read and wrote."""

    def __init__(self, store: Store, baseline: str) -> None:
        self.store, self.baseline = store, baseline
        self.touched: dict[str, int] = {}

    def _of(self, key: str):
        return F.pmod(F.col(key), F.lit(self.store.buckets)).cast("int")

    def _buckets(self, df: DataFrame, key: str) -> list[int]:
        """The buckets that some rows fall into: as many numbers as there are buckets, at most."""
        return [r[0] for r in df.select(self._of(key)).distinct().collect()]

    def _empty(self, schema: str) -> DataFrame:
        return self.store.spark.createDataFrame([], schema)

    def _found(self, base: dict | None, wanted: DataFrame) -> DataFrame:
        """The valid rows of the components wanted, from the buckets they fall into."""
        rows = self.store.read(base, "members", self._buckets(wanted, "component")) if base else None
        if rows is None:
            return self._empty(MEMBERS)
        return valid_members(rows.join(wanted, "component", "left_semi")).select(*_columns(MEMBERS))

    def write(self, batch: DataFrame, number: int) -> None:
        """Merge a batch of candidates (the columns merge.READ). A batch that was committed already is passed over."""
        base = self.store.latest()
        if base and base["run"] >= number:
            return
        batch = stored(merge.hubbed_candidates(batch), "batch")
        hubs = batch.select("hub").distinct().select("hub", merge.named("component", "hub").alias("key"))
        met = stored(self._met(base, batch.select("hub", F.explode("keys").alias("key")).unionByName(hubs)), "met")
        old = stored(met.where("component is not null").select("component").distinct(), "old")
        parts = stored(self._linked(batch, met), "parts")
        named = lambda df, by: df.join(parts, F.col(by) == F.col("node"), "left").withColumn("to", F.coalesce("to", by)).drop("node")
        members = stored(named(self._found(base, old), "component"), "members")
        seeds, waited = (members.where(F.col("kind") == kind).withColumnsRenamed({"component": "was", "to": "component"}) for kind in ("evidence", "waiting"))
        fresh = named(batch.drop("keys"), "hub").drop("hub").withColumnRenamed("to", "component")
        candidates = fresh.unionByName(waited.select(*merge.READ, "component"))
        rows = seeds.select(*EDGES, "component").withColumn("kind", F.lit(0)).unionByName(candidates.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        out = stored(merge.fold_components(rows, self.baseline), "merged")

        done = out.where("row_kind = 'candidate'").select("candidate_id", F.col("event_id").alias("into"), "outcome", "by_seq", "by_candidate", "place")
        judged = stored(candidates.join(done, "candidate_id"), "judged")
        taken = judged.where("into is not null")
        # evidence in the order in which it came: by batch, then by place in its component (components share no key)
        order = F.row_number().over(Window.partitionBy("component").orderBy("by_seq", "by_candidate", "place"))
        new = taken.withColumn("event_ord", F.lit(number + 1).cast("bigint") * (1 << 32) + order)
        begun = taken.where(F.col("outcome").isin("first", "backfill")).select(F.col("into").alias("event_id"), F.col("fingerprint").alias("name"))
        names = seeds.groupBy("event_id").agg(F.min("fingerprint").alias("name")).unionByName(begun)
        states = out.where("row_kind = 'event'").select("event_id", F.col("facts").alias("now"))
        edges = seeds.select(*EDGES, "component").unionByName(new.drop("event_id").withColumnRenamed("into", "event_id").select(*EDGES, "component"))
        edges = edges.join(names, "event_id").join(states, "event_id").drop("fingerprint", "facts").withColumnsRenamed({"name": "fingerprint", "now": "facts"})
        waiting = judged.where("outcome = 'pending'").select(*merge.READ, "component")

        here = stored(judged.select("component").unionByName(members.select(F.col("to").alias("component"))).distinct(), "here")
        marks = here.unionByName(old).distinct().withColumn("kind", F.lit("mark"))
        state = marks.unionByName(edges.withColumn("kind", F.lit("evidence")), allowMissingColumns=True).unionByName(waiting.withColumn("kind", F.lit("waiting")), allowMissingColumns=True)
        state = state.withColumn("at", F.lit(number).cast("bigint")).select(*[F.col(c).cast(k).alias(c) for c, k in (f.split() for f in MEMBERS.split(", "))]).withColumn("bucket", self._of("component"))
        # the keys of rows that stay in their component stand in the store already; a component's name has a key too, so that no other takes the name
        held = taken.withColumn("fingerprint", F.when(F.col("outcome").isin("first", "backfill"), F.col("fingerprint"))).withColumn("event_id", F.col("into"))
        keyed = [merge.row_keys(x, "component", event) for x, event in ((held, "event_id"), (judged.where("outcome = 'pending'"), "verdict_event"), (seeds.where("was <> component"), "event_id"))]
        names_now = here.select("component", merge.named("component", "component").alias("key"))
        for more in keyed:
            names_now = names_now.unionByName(more)
        names_now = names_now.distinct().withColumn("at", F.lit(number).cast("bigint")).withColumn("bucket", self._of("key")).select("key", "component", "at", "bucket")
        history = out.where("row_kind = 'candidate'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(number)).withColumn("bucket", F.lit(0))
        made = self.store.commit(base, number, {"members": state, "keys": names_now, "history": history}, RULES)
        written = marks.count() + members.where("kind = 'evidence'").count() + judged.where("into is not null or outcome = 'pending'").count()
        self.touched = {"known keys": met.where("component is not null").count(), "members read": members.count(), "members written": written, "version": made["version"]}
        discard(batch, met, old, parts, members, out, judged, here)

    def _met(self, base: dict | None, pairs: DataFrame) -> DataFrame:
        """key, low, high, component for pairs(hub, key): the least and greatest hub that has the key, and the component that has it already.

        A key that one hub has and no component is left out: it links nothing. Batch and table meet in one sum by key.
        """
        known = self.store.read(base, "keys", self._buckets(pairs, "key")) if base else None
        rows = pairs.select("key", "hub", F.lit(None).cast("struct<at: bigint, component: bigint>").alias("last"))
        if known is not None:
            rows = rows.unionByName(known.select("key", F.lit(None).cast("bigint").alias("hub"), F.struct("at", "component").alias("last")))
        found = rows.groupBy("key").agg(F.min("hub").alias("low"), F.max("hub").alias("high"), F.max("last").alias("last"))
        return found.select("key", "low", "high", "last.component").where("low is not null and (low <> high or component is not null)")

    def _linked(self, batch: DataFrame, met: DataFrame) -> DataFrame:
        """node, to: the component that hubs and older components fall into which share keys with others; those not named stay by themselves."""
        shared, one = met.where("low <> high"), met.where("low = high and component <> low")
        hubs = batch.select(F.col("hub").alias("node"), F.explode("keys").alias("key")).join(shared.select("key"), "key").select("node", "key")
        links = hubs.unionByName(one.select(F.col("low").alias("node"), "key")).unionByName(shared.unionByName(one).where("component is not null").select(F.col("component").alias("node"), "key"))
        return identity_components(links).withColumnRenamed("component", "to")

    def _all(self, kind: str, manifest: dict | None) -> DataFrame:
        rows = self.store.read(manifest or self.store.latest(), "members")
        return (self._empty(MEMBERS) if rows is None else valid_members(rows)).where(F.col("kind") == kind)

    def evidence(self, manifest: dict | None = None) -> DataFrame:
        """The ledger's evidence, each piece with its event's fingerprint and facts."""
        return self._all("evidence", manifest).select(*EDGES)

    def waiting(self, manifest: dict | None = None) -> DataFrame:
        return self._all("waiting", manifest).select(*merge.READ)
