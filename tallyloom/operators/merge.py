"""The ledger merge: candidates folded, in order, into events.

Rows that can touch the same event share a key (evidence, URL, legacy id, fingerprint, or a matcher's verdict), so identity components
fold independently. A component's rows stream through its task in order of seq, and each outcome leaves as soon as it is final; what is
held is the component's events and the candidates that wait at the gate, not its rows. A component is one task's work; candidate ids
are distinct.

Fold of one candidate, first rule that fits:
no date and no new-content cursor: pending, date_verification; matched event, new evidence and different facts: update if the support
set's confidence is above low, else pending, evidence_gate; matched event otherwise: duplicate, evidence attached; no event: first, or
backfill before the baseline, if the support set's confidence is above low, else pending, evidence_gate. The support set is the
candidate and the waiting ones of equal fingerprint and equal, known facts; those are promoted with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.resolve import hub_components
from tallyloom.session import dealt

OUTCOME = "component bigint, row_kind string, candidate_id string, event_id string, outcome string, stage string, evidence_confidence string, facts string, n_evidence int, by_seq bigint, by_candidate string, place int"
SEED = "event_id string, event_ord bigint, fingerprint string, facts string, evidence_id string, url string, legacy_id string, owner string, tier string, in_scope boolean"
#: Columns of a candidate that the fold reads.
READ = ("candidate_id", "seq", "fingerprint", "evidence_id", "url", "legacy_id", "verdict_event", "owner", "tier", "in_scope", "day", "has_cursor", "facts")


def _confidence(evidence: dict[str, tuple[str, str, bool]]) -> str:
    """Of evidence id -> (owner, tier, in scope)."""
    if any(tier == "authoritative" and scope for _, tier, scope in evidence.values()):
        return "high"
    return "medium" if len({owner for owner, tier, _ in evidence.values() if tier == "trusted"}) >= 2 else "low"


@dataclass
class _Event:
    event_id: str
    fingerprint: str
    facts: str | None
    evidence: dict[str, tuple[str, str, bool]] = field(default_factory=dict)
    state: str = "first"


class _Ledger:
    """The events of one component and its waiting candidates."""

    def __init__(self, baseline: str) -> None:
        self.baseline, self.events = baseline, {}
        self.by_key: dict[tuple[str, str], str] = {}
        self.waiting: dict[tuple[str, str], list[dict]] = {}

    def seed(self, row: dict) -> None:
        e = self.events.setdefault(row["event_id"], _Event(row["event_id"], row["fingerprint"], row["facts"], state="seed"))
        self._attach(e, row)

    def _attach(self, event: _Event, row: dict) -> None:
        event.evidence[row["evidence_id"]] = (row["owner"], row["tier"], bool(row["in_scope"]))
        for kind, key in (("evidence", row["evidence_id"]), ("url", row["url"]), ("legacy", row["legacy_id"]), ("fingerprint", event.fingerprint)):
            if key is not None:
                self.by_key.setdefault((kind, key), event.event_id)

    def _match(self, row: dict) -> _Event | None:
        for kind, column in (("evidence", "evidence_id"), ("url", "url"), ("legacy", "legacy_id"), ("fingerprint", "fingerprint")):
            found = self.by_key.get((kind, row[column]))
            if found is not None:
                return self.events[found]
        return self.events.get(row["verdict_event"])

    def left(self) -> list[dict]:
        """The candidates that still wait."""
        return [r for group in self.waiting.values() for r in group]

    def fold(self, row: dict) -> list[tuple[dict, str | None, str, str | None]]:
        """(candidate, event id, outcome, stage) of the candidate, and of those promoted with it; none for one that waits."""
        if row["day"] is None and not row["has_cursor"]:
            return [(row, None, "pending", "date_verification")]
        event = self._match(row)
        group = (row["fingerprint"], row["facts"]) if row["facts"] is not None else None
        support = [*(self.waiting.get(group, []) if group else []), row]
        weight = _confidence({r["evidence_id"]: (r["owner"], r["tier"], bool(r["in_scope"])) for r in support})
        changed = event is not None and row["evidence_id"] not in event.evidence and row["facts"] is not None and row["facts"] != event.facts
        if event is not None and not changed:
            self._attach(event, row)
            return [(row, event.event_id, "duplicate", None)]
        if weight == "low":
            if group:
                self.waiting.setdefault(group, []).append(row)
                return []
            return [(row, None, "pending", "evidence_gate")]
        if group:
            self.waiting.pop(group, None)
        if event is None:
            name = "evt_" + hashlib.sha256(f"{row['candidate_id']}\n{row['fingerprint']}".encode()).hexdigest()[:24]
            outcome = "backfill" if row["day"] is not None and row["day"] < self.baseline else "first"
            event = self.events[name] = _Event(name, row["fingerprint"], row["facts"], state=outcome)
        else:
            outcome, event.facts, event.state = "update", row["facts"], "update"
        for r in support:
            self._attach(event, r)
        return [(r, event.event_id, outcome if r is row else "promoted", None) for r in support]


def merge_ledger(candidates: DataFrame, seeds: DataFrame, baseline: str) -> DataFrame:
    """Rows of two kinds: "candidate" (its last outcome, and which row of which seq brought it, at which place) and "event" (its state,
    confidence, facts and number of evidences).

    candidates: the columns READ; seeds: (event_id, fingerprint, facts, evidence_id, url, legacy_id, owner, tier, in_scope), one for each
    piece of evidence of the events that are in the ledger already, in ledger order by event_ord.
    """
    rows = _rows_of(candidates, seeds)
    parts = hub_components(rows)
    return fold_components(rows.join(parts, "hub", "left").withColumn("component", F.coalesce("component", "hub")), baseline)


def _own_keys(*more: Column) -> Column:
    """The keys of a row, its fingerprint's first."""
    return F.array_compact(F.array(named("fp", "fingerprint"), named("evd", "evidence_id"), named("url", "url"), named("leg", "legacy_id"), *more))


def row_keys(df: DataFrame, name: str, event: str) -> DataFrame:
    """name, key for each key of the rows, that of the event in the column `event` among them."""
    return df.select(name, F.explode(_own_keys(named("evt", event))).alias("key"))


def named(kind: str, name: str) -> Column:
    """A key or node as a number. Two names that share one fall into one component, which changes nothing: the fold compares names."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(F.lit(kind), F.col(name)))


def _hubbed(df: DataFrame, node: Column, event: str) -> DataFrame:
    """df with its keys and its hub, the first of these; a row without any is its own hub."""
    df = df.withColumn("keys", _own_keys(named("evt", event)))
    return df.withColumn("hub", F.coalesce(F.try_element_at("keys", F.lit(1)), node))


def hubbed_candidates(candidates: DataFrame) -> DataFrame:
    """The columns READ of candidates, their keys and their hub."""
    return _hubbed(candidates.select(*READ), named("c", "candidate_id"), "verdict_event")


def _rows_of(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidates and evidence with their keys and their hub."""
    seeds = _hubbed(seeds.withColumn("kind", F.lit(0)), named("e", "event_id"), "event_id")
    return seeds.unionByName(hubbed_candidates(candidates).withColumn("kind", F.lit(1)), allowMissingColumns=True)


def fold_components(rows: DataFrame, baseline: str) -> DataFrame:
    """The outcome of rows (kind 0: seeds, 1: candidates) whose `component` is known."""
    columns = ["component", "kind", "event_ord", "event_id", *READ]
    ordered = dealt(rows.select(*columns), "component").sortWithinPartitions("component", "kind", "event_ord", "seq", "candidate_id", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ledger = None, _Ledger(baseline)

        def flush() -> list[tuple]:
            done = [(now, "candidate", r["candidate_id"], None, "pending", "evidence_gate", None, None, None, None, None, None) for r in ledger.left()]
            return done + [(now, "event", None, e.event_id, e.state, None, _confidence(e.evidence), e.facts, len(e.evidence), None, None, None) for e in ledger.events.values()]

        names = [x.split(" ")[0] for x in OUTCOME.split(", ")]
        for frame in frames:
            out: list[tuple] = []
            fields = list(frame)
            columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in fields]
            for values in zip(*columns, strict=True):
                row = dict(zip(fields, values, strict=True))
                if row["component"] != now:
                    if now is not None:
                        out += flush()
                    now, ledger = row["component"], _Ledger(baseline)
                if row["kind"] == 0:
                    ledger.seed(row)
                else:
                    out += [(now, "candidate", r["candidate_id"], event_id, outcome, stage, None, None, None, row["seq"], row["candidate_id"], i) for i, (r, event_id, outcome, stage) in enumerate(ledger.fold(row))]
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame(flush(), columns=names)

    return ordered.mapInPandas(run, OUTCOME)


def merge_metrics(merged: DataFrame) -> DataFrame:
    """Candidates by outcome and stage."""
    return merged.where("row_kind = 'candidate'").groupBy("outcome", "stage").agg(F.count(F.lit(1)).alias("n"))


def commit(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """All tables of a run, or none: each goes to a folder of the run, then one manifest row makes them current. Rerunning a run replaces it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    spark.createDataFrame([(run_id, sorted(tables))], "run_id string, tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/run_id_part={run_id}")


def last_run(spark, root: str, before: str | None = None) -> str | None:
    """The last run in the manifest (before the given one); None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    runs = spark.read.parquet(f"{root}/_manifest")
    return (runs if before is None else runs.where(F.col("run_id") < before)).agg(F.max("run_id")).first()[0]


def current(spark, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """The table as of the last run in the manifest, or as of the given one."""
    return spark.read.parquet(f"{root}/{name}/run_id={run_id or last_run(spark, root)}")


def append_history(row: DataFrame, path: str) -> None:
    """One line of the run history."""
    row.coalesce(1).write.mode("append").json(path)
