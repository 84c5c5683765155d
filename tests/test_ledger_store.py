"""The bucketed store and the ledger that is merged batch by batch in it; outcomes are held against a fold over plain lists."""

import hashlib
import os

import pytest

from tallyloom.operators import store
from tallyloom.operators.ledger_store import RULES, IncrementalLedger
from tallyloom.operators.store import Conflict, Store
from tests.test_merge import BASELINE, CAND, SEEDS, run, some_rows

NAMES = [c.split()[0] for c in CAND.split(", ")]


def confidence(records):
    if any(r["tier"] == "authoritative" and r["in_scope"] for r in records):
        return "high"
    return "medium" if len({r["owner"] for r in records if r["tier"] == "trusted"}) > 1 else "low"


class Lists:
    """Events and waiting candidates as lists that are searched from the front, one candidate at a time."""

    def __init__(self, seeds=()):
        self.events, self.links, self.waiting, self.outcomes = [], [], [], {}
        for event_id, _, fingerprint, facts, evidence, url, legacy, owner, tier, scope in sorted(seeds, key=lambda s: s[1]):
            event = next((e for e in self.events if e["id"] == event_id), None)
            if event is None:
                event = {"id": event_id, "fingerprint": fingerprint, "facts": facts, "evidence": []}
                self.events.append(event)
            self.attach(event, {"evidence_id": evidence, "url": url, "legacy_id": legacy, "owner": owner, "tier": tier, "in_scope": scope})

    def attach(self, event, record):
        event["evidence"] = [r for r in event["evidence"] if r["evidence_id"] != record["evidence_id"]] + [record]
        self.links += [("evidence_id", record["evidence_id"], event), ("url", record["url"], event), ("legacy_id", record["legacy_id"], event), ("fingerprint", event["fingerprint"], event)]

    def event_of(self, row):
        for kind in ("evidence_id", "url", "legacy_id", "fingerprint"):
            for other, value, event in self.links:
                if other == kind and value is not None and value == row[kind]:
                    return event
        return next((e for e in self.events if e["id"] == row["verdict_event"]), None)

    def take(self, row):
        self.outcomes[row["candidate_id"]] = ("pending", "date_verification" if row["day"] is None and not row["has_cursor"] else "evidence_gate", None)
        if self.outcomes[row["candidate_id"]][1] == "date_verification":
            return
        event = self.event_of(row)
        like = [w for w in self.waiting if row["facts"] is not None and (w["fingerprint"], w["facts"]) == (row["fingerprint"], row["facts"])]
        if event and (row["facts"] in (None, event["facts"]) or row["evidence_id"] in [r["evidence_id"] for r in event["evidence"]]):
            self.attach(event, row)
            self.outcomes[row["candidate_id"]] = ("duplicate", None, event["id"])
            return
        by_id = {r["evidence_id"]: r for r in [*like, row]}
        if confidence(list(by_id.values())) == "low":
            self.waiting.append(row)
            return
        kind = "update" if event else "backfill" if row["day"] is not None and row["day"] < BASELINE else "first"
        if event is None:
            event = {"id": "evt_" + hashlib.sha256(f"{row['candidate_id']}\n{row['fingerprint']}".encode()).hexdigest()[:24], "fingerprint": row["fingerprint"], "evidence": []}
            self.events.append(event)
        event["facts"] = row["facts"]
        for r in [*like, row]:
            self.attach(event, r)
            self.outcomes[r["candidate_id"]] = ("promoted" if r is not row else kind, None, event["id"])
        self.waiting = [w for w in self.waiting if w not in like]

    def batch(self, rows):
        """Rows in order, with those that waited before."""
        again = [w for w in self.rest] if hasattr(self, "rest") else []
        todo = sorted([*again, *(dict(zip(NAMES, r, strict=True)) for r in rows)], key=lambda r: (r["seq"], r["candidate_id"]))
        self.waiting = []
        for row in todo:
            self.take(row)
        self.rest = [r for r in todo if self.outcomes[r["candidate_id"]][0] == "pending"]


def test_the_fold_equals_a_search_of_lists(spark):
    for seed in (3, 6):
        rows = some_rows(seed)
        got, events = run(spark, rows, SEEDS)
        lists = Lists(SEEDS)
        lists.batch(rows)
        assert got == lists.outcomes
        assert {k: (e.facts, e.n_evidence) for k, e in events.items()} == {e["id"]: (e["facts"], len(e["evidence"])) for e in lists.events}


def batches(seed, n=3):
    rows = sorted(some_rows(seed), key=lambda r: (r[1], r[0]))
    cuts = [len(rows) * k // n for k in range(n + 1)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("most", [8, 1])
def test_batches_end_in_the_ledger_of_the_lists(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(store, "MOST_RUNS", most)
    ledger, lists = IncrementalLedger(Store(spark, str(tmp_path), 5), BASELINE), Lists()
    for n, part in enumerate(batches(5)):
        ledger.write(spark.createDataFrame(part, CAND), n)
        lists.batch(part)
    ledger.write(spark.createDataFrame(batches(5)[2], CAND), 2)  # a batch that was committed is passed over
    got = sorted((r.event_id, r.evidence_id, r.facts, r.fingerprint) for r in ledger.evidence().collect())
    want = sorted((e["id"], r["evidence_id"], e["facts"], e["fingerprint"]) for e in lists.events for r in e["evidence"])
    assert sorted(set(got)) == want
    assert {r.candidate_id for r in ledger.waiting().collect()} == {r["candidate_id"] for r in lists.rest}
    assert ledger.store.latest()["run"] == 2
    held = ledger.store.latest()["tables"]["members"]["buckets"]
    assert max(map(len, held.values())) <= most
    ledger.store.vacuum(1)
    assert sorted((r.event_id, r.evidence_id, r.facts, r.fingerprint) for r in ledger.evidence().collect()) == got
    assert len(ledger.store.versions()) == 1 and ledger.store.verified()["run"] == 2


def test_a_batch_touches_its_components_whatever_the_size_of_the_ledger(spark, tmp_path):
    def plain(i, seq, evd, **more):
        base = {"candidate_id": f"c{i}-{evd}", "seq": seq, "fingerprint": f"f{i}", "evidence_id": evd, "url": f"u{evd}", "legacy_id": None, "verdict_event": None, "owner": "o", "tier": "authoritative", "in_scope": True, "day": "2026-02-01", "has_cursor": False, "facts": "a"}
        return tuple((base | more)[c] for c in NAMES)

    seen = []
    for size in (50, 1500):
        ledger = IncrementalLedger(Store(spark, f"{tmp_path}/{size}", 16), BASELINE)
        ledger.write(spark.createDataFrame([plain(i, 0, f"e{i}") for i in range(size)], CAND), 0)
        # a second piece of evidence for two events, one that joins two more, and one that is new
        two = [plain(3, 1, "n3"), plain(4, 1, "n4"), plain(5, 1, "n5", url="ue6"), plain(9999, 1, "n9")]
        ledger.write(spark.createDataFrame(two, CAND), 1)
        seen.append({k: v for k, v in ledger.touched.items()})
        assert ledger.evidence().count() == size + 4 and ledger.evidence().where("fingerprint = 'f3'").count() == 2
    # four components of the ledger are read: their marks aside, a row of evidence each
    assert seen[0] == seen[1] and seen[0]["members read"] == 8


def rows_of(spark, *values):
    return spark.createDataFrame([(v, v % 4) for v in values], "x bigint, bucket int")


def values(frame):
    return sorted(r.x for r in frame.collect())


def test_two_writers_and_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path), 4)
    one = s.commit(None, 0, {"t": rows_of(spark, 1, 2, 3)})
    two = s.commit(one, 1, {"t": rows_of(spark, 4, 5)})
    with pytest.raises(Conflict):
        s.commit(one, 1, {"t": rows_of(spark, 6)})
    assert values(s.read(two, "t")) == [1, 2, 3, 4, 5] and values(s.read(one, "t")) == [1, 2, 3]
    assert values(s.read(two, "t", [1, 3])) == [1, 3, 5] and s.read(two, "none") is None and values(s.read(two, "t", [])) == []


def test_damaged_runs_are_refused_and_the_last_valid_version_stands(spark, tmp_path):
    s = Store(spark, str(tmp_path), 4)
    base = None
    for run_number in range(3):
        base = s.commit(base, run_number, {"t": rows_of(spark, *range(run_number * 10, run_number * 10 + 10))})
    assert s.verified()["version"] == 3
    last = base["tables"]["t"]["buckets"]["1"][-1][0]
    folder = tmp_path / "t" / f"run={last}" / "bucket=1"
    part = next(p for p in folder.iterdir() if p.suffix == ".parquet")
    whole = part.read_bytes()
    (folder / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(whole[: len(whole) // 2])
    assert s.damaged(base) == [("t", last)] and s.verified()["version"] == 2
    os.remove(part)
    assert s.verified()["version"] == 2
    rows_of(spark, 1).drop("bucket").write.mode("append").parquet(str(folder))  # readable, but not what was written
    assert s.damaged(base) == [("t", last)]
    (tmp_path / "_versions" / "0000000004.json").write_text('{"version": 4, "tab')  # a manifest that broke off
    assert s.latest()["version"] == 3 and s.commit(s.latest(), 3, {"t": rows_of(spark, 99)})["version"] == 5


def test_rules_keep_the_last_row_of_a_key(spark):
    keys = spark.createDataFrame([(1, 5, 0, 1), (1, 4, 1, 1), (2, 9, 0, 2)], "key bigint, component bigint, at bigint, bucket int")
    assert sorted((r.key, r.component) for r in RULES["keys"](keys).collect()) == [(1, 4), (2, 9)]


def _sure(i, fingerprint, evidence):
    row = {"candidate_id": f"c{i:03d}", "seq": i, "fingerprint": fingerprint, "evidence_id": evidence, "url": None, "legacy_id": None, "verdict_event": None, "owner": "o", "tier": "authoritative", "in_scope": True, "day": "2026-02-01", "has_cursor": False, "facts": "a"}
    return tuple(row[c] for c in NAMES)


def test_a_batch_writes_the_keys_that_it_brings_and_no_others(spark, tmp_path):
    ledger = IncrementalLedger(Store(spark, f"{tmp_path}/keys", 4), BASELINE)
    ledger.write(spark.createDataFrame([_sure(i, "f", f"e{i}") for i in range(60)], CAND), 0)
    ledger.write(spark.createDataFrame([_sure(60, "f", "e60")], CAND), 1)
    keys = ledger.store.read(ledger.store.latest(), "keys").where("at = 1")
    assert keys.count() <= 4 and ledger.evidence().count() == 61


def test_a_component_keeps_its_rows_where_another_could_take_its_name(spark, tmp_path):
    # the second fingerprint of each pair reaches the first one's event by its evidence, and stands in no key afterwards
    ledger = IncrementalLedger(Store(spark, f"{tmp_path}/names", 4), BASELINE)
    ledger.write(spark.createDataFrame([_sure(2 * p + k, f"{p}-{k}", f"e{p}") for p in range(8) for k in (0, 1)], CAND), 0)
    ledger.write(spark.createDataFrame([_sure(100 + p, f"{p}-1", f"x{p}") for p in range(8)], CAND), 1)
    got = sorted({(r.fingerprint, r.evidence_id) for r in ledger.evidence().collect()})
    assert got == sorted([(f"{p}-0", f"e{p}") for p in range(8)] + [(f"{p}-1", f"x{p}") for p in range(8)])


def test_the_sink_leaves_no_tables_of_its_own_behind(spark, tmp_path):
    from tallyloom.session import scratch_dir
    from tallyloom.streaming.streams import ledger_sink

    before = set(os.listdir(scratch_dir(spark)))
    ledger_sink(f"{tmp_path}/sink", BASELINE)(spark.createDataFrame([_sure(i, f"f{i % 3}", f"e{i}") for i in range(9)], CAND), 0)
    assert spark.read.parquet(f"{tmp_path}/sink/evidence").count() == 9
    assert not {x.split("-")[0] for x in set(os.listdir(scratch_dir(spark))) - before} & {"candidates", "merged", "judged", "ranges", "links", "keys"}
