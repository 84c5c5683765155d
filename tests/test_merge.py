"""Scenarios of the ledger merge, and its independence of partitioning."""

import random

from tallyloom.operators import merge

BASELINE = "2026-01-01"


def cand(i, seq, fp="f", evd=None, url=None, owner="o1", tier="authoritative", scope=True, day="2026-02-01", cursor=False, facts="a", verdict=None):
    return (f"c{i}", seq, fp, evd or f"e{i}", url or f"u{i}", None, verdict, owner, tier, scope, day, cursor, facts)


CAND = "candidate_id string, seq bigint, fingerprint string, evidence_id string, url string, legacy_id string, verdict_event string, owner string, tier string, in_scope boolean, day string, has_cursor boolean, facts string"
SEED = "event_id string, event_ord bigint, fingerprint string, facts string, evidence_id string, url string, legacy_id string, owner string, tier string, in_scope boolean"


def run(spark, candidates, seeds=(), parts=3):
    out = merge.merge_ledger(spark.createDataFrame(candidates, CAND).repartition(parts), spark.createDataFrame(list(seeds), SEED), BASELINE).collect()
    return {r.candidate_id: (r.outcome, r.stage, r.event_id) for r in out if r.row_kind == "candidate"}, {r.event_id: r for r in out if r.row_kind == "event"}


SEEDS = [("ev1", 1, "known", "a", "s1", "su", None, "o9", "authoritative", True)]


def test_scenarios_in_one_batch(spark):
    rows = [
        cand(1, 1, fp="first"), cand(2, 1, fp="back", day="2025-12-31"), cand(3, 1, fp="undated", day=None), cand(4, 1, fp="cursor", day=None, cursor=True),
        cand(5, 1, fp="known", url="su", evd="n5"), cand(6, 2, fp="other-name", url="su", evd="n6", facts="b"), cand(7, 3, fp="x", evd="s1", facts="z"),
        cand(8, 1, fp="two", tier="trusted", owner="A"), cand(9, 2, fp="two", tier="trusted", owner="B"),
        cand(10, 1, fp="clash", tier="trusted", owner="A", facts="80"), cand(11, 2, fp="clash", tier="trusted", owner="B", facts="90"),
        cand(12, 1, fp="nofacts", tier="trusted", owner="A", facts=None), cand(13, 2, fp="nofacts", tier="trusted", owner="B", facts=None),
        cand(14, 1, fp="disc", tier="discovery", verdict="ev1", facts="q"),
    ]
    got, events = run(spark, rows, SEEDS)
    assert [got[f"c{i}"][0] for i in (1, 2, 3, 4)] == ["first", "backfill", "pending", "first"]
    assert got["c3"][1] == "date_verification"
    assert got["c5"] == ("duplicate", None, "ev1") and got["c6"] == ("update", None, "ev1") and got["c7"] == ("duplicate", None, "ev1")
    assert got["c8"][0] == "promoted" and got["c9"][0] == "first" and got["c8"][2] == got["c9"][2]
    assert events[got["c9"][2]].evidence_confidence == "medium" and events[got["c9"][2]].n_evidence == 2
    assert [got[f"c{i}"][:2] for i in (10, 11, 12, 13, 14)] == [("pending", "evidence_gate")] * 5
    assert events["ev1"].facts == "b" and events["ev1"].n_evidence == 3


def test_trusted_update_needs_two_owners(spark):
    rows = [cand(1, 1, fp="known", tier="trusted", owner="A", facts="n"), cand(2, 2, fp="known", tier="trusted", owner="B", facts="n")]
    got, events = run(spark, rows, SEEDS)
    assert got["c1"][0] == "promoted" and got["c2"] == ("update", None, "ev1") and events["ev1"].n_evidence == 3


def test_partitioning_does_not_matter(spark):
    r = random.Random(8)
    rows = [cand(i, r.randint(0, 20), fp=f"p{r.randint(0, 12)}", evd=f"e{r.randint(0, 60)}", url=f"u{r.randint(0, 70)}", owner=r.choice("AB"), tier=r.choice(["trusted", "discovery", "authoritative"]), facts=r.choice(["1", "2", None])) for i in range(80)]
    one = run(spark, rows, SEEDS, 1)
    r.shuffle(rows)
    two = run(spark, rows, SEEDS, 7)
    assert one[0] == two[0] and set(one[1]) == set(two[1])


def test_commit_is_all_or_nothing_and_repeatable(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3)
    merge.commit({"a": df, "b": df}, root, "r1")
    merge.commit({"a": spark.range(5), "b": df}, root, "r2")
    merge.commit({"a": spark.range(5), "b": df}, root, "r2")
    assert merge.current(spark, root, "a").count() == 5 and merge.current(spark, root, "b").count() == 3
    spark.range(9).write.parquet(f"{root}/a/run_id=r3")  # a run that broke off before its manifest row
    assert merge.current(spark, root, "a").count() == 5


def plain_fold(rows, seeds):
    """All candidates in order against one list of events, without components."""
    ledger, out = merge._Ledger(BASELINE), {}
    for s in sorted(seeds, key=lambda s: s[1]):
        ledger.seed(dict(zip(SEED.replace(" string", "").replace(" bigint", "").replace(" boolean", "").split(", "), s, strict=True)))
    names = [c.split(" ")[0] for c in CAND.split(", ")]
    for row in sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: (r["seq"], r["candidate_id"])):
        for r, event, outcome, stage in ledger.fold(row):
            out[r["candidate_id"]] = (outcome, stage, event)
    for r in ledger.left():
        out[r["candidate_id"]] = ("pending", "evidence_gate", None)
    return out, {e.event_id: (e.state, e.facts, len(e.evidence)) for e in ledger.events.values()}


def some_rows(seed):
    r = random.Random(seed)
    return [cand(i, r.randint(0, 40), fp=f"p{r.randint(0, 25)}", evd=f"e{r.randint(0, 200)}", url=f"u{r.randint(0, 200)}", owner=r.choice("AB"), tier=r.choice(["trusted", "discovery", "authoritative"]), facts=r.choice(["1", "2", None]), day=r.choice(["2026-02-01", "2025-02-01", None])) for i in range(150)]


def test_components_fold_as_one_plain_list_does(spark):
    for seed in (3, 4):
        rows = some_rows(seed)
        got, events = run(spark, rows, SEEDS)
        want, known = plain_fold(rows, SEEDS)
        assert got == want
        assert {k: (e.outcome, e.facts, e.n_evidence) for k, e in events.items()} == known


def test_a_stream_of_batches_ends_in_the_same_ledger_and_can_be_run_again(spark, tmp_path):
    from tallyloom.streaming import streams

    rows = sorted(some_rows(5), key=lambda r: (r[1], r[0]))
    write = streams.ledger_sink(str(tmp_path), BASELINE)
    parts = [spark.createDataFrame(p, CAND) for p in (rows[:60], rows[60:110], rows[110:])]
    for n, p in enumerate(parts):
        write(p, n)
    edges = lambda: sorted((r.event_id, r.evidence_id, r.facts) for r in merge.current(spark, str(tmp_path), "evidence").collect())
    once = edges()
    write(parts[2], 2)
    assert edges() == once
    (tmp_path / "evidence" / "run_id=0000000009").mkdir()  # a run that broke off before its manifest row
    assert edges() == once
    ledger, waits = merge._Ledger(BASELINE), []
    for part in (rows[:60], rows[60:110], rows[110:]):  # those that wait are tried again with each batch
        ledger.waiting, outcome = {}, {}
        names = [c.split(" ")[0] for c in CAND.split(", ")]
        batch = sorted([*waits, *(dict(zip(names, r, strict=True)) for r in part)], key=lambda r: (r["seq"], r["candidate_id"]))
        for row in batch:
            outcome |= {r["candidate_id"]: o for r, _, o, _ in ledger.fold(row)}
        waits = [r for r in batch if outcome.get(r["candidate_id"], "pending") == "pending"]
    assert {e for e, _, _ in once} == set(ledger.events)
    for k, e in ledger.events.items():
        own = [x for x in once if x[0] == k]
        assert {x[1] for x in own} == set(e.evidence) and {x[2] for x in own} == {e.facts}
    assert {r.candidate_id for r in merge.current(spark, str(tmp_path), "waiting").collect()} == {r["candidate_id"] for r in waits}


def test_hubs_fall_into_the_components_of_their_keys(spark):
    from tallyloom.operators.resolve import hub_components

    r = random.Random(3)
    rows = [[r.randint(0, 150) for _ in range(r.randint(1, 3))] for _ in range(90)]
    got = {x.hub: x.component for x in hub_components(spark.createDataFrame([(k[0], k) for k in rows], "hub bigint, keys array<bigint>")).collect()}
    low = {k: k for keys in rows for k in keys}
    for _ in low:
        for keys in rows:
            least = min(low[k] for k in keys)
            low |= dict.fromkeys(keys, least)
    same = lambda label: {frozenset(h for h in {k[0] for k in rows} if label(h) == label(g)) for g in {k[0] for k in rows}}
    assert same(lambda h: low[h]) == same(lambda h: got.get(h, h))


def test_keys_that_link_nothing_cost_no_rounds(spark):
    import os

    from tallyloom.session import scratch_dir

    folder = scratch_dir(spark)
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    rows, before = [cand(i, i, fp=f"alone{i}") for i in range(3000)], size()
    assert len(run(spark, rows)[0]) == 3000
    assert size() - before < 50_000


def test_a_candidate_without_keys_is_judged(spark):
    row = list(cand(1, 1))
    row[2] = row[3] = row[4] = None
    assert run(spark, [tuple(row)])[0]["c1"][0] == "first"
