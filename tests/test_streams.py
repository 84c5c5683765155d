"""Keyed state with timers: outcomes do not depend on how rows fall into batches, and no row is lost."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.streaming import streams

START = dt.datetime(2024, 1, 1)
HEALTH = "source_id bigint, ts timestamp, seq bigint, failed boolean, hours double"
HITS = "fingerprint string, ts timestamp, seq bigint, candidate_id bigint, tier string, owner bigint, in_scope boolean"


def landed(spark, folder, schema, batches):
    for rows in batches:
        made = [tuple(START + dt.timedelta(hours=x[1]) if i == 1 else v for i, v in enumerate(x)) for x in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def hours(ts):
    return None if ts is None else (ts - START).total_seconds() / 3600


def test_alarms_come_from_timers_and_once(spark, tmp_path):
    rows = [
        (1, 0, 1, True, 2.0),  # silent afterwards: a timer at 4
        (2, 0, 2, True, 2.0), (2, 4, 3, False, 2.0),  # a success at the due time calls it off
        (3, 1, 4, True, 2.0), (3, 2, 5, True, 2.0), (3, 9, 6, True, 2.0), (3, 10, 7, False, 2.0), (3, 11, 8, True, 2.0),  # twice
        (4, 0, 9, True, None), (4, 1, 10, True, None), (4, 2, 11, True, None),  # no interval: counted only
        (9, 40, 12, False, 1.0),
    ]
    rows.sort(key=lambda r: r[1])
    seen = []
    for name, cuts in (("one", [rows]), ("four", [rows[:4], rows[4:7], rows[7:9], rows[9:]])):
        stream = landed(spark, f"{tmp_path}/{name}", HEALTH, cuts)
        streams.run_to_end(streams.source_health(stream), "update", f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}/out")
        seen.append(sorted((r.source_id, hours(r.first_failure_at), hours(r.alarm_at)) for r in out.where("kind = 'alarm'").collect()))
        state = {r.source_id: r for r in streams.latest(out.where("kind = 'state'"), "source_id").collect()}
        assert state[4].consecutive_failures == 3 and state[3].consecutive_failures == 1 and hours(state[3].last_success) == 10 and state[9].consecutive_failures == 0
        assert out.where("kind = 'alarm' and by_timer and source_id = 1").count() == 1
    assert seen[0] == seen[1] == [(1, 0, 4), (3, 1, 5), (3, 11, 15)]


def test_a_fingerprint_is_promoted_once_and_forgotten_after_its_span(spark, tmp_path):
    rows = [
        ("a", 0, 1, 10, "trusted", 1, True), ("a", 1, 2, 11, "discovery", 2, True), ("a", 2, 3, 12, "trusted", 3, True), ("a", 3, 4, 13, "trusted", 4, True),  # opened by 12, with 10 and 11; 13 passes
        ("b", 0, 5, 20, "trusted", 1, True), ("b", 80, 6, 21, "trusted", 2, True),  # forgotten in between
        ("b", 81, 7, 22, "authoritative", 5, False), ("b", 82, 8, 23, "authoritative", 5, True),  # out of scope, then in it
        ("a", 90, 9, 14, "authoritative", 9, True),  # anew
    ]
    rows.sort(key=lambda r: r[1])
    want = [("a", 10, 12, "medium"), ("a", 11, 12, "medium"), ("a", 12, 12, "medium"), ("a", 14, 14, "high"), ("b", 21, 23, "high"), ("b", 22, 23, "high"), ("b", 23, 23, "high")]
    for name, cuts in (("one", [rows]), ("three", [rows[:3], rows[3:6], rows[6:]])):
        stream = landed(spark, f"{tmp_path}/{name}", HITS, cuts)
        streams.run_to_end(streams.gate(stream, "2 days"), "append", f"{tmp_path}/{name}")
        got = sorted((r.fingerprint, r.candidate_id, r.opened_by, r.confidence) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect())
        assert got == want


def test_late_rows_are_kept_and_ended_windows_written(spark, tmp_path):
    schema = "source_id bigint, ts timestamp, seq bigint"
    batches = [[(1, 0, 1), (1, 3, 2), (1, 9, 3)], [(1, 2, 4), (1, 12, 5), (2, 8, 6)], [(2, 9, 7), (1, 30, 8)]]
    landed(spark, tmp_path, schema, batches)
    opened = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.run_to_end(streams.windows_with_late(opened, "1 hour", lambda ts: F.window(ts, "4 hours")), "append", str(tmp_path))
    got = sorted((r.source_id, hours(r.begins), r.hits, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # watermarks: 8 before the second batch, 11 before the third, 29 at the end
    assert got == [(1, 0, 2, False), (1, 2, 1, True), (1, 8, 1, False), (1, 12, 1, False), (2, 8, 1, True), (2, 9, 1, True)]


def test_a_call_serves_all_sources_of_a_group():
    import pandas as pd

    from tallyloom.streaming.processors import SourceHealth

    class Held:
        """The state and timers of one group."""

        value, timers = None, set()
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        getValueState = lambda self, *a: self  # noqa: E731, N815
        registerTimer = lambda self, at: self.timers.add(at)  # noqa: E731, N815
        deleteTimer = lambda self, at: self.timers.discard(at)  # noqa: E731, N815

        def update(self, value):
            self.value = value

    health, held, hour = SourceHealth(), Held(), 3_600_000_000
    health.init(held)
    rows = pd.DataFrame([(1, 0, 1, True, 2.0), (2, 0, 2, True, 1.0), (2, 9 * hour, 3, True, 1.0), (3, 0, 4, False, None)], columns=["source_id", "at", "seq", "failed", "hours"])
    out = pd.concat(health.handleInputRows((0,), iter([rows]), None))
    assert out[out["kind"] == "alarm"][["source_id", "alarm_at"]].values.tolist() == [[2, 2 * hour]]
    assert out[out["kind"] == "state"][["source_id", "consecutive_failures"]].values.tolist() == [[1, 1], [2, 2], [3, 0]]
    assert held.timers == {4 * hour // 1000}


def test_late_evidence_counts_for_its_own_life_and_turns_no_time_back(spark, tmp_path):
    rows = [
        ("c", 20, 4, 33, "authoritative", 7, True),  # of a life that was over by 100: promoted by itself
        ("c", 90, 2, 31, "discovery", 5, True),  # late, within the span
        ("c", 100, 1, 30, "trusted", 1, True),
        ("c", 140, 3, 32, "trusted", 2, True), ("c", 141, 5, 34, "trusted", None, True),
    ]
    want = [("c", 30, 32, 3, "medium"), ("c", 31, 32, 3, "medium"), ("c", 32, 32, 3, "medium"), ("c", 33, 33, 1, "high")]
    for name, cuts in (("one", [rows]), ("late", [rows[2:3], rows[:2], rows[3:]])):
        stream = landed(spark, f"{tmp_path}/{name}", HITS, cuts)
        streams.run_to_end(streams.gate(stream, "2 days"), "append", f"{tmp_path}/{name}")
        got = sorted((r.fingerprint, r.candidate_id, r.opened_by, r.owners, r.confidence) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect())
        assert got == want


def test_rows_reach_a_processor_in_packs(spark):
    rows = spark.range(5000).selectExpr("nullif(id % 3, 2) as key", "id", "nullif(id, 7) as v").repartition(2)
    packs = streams.packed(rows, "key").collect()
    assert len(packs) <= 6 and all(len(p.id) == len(p.v) for p in packs)
    assert sorted((i, p.key, v) for p in packs for i, v in zip(p.id, p.v, strict=True)) == [(i, None if i % 3 == 2 else i % 3, None if i == 7 else i) for i in range(5000)]


def test_the_late_router_marks_each_row_of_its_packs():
    import pandas as pd

    from tallyloom.streaming.processors import PACKS, LateRouter

    class Timer:
        getCurrentWatermarkInMs = lambda self: 5  # noqa: E731, N815

    packs = pd.DataFrame({"source_id": 1, "seq": [[2 * i, 2 * i + 1] for i in range(PACKS + 1)], "at": [[5000, 5001]] * (PACKS + 1)})
    out = list(LateRouter().handleInputRows((1,), iter([packs]), Timer()))
    assert [len(x) for x in out] == [2 * PACKS, 2]
    rows = pd.concat(out)
    assert rows["seq"].tolist() == list(range(2 * PACKS + 2)) and rows["late"].tolist() == [True, False] * (PACKS + 1)
