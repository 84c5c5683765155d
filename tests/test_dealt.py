"""Tasks grow in number with the tables."""

from tallyloom import session
from tallyloom.plans import registry
from tallyloom.sources import adapters as A

DATA = "/root/testdata/sf0.001"


def test_ledger_events_are_dealt_by_the_size_of_the_tables(spark, monkeypatch):
    few = A.ledger_events(spark, DATA)
    monkeypatch.setattr(session, "BYTES_A_TASK", 1 << 12)
    many = A.ledger_events(spark, DATA)
    assert many.rdd.getNumPartitions() > 4 >= few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_places_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    place = lambda: sorted(map(tuple, registry.QUERIES["w2_timeline_order"](spark, DATA).collect()))
    few = place()
    monkeypatch.setattr(session, "BYTES_A_TASK", 1 << 12)
    assert place() == few


def test_sources_are_looked_up_without_a_shuffle_or_in_tasks_that_grow_in_number(spark, monkeypatch):
    edges, sources = A.event_evidence(spark, DATA), A.registry(spark, DATA).select("source_id", "tier")
    monkeypatch.setattr(session, "BYTES_A_TASK", 1 << 12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(session.looked_up(edges, sources, "source_id")) and "SortMergeJoin" in plan(edges.join(sources, "source_id"))
        small = sorted(map(tuple, session.looked_up(edges, sources, "source_id").collect()))
        monkeypatch.setattr(session, "SMALL_BYTES", 0)
        large = session.looked_up(edges, sources, "source_id")
        assert large.rdd.getNumPartitions() > 4 and sorted(map(tuple, large.collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence_of_ledger_events_is_summed_in_order(spark):
    plan = A.ledger_events(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan


def test_running_support_is_dealt_by_the_size_of_the_tables(spark, monkeypatch):
    few = registry.QUERIES["e2_running_support"](spark, DATA)
    monkeypatch.setattr(session, "BYTES_A_TASK", 1 << 12)
    many = registry.QUERIES["e2_running_support"](spark, DATA)
    assert many.rdd.getNumPartitions() > 4 >= few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_places_within_companies_are_dealt_by_the_size_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(session, "BYTES_A_TASK", 1 << 12)
    assert registry.QUERIES["w1_ledger_order"](spark, DATA).rdd.getNumPartitions() > 4
