"""Pages, facets and matrices on small tables."""

from pyspark.sql import functions as F

from tallyloom.operators import rules
from tallyloom.operators import surface as S


def test_a_deep_page_equals_the_head_of_the_order(spark, monkeypatch):
    rows = [(f"e{i:03d}", f"2024-01-{1 + i % 28:02d}", f"L{1 + i % 3}", "k", "c", "t", "o") for i in range(300)]
    events = spark.createDataFrame(rows, "id string, date_key string, level string, kind string, company string, title string, origin string").repartition(4)
    page = lambda: [tuple(r) for r in S.timeline_query(events, kind="k", offset=120, limit=15).orderBy("place").collect()]
    near = page()
    monkeypatch.setattr(S, "DEEPEST_HEAD", 10)
    deep = S.timeline_query(events, kind="k", offset=120, limit=15)
    assert page() == near and len(near) == 15 and near[0][deep.columns.index("place")] == 121 and near[0][deep.columns.index("total")] == 300


def test_facets_keep_their_order_and_zeros(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["x"]), (2, "a", ["x"]), (3, None, [])], "id int, route string, tags array<string>")
    got = S.facet_counts(rows, "id", {"route": (F.col("route"), ["b", "a"], False), "tags": (F.col("tags"), None, True)}).orderBy("place").collect()
    assert [(r.facet, r.value, r.n) for r in got] == [("route", "b", 0), ("route", "a", 2), ("tags", "x", 2), ("tags", "y", 1)]


def test_matrix_cells_come_by_rank(spark):
    rows = spark.createDataFrame([(1, "A", "late"), (1, "A", "early"), (1, "A", "odd"), (1, "B", "early"), (2, "C", "late")], "id int, regulator string, status string")
    got = {r.id: (r.A, r.B) for r in S.ranked_matrix(rows, ["id"], "regulator", ["A", "B"], "status", {"early": 1, "late": 2}).collect()}
    assert got == {1: ("early,late,odd", "early"), 2: (None, None)}


def test_rules_of_rows_entries_and_references(spark):
    df = spark.createDataFrame([(1, 5, [1, 2], ["a"]), (2, None, None, ["a", "z", "z"]), (3, -1, [0, None], None)], "id int, n int, xs array<int>, refs array<string>")
    parent = spark.createDataFrame([("a",), ("a",)], "k string")
    table = [rules.Rule("positive", "n > 0"), rules.Rule("entries", "x > 0", each="xs"), rules.Rule("only_small", "false", when="n < 0")]
    broken, held, clean = rules.checked(df, "id", table, [rules.Reference("known", "refs", parent, "k", many=True)])
    assert sorted((r.id, r.rule, r.times) for r in broken.collect()) == [(2, "known", 2), (2, "positive", 1), (3, "entries", 2), (3, "only_small", 1), (3, "positive", 1)]
    assert {r.id for r in held.collect()} == {2, 3} and [tuple(r) for r in clean.collect()] == [(1, 5, [1, 2], ["a"])]
