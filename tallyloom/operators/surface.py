"""The query surface: timeline, filters, rankings, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tallyloom.functions.scoring import level_rank
from tallyloom.session import dealt, stored, tasks_for


#: Rows before the end of a page up to which it is taken from the head of the order, in one task.
DEEPEST_HEAD = 10_000


def timeline(frames: list[DataFrame]) -> DataFrame:
    """One timeline of several bodies of events (id, date_key, level, kind, company, title, origin)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def timeline_order() -> list[Column]:
    return [F.desc("date_key"), level_rank(F.col("level")).desc(), F.asc("id")]


def timeline_query(
    events: DataFrame, kind: str | None = None, company: str | None = None, origin: str | None = None, levels: tuple[str, ...] = (), since: str | None = None, q: str | None = None, offset: int = 0, limit: int = 20, most: int = 200
) -> DataFrame:
    """A page of the timeline (of `most` rows at most) with `total`, the number of matches; every condition is optional."""
    for name, value in (("kind", kind), ("company", company), ("origin", origin)):
        if value is not None:
            events = events.where(F.col(name) == value)
    if levels:
        events = events.where(F.col("level").isin(*levels))
    if since is not None:
        events = events.where(F.col("date_key") >= since)
    if q:
        events = events.where(F.lower(F.concat_ws(" ", "title", "company", "kind")).contains(q[:200].lower()))
    size = max(1, min(most, limit))
    total = events.agg(F.count(F.lit(1)).alias("total"))
    if offset + size <= DEEPEST_HEAD:
        # a page is the head of one order: Spark keeps offset + size rows of each partition, no more
        page = events.orderBy(*timeline_order()).limit(offset + size)
        page = page.withColumn("place", F.row_number().over(Window.orderBy(*timeline_order()))).where(F.col("place") > offset)
    else:  # a deep page is read from its range of the order
        page = numbered(events, "place", *timeline_order()).where((F.col("place") > offset) & (F.col("place") <= offset + size)).withColumn("place", F.col("place").cast("int"))
    return page.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`, its place (1, 2, ...) in a total order: ranges of the order are numbered apart and shifted by the rows before them."""
    tasks = tasks_for(df)
    ranges = df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)
    part = stored(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
    # one row for each partition, so this window is as short as the job is wide
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = part.groupBy("__part").count().select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return dealt(part, "__part").join(F.broadcast(shift), "__part").withColumn(name, place).drop("__part", "__before")


def featured(level: Column) -> Column:
    """Whether an event is shown among the featured ones."""
    return F.coalesce(level.isin("L1", "L2"), F.lit(False))


def in_stated_order(df: DataFrame, order: Column, *ties: Column) -> DataFrame:
    """The rows that state their place in a comparison, numbered by it; rows without a place take no part."""
    return numbered(df.where(order.isNotNull()), "place", order.asc(), *ties)


def headline(studies: DataFrame) -> DataFrame:
    """The best study of each company: scope, then design rank, then completeness, then date; an ordered minimum, no gathering."""
    order = F.struct((~F.col("in_scope")).alias("s"), "design_rank", (-F.col("filled")).alias("c"), (-F.unix_date("day")).alias("d"), "study_id")
    best = studies.where("has_numbers").groupBy("company").agg(F.min(F.struct(order.alias("o"), "study_id", "design_rank")).alias("b"))
    return best.select("company", F.col("b.study_id").alias("study_id"), F.col("b.design_rank").alias("design_rank"))


def hot_list(events: DataFrame, today: Column, days: int, k: int = 20) -> DataFrame:
    """Events with a level, of the last `days`, by level, score (none is nought) and date."""
    age = F.datediff(today, F.to_date("date_key"))
    fit = events.where(F.col("level").isNotNull() & (age >= 0) & (age <= days))
    return fit.orderBy(level_rank(F.col("level")).desc(), F.coalesce("score", F.lit(0)).desc(), F.desc("date_key"), "id").limit(k)


def widening(events: DataFrame, today: Column, narrow: int = 31, wide: int = 90, least: int = 3, k: int = 5) -> DataFrame:
    """The hot list of the narrow window, or of the wide one where that holds too few."""
    near = hot_list(events, today, narrow, k)
    enough = near.agg((F.count(F.lit(1)) >= least).alias("enough")).withColumn("one", F.lit(1))
    both = near.withColumn("near", F.lit(True)).unionByName(hot_list(events, today, wide, k).withColumn("near", F.lit(False)))
    return both.withColumn("one", F.lit(1)).join(enough, "one").where(F.col("near") == F.col("enough")).drop("one", "near", "enough")


def facet_counts(rows: DataFrame, key: str, facets: dict[str, tuple[Column, list[str] | None, bool]]) -> DataFrame:
    """facet, value, n, place: distinct keys of each value of each facet, from one pass.

    facets: for each name the column (an array counts each of its values), its values in their fixed order (none: as found, the most frequent first), and whether values
    without rows are dropped; without a fixed order there are none. Facets come in the order in which they are given.
    """
    spark = rows.sparkSession
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), (c if isinstance(rows.select(c).schema[0].dataType, ArrayType) else F.array(c)).alias("vs")) for i, (c, _, _) in enumerate(facets.values())])
    found = rows.select(key, F.explode(pairs).alias("p")).select(key, "p.f", F.explode("p.vs").alias("value")).where("value is not null")
    counts = found.groupBy("f", "value").agg(F.count_distinct(key).alias("n"))
    fixed = spark.createDataFrame([(i, v, k, drop) for i, (_, values, drop) in enumerate(facets.values()) for k, v in enumerate(values or [])], "f int, value string, own int, dropped boolean")
    free = [i for i, (_, values, _) in enumerate(facets.values()) if values is None]
    out = fixed.join(counts, ["f", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n > 0 or not dropped").select("f", "value", "n", "own")
    # values are dimensions: a facet has as many rows here as it has different values
    rank = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "value")) - 1
    out = out.unionByName(counts.where(F.col("f").isin(free)).select("f", "value", "n", rank.alias("own")))
    name = F.element_at(F.array(*[F.lit(x) for x in facets]), F.col("f") + 1)
    return out.select(name.alias("facet"), "value", "n", (F.col("f") * 1_000_000 + F.col("own")).cast("bigint").alias("place"))


def grouped_coverage(pairs: DataFrame, group: str, row: str, column: str, columns: list[str]) -> DataFrame:
    """A matrix of 0 and 1 for each group: its rows with totals, and a row "all" with the totals of its columns; one pass, summed by group."""
    cells = pairs.groupBy(group, row).agg(*[F.max((F.col(column) == c).cast("int")).alias(c) for c in columns])
    cells = cells.withColumn("total", sum(F.coalesce(F.col(c), F.lit(0)) for c in columns))
    totals = cells.groupBy(group).agg(F.lit("all").alias(row), *[F.sum(c).cast("int").alias(c) for c in [*columns, "total"]])
    return cells.unionByName(totals.select(cells.columns))


def ranked_matrix(rows: DataFrame, keys: list[str], column: str, columns: list[str], value: str, rank: dict[str, int]) -> DataFrame:
    """A cell for each key and column: its different values in order of rank (values without a rank come last, by name), joined by commas; null where there are none."""
    place = F.coalesce(*[F.when(F.col(value) == v, n) for v, n in rank.items()], F.lit(1 << 20))
    rows = rows.select(*keys, column, F.struct(place.alias("p"), F.col(value).alias("v")).alias("s")).distinct()
    cell = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(column) == c, F.col("s")))), lambda x: x["v"]), ",")
    filled = rows.groupBy(*keys).agg(*[cell(c).alias(c) for c in columns])
    return filled.select(*keys, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])


def daily_issue(events: DataFrame, today: Column, daily: Column, order: list[Column], first: int = 5, top: int = 10, days: int = 31) -> DataFrame:
    """list ("daily", "top", "featured"), place and the columns of events: the first of the day, the top stories, and the featured ones of the last days by date.

    events: the current issue and what was released before (`current` tells them apart), with level and date_key. The first two lists are short by their nature; the third is
    numbered by ranges.
    """
    now = events.where("current")
    head = lambda rows, n, name: rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).withColumn("list", F.lit(name))
    age = F.datediff(today, F.to_date("date_key"))
    shown = numbered(events.where(featured(F.col("level")) & age.between(0, days)), "place", F.desc("date_key"), *order).withColumn("list", F.lit("featured"))
    return head(now.where(daily), first, "daily").unionByName(head(now, top, "top")).unionByName(shown.withColumn("place", F.col("place").cast("bigint")))


def host_links(links: DataFrame, key: str) -> DataFrame:
    """The first link (by pos) of each host for each key, in their order: key, host, url, place. Rows are reduced by host before they are ordered."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    one = links.groupBy(key, host.alias("host")).agg(F.min(F.struct("pos", "url")).alias("m"))
    return one.select(key, "host", "m.url", F.row_number().over(Window.partitionBy(key).orderBy("m.pos", "m.url")).cast("bigint").alias("place"))


def coverage(pairs: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """A matrix of 0 and 1 with row totals and a last row of column totals."""
    flags = pairs.select(row, column).distinct()
    cells = flags.groupBy(row).agg(*[F.max((F.col(column) == c).cast("int")).alias(c) for c in columns])
    cells = cells.withColumn("total", sum(F.col(c) for c in columns))
    totals = cells.agg(F.lit("all").alias(row), *[F.sum(c).cast("int").alias(c) for c in [*columns, "total"]])
    return cells.unionByName(totals)


def heat_bin(share: Column) -> Column:
    """Six steps of a share."""
    out = F.lit(5)
    for step, limit in reversed(list(enumerate((0.2, 0.4, 0.6, 0.8, 0.9)))):
        out = F.when(share < limit, step).otherwise(out)
    return out


def age_vector(events: DataFrame, key: str, day: Column, today: Column, n: int) -> DataFrame:
    """key and `spark`: for each of the last n days (latest last) whether the event falls on it."""
    age = F.datediff(today, day)
    return events.select(key, F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.when(i == age, 1).otherwise(0)).alias("spark"))


def unique_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).count().where("count > 1")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def missing_combinations(df: DataFrame, first: tuple[str, list], second: tuple[str, list]) -> DataFrame:
    """Required combinations of two short lists that no row has."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(a, b) for a in first[1] for b in second[1]], [first[0], second[0]])
    return wanted.join(df.select(first[0], second[0]).distinct(), [first[0], second[0]], "left_anti")
