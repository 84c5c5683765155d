"""Quality rules as data: a table of named conditions, compiled into one scan; violations and quarantined rows come from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition (SQL) that must hold for each row, or for each entry `x` of the array column `each`, where `when` (SQL) holds.

    A condition that is null counts as broken; a null array, or one without entries, has none to break a rule.
    """

    name: str
    holds: str
    when: str = "true"
    each: str | None = None


@dataclass(frozen=True)
class Reference:
    """Every value of a column (or of an array column) is a key of the parent; nulls refer to nothing."""

    name: str
    column: str
    parent: DataFrame
    key: str
    many: bool = False


def _broken(rule: Rule) -> str:
    """How often a row breaks the rule, in SQL."""
    if rule.each is None:
        return f"cast(({rule.when}) and not coalesce({rule.holds}, false) as int)"
    return f"if({rule.when}, size(filter(coalesce({rule.each}, array()), x -> not coalesce({rule.holds}, false))), 0)"


def marked(df: DataFrame, rules: list[Rule], references: list[Reference] = ()) -> DataFrame:
    """df with `broken`: a map from the name of each rule that the row breaks to how often. All rules of rows are read from one scan; a reference is one join with its parent's keys."""
    out = df
    for i, r in enumerate(references):
        # the values of all rows, once each, against the parent's keys: neither side is multiplied
        values = df.select((F.explode(r.column) if r.many else F.col(r.column)).alias("__v")).where("__v is not null").distinct()
        lost = values.join(r.parent.select(F.col(r.key).alias("__v")).distinct(), "__v", "left_anti")
        if r.many:
            keyed = df.select("__row", F.explode(r.column).alias("__v")).join(lost, "__v").groupBy("__row").agg(F.count(F.lit(1)).cast("int").alias(f"__r{i}"))
            out = out.join(keyed, "__row", "left")
        else:
            out = out.join(lost.select(F.col("__v").alias(r.column), F.lit(1).alias(f"__r{i}")), r.column, "left")
    names = [r.name for r in rules] + [r.name for r in references]
    counts = [F.expr(_broken(r)) for r in rules] + [F.coalesce(F.col(f"__r{i}"), F.lit(0)) for i in range(len(references))]
    flat = [x for name, count in zip(names, counts, strict=True) for x in (F.lit(name), count)]
    return out.withColumn("broken", F.map_filter(F.create_map(*flat), lambda _, v: v > 0)).drop(*[f"__r{i}" for i in range(len(references))])


def checked(df: DataFrame, key: str, rules: list[Rule], references: list[Reference] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(violations, quarantined, clean): key, rule and times of every broken rule; the rows that break one; the rows that break none.

    The key is unique (see `unique_keys`); it tells rows apart where an array refers to a parent.
    """
    if len({r.name for r in [*rules, *references]}) < len(rules) + len(references):
        raise ValueError("rules need names of their own")
    rows = marked(df.withColumn("__row", F.col(key)), rules, references).drop("__row")
    violations = rows.select(key, F.explode("broken").alias("rule", "times"))
    return violations, rows.where(F.size("broken") > 0), rows.where(F.size("broken") == 0).drop("broken")
