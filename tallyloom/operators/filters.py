"""Filters of boards and tables: each facet is a parameter, and one that is not given filters nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def board_filter(products: DataFrame, key: str, routes: tuple[str, ...] = (), cancer: str | None = None, status: str | None = None, region: str | None = None, keyword: str | None = None, fields: tuple[str, ...] = (), studies: DataFrame | None = None) -> DataFrame:
    """Rows of products(key, routes, cancers, mced, status_keys, region, fields...) that have all routes and fit every other facet.

    The cancer "MCED" stands for the flag mced. A keyword is sought in the fields and in the names of studies(key, name).
    """
    if routes:
        products = products.where(F.size(F.array_except(F.array(*[F.lit(r) for r in routes]), "routes")) == 0)
    if cancer:
        products = products.where(F.col("mced") if cancer == "MCED" else F.array_contains("cancers", cancer))
    if status:
        products = products.where(F.array_contains("status_keys", status))
    if region:
        products = products.where(F.col("region") == region)
    if keyword:
        hit = F.lower(F.concat_ws(" ", *fields)).contains(keyword.lower())
        if studies is None:
            return products.where(hit)
        named = studies.where(F.lower("name").contains(keyword.lower())).select(F.col(key).alias("__named")).distinct()
        products = products.join(named, F.col(key) == F.col("__named"), "left").where(hit | F.col("__named").isNotNull()).drop("__named")
    return products


def facet_filter(rows: DataFrame, facets: dict[str, str | None], q: str | None = None, fields: tuple[str, ...] = (), nested: Column | None = None) -> DataFrame:
    """Rows that fit every facet (None, "" and "all" are off; a null counts as "none") and hold q in a field or in the array `nested`."""
    for name, value in facets.items():
        if value and value != "all":
            rows = rows.where(F.coalesce(F.col(name).cast("string"), F.lit("none")) == value)
    word = (q or "").strip().lower()
    if word:
        more = [] if nested is None else [F.array_join(nested, " ")]
        rows = rows.where(F.lower(F.concat_ws(" ", *[F.col(f) for f in fields], *more)).contains(word))
    return rows


def performance_rows(rows: DataFrame, prospective: tuple[str, ...], scope: str | None = None, design: str | None = None, tier: str | None = None) -> DataFrame:
    """Rows of a scope and design; without a design those of prospective ones, or all with the tier "all"."""
    if scope:
        rows = rows.where(F.col("scope") == scope)
    if design:
        return rows.where(F.col("design") == design)
    return rows if tier == "all" else rows.where(F.col("design").isin(*prospective))


def scatter_rows(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """Rows with both numbers that are not of a diagnostic use."""
    if scope:
        rows = rows.where(F.col("scope") == scope)
    return rows.where(~F.coalesce("diagnostic", F.lit(False)) & F.col("spec").isNotNull() & F.col("sens").isNotNull())


def performance_order(key: str | None = None, direction: int = 1, design_rank: Column | None = None) -> list[Column]:
    """By design and sensitivity, or by one figure, the highest first (the lowest first with direction -1); none counts as -1."""
    if key is None:
        return [F.col("design_rank") if design_rank is None else design_rank, F.coalesce("sens", F.lit(-1)).desc()]
    figure = F.coalesce(key, F.lit(-1))
    return [figure.desc() if direction > 0 else figure.asc()]
