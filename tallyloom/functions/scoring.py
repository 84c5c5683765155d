"""Importance bands, event classes and rank ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bands of each part of the importance, and the level ladder.
RELEVANCE = (0, 10, 20, 30)
IMPACT = (0, 15, 30, 40, 50)
ACTIONABILITY = (0, 10, 20)
LEVELS = ((80, "L1"), (60, "L2"), (40, "L3"))

# Classes of events by the first pattern that a lower-case title matches.
EVENT_PATTERNS = (
    ("regulatory_decision", r"fda|nmpa|cmde|批准|获批|审评|breakthrough|clearance|approval|pma\b|de novo"),
    ("conference_disclosure", r"asco|esmo|aacr|wclc|conference|congress|会议|大会|poster|abstract"),
    ("clinical_readout", r"trial|study|sensitivity|specificity|clinical|队列|临床|灵敏度|特异性|readout"),
    ("publication", r"journal|publication|published|pubmed|nature|lancet|期刊|发表|论文"),
    ("product_launch", r"launch|commercializ|推出|上市|发布产品"),
    ("partnership", r"partner|collaborat|agreement|合作|联盟"),
    ("corporate", r"financ|restructur|layoff|acqui|merger|融资|重组|收购|财报"),
)
# The category of each class.
CATEGORY = {"regulatory_decision": "regulatory", "conference_disclosure": "academic", "clinical_readout": "research", "publication": "research"}


def level_of(total: Column) -> Column:
    out = F.lit(None).cast("string")
    for least, level in reversed(LEVELS):
        out = F.when(total >= least, level).otherwise(out)
    return out


def importance(df: DataFrame) -> DataFrame:
    """Adds total and level; a part outside its bands leaves both null (such rows belong in quarantine)."""
    ok = F.col("relevance").isin(*RELEVANCE) & F.col("impact").isin(*IMPACT) & F.col("actionability").isin(*ACTIONABILITY)
    total = F.when(ok, F.col("relevance") + F.col("impact") + F.col("actionability"))
    return df.withColumn("total", total).withColumn("level", level_of(F.col("total")))


def classify(title: Column, category: Column | None = None) -> Column:
    """The class of a title; with category "research" what is not caught before is a publication."""
    out = F.lit("other")
    low = F.lower(F.coalesce(title, F.lit("")))
    for name, pattern in reversed(EVENT_PATTERNS):
        hit = low.rlike(pattern)
        if name == "publication" and category is not None:
            hit = hit | (F.coalesce(category, F.lit("")) == "research")
        out = F.when(hit, name).otherwise(out)
    return out


def category_of(event_type: Column) -> Column:
    out = F.lit("market")
    for name, category in CATEGORY.items():
        out = F.when(event_type == name, category).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    """3 for L1 down to 0 for none."""
    return F.when(level == "L1", 3).when(level == "L2", 2).when(level == "L3", 1).otherwise(0)


def bands_of_score(score: Column) -> Column:
    """An old single score as struct(relevance, impact, actionability)."""
    band = lambda r, i, a: F.struct(F.lit(r).alias("relevance"), i.cast("int").alias("impact"), a.cast("int").alias("actionability"))
    return (
        F.when(score >= 80, band(30, F.when(score >= 95, 50).otherwise(40), F.when(score >= 90, 20).otherwise(10)))
        .when(score >= 60, band(30, F.lit(30), F.when(score >= 70, 10).otherwise(0)))
        .when(score >= 40, band(20, F.lit(15), F.lit(10)))
        .otherwise(band(10, F.lit(15), F.lit(0)))
    )
