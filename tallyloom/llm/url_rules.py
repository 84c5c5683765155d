"""URL filters: fixed host and path rules, and association rules mined from labelled URLs.

A URL's items are its host, each parent domain, its host labels, path segments, neighbouring pairs of both, and shapes of segments; and three fixed
items that every URL has once at most: its registered domain, the shape of its last segment and the file ending. Spark's FP-growth mines
combinations of the fixed items, and of the fixed items with one other, that occur with a label: a URL is one basket of its fixed items and
one for each other item, so it makes 16 combinations of an item at most, however many segments it has (all subsets of the segments of one long URL that repeats would be
2**segments). Rules of enough confidence and support (a share, and LEAST_URLS labelled URLs) whose shorter forms are not as good stay. They are
matched by an inverted index: each rule stands under one of its items, a URL looks up the rules of its items and keeps those all of
whose items it has; the most confident wins (then the better supported, the longer, and the first in order).

Edge cases: a null URL or one without "://" has an empty host and path, no items and the default verdict; labels that are null
don't count; with no labelled rows there are no mined rules. Repeated rows come out once each; very long URLs are judged whole; rules
that tie are told apart by length, then by their items in order; columns of pages other than the id and the URL aren't read, whatever
their names; an empty table of pages gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import discard, stored

# Fixed values: (verdict, host, path) of the base rules.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Mining: least share of labelled URLs, least confidence, least gain of a longer rule over its parts.
SUPPORT, CONFIDENCE, GAIN = 0.002, 0.6, 0.02
#: Labelled URLs that a rule needs at least, however few there are in all.
LEAST_URLS = 5
#: Labels of a host whose suffixes are items, besides the host as a whole (no valid host has more).
MOST_LABELS = 127
#: Labelled URLs that are mined, at most about; the rarest item kinds are dropped before mining by the support threshold itself.
SAMPLE_URLS = 200_000
#: Rules up to which the index is sent to every task; more are dealt out with the URLs' items.
SENT_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty where there is none."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)), "/", 1)).otherwise("")
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to "?" or "#"."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    head = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    start = F.locate("/", head)
    return F.coalesce(F.when((F.locate("://", url) > 0) & (start > 0), F.substring(head, start, F.length(head))).otherwise(""), F.lit(""))


def base_rule(host: Column, path: Column, rules: tuple = BASE_RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null where none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # longest host first, then longest path: the nearest ancestor decides
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def items_of(host: Column, path: Column) -> Column:
    """The distinct items of a URL."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    near = F.slice(labels, F.greatest(F.size(labels) - MOST_LABELS + 1, F.lit(1)), MOST_LABELS)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(near), F.lit(1))), lambda k: F.concat(F.lit("site="), F.array_join(F.slice(near, k, F.size(near)), ".")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), r"\p{L}+", "a")
    shapes = F.transform(parts, lambda x: F.concat(F.lit("shape="), shape(x)))
    plain = F.filter(parts, lambda x: ~x.rlike("[0-9]"))
    own = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))  # the registered domain is an item as a whole
    tokens = F.filter(F.flatten(F.transform(own, lambda x: F.split(x, "-"))), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)
    no = F.array().cast("array<string>")
    of = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    pairs = lambda kind, xs: F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, y: F.concat(F.lit(kind), x, F.lit("/"), y))
    fixed = F.concat(
        F.array(F.concat(F.lit("domain="), F.substring_index(F.array_join(near, "."), ".", -2))),
        F.when(F.size(parts) > 0, F.array(F.concat(F.lit("last="), shape(F.element_at(parts, -1))))).otherwise(no),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(no),
    )
    whole = F.when(F.size(labels) > MOST_LABELS, F.array(F.concat(F.lit("site="), host))).otherwise(no)
    return F.when(host == "", no).otherwise(F.array_distinct(F.concat(fixed, parents, whole, of("word=", tokens), pairs("words=", tokens), of("part=", plain), pairs("parts=", plain), shapes)))


def _is_fixed(item: Column) -> Column:
    return item.startswith("domain=") | item.startswith("last=") | item.startswith("ending=")


def _is_verdict(item: Column) -> Column:
    return item.startswith("verdict=")


def _frequent(baskets: DataFrame, least: int) -> DataFrame:
    """items (sorted) and freq of the combinations that at least `least` of the baskets hold."""
    n = baskets.count()
    if n < least:
        return baskets.sparkSession.createDataFrame([], "items array<string>, freq bigint")
    # half a basket less, so that rounding up in the share doesn't ask for one more
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=1.0).fit(baskets).freqItemsets
    return sets.select(F.array_sort("items").alias("items"), "freq")


def mined_rules(marked: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, gain: float = GAIN, least_urls: int = LEAST_URLS) -> DataFrame:
    """items, verdict, confidence, support: the pruned rules of marked(items, verdict)."""
    verdict = F.array(F.concat(F.lit("verdict="), "verdict"))
    marked = stored(marked.where(F.size("items") > 0).select(F.array_union(F.filter("items", _is_fixed), verdict).alias("fixed"), F.filter("items", lambda x: ~_is_fixed(x)).alias("free")), "baskets")
    spark = marked.sparkSession
    schema = "items array<string>, verdict string, confidence double, support double"
    total = marked.count()
    if not total:
        return spark.createDataFrame([], schema)
    least = max(least_urls, math.ceil(support * total - 1e-9))
    sets = _frequent(marked.select(F.col("fixed").alias("items")), least)
    # an item stands once in a URL, so combinations with it are counted once for each URL; those without it are counted above
    wider = _frequent(marked.select("fixed", F.explode("free").alias("one")).select(F.concat("fixed", F.array("one")).alias("items")), least)
    sets = stored(sets.unionByName(wider.where(F.exists("items", lambda x: ~(_is_fixed(x) | _is_verdict(x))))), "itemsets")
    # a rule is a frequent set with one verdict in it; its confidence is that set's count over the count without the verdict
    with_verdict = sets.select(
        F.array_sort(F.filter("items", lambda x: ~_is_verdict(x))).alias("items"),
        F.element_at(F.filter("items", _is_verdict), 1).alias("verdict"),
        F.col("freq").alias("hits"),
        F.exists("items", _is_verdict).alias("has"),
    ).where("has")
    base = with_verdict.where(F.size("items") == 0).select("verdict", (F.col("hits") / total).alias("prior"))
    plain = sets.where(~F.exists("items", _is_verdict)).select("items", "freq")
    rules = with_verdict.where(F.size("items") > 0).join(plain, "items").select("items", F.substring_index("verdict", "=", -1).alias("verdict"), (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / total).alias("support"))
    rules = rules.where(F.col("confidence") >= confidence).join(base.select(F.substring_index("verdict", "=", -1).alias("verdict"), "prior"), "verdict").where(F.col("confidence") >= F.col("prior") + gain)
    rules = stored(rules.drop("prior"), "rules")
    discard(marked, sets)
    # drop a rule where leaving out one of its items gives a rule of the same verdict that is about as good
    shorter = rules.where(F.size("items") > 1).select("items", "verdict", "confidence", F.explode("items").alias("out"))
    shorter = shorter.select("items", "verdict", "confidence", F.array_except("items", F.array("out")).alias("part"))
    parts = rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    weak = shorter.join(parts, ["part", "verdict"]).where(F.col("part_confidence") > F.col("confidence") - gain).select("items", "verdict").distinct()
    return rules.join(weak, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support")


def index_of(rules: DataFrame) -> DataFrame:
    """item, rule_items, rule_verdict, confidence, support: each rule once, under that of its items that fewest rules share."""
    shared = rules.select(F.explode("items").alias("item")).groupBy("item").count()
    numbered = rules.withColumn("rule", F.xxhash64("items", "verdict"))
    least = numbered.select("rule", "items", "verdict", F.explode("items").alias("item")).join(shared, "item").groupBy("rule", "items", "verdict").agg(F.min(F.struct("count", "item")).alias("least"))
    return numbered.join(least, ["rule", "items", "verdict"]).select("least.item", F.col("items").alias("rule_items"), F.col("verdict").alias("rule_verdict"), "confidence", "support")


def labelled(urls: DataFrame, marks: DataFrame, page_id: str = "page_id") -> DataFrame:
    """items, verdict of the rows of urls(page_id, host, path, base) that marks(m_id, bad) has; both are dealt by id (the files of URLs are far smaller than their rows in memory, so no side goes to the driver)."""
    given = F.when(F.col("base").isNotNull(), F.col("base.verdict")).when(F.col("bad") == 1, "block").otherwise("allow")
    both = urls.select(page_id, "host", "path", "base").join(marks.hint("merge"), F.col(page_id) == F.col("m_id"))
    return both.select(items_of(F.col("host"), F.col("path")).alias("items"), given.alias("verdict"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row, mined (struct confidence, support, verdict, items): the best rule all of whose items the URL of urls(row, items) has.

    The URLs stay where they are and the index goes to them, up to SENT_RULES rules: its size goes by the least support, not by the tables.
    """
    index = stored(index_of(rules), "index")
    index = index.hint("broadcast" if index.count() <= SENT_RULES else "merge")
    hits = urls.select("row", "items", F.explode("items").alias("item")).join(index, "item").where(F.size(F.array_except("rule_items", "items")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("rule_items").alias("length"), F.array_join("rule_items", " ").alias("rule_text"), F.col("rule_verdict").alias("verdict")))
    return hits.groupBy("row").agg(best.alias("mined"))


def judged(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", label_id: str = "doc_id", sample_urls: int = SAMPLE_URLS, default: str = "allow") -> DataFrame:
    """For each row of pages: page_id, host, path, rule, verdict, and the mined rule with its confidence.

    A page and a label belong together where their ids are equal. A labelled URL counts as block where its page is marked toxic or
    of low quality; where a base rule fits, that rule's verdict is its label.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.col(page_id), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    urls = stored(urls.withColumn("base", base_rule(F.col("host"), F.col("path"))).withColumn("items", items_of(F.col("host"), F.col("path"))), "urls")
    marks = labels.groupBy(F.col(label_id).alias("m_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad")).where("bad is not null")
    share = max(1, -(-marks.count() // sample_urls))
    some = marks.where(F.pmod(F.xxhash64("m_id"), F.lit(share)) == 0)
    rules = stored(mined_rules(labelled(urls, some, page_id)), "mined")
    best = matched(urls.where("base is null").select("row", "items"), rules)
    out = urls.join(best.hint("merge"), "row", "left")
    verdict = F.coalesce("base.verdict", "mined.verdict", F.lit(default))
    return out.select(page_id, "host", "path", F.col("base.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.rule_text").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))
