"""Landing of collected payloads: listings, feeds, search results, regulator, literature and social JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import canonical_urls, strip_html
from tallyloom.sources.markup import read_links

_ANCHOR = r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'
# Words that mark a path as an article's, sections of a site, names of page numbers, newswires, files.
NEWS_WORDS = ("news", "newsroom", "press", "release", "releases", "media", "announcement", "announcements", "blog", "article", "articles", "story", "stories", "insight", "insights", "update", "updates", "xinwen", "xwzx", "gsxw", "gsdt", "dongtai", "zixun")
SECTION_WORDS = ("about", "about-us", "team", "leadership", "management", "board", "governance", "career", "careers", "job", "jobs", "contact", "contact-us", "privacy", "privacy-policy", "terms", "legal", "cookie", "cookies", "sitemap", "login", "faq", "product", "products", "our-products", "solutions", "services", "patient", "patients", "provider", "providers", "physician", "physicians", "health-systems", "investor", "investors", "financial", "financials", "annual-reports", "sec-filings", "stock-information")
PAGE_NAMES = ("page", "p", "offset", "start")
NEWSWIRES = ("prnewswire.com", "businesswire.com", "globenewswire.com", "accesswire.com")
FILES = ("pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "zip", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp4")
LEAST_SCORE, MOST_TITLE = 3, 300


def anchors(pages: DataFrame, key: str) -> DataFrame:
    """key, pos, href, label: the anchors of each page in order, from <main> where there is one, else outside <nav> and <footer>, or all if none is left."""
    main = F.regexp_extract("html", r"(?is)<main\b[^>]*>(.*?)</main>", 1)
    area = F.when(main != "", main).otherwise(F.col("html"))
    tags = F.regexp_extract_all(area, F.lit(_ANCHOR), 0)
    flat = pages.select("*", F.posexplode(tags).alias("pos", "tag"))
    return flat.withColumn("href", F.regexp_extract("tag", _ANCHOR, 1)).withColumn("label", strip_html(F.regexp_extract("tag", _ANCHOR, 2))).drop("tag", "html")


def _says_news(path: Column) -> Column:
    """A word of the path (parted by "/", "_" or "-", up to a dot) is one of an article's."""
    return F.exists(F.split(path, "[/_-]"), lambda w: F.substring_index(w, ".", 1).isin(*NEWS_WORDS))


def _says_year(path: Column) -> Column:
    """A part of the path begins with a year, alone or with a month and a day run on, and a hyphen or its end behind."""

    def begins(part: Column) -> Column:
        digits = F.regexp_extract(part, "^[0-9]*", 0)
        behind = F.substring(part, F.length(digits) + 1, F.lit(1))
        return F.length(digits).between(4, 8) & F.substring(digits, 1, 4).try_cast("int").between(1900, 2099) & behind.isin("", "-")

    return F.exists(F.split(path, "/"), begins)


def _pages_on(path: Column, search: Column) -> Column:
    """A page number in the query, or at the end of the path where there is no query."""
    named = F.exists(F.split(F.substring(search, 2, 1 << 20), "&"), lambda x: F.substring_index(x, "=", 1).isin(*PAGE_NAMES) & F.substring_index(x, "=", -1).rlike("^[0-9]") & x.contains("="))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return named | ((search == "") & (F.try_element_at(parts, F.lit(-2)) == "page") & F.try_element_at(parts, F.lit(-1)).rlike("^[0-9]+$"))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: conditions on them are not written out again below them."""
    # the outer form: Spark infers a condition from the other one, and that would be written out below
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def harvest_links(pages: DataFrame, key: str) -> DataFrame:
    """key, link, headline, score, day: links of pages(key, url, html) that look like news of the site or of a newswire, first of each URL.

    Links are sought in <main>; only where none there counts, in the page without <nav> and <footer>. A title is the heading or the first
    block of a link, else its label, else the heading of the card around it (sources/markup.py reads them); what a link's URL says is judged in columns.
    """
    flat = read_links(pages, key)

    scheme, origin = F.regexp_extract("url", "^([a-zA-Z]+:)", 1), F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1)
    listed = F.regexp_replace("url", "[?#].*$", "")
    link = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
    link = link.when(F.col("href").startswith("//"), F.concat(scheme, "href")).when(F.col("href").startswith("/"), F.concat(origin, "href"))
    link = link.when(F.col("href").startswith("#"), F.concat(F.regexp_replace("url", "#.*$", ""), "href")).when(F.col("href").startswith("?"), F.concat(listed, "href"))
    flat = _settled(flat, link=link.otherwise(F.concat(F.regexp_replace(listed, "/[^/]*$", "/"), "href"))).where("link is not null")

    host = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://[^/?#]*", ""), r"[?#].*$", "")
    search = lambda c: F.regexp_extract(c, r"^[^?#]*(\?[^#]+)", 1)
    flat = _settled(flat, host=host("link"), site=host("url"), path=path("link"), listing=F.regexp_replace(path("url"), "/+$", ""))
    below = lambda x, y: x.endswith(F.concat(F.lit("."), y))
    own = (F.col("host") == F.col("site")) | below(F.col("host"), F.col("site")) | below(F.col("site"), F.col("host"))
    wire = F.lit(False)
    for name in NEWSWIRES:
        wire = wire | (F.col("host") == name) | F.col("host").endswith(f".{name}")
    itself = (F.col("host") == F.col("site")) & (F.regexp_replace("path", "/+$", "") == F.col("listing")) & (search("link") == search("url"))
    flat = _settled(flat, wire=wire).where((own | F.col("wire")) & ~(F.col("path").contains(".") & F.lower(F.substring_index("path", ".", -1)).isin(*FILES)) & ~itself)

    named = _settled(flat, small=F.lower(F.coalesce(F.try_url_decode("path"), F.col("path"))))
    small, listing = F.col("small"), F.lower("listing")
    under = (F.col("host") == F.col("site")) & (F.length(listing) > 1) & small.startswith(F.concat(listing, F.lit("/"))) & (F.length(small) > F.length(listing) + 1)
    rest = F.when(under, F.substring(small, F.length(listing) + 1, F.length(small))).otherwise(small)  # the listing's own path says nothing
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    named = _settled(named, under=under, rest=rest)
    named = _settled(named, article=points(F.col("under"), 2) + points(_says_news(F.col("rest")), 2) + points(_says_year(F.col("rest")), 2))
    section = F.exists(F.split("rest", "/"), lambda x: x.isin(*SECTION_WORDS))
    score = points(F.col("told"), 3) + F.col("article") - points(section, 4) - points(_pages_on(small, F.lower(search("link"))), 4)
    doubtful = F.col("wire") | F.col("from_card") | F.col("button")
    fit = _settled(named, score=score).where((~doubtful | (F.col("told") & (F.col("article") > 0))) & (F.col("score") >= LEAST_SCORE))

    clean = canonical_urls(fit, "link")[0]
    first = clean.groupBy(key, "area", "canonical_url").agg(F.min(F.struct("pos", "title", "score", "day")).alias("m"))
    best = first.withColumn("least", F.min("area").over(Window.partitionBy(key))).where(F.col("area") == F.col("least"))
    return best.select(key, F.col("canonical_url").alias("link"), F.substring("m.title", 1, MOST_TITLE).alias("headline"), F.col("m.score").alias("score"), F.col("m.day").alias("day"))


def harvest_feed(feeds: DataFrame, key: str) -> DataFrame:
    """key, pos, link, title, day: items of RSS or Atom bodies; the day is the one written, whatever its zone."""
    items = F.regexp_extract_all("body", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), 0)
    flat = feeds.select(key, F.posexplode(items).alias("pos", "item"))
    got = lambda p: F.regexp_extract("item", p, 1)
    title = F.trim(F.regexp_replace(got(r"(?is)<title[^>]*>(.*?)</title>"), r"<!\[CDATA\[|\]\]>", ""))
    alternate = F.regexp_extract(F.regexp_extract("item", r'(?is)<link\b[^>]*rel="alternate"[^>]*>', 0), 'href="([^"]*)"', 1)
    plain, first = F.trim(got(r"(?is)<link[^>]*>([^<]+)</link>")), F.regexp_extract("item", r'(?is)<link\b[^>]*href="([^"]*)"', 1)
    link = F.when(plain != "", plain).when(alternate != "", alternate).otherwise(first)
    iso = F.regexp_extract("item", r"(?is)<(?:published|updated|pubDate|dc:date)>\s*(20[0-9]{2}-[0-9]{2}-[0-9]{2})", 1)
    rfc = F.regexp_extract("item", r"(?is)<pubDate>\s*(?:[A-Za-z]{3}, )?([0-9]{1,2} [A-Za-z]{3} 20[0-9]{2})", 1)
    day = F.when(iso != "", iso).otherwise(F.date_format(F.try_to_timestamp(rfc, F.lit("d MMM yyyy")), "yyyy-MM-dd"))
    rows = canonical_urls(flat.withColumn("link", link).withColumn("title", title).withColumn("day", day).drop("item"), "link")[0]
    best = rows.groupBy(key, "canonical_url").agg(F.min(F.struct("pos", "title", "day")).alias("m"))
    return best.select(key, F.col("m.pos").alias("pos"), F.col("canonical_url").alias("link"), F.col("m.title").alias("title"), F.col("m.day").alias("day"))


_BLOCK = r"###\s*([0-9]+)\.\s*([^\n]*)\nURL:\s*(\S+)"


def parse_search(listings: DataFrame, key: str, most: int = 5) -> DataFrame:
    """key, position, title, url of search result blocks; https only, the first `most` of each query."""
    flat = listings.select(key, F.explode(F.regexp_extract_all("body", F.lit(_BLOCK), 0)).alias("b"))
    got = flat.select(key, F.regexp_extract("b", _BLOCK, 1).cast("int").alias("position"), F.trim(F.regexp_extract("b", _BLOCK, 2)).alias("title"), F.regexp_extract("b", _BLOCK, 3).alias("url")).where("url like 'https://%'")
    return got.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("n") <= most).drop("n")


REGULATOR = "results array<struct<number:string,tradename:string,product:string,decision_code:string,decision:string,decision_date:string>>"


def land_regulator(landed: DataFrame, most: int = 8) -> DataFrame:
    """endpoint, legacy_id, title, day, event_type: landed regulator JSON, the latest `most` of each endpoint."""
    flat = landed.select("endpoint", F.explode(F.slice(F.from_json("body", REGULATOR)["results"], 1, 500)).alias("r"))
    title = F.concat(F.coalesce("r.tradename", "r.product"), F.lit(" — "), F.coalesce("r.decision_code", "r.decision", F.lit("decision")))
    day = F.date_format(F.try_to_timestamp("r.decision_date", F.lit("yyyyMMdd")), "yyyy-MM-dd")
    rows = flat.select("endpoint", F.concat(F.lit("fda:"), "r.number").alias("legacy_id"), title.alias("title"), day.alias("day"), F.lit("regulatory_decision").alias("event_type"))
    newest = Window.partitionBy("endpoint").orderBy(F.desc_nulls_last("day"), F.regexp_extract("legacy_id", "([0-9]+)$", 1).cast("bigint"), "legacy_id")
    return rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most).drop("n")


LITERATURE = "map<string,struct<title:string,articleids:array<struct<idtype:string,value:string>>>>"


def land_literature(landed: DataFrame) -> DataFrame:
    """uid, title, url, legacy_id of landed summaries: numeric uids, a DOI where one looks right, else the article number."""
    flat = landed.select(F.explode(F.from_json("body", LITERATURE)).alias("uid", "doc")).where(F.col("uid").rlike("^[0-9]{1,12}$"))
    dois = F.filter("doc.articleids", lambda x: (x["idtype"] == "doi") & x["value"].rlike(r"^10\.[0-9]{4,9}/\S+$"))
    doi = F.try_element_at(dois, F.lit(1))["value"]
    url = F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "uid", F.lit("/")))
    return flat.select("uid", F.col("doc.title").alias("title"), url.alias("url"), F.concat(F.lit("pmid:"), "uid").alias("legacy_id"))


POST = "url string, link string, publish_time string, article struct<url:string,link:string,time:string>"


def land_posts(subscriptions: DataFrame, posts: DataFrame, accounts: DataFrame, host: str, most: int | None = 500) -> DataFrame:
    """post_id, account, url, at: posts of whitelisted accounts, payloads of several shapes, the first post of each URL.

    The batch is refused (an exception) with more than `most` posts, or if a whitelisted account is not followed.
    """
    if most is not None and posts.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} posts in a batch")
    if not accounts.where("state <> 'following'").isEmpty():
        raise ValueError("a whitelisted account is not followed")
    p = F.from_json("payload", POST)
    url = F.coalesce(p["url"], p["link"], p["article"]["url"], p["article"]["link"])
    at = F.coalesce(p["publish_time"], p["article"]["time"])
    rows = posts.join(subscriptions, "subscription_id").join(accounts.select("account"), "account").select("post_id", "account", url.alias("url"), at.alias("at"))
    rows = rows.where(F.col("url").startswith(f"https://{host}/"))
    first = rows.groupBy("account", "url").agg(F.min(F.struct("post_id", "at")).alias("m"))
    return first.select(F.col("m.post_id").alias("post_id"), "account", "url", F.col("m.at").alias("at"))


def run_history(lines: DataFrame, schema: str) -> DataFrame:
    """The whole JSON lines of a log (column value); blank and broken lines are left out."""
    parsed = lines.where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"), "value").where("v is not null")
    return parsed.select(F.from_json("value", schema).alias("r")).select("r.*")
