"""Column logic on URLs, titles, bodies and dates, used inside table jobs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track, and parameters that must not be stored.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "source")
SECRET = ("access_token", "api_key", "apikey", "auth", "key", "password", "signature", "token")
# Characters of no width.
ZERO_WIDTH = "​‌‍⁠﻿"
# Legal forms at the end of a company's name.
LEGAL = ("incorporated", "inc", "corporation", "corp", "company", "co", "ltd", "limited", "llc", "plc", "gmbh", "ag")
LEGAL_CN = ("股份有限公司", "有限责任公司", "有限公司", "公司")

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
MAX_URL_BYTES = 2048


def canonical_urls(df: DataFrame, url: str = "url", root: bool = False) -> tuple[DataFrame, DataFrame]:
    """df with canonical_url, and the rejected rows with their reason.

    Rejected: too long, not http(s), with user information, or with a secret parameter. The rest loses its fragment, "www.",
    doubled and final slashes and tracking parameters; the host is in lower case; parameters are ordered by name, then as they came.
    With `root`, a host without a path gets "/" and a scheme's own port goes, as a URL parser does it.
    """
    raw = F.trim(F.col(url))
    part = lambda k: F.regexp_extract(raw, _URL, k)
    scheme, authority, path, query = F.lower(part(1)), part(2), part(3), part(4)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    params = F.filter(F.split(query, "&"), lambda p: p != "")
    reason = (
        F.when(raw.isNull() | (raw == ""), "missing")
        .when(F.octet_length(raw) > MAX_URL_BYTES, "too_long")
        .when(~scheme.isin("http", "https") | (authority == ""), "not_http")
        .when(authority.contains("@"), "user_info")
        .when(F.exists(params, lambda p: name(p).isin(*SECRET)), "secret_parameter")
    )
    kept = F.filter(params, lambda p: ~name(p).isin(*TRACKING) & ~name(p).startswith("utm_"))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    tail = F.array_join(F.transform(ordered, lambda s: s["p"]), "&")
    host = F.regexp_replace(F.lower(authority), r"^www\.", "")
    clean = F.regexp_replace(F.regexp_replace(F.translate(path, ZERO_WIDTH, ""), "/{2,}", "/"), "/+$", "")
    if root:
        host = F.regexp_replace(host, F.when(scheme == "https", ":443$").otherwise(":80$"), F.lit(""))
        clean = F.when(clean == "", "/").otherwise(clean)
    out = F.concat(scheme, F.lit("://"), host, clean, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason").withColumn("canonical_url", out), marked.where("reject_reason is not null")


def evidence_identity(content: Column, title: Column, snippet: Column, canonical_url: Column) -> tuple[Column, Column]:
    """The body's hash, and the evidence id made of URL and hash."""
    blank = F.coalesce(content, F.lit("")) == ""
    body = F.trim(F.when(blank, F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(snippet, F.lit("")))).otherwise(content))
    sha = F.sha2(body, 256)
    return sha, F.concat(F.lit("evd_"), F.substring(F.sha2(F.concat(canonical_url, F.lit("\n"), sha), 256), 1, 24))


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(x: Column, ascii_only: bool = False) -> Column:
    """Compatibility form; Spark has no builtin. With ascii_only the caller knows that there is nothing to do, and no Python runs."""
    return x if ascii_only else _nfkc(x)


def norm_name(x: Column, ascii_only: bool = False) -> Column:
    """For fingerprints: compatibility form (a trade mark sign becomes letters), lower case, letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(x, ascii_only)), "[®™©]", ""), r"[^\p{L}\p{N}]+", " "))


def fingerprint(company: Column, product: Column, event_type: Column, day: Column, ascii_only: bool = False) -> Column:
    return F.concat_ws("|", norm_name(F.coalesce(company, F.lit("")), ascii_only), norm_name(F.coalesce(product, F.lit("")), ascii_only), event_type, F.coalesce(F.substring(day, 1, 10), F.lit("")))


def norm_entity(x: Column, ascii_only: bool = False) -> Column:
    """For comparing companies: marks go first, then legal forms at the end and all separators."""
    base = F.lower(nfkc(F.regexp_replace(x, "[®™©]", ""), ascii_only))
    bare = F.regexp_replace(F.regexp_replace(base, r"(?:[\s,.]+(?:" + "|".join(LEGAL) + r")\.?)+$", ""), "(?:" + "|".join(LEGAL_CN) + ")$", "")
    return F.regexp_replace(bare, r"[\s\-_.,'’()（）]+", "")


def fact_hash(facts: Column, keep_empty: bool = False) -> Column:
    """A hash of a map that ignores order, key case and spacing; without keep_empty blank values don't count and no facts give null."""
    pairs = F.transform(F.map_entries(facts), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.trim(F.regexp_replace(F.coalesce(e["value"], F.lit("")), r"\s+", " ")).alias("v")))
    used = pairs if keep_empty else F.filter(pairs, lambda p: p["v"] != "")
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(used), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "\n"), F.lit("}"))
    return F.sha2(text, 256) if keep_empty else F.when(F.size(used) > 0, F.sha2(text, 256))


# Names of months, each short or whole.
_MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:t(?:ember)?)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
_MONTH = rf"({'|'.join(_MONTHS)})\.?"
_NTH = r"([0-9]{1,2})(?:st|nd|rd|th)?"
# Fixed rule: explicit dates, as (pattern, groups of year, month and day; 0 where there is no day).
_FORMS = (
    (r"\b(20[0-9]{2})[-/.](1[0-2]|0?[1-9])[-/.](3[01]|[12][0-9]|0?[1-9])(?:\b|T)", (1, 2, 3)),
    (r"\b(20[0-9]{2})[-/.](1[0-2]|0?[1-9])\b(?![-/.](?:3[01]|[12][0-9]|0?[1-9])(?:\b|T))", (1, 2, 0)),
    (r"(20[0-9]{2})\s*年\s*(1[0-2]|0?[1-9])\s*月\s*(3[01]|[12][0-9]|0?[1-9])\s*日", (1, 2, 3)),
    (r"(20[0-9]{2})\s*年\s*(1[0-2]|0?[1-9])\s*月(?!\s*(?:3[01]|[12][0-9]|0?[1-9])\s*日)", (1, 2, 0)),
    (rf"(?i)\b{_MONTH}\s+{_NTH},?\s+(20[0-9]{{2}})\b", (3, 1, 2)),
    (rf"(?i)\b{_NTH}\s+{_MONTH},?\s+(20[0-9]{{2}})\b", (3, 2, 1)),
    (rf"(?i)\b{_MONTH},?\s+(20[0-9]{{2}})\b", (2, 1, 0)),
)
_PATH = r"/(20[0-9]{2})/(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])(?:[/?#]|$)"


def dates_in(text: Column) -> Column:
    """All explicit days (yyyy-MM-dd) and months (yyyy-MM) in a text, in no order; days that don't exist are left out."""
    short = F.array(*[F.lit(m[:3]) for m in _MONTHS])

    def found(pattern: str, year: int, month: int, day: int) -> Column:
        def one(m: Column) -> Column:
            part = lambda g: F.regexp_extract(m, pattern, g)
            number = F.array_position(short, F.lower(F.substring(part(month), 1, 3))).cast("string") if "jan" in pattern else part(month)
            return F.concat_ws("-", part(year), F.lpad(number, 2, "0"), *([F.lpad(part(day), 2, "0")] if day else []))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), one)

    every = F.concat(*[found(p, *groups) for p, groups in _FORMS])
    return F.filter(every, lambda x: (F.length(x) == 7) | F.try_to_date(x, "yyyy-MM-dd").isNotNull())


def latest_date(text: Column, today: Column) -> Column:
    """The latest explicit day or month in the first 600 characters that is not after today (yyyy-MM-dd strings)."""
    return F.array_max(F.filter(dates_in(F.substring(text, 1, 600)), lambda x: x <= today))


def path_date(url: Column, today: Column) -> Column:
    """The day in a URL's path, if it is not after today."""
    day = F.concat_ws("-", F.regexp_extract(url, _PATH, 1), F.regexp_extract(url, _PATH, 2), F.regexp_extract(url, _PATH, 3))
    return F.when(url.rlike(_PATH) & (day <= today) & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def inferred_date(content: Column, title: Column, url: Column, today: Column) -> Column:
    """From the body, else the title, else the URL's path."""
    return F.coalesce(latest_date(content, today), latest_date(title, today), path_date(url, today))


def stale_month(latest: Column, since_month: Column) -> Column:
    """The month of a date that is before since_month; null otherwise."""
    return F.when(F.substring(latest, 1, 7) < since_month, F.substring(latest, 1, 7))


def date_key(partial: Column) -> Column:
    """A partial date (year, month or day) as a string that sorts: missing parts are 00."""
    return F.when(F.length(partial) == 4, F.concat(partial, F.lit("-00-00"))).when(F.length(partial) == 7, F.concat(partial, F.lit("-00"))).otherwise(partial)


def age_days(partial: Column, today: Column) -> Column:
    """Whole days from a partial date (missing parts are 1) to today."""
    full = F.when(F.length(partial) == 4, F.concat(partial, F.lit("-01-01"))).when(F.length(partial) == 7, F.concat(partial, F.lit("-01"))).otherwise(partial)
    return F.datediff(F.to_date(today), F.try_to_date(full, "yyyy-MM-dd"))


def instant(x: Column) -> Column:
    """A timestamp from yyyyMMdd, yyyy-MM, yyyy-MM-dd, ISO, or epoch seconds or milliseconds; null for anything else."""
    digits = x.rlike("^[0-9]+$")
    epoch = F.when(digits & (F.length(x) == 10), F.timestamp_seconds(x.try_cast("bigint"))).when(digits & (F.length(x) == 13), F.timestamp_millis(x.try_cast("bigint")))
    forms = ((r"^[0-9]{8}$", "yyyyMMdd"), (r"^[0-9]{4}-[0-9]{2}$", "yyyy-MM"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"))
    tried = [F.when(x.rlike(p), F.try_to_timestamp(x, F.lit(f))) for p, f in forms]
    return F.coalesce(epoch, *tried, F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.try_to_timestamp(x)))


# Named entities that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _numbered(x: Column, pattern: str, base: int) -> Column:
    """x with each entity of the pattern replaced by the character that its number names; numbers that name none leave nothing."""

    def one(text: Column, entity: Column) -> Column:
        code = F.conv(F.regexp_extract(entity, pattern, 1), base, 10).try_cast("bigint")
        named = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(named, code)), 8, "0")), "UTF-32")
        return F.replace(text, entity, F.coalesce(char, F.lit("")))

    return let(x, lambda v: F.aggregate(F.array_distinct(F.regexp_extract_all(v, F.lit(pattern), 0)), v, one))


def decode_entities(x: Column) -> Column:
    """Numeric entities, hexadecimal ones first, then the named ones."""
    x = _numbered(_numbered(x, r"&#[xX]([0-9A-Fa-f]+);", 16), r"&#([0-9]+);", 10)
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def strip_tags(html: Column) -> Column:
    """Scripts and styles go, tags become spaces, white space collapses."""
    x = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style>", " ")
    return squeezed(F.regexp_replace(x, r"(?s)<[^>]*>", " "))


def strip_html(html: Column) -> Column:
    """The text of a page: no tags, entities decoded, white space collapsed."""
    return squeezed(decode_entities(strip_tags(html)))


def clean_title(title: Column) -> Column:
    """No zero-width characters, no site or brand at the end, dots as an ellipsis."""
    x = F.translate(title, ZERO_WIDTH, "")
    for _ in range(2):
        x = F.regexp_replace(x, r"\s*\|\s*[^|]{1,40}$", "")
    x = F.regexp_replace(x, r"\s+[-–—]\s+[A-Z][A-Za-z0-9 ]{1,24}$", "")
    return F.trim(F.regexp_replace(x, r"\.\.\.", "…"))


JUNK_LINE = r"^(?:skip to |share|menu|home|search|login|sign in|cookie)"
TAIL_LINE = r"^(?:related articles|related posts|about the author|share this|相关阅读|相关文章|版权声明)"
BODY_LIMIT, BODY_LEAST, BODY_SHOWN = 8_000, 200, 400


def clean_content(content: Column) -> Column:
    """Leading junk lines go, the text ends before a tail marker, blank lines collapse, and it is cut at BODY_LIMIT characters."""
    lines = F.split(content, "\n")
    first = F.array_position(F.transform(lines, lambda x: ~F.lower(F.trim(x)).rlike(JUNK_LINE) & (F.trim(x) != "")), True)
    body = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    tail = F.array_position(F.transform(body, lambda x, i: F.lower(F.trim(x)).rlike(TAIL_LINE) & (i > 0)), True)
    kept = F.when(tail > 1, F.slice(body, 1, (tail - 1).cast("int"))).otherwise(body)
    text = F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    return F.when(F.length(text) > BODY_LIMIT, F.concat(F.substring(text, 1, BODY_LIMIT), F.lit("…"))).otherwise(text)


def first_line(content: Column) -> Column:
    """The first line that is neither blank nor junk, cut at BODY_LIMIT characters of its own; null where there is none."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).rlike(JUNK_LINE))
    line = F.try_element_at(lines, F.lit(1))
    return F.when(F.length(line) > BODY_LIMIT, F.concat(F.substring(line, 1, BODY_LIMIT), F.lit("…"))).otherwise(line)


def content_status(clean: Column) -> Column:
    return F.when(F.length(clean) < BODY_LEAST, "failed").when(F.length(clean) >= BODY_SHOWN, "shown").otherwise("stored")


def sheet_safe(x: Column) -> Column:
    """A cell that a spreadsheet does not run."""
    return F.when(x.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), x)).otherwise(x)


def csv_line(*cells: Column) -> Column:
    """One line: every cell quoted, quotes doubled, made safe."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(sheet_safe(F.coalesce(c.cast("string"), F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])


def error_code(message: Column, allowed: tuple[str, ...] = ("timeout", "http_error", "parse_error", "budget", "merge_failed")) -> Column:
    """A public error code: one of the allowed, or http_<status>, or "internal"."""
    status = F.regexp_extract(message, r"\b([45][0-9]{2})\b", 1)
    return F.when(message.isin(*allowed), message).when(status != "", F.concat(F.lit("http_"), status)).otherwise("internal")
