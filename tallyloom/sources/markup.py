"""Links of listing pages, read by a markup parser with a stack of open elements.

A page is read once. For every link the parser keeps the text of its blocks, its first heading, its label, and the headings that stand beside it between the
links before and after it, with how many elements part them; from these a title and a day are chosen. Broken markup has a defined reading: an element that is never closed ends
with the element around it; a closing tag without an open element is passed over; a link inside a link ends the outer one; a page that breaks off ends all that is open.
Scripts, styles and comments are no text; markup that was written as entities is taken out of texts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# What buttons say, elements without an end, elements that part blocks of text, words before a listing's day.
BUTTON_VERBS = ("read", "learn", "view", "see", "find out", "download", "continue", "click", "more", "next", "previous")
BUTTON_WORDS = ("home", "news")
BUTTON_CN = ("阅读", "查看", "了解", "点击", "更多", "详情")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("div", "p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "time", "br", "dt", "dd", "td", "tr", "figure", "figcaption")
BEFORE_DAY = ("hot", "new", "top", "置顶", "最新")
TEMPLATES = ("{{", "%7b%7b")
LEAST_TITLE, CARD_REACH = 12, 1500
HEADLINE_HAN, HEADLINE_CHARS, HEADLINE_WORDS = 12, 35, 5

HEADINGS = BLOCKS[5:11]
_NUMBER = re.compile("[0-9]+")


def squeezed(text: str) -> str:
    return " ".join(text.split())


def plain(text: str) -> str:
    """Text with single spaces; markup that was written as entities goes."""
    while "<" in text and ">" in text[text.index("<") :]:
        a = text.index("<")
        text = text[:a] + " " + text[text.index(">", a) + 1 :]
    return squeezed(html.unescape(text) if "&" in text else text)


def days(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and day of each date in numbers: a year, a month and a day, parted by one sign each, in that order."""
    numbers = list(_NUMBER.finditer(text))
    for y, m, d in zip(numbers, numbers[1:], numbers[2:], strict=False):
        signs = text[y.end() : m.start()].strip(), text[m.end() : d.start()].strip()
        if len(y[0]) != 4 or y[0][:2] not in ("19", "20") or len(m[0]) > 2 or len(d[0]) > 2 or signs[0] not in ("-", ".", "/", "年") or signs[1] not in ("-", ".", "/", "月"):
            continue
        if 1 <= int(m[0]) <= 12 and 1 <= int(d[0]) <= 31:
            end = d.end() + len(text[d.end() :]) - len(text[d.end() :].lstrip())
            yield y.start(), end + 1 if text[end : end + 1] == "日" else d.end(), f"{y[0]}-{int(m[0]):02d}-{int(d[0]):02d}"


def split_day(text: str) -> tuple[str, str | None]:
    """A title without the day of a listing before or behind it, and that day."""
    for start, end, day in days(text):
        lead = text[:start].strip().lower()
        if lead == "" or lead in BEFORE_DAY and text[:start] != text[:start].rstrip():
            return text[end:].strip(), day
        if not text[end:].strip():
            return text[:start].strip(), day
    return text, None


def han(text: str) -> int:
    return sum("一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "\U00020000" <= c <= "\U0003ffff" or c in "々〇" for c in text)


def headline_like(title: str) -> bool:
    """A sentence: enough Han characters, or enough characters in enough words."""
    return han(title) >= HEADLINE_HAN or len(title) >= HEADLINE_CHARS and len(title.split()) >= HEADLINE_WORDS


def button_like(title: str) -> bool:
    small = title.lower()
    return small in BUTTON_WORDS or small.startswith(BUTTON_CN) or any(small == v or small.startswith(v) and small[len(v)].isspace() for v in BUTTON_VERBS)


def usable(title: str) -> bool:
    return len(title) >= LEAST_TITLE and not any(t in title.lower() for t in TEMPLATES) and (not button_like(title) or headline_like(title))


class _Open:
    """An element that is open: its name, and the number of the tag that opened it."""

    def __init__(self, name: str, number: int) -> None:
        self.name, self.number = name, number


class _Link:
    def __init__(self, attributes: dict[str, str | None], depth: int, main: bool, aside: bool, start: int) -> None:
        self.attributes, self.depth, self.main, self.aside, self.start = attributes, depth, main, aside, start
        self.blocks, self.text, self.headed = [""], "", None
        self.lead = self.follow = None

    def add(self, text: str) -> None:
        self.text += text
        self.blocks[-1] += text
        if self.headed is not None and not self.headed[1]:
            self.headed[0] += text

    def titled(self) -> tuple[str, str | None, bool]:
        """Title, day, and whether the title stands outside the link's text."""
        whole = plain(self.text)
        day = next((d for _, _, d in days(whole)), None)
        headed = split_day(plain(self.headed[0]))[0] if self.headed else ""
        blocks = [b for b in (split_day(plain(b))[0] for b in self.blocks) if b]
        own = headed if usable(headed) else split_day(whole)[0] if len(blocks) < 2 else next(filter(usable, blocks), "")
        if usable(own):
            return own, day, False
        label = plain(self.attributes.get("aria-label") or self.attributes.get("title") or "")
        if headline_like(label):
            return label, day, True
        card = self.follow if not whole and self.follow else self.lead[0] if self.lead and self.lead[1] <= (2 if whole else 0) else ""
        return plain(card), day, True


class Listing(HTMLParser):
    """The links of a page in order."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", page):
            self.lines.append(m.end())
        self.stack: list[_Open] = []
        self.links: list[_Link] = []
        self.link: _Link | None = None
        self.number = 0
        self.heading: list | None = None  # of one outside links: name, start, text
        self.last: tuple[str, int, int] | None = None  # the heading before: text, number of the tag that ended it, start
        self.silent_links: list[_Link] = []  # the link before, while a heading may follow it
        self.after = 0  # where the link before ended
        self.feed(page)
        self.close()
        self._end_link()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _inside(self, *names: str) -> bool:
        return any(e.name in names for e in self.stack)

    def _end_link(self) -> None:
        if self.link is not None:
            self.links.append(self.link)
            self.silent_links, self.after, self.last, self.heading = [self.link], self._at(), None, None
            self.link = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.number += 1
        if tag == "a":
            self._end_link()
            self.silent_links = []
            self.link = _Link({k: v for k, v in reversed(attrs)}, len(self.stack), self._inside("main"), self._inside("nav", "footer"), self._at())
            if self.last and self._at() - self.last[2] <= CARD_REACH:
                self.link.lead = (self.last[0], sum(e.number > self.last[1] for e in self.stack))
        elif self.link is not None:
            self.link.add(" ")
            if tag in BLOCKS:
                self.link.blocks.append("")
            if tag in HEADINGS and self.link.headed is None:
                self.link.headed = ["", False]
        elif tag in HEADINGS:
            self.heading = [tag, self._at(), "", len(self.stack)]
        elif self.heading is not None:
            self.heading[2] += " "
        if tag not in VOID:
            self.stack.append(_Open(tag, self.number))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.number += 1
        if tag == "a":
            self._end_link()
        elif self.link is not None:
            self.link.add(" ")
            if tag in BLOCKS:
                self.link.blocks.append("")
            if tag in HEADINGS and self.link.headed is not None:
                self.link.headed[1] = True
        elif self.heading is not None and tag == self.heading[0]:
            text, start, depth = self.heading[2], self.heading[1], self.heading[3]
            self.last, self.heading = (text, self.number, start), None
            for link in self.silent_links:
                # beside the link: what was open around it is open still
                if link.depth <= depth and link.depth <= len(self.stack) and start - self.after <= CARD_REACH:
                    link.follow = text
            self.silent_links = []
        if any(e.name == tag for e in self.stack):
            while self.stack.pop().name != tag:
                pass
            if self.link is not None and len(self.stack) < self.link.depth:
                self._end_link()
            # a container that held the link has ended: no heading beside it can follow
            self.silent_links = [link for link in self.silent_links if link.depth <= len(self.stack)]

    def handle_data(self, data: str) -> None:
        if self._inside("script", "style"):
            return
        if self.link is not None:
            self.link.add(data)
        elif self.heading is not None:
            self.heading[2] += data


SCHEMA = "area int, pos int, href string, title string, day string, from_card boolean, told boolean, button boolean"


def links_of(page: str) -> Iterator[tuple]:
    """SCHEMA of the links of a page that have a target and a usable title: area 0 is <main>, area 1 all but <nav> and <footer>."""
    for pos, link in enumerate(Listing(page).links):
        href = (link.attributes.get("href") or "").strip()
        if not href or any(t in href.lower() for t in TEMPLATES):
            continue
        title, day, from_card = link.titled()
        if not usable(title):
            continue
        for area, holds in ((0, link.main), (1, not link.aside)):
            if holds:
                yield area, pos, href, title, day, from_card, headline_like(title), button_like(title)


def read_links(pages: DataFrame, key: str) -> DataFrame:
    """key, url and SCHEMA of the links of pages(key, url, html), a row each; pages are read where they lie, a batch of them at a time."""
    kind = pages.schema[key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{key} {kind}, url string, {SCHEMA}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, u, *link) for k, u, page in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True) for link in links_of(page or "")]
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select(key, "url", "html").mapInArrow(run, schema)
