"""The markup parser: broken pages, entities, days, cards."""

import pytest

from tallyloom.sources import markup as M

SAID = "Company reports that the trial met its goals"


def links(page):
    return [(href, title, day, card) for area, _, href, title, day, card, *_ in M.links_of(page) if area == 1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-03-05 Title", ("Title", "2024-03-05")), ("Title 2024.3.5", ("Title", "2024-03-05")), ("New 2024/03/05 Title", ("Title", "2024-03-05")), ("置顶 2024年3月5日 标题", ("标题", "2024-03-05")),
        ("Title of 2024-03-05 and more", ("Title of 2024-03-05 and more", None)), ("2024-13-05 Title", ("2024-13-05 Title", None)), ("12024-03-05 Title", ("12024-03-05 Title", None)), ("2024-03-055", ("2024-03-055", None)),
        ("1850-03-05 x", ("1850-03-05 x", None)), ("", ("", None)),
    ],
)
def test_days_are_parted_from_titles(text, want):
    assert M.split_day(text) == want


def test_titles_buttons_and_headlines():
    assert M.headline_like("五六七八九十一二三四五六") and not M.headline_like("五六七八九十一二三四五") and M.headline_like("a" * 31 + " b c d e") and not M.headline_like("a" * 50)
    assert M.button_like("Read more") and M.button_like("NEWS") and M.button_like("查看全部") and not M.button_like("Reading room") and not M.button_like("News of the day")
    assert not M.usable("short") and not M.usable("{{ a long template title }}") and M.usable("a title of its own") and not M.usable("Read the full text")


def test_plain_text():
    assert M.plain(" a &amp; b\n <b>c</b> ") == "a & b c" and M.plain("1 < 2") == "1 < 2" and M.plain("x <unclosed") == "x <unclosed"


def test_broken_markup_has_a_defined_reading():
    assert links(f'<a href="/a">{SAID}') == [("/a", SAID, None, False)]  # a page that breaks off
    assert links(f'<a href="/a">{SAID}<a href="/b">{SAID}</a>') == [("/a", SAID, None, False), ("/b", SAID, None, False)]  # a link in a link
    assert links(f'</div></p><div><a href="/a">{SAID}</div>more text after the link that is not closed') == [("/a", SAID, None, False)]  # ends with the element around it
    assert links(f"<a href=/a>{SAID}</a>") == [("/a", SAID, None, False)] and links(f'<A HREF="/a" HREF="/b">{SAID}</A>') == [("/a", SAID, None, False)]
    assert links("") == [] and links("no markup < at > all") == [] and links("<a>" + SAID + "</a>") == [] and links(f'<a href="{{{{url}}}}">{SAID}</a>') == []
    assert links(f'<!-- <a href="/x">{SAID}</a> --><script>var a = "<a href=/y>{SAID}</a>"</script><a href="/a">{SAID}<style>p{{}}</style></a>') == [("/a", SAID, None, False)]
    assert links(f'<a href="/a&amp;b">{SAID} &lt;b&gt;now&lt;/b&gt;</a>') == [("/a&b", f"{SAID} now", None, False)]
    deep = "<div>" * 3000 + f'<a href="/a">{SAID}</a>'
    assert links(deep) == [("/a", SAID, None, False)]


def test_cards():
    far = "<p>x</p>" * 400
    assert links(f'<h2>{SAID}</h2><div><a href="/a"></a></div>') == []  # a link without text takes a heading only from where it stands
    assert links(f'<div><h2>{SAID}</h2><a href="/a"></a></div>') == [("/a", SAID, None, True)]
    assert links(f'<h2>{SAID}</h2><div><div><a href="/a">More</a></div></div>') == [("/a", SAID, None, True)] and links(f'<h2>{SAID}</h2><div><div><div><a href="/a">More</a></div></div></div>') == []
    assert links(f'<h2>{SAID}</h2>{far}<a href="/a">More</a>') == []  # too far
    assert links(f'<h2>{SAID}</h2><a href="/a">First link with a title</a><a href="/b">More</a>') == [("/a", "First link with a title", None, False)]  # a heading belongs to the link that follows it
    assert links(f'<a href="/a"></a><div><h3>{SAID}</h3></div>') == [("/a", SAID, None, True)] and links(f'<a href="/a"></a><a href="/b">x</a><h3>{SAID}</h3>') == []


def test_areas():
    page = f'<nav><a href="/n">{SAID}</a></nav><main><a href="/m">{SAID}</a></main><a href="/o">{SAID}</a><footer><a href="/f">{SAID}</a></footer>'
    assert [(r[0], r[2]) for r in M.links_of(page)] == [(0, "/m"), (1, "/m"), (1, "/o")]


def test_pages_without_html(spark):
    pages = spark.createDataFrame([(1, "https://x.com", None), (2, None, f'<a href="/a">{SAID}</a>'), (3, "https://x.com", "")], "page_id int, url string, html string")
    assert [(r.page_id, r.url, r.href) for r in M.read_links(pages, "page_id").where("area = 1").collect()] == [(2, None, "/a")]
