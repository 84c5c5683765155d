import pytest

from tallyloom.sources import harvest


def test_listing_links(spark):
    html = """<nav><a href="/about">A long enough headline in navigation that must not count</a></nav>
      <a href="/news/2025/05/big-result">The study of many things met its goal today</a>
      <a href="/news/2025/05/big-result?utm_source=x">The study of many things met its goal today again</a>
      <a href="/news/file.pdf">A report as a file with a long enough headline</a>
      <a href="https://other.com/news/2025/x">Another site has a long enough headline as well</a>
      <a href="https://www.prnewswire.com/news-releases/abc">The wire carries a long enough headline as well</a>
      <a href="/news/page/2">Older entries of this very long list of news</a><a href="#top">Back to the top of this long page please</a>"""
    got = {r.link for r in harvest.harvest_links(spark.createDataFrame([(1, "https://x.com/news", html)], "page_id int, url string, html string"), "page_id").collect()}
    assert got == {"https://x.com/news/2025/05/big-result", "https://prnewswire.com/news-releases/abc"}


def test_posts_fail_as_a_batch(spark):
    subs = spark.createDataFrame([(1, 1)], "subscription_id int, account int")
    posts = spark.createDataFrame([(1, 1, '{"url":"https://h/a"}'), (2, 1, '{"article":{"link":"https://h/a"}}'), (3, 1, '{"url":"https://other/a"}')], "post_id int, subscription_id int, payload string")
    good = spark.createDataFrame([(1, "following")], "account int, state string")
    assert [(r.post_id, r.url) for r in harvest.land_posts(subs, posts, good, "h").collect()] == [(1, "https://h/a")]
    with pytest.raises(ValueError):
        harvest.land_posts(subs, posts, good, "h", most=2)
    with pytest.raises(ValueError):
        harvest.land_posts(subs, posts, spark.createDataFrame([(1, "left")], "account int, state string"), "h")


def harvested(spark, html, url="https://x.com/newsroom"):
    frame = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return {(r.link, r.headline, r.day) for r in harvest.harvest_links(frame, "page_id").collect()}


def test_titles_of_links(spark):
    said = "Company reports that the trial met its goals"
    assert harvested(spark, f"<a href='/newsroom/a'><time>2024-03-05</time><h3>{said}</h3><p>more</p></a>") == {("https://x.com/newsroom/a", said, "2024-03-05")}
    assert harvested(spark, f'<a href="/newsroom/a" aria-label="{said}"><img src="x>y.png"></a>') == {("https://x.com/newsroom/a", said, None)}
    assert harvested(spark, f'<div><h3>{said}</h3><p>x</p><div><a href="/newsroom/a">Read more</a></div></div>') == {("https://x.com/newsroom/a", said, None)}
    assert harvested(spark, f'<div><a href="/newsroom/a"></a><h3>{said}</h3></div>') == {("https://x.com/newsroom/a", said, None)}
    assert harvested(spark, f'<div><a href="/newsroom/a"></a></div><div><h3>{said}</h3></div>') == set()
    assert harvested(spark, '<a href="/newsroom/a">Learn more</a><a href="/about/team/a">Meet the people who lead this fine company today</a>') == set()
    assert harvested(spark, f'<a href="/newsroom/a">{said} &amp; more 2024.03.05</a>') == {("https://x.com/newsroom/a", f"{said} & more", "2024-03-05")}


def test_links_outside_main_count_where_main_has_none(spark):
    said = "Company reports that the trial met its goals"
    assert harvested(spark, f'<main><a href="/x">More</a></main><a href="/newsroom/a">{said}</a><nav><a href="/newsroom/b">{said}</a></nav>') == {("https://x.com/newsroom/a", said, None)}
    assert harvested(spark, f'<main><a href="//www.accesswire.com/1/news">{said}</a></main><a href="/newsroom/a">{said}</a>') == {("https://accesswire.com/1/news", said, None)}
