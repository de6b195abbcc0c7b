"""Main texts against a plain reading of the pages' articles, and hand-made pages."""

from __future__ import annotations

import html
import re
import time

from wardlight.llm import html_text as ht
from wardlight.llm.registry import QUERIES
from wardlight.llm.tables import load


def plain(source: str) -> str:
    """The article of a page of the supplied tables: blocks begin with <h1> or <p>."""
    body = re.sub(r"<!--.*?-->", "", source.split("<article>", 1)[1].split("</article>")[0], flags=re.S)
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " " if "<br" in b else "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in load(spark, sf_dir, "pages").collect()}
    rows = QUERIES["op4_html"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = plain(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_walk():
    page = ht.Page(
        '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav>'
        '<div class="cookie-notice">We use</div><main><header><h1>A &amp; B</h1></header><p>one  <b>t</b>wo\n<p>three<br>four'
        '<ul><li>x<li>y</ul><aside>side</aside><script>var a="</p><p>no";</script><table><tr><td>c1<td>c2</table>'
        '<div id=comments>bad</div>tail &lt;&#233;&nbsp;!</main><footer>end</footer><p a="'
    )
    assert page.text() == "A & B\none two\nthree four\nx\ny\nc1\nc2\ntail <é !"
    assert ht.Page("").text() == "" and ht.Page("a<b>c</b> < d").text() == "ac < d"
    assert ht.Page("<div>one</div>two<article></article>").text() == "one\ntwo"


def test_templates_are_deleted(spark):
    def page(i):
        box = "<section><h2>More from us</h2><p>Read our blog</p></section>"
        return f"<body><div><p>Welcome to the site</p></div><article><p>Story {i} of many words</p>{box}</article></body>"

    rows = [(i, f"https://Host.example/{i}", page(i)) for i in range(8)]
    rows += [(100 + i, "https://copies.example/x", "<p>Same story</p>") for i in range(9)]
    rows += [(200, None, None), (201, "", ""), (202, "https://one.example", page(3)), (202, "https://one.example", page(3))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, template int")
    got = ht.main_texts(df).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[3] == "Story 3 of many words"
    assert by_id[104] == "Same story"
    assert by_id[200] == by_id[201] == ""
    assert by_id[202] == "Story 3 of many words\nMore from us\nRead our blog"
    assert ht.main_texts(df.limit(0)).count() == 0


def test_inline_elements_stay_in_their_sentences(spark):
    def page(i):
        linked = '<div>Fact ' + str(i) + ' <a href="/x"><div>See all</div></a> after</div>'
        return f"<article><p><b>Note:</b> day {i} by <a href='/jd'>Jane Doe</a> of the desk</p>{linked}</article>"

    df = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    for r in ht.main_texts(df).collect():
        i = r["page_id"]
        assert r["text"] == f"Note: day {i} by Jane Doe of the desk\nFact {i}\nafter"


def test_rarer_boxes_are_deleted_and_passages_stay(spark):
    def page(i):
        advert = f"<div><p>Shoes of kind {i % 3}</p><p>Buy them now</p></div>"
        menu = f"<ul><li><a>Topic {i % 4}</a></li><li><a>Other topic {i % 4}</a></li></ul>"
        notice = "<div>Rules changed</div>" if i % 7 == 0 else '<div class="notice">Seen</div>'
        quoted = "<p>To be or not to be</p>" if i % 3 == 0 else "<ul><li>To be or not to be</li></ul>" if i == 1 else ""
        marked = f"<article>{notice}<h1>Day {i}</h1>{advert}<p>Story {i} of many words</p>{quoted}</article>"
        return f"<body>{menu}{marked if i % 2 else marked.replace('article', 'div')}</body>"

    rows = [(i, f"https://boxes.example/{i}", page(i)) for i in range(60)]
    # Without its class, a listed block is the same block.
    bare = "<article><div>Seen</div><p>The last story</p></article>"
    rows.append((60, "https://boxes.example/60", bare))
    # Near copies in one wrapper are stories, not boxes.
    body = "".join(f"<p>Paragraph {k} of a long story that several pages tell alike, with one other headline</p>" for k in range(9))
    rows += [(100 + i, f"https://news.example/{i}", f"<article><h1>Head {i}</h1><div>{body if i < 8 else i}</div></article>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in ht.main_texts(df).collect()}
    assert got[60] == "The last story"
    for i in range(60):
        lines = [f"Day {i}", f"Story {i} of many words"]
        if i % 2 and (i % 3 == 0 or i == 1):
            lines.append("To be or not to be")
        assert [x for x in got[i].split("\n") if i % 2 or x != "To be or not to be"] == lines
    assert all(got[100 + i].startswith(f"Head {i}\nParagraph 0") and "Paragraph 8" in got[100 + i] for i in range(8))


def test_names_and_wrappers_around_articles():
    """Whole names decide; an element that holds the only article is not dropped; teasers are not the article."""
    def text(source):
        return ht.read_page(source).text()

    assert text('<div class="content no-sidebar"><article>A story</article></div>') == "A story"
    assert text('<div id="page" class="site header-fixed"><main>A story</main></div>') == "A story"
    assert text('<form id="aspnetForm"><nav>menu</nav><article>A story</article></form>') == "A story"
    assert text('<article>A story<section id="share-price">of shares</section></article>') == "A story\nof shares"
    assert text('<p>good</p><div class="comments"><article>bad</article></div>') == "good"
    assert text('<aside><article>teaser</article></aside><p>good</p>') == "good"
    assert text('<div class="site-footer">f</div><div class="related_posts">r</div><div id="top-banner">b</div><p>good</p>') == "good"
    story = "A long story of many words. " * 9
    assert text(f"<article>Teaser</article><div><p>{story}</p></div>") == f"Teaser\n{story.strip()}"
    assert text(f"<article>{story}</article><div>Short text</div>") == story.strip()


def test_repeated_stories_stay(spark):
    """Blocks of an article, and long ones anywhere, that some of a host's pages repeat."""
    story = "One story that six of forty pages tell in the same words. " * 6
    extra = f"<div>{story}</div><table><tr><td>c1<td>c2</table><ul><li>i1<li>i2</ul>"

    def page(i):
        body = f"<h1>Head {i}</h1><p>Lead {i}</p>{extra if i < 6 else ''}"
        return f"<article>{body}</article>" if i % 2 else f"<div>{body.split('<table>')[0]}</div>"

    df = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    for r in ht.main_texts(df).collect():
        i = r["page_id"]
        lines = [f"Head {i}", f"Lead {i}"]
        if i < 6:
            lines += [story.strip(), *(["c1", "c2", "i1", "i2"] if i % 2 else [])]
        assert r["text"].split("\n") == lines


def test_deep_pages():
    """Time grows with the length of a page, however its elements nest."""
    for source in (
        "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "x", "<p><table><tr><td>" + "<div>" * 20_000, "<ul>" + "<li><b>" * 20_000,
        "<table>" + "<tr><td>" * 20_000, "word <i>and</i> " * 50_000,
    ):
        start = time.perf_counter()
        ht.read_page(source)
        assert time.perf_counter() - start < 5
