import html
import re

from posada.llm import html_extract
from posada.llm.queries import op10_html


def expected(page):
    """The blocks of the article of the driver's pages."""
    article = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_query_equals_article(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op10_html(spark, sf).collect():
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, expected(pages[r.page_id].html), len(r.text))


LONG = "Long text of the article that goes on &amp; on for a while, with many words in it."
PAGE = f"""<html><head><title>x</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div id="main-nav"><a href=x>x</a></div><div class="cookie-notice"><p>We use cookies. {LONG}</p></div>
<main><div class="post with-sidebar"><header><h1>Title</h1></header><p>{LONG}</p><p>Ok.</p><div class="advert">Buy! {LONG}</div><ul><li>one&nbsp;<b>two</b></li></ul><pre>a
  b</pre><form><p>{LONG}</p></form><p>{LONG}<script>var t="</p><p>no";</script></p></div>
<section class="comments"><p>Nice! {LONG}</p></section></main><aside><p>{LONG}</p></aside><div class=sidebar><p>a b c</p></div><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><footer>&copy; x</footer></body></html>"""


def test_boilerplate_goes_and_short_blocks_stay():
    t = html.unescape(LONG)
    assert html_extract.main_text(PAGE) == "\n".join(["Title", t, "Ok.", "one two", "a b", t])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "plain &lt; text"), (4, "<p>cut <b>of"), (5, "<div class=cookie>x"), (6, "<" * 2000), (7, "<p>" * 5000 + "x"), (8, "&am"), (9, "<nav>a</nav>"), (10, "<div>" * 3000 + "deep"), (10, "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "'x' as text", "1 as n_chars")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect() if r.page_id < 10}
    assert got[1] == got[2] == got[5] == got[9] == "" and got[3] == "plain < text" and got[4] == "cut of" and got[7] == "x" and got[8] == "&am"
    assert html_extract.extract(df.where("false")).count() == 0


def test_the_whole_article_stays():
    t, links = html.unescape(LONG), "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(4))
    text = html_extract.main_text
    sources = [f"Source {i}" for i in range(4)]
    body = f"<p>{LONG}</p>" * 12
    assert text(f"<body><article><h1>Title</h1><div class=entry-content>{body}</div><section><p>Last.</p><ul>{links}</ul></section></article></body>") == "\n".join(["Title", *[t] * 12, "Last.", *sources])
    assert text(f"<body><div><h1>Title</h1><div>{body}</div></div></body>") == "\n".join(["Title", *[t] * 12])
    assert text(f"<article><a name=x>{body}<p>End.</p></article>") == "\n".join([*[t] * 12, "End."])
    assert text(f"<article><p>{LONG}<p class=notice>Buy<p>{LONG}<ul><li class=social>Share<li>one</ul><p>End.</article>") == "\n".join([t, t, "one", "End."])
    assert text(f"<head><title>x</title><body><form action=x><div id=nav><a href=1>one</a></div><div class=sidebar-right><h1>Title</h1>{body}</div></form>") == "\n".join(["Title", *[t] * 12])
    assert text(f"<article><h1>Title</h1><p>{LONG}</p></article><div class=comments>{body}</div>") == "\n".join(["Title", t])


def test_headers_by_class_and_what_stays_in_the_article():
    body = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    t = html.unescape(LONG)
    text = lambda page: html_extract.main_text(page).split("\n")
    assert text(f"<body><div class=header>Name</div><div class='site-header'>Name</div>{body}</body>") == [t, t]
    assert text(f"<body><div class=header><h1>Title</h1></div>{body}</body>") == ["Title", t, t]
    assert text(f"<body><div class=header><h1>Site</h1></div><h1>Title</h1>{body}</body>") == ["Title", t, t]
    assert text(f"<article><div class='entry-header'><h1>Title</h1></div>{body}</article>") == ["Title", t, t]
    assert text(f"<article>{body}<div class='related-work'><p>{LONG}</p></div><p>See <math><mi>x</mi></math></p></article>") == [t, t, t, "See x"]
    assert text(f"<article>{body}</article><div class='related-posts'><p>{LONG}</p></div>") == [t, t]


def test_names_inside_an_article_are_topics():
    t = html.unescape(LONG)
    article = lambda x: html_extract.main_text(f"<body><article><h1>Title</h1><p>{LONG}</p>{x}<p>End.</p></article></body>").split("\n")
    for block in ("<p class=side>Kept.</p>", "<p class=alert>Kept.</p>", "<section id=search-algorithm>Kept.</section>", "<div class=social-history>Kept.</div>", "<section id=discussion>Kept.</section>",
                  "<blockquote class=reply>Kept.</blockquote>", "<table class=widget><tr><td>Kept.</table>"):
        assert article(block) == ["Title", t, "Kept.", "End."], block
    for block in ("<div class=cookie-box>Gone.</div>", "<div class=ad-slot-2>Gone.</div>", "<div class=social>Gone.</div>", "<ul class=widget><li><a href=1>Gone</a></ul>", "<!-- no end <p>Gone."):
        assert article(block) == ["Title", t, *([] if "!--" in block else ["End."])], block
    assert html_extract.main_text(f"<body><div class=alert>Gone. {LONG}</div><article><p>{LONG}</p></article></body>") == t


def test_elements_in_a_line_do_not_end_it():
    assert html_extract.main_text(f"<article><p>One <button>x<div>y</div></button>two <svg><text>z</text></svg><script>q</script>three</p><p>{LONG}</p></article>").startswith("One two three\n")


def test_deep_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    for page in ("<div class=ad>" * 20_000 + "x", "<div>text" * 20_000, "<p>a</p>" + "<section><div>b</div>" * 10_000, "<article>" + "<div class=widget>w" * 10_000):
        tracemalloc.start()
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 40 and tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
