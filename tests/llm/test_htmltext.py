from __future__ import annotations

import random
import re
from html import unescape

import pytest
from conftest import SF

from tomewright.llm import htmltext
from tomewright.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, schema=SCHEMA):
    return {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, schema)).collect()}


def main_text(html: str) -> str:
    return " ".join(htmltext.candidates(htmltext.lines_of(html))[0])


def test_op13_equals_a_plain_reading_of_the_articles(spark):
    """The tables' pages have an article of headings, paragraphs, bold words and line breaks."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op13_html"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"(?s)<article>(.*)</article>", page.html)[1]
        blocks = re.sub(r"<[^>]*>", "\n", re.sub("</?b>", "", inside)).split("\n")
        want = " ".join(filter(None, (" ".join(unescape(b).split()) for b in blocks)))
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (want, len(want), page.url)


def test_structure():
    body = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar with-comments">
      <header><h1>Site</h1></header><div id="main-menu"><a href=x>Home</a></div><div class="cookieNotice">We use cookies</div>
      <main><article class="post"><header><h2>Head&shy;line</h2></header><p>One &lt;b&gt;  two<b>th</b>ree<br>four
      <p>five &#233;&eacute;<script>if (a < b) document.write("</p>no")</script><!-- <p>no</p> --> six
      <div class="ad-slot">buy</div><aside>by the way</aside><form><label>name</label><input value="no"></form>
      <ul><li>a<li>b</ul><table><tr><td>1<td>2</table><footer>tags</footer></article>
      <section id="comments"><article class="comment"><p>First!</p></article></section></main>
      <div class="widget sponsored">buy</div><footer>&copy; us</footer></body></html>"""
    assert main_text(body) == "Head\xadline One <b> twothree four five éé six a b 1 2"
    # a menu that isn't closed, attributes with a > in them, upper case, an article within noise only
    assert main_text('<DIV CLASS="Ad">x<ARTICLE title="a>b">in</ARTICLE>') == "in"
    assert main_text("<div role=navigation>menu</div><div role=main><p>text</p></div><p>out</p>") == "text"
    assert main_text('<div class="top-nav">menu</div><div class="post-content"><p>a long enough text</p></div><p>out</p>') == "a long enough text"
    assert main_text("<p>only<p>paragraphs &am &amp &quo") == "only paragraphs &am & &quo"
    assert main_text('<div class="has-sidebar with-comments"><p>all of it</p><p>text <span class="ad">buy</span> more</p></div>') == "all of it text more"
    assert main_text('<article class="post comment-open"><p>a</p><article class="comment">b</article></article>') == "a"
    assert main_text('<div class="sidebar-wrap"><article><p>kept</p><div class="share">no</div></article></div>') == "kept"
    assert main_text("") == main_text("<!-- never closed") == main_text("<script>never closed") == ""
    assert main_text("a < b and <") == "a < b and <"


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("cells", [htmltext.CELLS, 8])
def test_alignment_equals_brute_force(monkeypatch, cells):
    monkeypatch.setattr(htmltext, "CELLS", cells)
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        places = htmltext.aligned(a, b)
        picked = [a[i] for i in places]
        assert places == sorted(set(places)) and len(places) == lcs_length(a, b)
        rest = iter(b)
        assert all(x in rest for x in picked)
    assert len(htmltext.aligned(list(range(5000)), [x for x in range(5000) if x % 3])) == 3333


def soup(words: str, n: int) -> str:
    return f"<body><div>Best Site</div><p>Since 1990</p><div>{words} number {n} is of its own.</div><p>More of {words} {n}.</p><div>All rights</div></body>"


def test_pages_of_nearest_urls(spark):
    """Without an article element, lines shared with both neighbours of the host go; copies are no neighbours."""
    rows = [(i, f"http://a.org/x/{i}", soup("fox", i)) for i in range(1, 7)]
    rows += [(20 + i, f"http://copies.org/x/{i}", soup("same", 0)) for i in range(5)]
    rows += [(30, "http://alone.org/1", soup("one", 1)), (31, None, soup("none", 1)), (32, "http://a.org/x/3", None)]
    rows += [(40, "http://two.org/1", soup("cat", 1)), (41, "http://two.org/1?page=2", soup("dog", 2))]
    rows += [(50 + i, f"http://art.org/{i}", f"<article><p>Quoted by all.</p><p>own {i}</p></article>") for i in range(3)]
    got = texts(spark, rows)
    for i in range(1, 7):
        assert got[i].text == f"fox number {i} is of its own. More of fox {i}." and got[i].n_site_lines == 3, got[i]
    for i in (20, 24, 30, 31):
        assert got[i].text.startswith("Best Site") and got[i].n_site_lines == 0
    assert (got[32].text, got[32].n_chars) == ("", 0)
    assert got[40].text == "cat number 1 is of its own. More of cat 1."
    assert got[51].text == "Quoted by all. own 1"


def test_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randint(0, 2)}.org/{rng.randint(0, 40)}", soup(rng.choice("abc"), rng.randint(0, 30))) for i in range(120)]
    want = {k: r.text for k, r in texts(spark, rows).items()}
    monkeypatch.setattr(htmltext, "BLOCK", 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {r.page_id: r.text for r in htmltext.extract(df).collect()} == want
    assert sum(t.startswith("Best Site") for t in want.values()) < 60


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "http://a.org/1", long, "x", b"k"), (None, None, None, None, None), (1, "http://a.org/1", long, "y", b"k"), (2, "http://a.org/2", "\x00 <p", "z", b"k")]
    got = htmltext.extract(spark.createDataFrame(rows, SCHEMA + ", text string, key binary")).collect()
    size = len(" ".join(f"line {i}" for i in range(60_000)))
    assert sorted(r.n_chars for r in got) == [0, 4, size, size]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "n_site_lines"}
    assert htmltext.extract(spark.createDataFrame([], SCHEMA)).collect() == []
