"""Main text of pages: rules case by case, whole tables against a plain reading of their template, odd rows."""

import html
import os
import re

import pytest
from pyspark.sql import functions as F

from docquorum.llm.html_text import extract, main_text

SF_DIR = "/root/testdata/sf0.01"

CASES = [
    # menus, headers, sidebars, comments and footers around a short article, beside a longer sidebar
    ("<html><body><nav><a href=1>a</a></nav><div id=header><h1>Site</h1></div><div class=content><h1>T</h1><p>Short one."
     "</p><p>Two &amp; <b>bold</b>\n x<script>var a='</p>'</script>y</p></div><div class=sidebar><p>lots of, text, here, "
     "which is long, longer than the article by far, very much.</p></div><div id=comments><p>c, c, c, c</p></div>"
     "<footer>f</footer>", "T\nShort one.\nTwo & bold xy"),
    ("<main><article><header><h1>T</h1></header><section><p>a</p></section><section><p>b</p><aside>no</aside></section>"
     "<section class=comments><article class=comment><p>x, y, z</p></article></section></article></main>", "T\na\nb"),
    ("<article><h1>Hi</h1><p>t</p><section><h2>Comments (3)</h2><p>a reader</p></section></article>", "Hi\nt"),
    ("<article><p>One.</p><div class='notice cookie-banner'>We use cookies</div><div role=alert>Late</div>"
     "<p>Two <span class=ad>Buy</span>words.</p><ul><li><a href=1>more</a><li><a href=2>like</a><li><a href=3>this</a></ul>"
     "<form><label>Mail</label><input></form><p hidden>no</p></article>", "One.\nTwo words."),
    # without names: menus are known by their links, items and cells by themselves
    ("<body><div><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></div>"
     "<div><p>First, para<p>second<ul><li>i1<li>i2</ul>tail</div>", "First, para\nsecond\ni1\ni2\ntail"),
    ("<table><tr><td>a, b, c<td>d<tr><td>e</table>", "a, b, c\nd\ne"),
    # a form around the whole page stays, its fields go
    ("<form><div class=x><p>long text here, which holds the page</p><input><label>L</label></div></form>",
     "long text here, which holds the page"),
    # names that would leave nothing do not count, unless an element says where the article is
    ("<div class=banner><p>All there is.</p></div>", "All there is."),
    ("<div class=banner><p>An advert.</p></div><article></article>", ""),
    ("<div class='entry has-sidebar'><p>Kept, of course.</p></div>", "Kept, of course."),
    # parts of one article side by side
    ("<div id=all><div class=part><p>One, two, three, four.</p></div><div class=part><p>Five.</p></div></div>",
     "One, two, three, four.\nFive."),
    # broken and odd markup
    ("<p>x<br>y<hr>z", "x y\nz"), ("<div title='a>b'><p>in</p></div>", "in"), ("<p>ok</p><a href='x", "ok"),
    ("a < b <3 <!-- c --> d</ b", "a < b <3 d"), ("<p>a<!-- never ends", "a"), ("<script>only", ""),
    ("hello  world\n&lt;x&gt;", "hello world <x>"), ("&#233;&eacute;&#x1F600;&nbsp;&amp;amp;", "éé\U0001f600 &amp;"),
    ("<P>Up</P><Script>x</SCRIPT >\t<p>Down</p>", "Up\nDown"), ("", ""), (None, ""), (" \n ", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<" * 300_000, "<a" * 300_000, "<ul><li>" * 50_000, "<span class=ad>" * 50_000,
    "<div>" * 30_000 + "</p>" * 30_000, "<a \"" * 100_000 + ">", "<!--" * 100_000, "<script>" * 100_000,
    "&" * 500_000, "<form><table><tr><td>" * 20_000,
])
def test_hostile_pages_take_linear_time(page):
    assert isinstance(main_text(page), str)


def by_template(page):
    """The pages of the given tables: one article element of paragraphs and a heading."""
    article = page[page.find("<article>") + len("<article>"):page.find("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", article)))
    return "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")
def test_whole_table(spark):
    rows = extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()
    assert len(rows) == 250
    assert all(r["main_text"] == by_template(r["html"]) for r in rows)


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>word{i}, &amp; more</p>" for i in range(50_000)) + "</article>"
    rows = [(1, None, "k"), (2, "", None), (3, "<p>same</p>", "x"), (3, "<p>same</p>", "x"), (None, long, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    found = extract(pages)
    assert found.columns == ["page_id", "html", "main_text"]
    texts = [r["main_text"] for r in found.orderBy(F.col("page_id").asc_nulls_last()).collect()]
    assert texts[:4] == ["", "", "same", "same"] and texts[4].count("\n") == 49_999 and "word49999, & more" in texts[4]
    assert extract(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")
def test_query(spark):
    from docquorum.llm.catalogue import QUERIES

    rows = QUERIES["op13_html_extraction"](spark, SF_DIR)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows.collect())
