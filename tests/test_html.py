from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import htmldom as H
from corvane.functions.html import decode_lossy, decode_strict, headings, main_text, section_text, sections, text_by_line
from corvane.operators.records import html_records, markdown_snapshots
from corvane.plans.pages import page_views, section_views
from corvane.schema import Site, Sites

SITES = Sites((Site("alpha", "https://a.example"),))
PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav>Menu</nav><header>Head</header>
<main role="main"><h1 id="top">Title &amp; more</h1><p>First <b>bold</b> <a href="/x">link</a></p>loose text
<h2 id="one">One</h2><p>alpha</p><h3 id="deep">Deep</h3><p>beta</p><h2>No id</h2><p>gamma</p>
<h2 id="two">Two</h2><pre><code>code()</code></pre><table><tr><th>a</th><td>b</td></tr></table><ul><li>x<li>y</ul></main>
<div class="x md-footer">Foot</div><script>var s = "</p>";</script></body></html>"""


def test_main_content():
    text = H.without_boilerplate(H.parse(PAGE)).text(" ", strip=True)
    for gone in ("Menu", "Head", "Foot", "var s", "p{}"):
        assert gone not in text
    assert text.startswith("Title & more First bold link loose text One alpha")
    order = "<div class='md-content'>second</div><main>first</main>"
    assert H.without_boilerplate(H.parse(order)).text() == "first"
    for mark in H.BOILERPLATE:
        tag, _, cls = mark.partition(".")
        html = f"<{tag or 'div'} class='a {cls}'>gone</{tag or 'div'}><p>kept</p>"
        assert H.without_boilerplate(H.parse(html)).text() == "kept"


def test_sections():
    found = H.sections(H.parse(PAGE))
    assert [(a, t, n) for a, t, n, _ in found] == [("top", "Title & more", 1), ("one", "One", 2), ("deep", "Deep", 3), ("two", "Two", 2)]
    words = {a: " ".join(H.markdown(c).split()) for a, _, _, c in found}
    assert words["one"] == "alpha ### Deep beta"  # overlaps the section below; ends at a heading without id
    assert words["deep"] == "beta"
    assert words["top"].startswith("First **bold** [link](/x) ## One") and "loose" not in words["top"]
    assert "```" in words["two"] and "| a | b |" in words["two"] and "* x" in words["two"]
    assert H.sections(H.parse("<p>none</p>"))[0][:3] == (None, "", 0)
    assert H.headings(H.parse(PAGE))[1] == ("one", "One")


@pytest.mark.parametrize(
    ("html", "anchor", "want"),
    [
        ("<h2 id='a'>A</h2><p>one</p><h2 id='b'>B</h2><p>two</p>", "a", "A\none"),
        ("<h2 id='a'>A</h2><p>one</p><h3>C</h3><p>two</p><h2>B</h2>", "a", "A\none\nC\ntwo"),
        ("<h2 id='a'>A <i>x</i></h2><div><p>one</p></div>", "a", "A x\nx\none\none"),
        ("<p>x</p>", "a", ""),
        ("", "a", ""),
        ("<p id='q.r'>x</p><p>y</p><h2>z</h2>", "q.r", "x\ny"),
    ],
)
def test_section_text(spark, html, anchor, want):
    df = spark.createDataFrame([(html, anchor)], "h string, a string")
    assert df.select(section_text(F.col("h"), F.col("a"))).first()[0] == want


def test_columns(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>open <b>and"), (5, "<h2 id='a'>" + "z" * 5000)], "k int, h string")
    got = {r["k"]: r for r in df.select("k", main_text("h").alias("m"), sections(F.col("h")).alias("s"), headings("h").alias("hs"), section_text(F.col("h"), F.lit("a")).alias("t"), text_by_line("h").alias("l")).collect()}
    assert [s["anchor"] for s in got[1]["s"]] == ["top", "one", "deep", "two"]
    assert got[1]["s"][3]["markdown"] == "* x * y"  # code and table rows are gone
    assert all("\n" not in s["markdown"] and "|" not in s["markdown"] and "`" not in s["markdown"] for s in got[1]["s"])
    assert got[2]["m"] == got[3]["m"] == "" and got[2]["s"][0]["markdown"] == "" and got[4]["m"] == "open \nand"
    assert len(got[5]["t"]) == 4000 and got[1]["hs"][0]["title"] == "Title & more"


def test_decoding(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\xffb\xc3\xa9")), (2, bytearray("ok".encode())), (3, None)], "k int, b binary")
    got = df.orderBy("k").select(decode_lossy("b").alias("x"), decode_strict("b").alias("y")).collect()
    assert [tuple(r) for r in got] == [("abé", None), ("ok", "ok"), (None, None)]


def test_records_and_views(spark):
    pages = spark.createDataFrame([("a/b.html", PAGE, "alpha"), ("c.html", "", "alpha"), ("d/", None, "alpha")], "path string, text string, source_site string")
    got = sorted((tuple(r[c] for c in ("path", "pos", "title", "anchor", "url")) for r in html_records(pages, "https://a.example/").collect()), key=str)
    assert got[0] == ("a/b.html", 0, "Title & more", "top", "https://a.example/a/b.html#top") and len(got) == 6
    assert ("c.html", 0, "c.html", None, "https://a.example/c.html") in got and ("d/", 0, "index", None, "https://a.example/d/") in got
    names = {r["name"]: r["markdown"] for r in markdown_snapshots(pages).collect()}
    assert set(names) == {"alpha-a_b.md", "alpha-c.md", "alpha-d_.md"} and names["alpha-a_b.md"].startswith("# Title & more First **bold** [link](/x) loose text ## One alpha")
    views = pages.select(F.col("source_site").alias("site"), F.col("path").alias("rel"), F.col("text").alias("html"))
    cut = {r["path"]: r for r in page_views(views, SITES, 10).collect()}
    assert cut["a/b.html"]["truncated"] and cut["a/b.html"]["text"].endswith("\n\n[... truncated ...]") and cut["a/b.html"]["html_length"] == len(PAGE)
    assert not cut["c.html"]["truncated"] and cut["d/"]["html"] == ""
    assert all(not r["truncated"] for r in page_views(views, SITES, -1).collect())
    section = {r["path"]: r for r in section_views(views, SITES, F.lit("one")).collect()}["a/b.html"]
    assert section["url"] == "local://alpha/a/b.html#one" and section["section"].startswith("One\nalpha\nDeep\nbeta") and not section["truncated"]


def test_the_most_preferred_main_content_wins():
    page = "<div class='md-content'>c</div><article>a</article><main>m1</main><main>m2</main><main role='main'>r1</main><main role='main'>r2</main>"
    for want in ("r1", "m1", "c", "a"):
        assert H.without_boilerplate(H.parse(page)).text() == want
        page = page.replace("<main role='main'>r1</main><main role='main'>r2</main>", "") if want == "r1" else page.replace("<main>m1</main><main>m2</main>", "") if want == "m1" else page.replace("<div class='md-content'>c</div>", "")
    assert H.without_boilerplate(H.parse("<p>x</p><nav>n</nav>")).text() == "x"
