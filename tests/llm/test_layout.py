"""Text of pages: what is seen, and how it is laid out."""

import time

import pytest

from stationmine.llm.layout import extract, render

CASES = [
    ("<p>one<p>two <b>bold</b>\n line", "one\n\ntwo bold line"),
    ("<p>a<div>b</div>c", "a\n\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>p<li>q</ol>", "3. p\n4. q"),
    ("<table><tr><th>Name<th>Age<tr><td>Bob<td>7</table>", "Name  Age\nBob   7"),
    ("<table><td>a<td>b<tbody><tr><td colspan=2>wide<td>c</table>z", "a     b\nwide     c\n\nz"),
    ("<table>lost<tr><td>a</table>", "lost\n\na"),
    ("<table><tr><td><p>x<p>y<td>z</table>", "x y  z"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("<h1>T<h2>U</h2>v", "T\n\nU\n\nv"),
    ("a<script>if (a<b) '</p>'</script>b<style>p{}</style><!-- x --><noscript>n</noscript>c", "abc"),
    ("<style>.no, #h {display: none} i{color:red}</style><p class='x no'>a<p id=h>b<i>c</i></p><p>d", "d"),
    ("<div hidden>a</div><p style='display:none'>b</p><span style='visibility:hidden'>c<i style='visibility:visible'>d</i></span>", "d"),
    ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details><dialog>z</dialog>", "s\nt\ny"),
    ("<title>T</title><body>&lt;b&gt; &amp; &eacute;&#33;&nbsp;x", "<b> & é!\xa0x"),
    ("</div></p></b>x</table>y", "xy"),
    ("<b><p>x</b>y", "xy"),
    ("a < b <3 </ x>c", "a < b <3 c"),
    ("<a title='1 > 0' href=x>k</a>", "k"),
    ("<td>a</td>b", "ab"),
    ("x<p", "x"),
    ("x<a href='y", "x"),
    ("x<!-- y", "x"),
    ("<script>y", ""),
    ("", ""),
    ("   \n ", ""),
]


MISPLACED = [
    ("<table><form><tr><td>x<td>y</form></table>z", "x  y\n\nz"),
    ("<table><center><tr><td>x</center></table>", "x"),
    ("<table><tr><b>x</b><td>y</table>", "x\n\ny"),
    ("<table><tr><div>x</div><p>w<td>y</table>z", "x\n\nw\n\ny\n\nz"),
    ("<table><tr><td>x</td></tr><div>a</div><p>b", "a\n\nb\n\nx"),
    ("<table hidden><tr><td>x</td></tr><p>b", "b"),
    ("<table><colgroup><col><tr><td>x</table>", "x"),
    ("<table><colgroup>w<tr><td>x</table>", "w\n\nx"),
    ("<table><tr><td>a<tr><table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<div><table><tr></div><td>x<td>y</table>z</div>w", "x  y\n\nz\nw"),
    ("<table><tr><td><ul><li>a<li>b</ul><td>c</table>", "- a\n- b\nc"),
    ("<table><tr><td><p>a<p>b</table>", "a\n\nb"),
    ("<table><tr><td><table><tr><td>a<td>b<tr><td>c<td>d</table><td>e</table>", "a  b\nc  d\ne"),
    ("<ul><li>k<table><tr><td><pre>a\n b</pre></table></ul>", "- k\n\n  a\n   b"),
    ("a<svg><title>t</title><defs><text>n</text></defs><path d='x'/><text x=1>b</text><text>c</text></svg>d", "a\nb\nc\nd"),
    ("<svg><defs/><title/><text>b</text></svg>", "b"),
    ("<svg><defs><p>b", "b"),
    ("x <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation>q</annotation></math>", "x a=1"),
]


@pytest.mark.parametrize("page,text", MISPLACED)
def test_misplaced_and_nested_text_is_kept(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page", ["<table><b>x" * 20_000, "<table><tr>" + "<p>x" * 50_000, "<svg><g>x" * 20_000,
                                  "<table><tr><td><ul><li>x<li>y" * 5_000, "<table><form>x" * 20_000])
def test_hostile_pages_with_misplaced_elements_take_linear_time(page):
    start = time.process_time()
    assert render(page).count("x") == page.count("x")
    assert time.process_time() - start < 10


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert render(page) == text


@pytest.mark.parametrize(
    "page",
    ["<a x=\"" * 50_000, "<div>" * 50_000 + "x", "<" * 300_000, "<table><tr><td>" * 5_000, "<script>" * 20_000, "<ul><li>" * 20_000,
     "<p>" * 50_000, "</i>" * 50_000, "<!--" * 50_000, "&amp;" * 100_000, "<table><td colspan=1000>x" + "<tr><td>y" * 5000],
)
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    render(page)
    assert time.process_time() - start < 10


def test_rows(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, "b"), (2, None), (3, ""), (4, "<p>" + "word " * 100_000)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in extract(df.selectExpr("*", "1 AS text")).collect()), key=str)
    assert [(i, t[:4]) for i, t in got] == [(1, "a"), (1, "a"), (2, ""), (3, ""), (4, "word"), (None, "b")]
    assert extract(df.limit(0)).count() == 0
