"""Visible text of pages."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrove.llm.html_text import extract, visible_text
from tallygrove.llm.queries import QUERIES

CASES = [
    ("<p>a  <b>b</b>\nc<p>d<br>e", "a b c\n\nd\ne"),
    ("<h1>T</h1>x<div>y</div>z", "T\n\nx\ny\nz"),
    ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol><li>v</ul>", "- x\n- y\n  3. z\n  4. w\n- v"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<table><tr><th>Name<th>N<tr><td>abc<td>1<tr><td colspan=2>wide<td>q</table>", "Name  N\nabc   1\nwide     q"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    ("a<script>if (a<b) x('</p>')</script>b<style>p{}</style>c<!-- no > --> d", "abc d"),
    ("<head><title>t</title></head><body>x", "x"),
    ("<div style='color:red; DISPLAY : none'>no</div><p hidden>no</p><i aria-hidden=true>no</i>yes", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
    ("&lt;p&gt; &amp; &copy; &#233; &nbsp;x", "<p> & © é \xa0x"),
    ("1 < 2 and a<3", "1 < 2 and a<3"),
    ('<a href="x>y" title=\'>\'>l</a>', "l"),
    ("</b></p>x</div><td>y", "xy"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("x<img alt='pic'>y<hr>z", "xpicy\n\nz"),
    ("<select><option>a</select><textarea>t</textarea><input type=hidden value=v>", "t"),
    ("a<br><br>b", "a\n\nb"),
    ("<!-- open", ""), ("<p", "<p"), ("<script>x", ""), ("", ""), ("<p>", ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_cases(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b", "a x+1 b"),
        ("<math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math>", "y"),
        ("<svg><title>t</title><defs><text>no</text></defs><text>North</text><text>South</text></svg>", "North\nSouth"),
        ("<desc>d</desc>", "d"),
        ("c: <select><option>a<option selected>b<option>c</select>!", "c: b!"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<table><tr>loose<td>a</td>more<td>b</table>", "loose\nmore\na  b"),
        ("<table><tbody><tr> <td>a</td> <td>b</td> </tr></table>", "a  b"),
    ],
)
def test_formulas_drawings_menus_and_loose_text(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div style='visibility: hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
        ("<div style='visibility:hidden'><table><tr><td>no<td style='visibility:visible'>yes</table></div>", "  yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td rowspan=2 colspan=2>x<td>b<tr><td>c</table>", "x  b\n   c"),
        ("<textarea>a &amp; b</textarea>", "a & b"),
        ("<input type=submit value='Send'> <input value=no> <input type=image alt=go>", "Send go"),
        ("<style>.a, #b{display : none} @media print{i{display:none}} u{color:red}</style>"
         "<p class='x a'>no</p><p id=b>no</p><i>i</i><u>u</u>", "iu"),
        ("<style>/* c */ .ad{x:y;display:none", ""), ("<style>.ad{display:none}</style><b class=ad>no</b>y", "y"),
        ("<table><tr><td>\u6f22\u5b57<td>b<tr><td>abcde<td>c</table>", "\u6f22\u5b57   b\nabcde  c"),
        ("<table><tr><td>" + "w" * 500 + "<td>b<tr><td>a<td>c</table>", "w" * 500 + "  b\na  c"),
        ("<p don't>a</p>b", "a\n\nb"), ("<a href='x>l</a> m", "l m"), ("a<b href=\"", 'a<b href="'),
        ("<a x=\">\"", '<a x=">"'), ("a<![CDATA[ x > y ]]>b", "ab"), ("a<![CDATA[ x > y", "a y"),
        ("<!doctype html>a<?php x ?>b", "ab"), ("a<!x", "a<!x"), ("a<!-- > b", "a"),
        ("<table><tr><td>a</p></table>b", "a\n\nb"), ("<p>x<table><tr><td>y</p>z</table>", "x\n\nyz"),
    ],
)
def test_visibility_tables_and_cut_tags(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize(
    "unit, last",
    [
        ("<a ", ""), ("<![CDATA[x ", ""), ("<![CDATA[x>", ""), ("<a x=\"", ""), ("<a x=\"", "\">"), ("<a x='y", ">"), ("<a ", "x=\">\""),
        ("<b>", "</i>" * 100_000), ("<b>", "<hr>" * 100_000), ("<b>", "<li></li>" * 50_000), ("<!--", ""), ("<!x", ""),
        ("<title>", ""), ("<style>{", ""), ("<ul><li>x", ""), ("<blockquote>x", ""), ("</b", ""), ("<p><table>", "</p>" * 100_000),
        ("<td colspan=1000>x", ""), ("<tr><td>x", "<td>" + "w " * 100_000), ("<b><td>", "<td></td>" * 50_000),
    ],
)
def test_time_is_in_proportion(unit, last):
    start = time.process_time()
    found = visible_text(("<table>" if "<td" in unit and "<table" not in unit else "") + unit * (1_000_000 // len(unit)) + last)
    assert time.process_time() - start < 15
    assert len(found) < 250_000_000


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from(["a", "bb", "cc\u6f22", ""]), st.integers(1, 3), st.integers(1, 3)), max_size=4),
        max_size=5,
    )
)
def test_cells_stand_in_their_columns(rows):
    """Against a grid filled cell by cell: all cells of a column begin at one place, right of the columns before."""
    html = "".join(
        "<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}</td>" for t, w, h in row) + "</tr>" for row in rows
    )
    taken, at = set(), {}
    for y, row in enumerate(rows):
        x = 0
        for n, (text, w, h) in enumerate(row):
            while (y, x) in taken:
                x += 1
            taken |= {(y + j, x + i) for j in range(h) for i in range(w)}
            at[y, n] = x
            x += w
    own = {}
    for (y, n), x in at.items():
        text = rows[y][n][0]
        own[x] = max(own.get(x, 0), len(text) + text.count("\u6f22"))
    begin = {x: sum(own[before] + 2 for before in own if before < x) for x in own}
    wanted = []
    for y, row in enumerate(rows):
        line, columns = "", 0
        for n, (text, _, _) in enumerate(row):
            if text:
                line += " " * (begin[at[y, n]] - columns) + text
                columns = begin[at[y, n]] + len(text) + text.count("\u6f22")
        if row:
            wanted.append(line)
    assert visible_text(f"<table>{html}</table>").split("\n") == "\n".join(wanted).strip("\n").split("\n")


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 300 + "x") == "x"
    assert visible_text("<ul><li>" * 200 + "x").endswith("x")
    assert len(visible_text("<p>word</p>\n" * 100_000).split()) == 100_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "w ", "<b>", "</b>", "<br>", "<pre>", "</pre>", "\n", "&amp;", "<div hidden>", "</div>"]), max_size=30))
def test_any_markup(parts):
    text = visible_text("".join(parts))
    assert "".join(parts).count("w") >= text.count("w")
    if "<div hidden>" not in parts:
        assert "".join(parts).count("w") == text.count("w")
        assert "".join(parts).count("&amp;") == text.count("&")


def test_table(spark):
    rows = [(1, "u", html, 1, "t") for html, _ in CASES] + [(None, None, None, None, None), (1, "u", CASES[0][0], 1, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, c0 int, text string")
    found = extract(pages)
    assert found.columns == ["page_id", "url", "c0", "text"]
    assert sorted(r["text"] for r in found.collect()) == sorted([*(t for _, t in CASES), "", CASES[0][1]])
    assert extract(pages.limit(0)).count() == 0


def test_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for row in QUERIES["op10_html_extraction"](spark, sf).collect():
        assert row["text"] == visible_text(pages[row["page_id"]])
        assert "track(" not in row["text"] and "margin:0" not in row["text"] and "©" in row["text"]
