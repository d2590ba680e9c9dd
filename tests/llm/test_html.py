"""HTML extraction: layout rules, words against the standard parser, odd and hostile markup."""

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st

from tagloom.llm import html, queries

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>a<p>b": "a\n\nb",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "a<b>b</b> c<i> d </i>e": "ab c d e",
    "x<br>y<br/>z": "x\ny\nz",
    "a</p>b": "a\n\nb",
    "<ul><li>one<li>two<ul><li>in</ul><li>three</ul>": "- one\n- two\n  - in\n- three",
    '<ol start="9"><li>a<li>b<li value=3>c</ol>': "9. a\n10. b\n3. c",
    "<ol><li>a<br>b<p>c</ol>": "1. a\n   b\n\n   c",
    "<table><tr><th>k<th>value<tr><td>long key<td>1</table>": "k         value\nlong key  1",
    "<table><tr><td>a<td align=right>1<tr><td>b<td align=right>22</table>": "a   1\nb  22",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td colspan=2>wide one here<tr><td>a<td>b</table>": "wide one here\na  b",
    "<table><tfoot><tr><td>f</tfoot><tr><td>b<thead><tr><td>h</table>": "h\nb\nf",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<pre> a\n  b</pre>": " a\n  b",
    "<blockquote>q</blockquote>": "    q",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n    d\nu",
    "a<script>if (a < b) '</p>'</script>b": "ab",
    "<head><title>t</title><style>x</style></head>b": "b",
    "<title>t</title><p>b": "b",
    "a<!-- <p>no</p> -->b": "ab",
    "a<!-- open": "a",
    "<p hidden>x</p>a<p style='display : none'>y<b>z</b></p>b": "ab",
    "<p style='visibility:hidden'>x<b style='visibility: visible'>y</b></p>": "y",
    "<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>": "s\nt\ny",
    "<select><option>a<option selected>b</select>": "b",
    "<input value=v><input type=hidden value=h><textarea>\n a &lt;</textarea>": "v\n a <",
    "&amp;&lt;&nbsp;&eacute;&#8364; &unknown;": "&< é€ &unknown;",
    "1 < 2 <3 <": "1 < 2 <3 <",
    "<h1>a<h2>b</h2>c": "a\n\nb\n\nc",
    "</div></li>a</html>b": "ab",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert html.visible_text(page) == CASES[page]


class Words(HTMLParser):
    """All words outside elements that aren't shown, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.words, self.off = "", 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        if tag in html.BLOCKS or tag == "br":
            self.words += " "

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        if tag in html.BLOCKS:
            self.words += " "

    def handle_data(self, data):
        self.words += "" if self.off else data


def test_table_of_pages(spark):
    got = queries.op1_html_text(spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(texts) == len(pages) > 0
    for page in pages:
        parser = Words()
        parser.feed(page["html"])
        parser.close()
        words = re.findall(r"[^\s-]+", texts[page["page_id"]])
        assert words == re.findall(r"[^\s-]+", parser.words), page["page_id"]


TAGS = ["p", "div", "li", "ul", "table", "tr", "td", "b", "br", "pre", "dl", "dd", "select", "option", "thead"]
PIECE = st.one_of(
    st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ["<", ">", "&amp;", "<!--", '"', "<a b='"]),
    st.text("ab \n", max_size=4),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=40).map("".join))
def test_any_markup_gives_text(page):
    text = html.visible_text(page)
    assert text == text.strip("\n") and not re.search(r"[ \t]+$", text, re.M)


@pytest.mark.parametrize(
    "piece", ["<a ", "<b>", "<table><tr><td>", "<li>", "<!--", "<a b='", "<p>", "<td>", "x</p>", "<div>", "<"]
)
def test_long_pages_take_linear_time(piece):
    begin = time.process_time()
    html.visible_text(piece * (400_000 // len(piece)))
    assert time.process_time() - begin < 20


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<p>a", "x"), (3, "<p>a", "x"), (None, "b", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, extra string")
    got = html.extract_text(pages).collect()
    assert sorted((str(r["page_id"]), str(r["text"]), str(r["extra"])) for r in got) == sorted(
        [("1", "None", "x"), ("2", "", "x"), ("3", "a", "x"), ("3", "a", "x"), ("None", "b", "None")]
    )
    assert html.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tbody><td>x", "x"),
        ("<table><tbody><td>x<td>y<tr><td>z</table>", "x  y\nz"),
        ("<table><tr>stray<td>a</table>", "stray\n\na"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
        ("<table><tbody><form><tr><td>a</td></tr></form></table>", "a"),
        ("<form><table><form><tr><td>a</td></tr></form></table></form>c", "a\n\nc"),
        ("<table><tr><td>a</td><b>bold</b></tr><tr><td>c</table>", "bold\n\na\nc"),
        ("<table hidden>out<tr><td>in</table>", "out"),
        ("<table><colgroup>t<tr><td>a</table>", "t\n\na"),
        ("<table><b>x<tr><td>a</table>", "x\n\na"),
        ("<head><meta x>text right after<p>p", "text right after\n\np"),
        ("<svg><title>no</title><text>one</text><text>two</text><desc>no</desc></svg>", "one two"),
        ("<math><mi>x</mi><annotation>no</annotation></math>", "x"),
    ],
)
def test_nothing_visible_is_dropped(page, want):
    assert html.visible_text(page) == want


PARTS = ["table", "tbody", "thead", "tr", "td", "th", "caption", "form", "b", "p", "div", "svg", "math", "head", "colgroup", "ul", "li"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([f"<{t}>" for t in PARTS] + [f"</{t}>" for t in PARTS] + ["w"] * 12), max_size=60))
def test_all_words_of_random_markup_come_out(pieces):
    page = "".join(f" w{i}x " if p == "w" else p for i, p in enumerate(pieces))
    want = re.findall(r"w\d+x", page)
    assert sorted(re.findall(r"w\d+x", html.visible_text(page))) == sorted(want)


def test_tall_and_wide_cells_take_linear_time():
    started = time.process_time()
    rows = "<tr><td colspan=1000 rowspan=65534>" * 12_000
    assert html.visible_text(f"<table>{rows}</table>") == ""
    rows = "".join(f"<tr><td rowspan=65534>w{i}" for i in range(12_000))
    assert html.visible_text(f"<table>{rows}</table>").split() == [f"w{i}" for i in range(12_000)]
    assert time.process_time() - started < 20


def test_cells_stand_beside_tall_ones():
    page = "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td rowspan=9 colspan=2>e<tr><td>f<td>g</table>"
    assert html.visible_text(page).splitlines() == ["a  b", "   c", "d  e", "f     g"]  # g starts behind the column of b and c
