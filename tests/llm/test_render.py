import time
import re
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest
from hushwin.llm import render
from hushwin.llm.common import table
from hushwin.llm.render import render as text_of
from tests.conftest import SF01
from tests.llm.cases import rows


class Plain(HTMLParser):
    """Visible words by another parser, without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag not in ("b", "i", "a", "em", "span"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag not in ("b", "i", "a", "em", "span"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_visible_words_equal_another_parser(spark):
    pages = table(spark, SF01, "pages")
    got = {r["page_id"]: r["text"] for r in rows(render.extract(pages))}
    assert len(got) == pages.count()
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        words = re.sub(r"(?m)^ *- ", "", got[r.page_id]).split()
        assert words == "".join(p.out).split(), r.page_id


def test_blocks_and_inline():
    assert text_of("<p>one <b>two</b>three<p>four<div>five</div>six<h2>T</h2>x<br>y") == "one twothree\n\nfour\n\nfive\nsix\n\nT\n\nx\ny"
    assert text_of("a  \n b<!-- c --> &amp; &lt;d&gt;&nbsp;e") == "a b & <d>\xa0e"
    assert text_of("<blockquote>q<p>r</blockquote>s") == "  q\n\n  r\n\ns"
    assert text_of("<pre>a\n  b\n\nc</pre>d") == "a\n  b\n\nc\n\nd"


def test_lists():
    assert text_of("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f") == "- a\n- b\n  3. c\n  4. d\n- e\n\nf"
    assert text_of("<dl><dt>t<dd>u<dt>v<dd>w</dl>") == "t\n  u\nv\n  w"


def test_tables():
    t = "<table><caption>C</caption><tr><th>name<th>n<tr><td>long name<td>1<td>x<tbody><tr><td>b<td>22<td>y</table>z"
    assert text_of(t) == "C\nname       n\nlong name  1   x\nb          22  y\n\nz"
    assert text_of("<table><td>a<table><td>in<td>ner</table><td>b</table>") == "a in  ner  b"
    assert text_of("<table><tr><td>a<p>b</p><ul><li>c</ul></td><td>d</table>") == "a b - c  d"


def test_visibility():
    assert text_of("<div hidden>a<p>b</div>c") == "c"
    assert text_of("<div style='color:red; display: none'>a<div>x</div></div>c<i style=visibility:hidden>d</i>e") == "ce"
    assert text_of("<div title='display:none' data-hidden>a</div>") == "a"
    assert text_of("<head><title>t</title></head><script>if (a<b) '</p>'</script><style>x</style><noscript>n</noscript>v<textarea>w</textarea>") == "v" + "w"
    assert text_of("<script>never closed <p>x") == ""


def test_visibility_is_read_from_parsed_attributes():
    for shown in ('class="hidden md:block"', 'title="a hidden gem"', 'href="/hidden/page"', "alt='x hidden'", 'style="backface-visibility:hidden"', 'data-style="display:none"',
                  'data-hidden', 'hidden="until-found"', 'style="x-display:none"', 'style="background:url(a;display:none)"', "style='content:\";display:none;\"'",
                  'style="/* display:none; */ color:red"', 'style="display:none;display:block"', 'style="display:block!important;display:none"', 'hidden style="display:flex"',
                  'style="color:red" style="display:none"', 'title=hidden', 'style="--x:{;display:none}"'):
        assert text_of(f"a<p {shown}>b<i>c</i></p>d") == "a\n\nbc\n\nd", shown
    for out in ("hidden", "HIDDEN", "hidden=''", "hidden=false", "a=b hidden", 'a="b"hidden', "hidden/", 'title="x>y" hidden', "style=display:none", 'STYLE="Display : NONE ! important;x:y"',
                'style = "color:red;/*;*/display:none"', 'style="display&#58;none"', "style='background:url(x;y);display:none'", 'style="visibility:collapse"', 'style="display:none;display:\\9"'):
        assert "".join(text_of(f"a<p {out}>b<i>c</i></p>d").split()) == "ad", out
    assert text_of("a<p style=visibility:hidden>b<i style=visibility:visible>c</i><br>d</p>e") == "a\n\nc\n\ne"
    assert text_of("<p style=visibility:hidden>b<i hidden>c</i><br>d</p>e<b>f</b>") == "ef"


def test_formulas():
    assert text_of("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds") == "so x=1 holds"
    assert text_of("<math><semantics><mrow><mi>y</mi><mspace/><mo>&lt;</mo></mrow><annotation encoding='application/x-tex'>y&lt;</annotation></semantics></math>z") == "y<z"
    assert text_of("a<math display=block><mfrac><mn>1</mn><mn>2</mn></mfrac></math>b") == "a\n1 2\nb"
    assert text_of("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>") == "1 2\n3"
    assert text_of("<math><mi>a</mi><mphantom><mi>b</mi></mphantom><mi>c</mi>") == "ac"


def test_drawings():
    svg = "<svg viewBox='0 0 1 1'><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>u</text></defs><style>s > t {}</style>%s</svg>"
    assert text_of("a" + svg % "<path d='M0'/><g><text x=1>one <tspan>two</tspan></text><text>three</text></g>" + "b") == "a one two three b"
    assert text_of("a " + svg % "fallback<title/><defs/><text><![CDATA[x<y &amp;]]></text>" + " b") == "a x<y &amp; b"
    assert text_of(svg % "<foreignObject><div>in<p>ner</div></foreignObject><g display=none><text>n</text></g><g visibility=hidden><text>n</text></g><g hidden><text>n</text></g>") == "in\n\nner"
    assert text_of("<svg><defs><use href=#a/>x<p>after") == "after"
    assert text_of("<svg/>x<math/>y<p>z<svg><g></p>w") == "xy\n\nz\n\nw"
    assert text_of("<title>t</title>v<svg><text>w</text></svg><title>t <b></title>x") == "v w x"


def test_selections():
    assert text_of("Choose <select><option>one<option selected>two</option><optgroup label=More><option>three</optgroup><option label=four>4</select> now") == \
        "Choose\none\ntwo\nMore\nthree\nfour\nnow"
    assert text_of("<select hidden><option>a</select><select style=visibility:hidden><optgroup label=x><option label=y>z</select>b<datalist><option>c</datalist>") == "b"


def test_broken_markup_and_edges(spark):
    assert text_of(None) == text_of("") == text_of("<p>") == ""
    assert text_of("<") == "<"
    assert text_of("a < b <3 </ x> c") == "a < b <3 c"
    assert text_of("<p a='x>y</p>z") == "y\n\nz"
    assert text_of("</div></p>x</li>") == "x"
    assert len(text_of("<div>" * 20000 + "deep" + "<li>" * 2000).strip()) >= 4
    rows_ = [(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t"), (2, "", "", None), (3, "", "<td>" * 5000 + "w", None)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"]) for r in rows(render.extract(df)))[:3] == [("1", ""), ("1", ""), ("2", "")]
    assert rows(render.extract(df.limit(0))) == []


TAGS = st.sampled_from("<p> </p> <div> </div> <ul> <ol> <li> </li> </ul> </ol> <table> <tr> <td> <th> </td> </tr> </table> <br> <b> </b> <pre> </pre> <h1> </h2> "
                       "<div hidden> <dd> <dt> <dl> </dl> <option> <caption> <tbody> </tbody> <blockquote> </blockquote>".split(" "))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TAGS, st.sampled_from(["w1", "w2 ", " \n", "&amp;"])), max_size=30))
def test_events_nest(parts):
    stack = []
    for kind, name, _ in render.tree("".join(parts)):
        if kind == "open":
            stack.append(name)
        elif kind == "close":
            assert stack.pop() == name
    assert not stack
    text_of("".join(parts))


FOREIGN = st.sampled_from("<svg> </svg> <math> </math> <g> <g/> </g> <text> </text> <foreignObject> </foreignObject> <title> </title> <defs/> <mi> </mi> <p> </p> <td> <table> </table> "
                          "<select> </select> <option> <option/label=x> <br> </br> <i/style=visibility:hidden> <![CDATA[x]]> w".split(" "))


@settings(max_examples=300, deadline=None)
@given(st.lists(FOREIGN, max_size=30))
def test_events_nest_in_drawings_and_formulas(parts):
    stack = []
    for kind, name, _ in render.tree("".join(parts)):
        if kind == "open":
            stack.append(name)
        elif kind == "close":
            assert stack.pop() == name
    assert not stack
    text_of("".join(parts))


@pytest.mark.parametrize("page", [
    "<table><tr><td>" + "long " * 20_000 + "<td>x" + "<tr><td>a<td>b" * 30_000,                       # one long cell over many rows
    "<blockquote>x" * 70_000, "<ul><li>x" * 80_000, "<dl><dd>x" * 80_000,                              # deep nests
    "<div>" * 30_000 + "<table><tr><td>" + "<b>" * 30_000 + "</div>" * 90_000,                         # tags that a cell stops
    "<table>" + "<tr><td rowspan=900 colspan=900>x" * 20_000, "<table><tr>" + "<td rowspan=999>x" * 1000 + "<tr><td>y" * 80_000,
    "<table><tr><td>" * 20_000 + "x", "</p></div></td>" * 60_000, "<p><table><b>" * 60_000, "<td>" * 200_000,
])
def test_time_and_text_grow_in_proportion_to_the_page(page):
    """Pages of about 1 MB."""
    began = time.process_time()
    text = render.render(page)
    assert time.process_time() - began < 20
    assert len(text) < 60 * len(page)


def test_spans_keep_columns():
    page = "<table><tr><th colspan=2>Both<th>Last<tr><td>a<td>b<td>c<tr><td rowspan=2>tall<td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>"
    assert render.render(page) == "Both     Last\na     b  c\ntall  d  e\n      f  g\nh     i  j"


def test_cells_keep_their_lines():
    page = "<table><tr><td><ul><li>one<li>two</ul><td>right<tr><td>x<td><pre>up\n down</pre><tr><td><table><tr><td>p<td>q<tr><td>r<td>s</table><td><p>run</p><p>on</p></table>"
    assert render.render(page) == "- one  right\n- two\nx      up\n        down\np  q   run on\nr  s"


def test_long_cells_widen_no_column():
    page = f"<table><tr><td>{'w' * 80}<td>x<tr><td>a<td>b</table>"
    assert render.render(page) == f"{'w' * 80}  x\na  b"
