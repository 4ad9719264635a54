import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import jsonld, text, urls
from pagemill.functions.css import matches, select
from pagemill.functions.dom import count_words, inner_html, outer_html, selector_path
from pagemill.functions.htmlparse import parse_document, parse_fragment


def body(html: str) -> str:
    return inner_html(next(iter(parse_document(html).elements("body"))))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<b>b<p>c</b>d", "<p>a<b>b</b></p><p><b>c</b>d</p>"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<table><tr><td>x</td></tr>foo</table>", "foo<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<a href=1>x<div>y<a href=2>z</a></div>", '<a href="1">x</a><div><a href="1">y</a><a href="2">z</a></div>'),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<select><option>a<option>b</select>z", "<select><option>a</option><option>b</option></select>z"),
        ("x &amp; &copy y &notit; &#x41; &#128512;", "x &amp; © y ¬it; A 😀"),
        ("x<noscript><img src=a></noscript>", "x<noscript>&lt;img src=a&gt;</noscript>"),
        ("<svg viewbox='0 0 1 1'><foreignobject><p>x</foreignobject></svg>", '<svg viewBox="0 0 1 1"><foreignObject><p>x</p></foreignObject></svg>'),
        ("<pre>\n\nx</pre>", "<pre>\nx</pre>"),
        ("<p z=1 a='&lt;'>", '<p a="&lt;" z="1"></p>'),
        ("a<!-- c --!>b<!>d", "a<!-- c -->b<!---->d"),
        ("x</p></br>", "x<p></p><br>"),
        ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
        ("1 < 2 <3", "1 &lt; 2 &lt;3"),
    ],
)
def test_tree_construction(html, want):
    assert body(html) == want


def test_documents_get_head_and_body():
    assert outer_html(parse_document("<title>t</title>x")) == "<html><head><title>t</title></head><body>x</body></html>"
    assert outer_html(parse_document("")) == "<html><head></head><body></body></html>"
    assert outer_html(parse_fragment("<td>x<p>y")) == "<html>x<p>y</p></html>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "x", " ", "<!--c-->", "<svg>", "</svg>", "<select>", "<script>", "</script>"])))
def test_any_markup_parses_to_a_tree(parts):
    doc = parse_document("".join(parts))
    for n in doc.walk():
        assert any(c is n for c in n.parent.children)
    assert [n.tag for n in doc.child_elements()] == ["html"]


def test_selectors():
    doc = parse_document('<div id=a class="x y"><p>1<p class=z data-k="Ab-c">2<span>3</span></div><p>4')
    texts = lambda s: [n.text() for n in select(doc, s)]
    assert texts("div > p") == ["1", "23"]
    assert texts("p + p") == ["23"]
    assert texts("div ~ p, span") == ["3", "4"]
    assert texts('[data-k="ab-C" i]') == ["23"] and texts('[data-k="ab-C"]') == []
    assert texts('[data-k^=Ab]:not(.q)') == ["23"] and texts("[data-k|=Ab]") == ["23"]
    assert texts("p:first-child") == ["1"] and texts("p:nth-child(2n)") == ["23", "4"]
    assert texts("div:has(> p) > .z span") == ["3"]
    assert texts("p[") == [] and texts("") == []
    assert matches(select(doc, "#a")[0], ".x.y") and selector_path(select(doc, "span")[0]) == "html > body > div#a > p.z > span"


@pytest.mark.parametrize("ref, want", [("x/../y?q#f", "https://h.org/a/y?q#f"), ("/z", "https://h.org/z"), ("//o.net/p", "https://o.net/p"), ("?k=1", "https://h.org/a/b?k=1"), ("#t", "https://h.org/a/b?q=0#t"), ("mailto:a@b", "mailto:a@b"), ("a b", "https://h.org/a/a%20b"), ("HTTP://X.org:80", "http://x.org/")])
def test_urls(ref, want):
    assert str(urls.parse(ref, urls.parse("https://H.org/a/b?q=0#s"))) == want


def test_bad_urls():
    assert urls.parse("not a url") is None and urls.parse("http://") is None


def test_text_functions():
    assert text.strip_tags("a<b>c</b>d>e<f") == "a c d e"
    assert text.decode_entities("&amp;lt; &#x41;&#66; &bogus; & &amp;") == "&lt; AB &bogus; & &amp;"
    assert text.strip_html_tags("<p>a&nbsp;b</p>") == " a\xa0b "
    assert count_words("Hello world 日本 x\x1fy") == 5
    assert text.join_surrogates("&#55357;<b>&#56832;") == "<b>😀" and text.join_surrogates("&#xD83D;x&#xDE00;") == "&#xD83D;x&#xDE00;"
    assert text.hide_comment_tags("<!-- <p> --><!-- <b>") == "<!-- �p� --><!-- <b>"
    assert text.first_words("<p>one two</p>", 5) == "one t" and text.non_empty("   ") is None


def test_json_ld():
    doc = parse_document(
        '<script type="application/ld+json">/* c */ {"@context": "x", "@graph": [{"@type": "WebSite", "name": "N"}], "u": "http://a//b"} // e</script>'
        '<script type="application/ld+json">{broken</script><script type="application/ld+json"><![CDATA[[{"headline": "A &amp;amp; B", "text": "body"}]]]></script>'
    )
    data = jsonld.schema_data(doc)
    assert data == [{"@type": "WebSite", "name": "N"}, {"@context": "x", "u": "http://a//b"}, {"headline": "A &amp; B", "text": "body"}]
    assert jsonld.text_at(data, "headline") == "A &amp; B" and jsonld.article_text(data) == "body"
    assert jsonld.property_at({"a": [{"b": 1}]}, "a.[].b") == "1" and jsonld.property_at({"x": {"y": True}}, "y") == "true"
