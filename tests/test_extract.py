import pytest

from pagemill.operators import canonical, cleanup, extractors, footnotes, gfm, patterns, scoring, standardize
from pagemill.operators.extract import extract_page
from pagemill.operators.markdown import to_markdown
from pagemill.operators.metadata import clean_author, clean_title, iso_date, site_of_domain
from pagemill.operators.pipeline import Options
from pagemill.functions.css import select, select_one
from pagemill.functions.dom import inner_html, outer_html
from pagemill.functions.htmlparse import parse_document
from pagemill.functions.index import Forest

PROSE = "The quick brown fox jumps over the lazy dog, and then it rests. " * 20


def page(inner: str, head: str = "") -> str:
    return f"<html lang=en><head><title>Title here</title>{head}</head><body>{inner}</body></html>"


def content(inner: str, **options) -> str:
    return extract_page(page(inner), "https://example.com/a/b", Options(**options))["content"]


def root(inner: str):
    return select_one(parse_document(f"<article>{inner}</article>"), "article")


def test_article_wins_and_clutter_goes():
    r = extract_page(page(f"<nav><a href=/>Home</a></nav><div class=sidebar>Side</div><article><h1>H</h1><p>{PROSE}</p><div class='share-box'>Tweet</div><div style='display: none'>gone</div></article><footer>Foot</footer>"), "https://example.com/")
    assert PROSE.strip() in r["content"] and not any(x in r["content"] for x in ("Home", "Side", "Tweet", "Foot", "gone"))
    assert r["word_count"] == 261 and r["language"] == "en" and r["domain"] == "example.com" and r["title"] == "Title here"


def test_options():
    inner = f"<article><p>{PROSE}</p><p class=hidden>{PROSE}</p><img src=a.png width=100 height=100><div class=newsletter-form>{PROSE}</div></article>"
    assert content(inner).count("lazy") == 20 and "<img" in content(inner)
    assert content(inner, remove_partial_selectors=False).count("lazy") == 40
    assert content(inner, remove_hidden_elements=False, remove_exact_selectors=False).count("lazy") == 40
    assert "<img" not in content(inner, remove_images=True)
    assert content("<article><p>a</p></article><div id=x><p>b</p></div>", content_selector="#x") == '<div id="x"><p>b</p></div>'
    debug = extract_page(page(inner), None, Options(debug=True))
    assert debug["debug"]["content_selector"] == "html > body > article"
    assert {r["reason"] for r in debug["debug"]["removals"]} >= {"exact selector match", "partial selector match"}


def test_retries():
    assert "words" in content(f"<div aria-hidden=true><article><p>{'words ' * 60}</p></article></div>")
    schema = '<script type="application/ld+json">{"articleBody": "' + "\\u0061lpha beta gamma " * 40 + '"}</script>'
    r = extract_page(page("<article><p>short</p></article>", schema), None, Options(debug=True))
    assert r["debug"]["content_selector"] == "schema.org/articleBody" and r["word_count"] == 120


@pytest.mark.parametrize("html", ["", None, "<", "\0", "plain text", "<html>", "<body></body>", "<div>" * 400 + "x", "<table>" * 50])
def test_odd_pages_do_not_fail(html):
    r = extract_page(html, "not a url", Options(separate_markdown=True, debug=True))
    assert r["domain"] is None and r["word_count"] >= 0


def test_root_choice():
    doc = parse_document(page(f"<main><div class=post-content><p>{PROSE}</p></div></main>"))
    assert scoring.find_root(doc).classes == ["post-content"]
    doc = parse_document(page(f"<div><p>few</p></div><div id=b><p>{PROSE}</p></div>"))
    assert scoring.find_root(doc).get("id") == "b"
    assert scoring.clutter_score(Forest().view(root("<div class=sidebar-menu><a href=a>Share this page</a> <a href=b>Subscribe now</a></div>"))) < 0


def test_patterns():
    def left(inner: str) -> str:
        r = root(inner)
        patterns.remove_patterns(r)
        return inner_html(r)

    long = f"<p>{PROSE}</p>"
    assert left(f"{long}<p>5 min read</p>") == long
    assert left(f"<p>By Jane Doe</p>{long}") == long
    assert left(f"{long}<h2>Related posts</h2><ul><li>a</li></ul>") == long
    assert left(f"{long}<div><time>Jan 5, 2024</time></div>") == long
    assert left(f"{long}<p>12 likes</p><p>Pinned</p><p>Current time in Rome</p>") == long
    assert left(f"<ul><li><a href='/a'>A</a></li></ul>{long}") == long
    assert left(f"{long}<h2>See</h2><ul><li><a href='https://a.b'>one. two.</a></li><li><a href='https://c.d'>three.</a></li></ul>") == long
    assert left(f"{long}<section>Sign up for our newsletter by email</section>") == long
    r = root("<h1>T</h1><div>Ann Lee, 2024-01-05</div><p>text</p>")
    patterns.remove_metadata_block(r)
    assert inner_html(r) == "<h1>T</h1><p>text</p>"


def test_cleanup_rules():
    r = root('<img src=a.png width=20><img src="data:image/gif;base64,x"><img src=b.png alt=k><img src=b2.png alt=k width=50 height=50><picture></picture>')
    cleanup.remove_small_images(r)
    cleanup.dedupe_images(r)
    assert [n.get("src") for n in r.elements("img")] == ["b2.png"]
    hidden = lambda html: cleanup.is_hidden(root(html).child_elements()[0])
    assert hidden("<p style='opacity:0.5'>") and hidden("<p inert>") and hidden("<p class='a invisible'>")
    assert not hidden("<p class='hidden md:block'>") and not hidden("<p>")


def test_footnotes():
    r = root("<p>One<sup><a href='#fn1'>1</a></sup> two<sup>2</sup></p><section class=footnotes><ol><li id=fn1>First <a href='#r'>↩</a></li><li id=fn2><p>Second</p></li></ol></section>")
    footnotes.standardize_footnotes(r)
    assert inner_html(r) == (
        '<p>One<sup id="fnref:1"><a href="#fn:1">1</a></sup> two<sup id="fnref:2"><a href="#fn:2">2</a></sup></p>'
        '<div id="footnotes"><div class="footnote" id="fn:1">First</div><div class="footnote" id="fn:2"><p>Second</p></div></div>'
    )
    r = root("<p>a<sup>1</sup> b<sup>2</sup></p><hr><p><sup>1</sup> x</p><p><sup>2</sup> y</p><blockquote>more</blockquote>")
    footnotes.standardize_footnotes(r)
    assert [n.text() for n in select(r, ".footnote")] == ["x", "ymore"] and not r.elements("hr")
    r = root("<p>plain</p>")
    footnotes.standardize_footnotes(r)
    assert inner_html(r) == "<p>plain</p>"


def test_canonical_forms():
    r = root('<pre class="language-rust"><span class=lineno>1</span>fn\tmain()<br><br><br><br>{}</pre><button data-copy>c</button>')
    canonical.standardize_code(r)
    assert inner_html(r) == '<pre><code data-lang="rust">fn    main()\n\n{}</code></pre>'
    r = root('<span class=katex><span class=katex-mathml><math><annotation encoding="application/x-tex">x^2</annotation></math></span></span><mjx-container data-latex="y" display=true></mjx-container>')
    canonical.standardize_math(r)
    assert inner_html(r) == '<span data-latex="x^2">x^2</span><div data-latex="y">y</div>'
    r = root('<div class="markdown-alert markdown-alert-tip">t</div><blockquote>[!NOTE] hi</blockquote><div class="alert alert-info">i</div>')
    canonical.standardize_callouts(r)
    assert [(n.get("data-callout"), n.get("data-callout-title")) for n in r.child_elements()] == [("tip", "Tip"), ("note", "Note"), ("info", "Info")]
    doc = parse_document('<img data-src=x><noscript><img src="real.png"></noscript>')
    canonical.resolve_noscript_images(doc)
    assert select_one(doc, "img").get("src") == "real.png" and not doc.elements("noscript")
    doc = parse_document('<div><template id=B:0></template><i>skeleton</i><!--/$-->kept</div><div hidden id=S:0><p>real</p></div><script>$RC("B:0","S:0")</script>')
    canonical.resolve_streamed(doc)
    assert inner_html(select_one(doc, "body")) == "<div><p>real</p>kept</div>"


def test_standardise():
    doc = parse_document('<article><p onclick=x style=y id=k>a<wbr>b</p><div><p>c</p></div><p><br></p><h1>1</h1><h1>2</h1><a href="javascript:x">l</a><object></object></article>')
    standardize.remove_unsafe(doc)
    r = select_one(doc, "article")
    standardize.standardize_content(r)
    assert inner_html(r) == '<p id="k">ab</p><p>c</p><h1>1</h1><h2>2</h2><a>l</a>'
    assert standardize.srcset_parts("data:image/png;base64,AA 1x, b.png 2x") == ["data:image/png;base64,AA 1x", " b.png 2x"]
    assert standardize.is_unsafe_uri(" JavaScript:x") and standardize.is_unsafe_uri("data:text/html,x") and not standardize.is_unsafe_uri("data:image/png;base64,x")
    assert standardize.sanitize('<a href="x" onclick=y>z</a>', "https://h.org/d/") == '<html><a href="https://h.org/d/x">z</a></html>'


def test_metadata():
    head = '<meta property="og:title" content="Story | Site Name"><meta property="og:site_name" content="Site Name"><meta name=author content="Ann - https://x.y"><meta name=keywords content="a, ,b"><link rel=icon href=/i.png><meta property="article:published_time" content="2024-02-03">'
    r = extract_page(page("<article><p>x</p></article>", head), "https://www.example.com/p")
    assert (r["title"], r["author"], r["site"], r["published"], r["keywords"], r["favicon"]) == ("Story", "Ann", "Site Name", "2024-02-03", ["a", "b"], "https://www.example.com/i.png")
    assert clean_title("Story - Example", "Example") == "Story" and clean_author("https://a.b") == "" and site_of_domain("en.wiki.org") == "Wiki"
    assert [iso_date(x) for x in ("March 3, 2024", "7 May 1999", "2024-13-01", "2024-02-30")] == ["2024-03-03", "1999-05-07", None, "2024-02-30"]


def test_markdown():
    html = '<h2>T</h2><p>a <strong>b</strong> <em>c</em> <code>d*</code> <a href="u(1)" title="t">l</a>_x</p><ul><li>1<ul><li>2</li></ul></li></ul><ol start=3><li>x</li></ol><blockquote><p>q</p></blockquote><hr><pre><code>z\n  y</code></pre>'
    assert to_markdown(html) == '## T\n\na **b** *c* `d*` [l](u\\(1\\) "t")\\_x\n\n*   1\n    *   2\n\n3.  x\n\n> q\n\n* * *\n\n```\nz\n  y\n```'
    assert to_markdown("<table><thead><tr><th>a</th><th>bb</th></tr></thead><tbody><tr><td>1</td><td>2|3</td></tr></tbody></table>") == "| a   | bb   |\n| --- | ---- |\n| 1   | 2\\|3 |"
    assert to_markdown('<p>n<sup id="fnref:1"><a href="#fn:1">1</a></sup></p><div id="footnotes"><div class="footnote" id="fn:1">N</div></div>') == "n[^1]\n\n[^1]: N"
    assert to_markdown('<p><span data-latex="a_b">x</span></p>') == "$a_b$" and to_markdown("<p></p>") == ""
    assert to_markdown('<iframe src="https://www.youtube.com/embed/k"></iframe>') == "![](https://www.youtube.com/watch?v=k)"


def test_comment_tree():
    c = lambda d: extractors.Comment("u", "d", "<p>x</p>", d)
    html = extractors.comment_tree([c(0), c(1), c(2), c(1), c(0)])
    assert html.count("<blockquote>") == html.count("</blockquote>") == 5
    assert html.index("</blockquote></blockquote><blockquote>") > 0


def test_sites():
    hn = '<table class=fatitem><tr class=athing><td class=titleline><a href="https://a.b">Story</a></td></tr><tr><td><a class=hnuser>me</a><span class=age title="2024-01-02T03:04:05"></span></td></tr></table><table><tr class="athing comtr" id=7><td class=ind><img width=40></td><td><a class=hnuser>you</a><div class=commtext>A comment of enough words to count as one</div></td></tr></table>'
    r = extract_page(page(hn), "https://news.ycombinator.com/item?id=1")
    assert (r["extractor_type"], r["title"], r["author"], r["published"]) == ("hackernews", "Story", "me", "2024-01-02") and "item?id=7" in r["content"]
    r = extract_page(page(hn), "https://news.ycombinator.com/item?id=1", Options(include_replies=False))
    assert "item?id=7" not in r["content"]
    chat = '<article data-testid="conversation-turn-1"><h5 class=sr-only>You said</h5><div class=markdown>Hi</div></article><article data-testid="conversation-turn-2"><div class=markdown>Hello</div></article>'
    r = extract_page(page(chat), "https://chatgpt.com/c/1")
    assert r["extractor_type"] == "conversation" and r["content"].index("Hi") < r["content"].index("Hello")
    bb = "<div data-partnereventstore='[{\"event_name\":\"E\",\"announcement_body\":{\"body\":\"[b]x[/b] [url=javascript:y]z[/url]\"}}]'></div>"
    r = extract_page(page(bb))
    assert (r["extractor_type"], r["title"]) == ("bbcode", "E") and "<strong>x</strong> z" in r["content"]
    wiki = extract_page("", "https://wiki.c2.com/?PageName", payloads={"https://c2.com/wiki/remodel/pages/PageName": '{"text": "See OtherPage and \'\'this\'\'", "date": "d"}'})
    assert wiki["title"] == "Page Name" and 'href="https://wiki.c2.com/?OtherPage">Other Page</a>' in wiki["content"] and "<em>this</em>" in wiki["content"]


def test_api_answers():
    item = '{"type": "story", "title": "T", "by": "u", "url": "https://x.y", "time": 86400, "kids": [2, 3]}'
    base = "https://hacker-news.firebaseio.com/v0/item"
    payloads = {f"{base}/1.json": item, f"{base}/2.json": '{"by": "a", "text": "first"}', f"{base}/3.json": '{"deleted": true, "text": "no"}'}
    r = extract_page("", "https://news.ycombinator.com/item?id=1", payloads=payloads)
    assert r["published"] == "1970-01-02" and "first" in r["content"] and ">no<" not in r["content"]
    gh = {"https://api.github.com/repos/o/r/issues/5": '{"title": "Bug", "body": "it **fails**, see https://a.b/c.", "user": {"login": "me"}, "labels": [{"name": "L"}], "created_at": "2024-01-02T0"}'}
    r = extract_page("", "https://github.com/o/r/issues/5", payloads=gh)
    assert r["title"] == "Bug" and "<strong>Labels:</strong> L" in r["content"] and 'href="https://a.b/c">' in r["content"]
    assert extractors.api_urls("https://github.com/o/r/pull/5")[0] == "https://api.github.com/repos/o/r/pulls/5" and extractors.api_urls(None) == []


def test_gfm():
    html = gfm.markdown_to_html("# T\n\nA *b* ~~c~~ `d`  \ne <b>\n\n- [x] done\n- [ ] open\n\n> q\n\n```py\n1 < 2\n```\n\n| h |\n|:-:|\n| v |\n\n[x](javascript:y) n[^1]\n\n[^1]: note")
    for part in ("<h1>T</h1>", "<em>b</em>", "<del>c</del>", "<code>d</code><br />", "&lt;b&gt;", 'type="checkbox" checked=""', "<blockquote>\n<p>q</p>", '<code class="language-py">1 &lt; 2\n</code>', '<th style="text-align: center">h</th>', '<a href="">x</a>', 'id="1"'):
        assert part in html, part


def test_outer_html_of_root_is_content():
    assert outer_html(root("x")) == "<article>x</article>"
