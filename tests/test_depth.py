"""Pages that are deep, odd or random: nothing stops a job, and views answer as walks do."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.dom import count_words, link_density, trim
from pagemill.functions.htmlparse import MAX_DEPTH, parse_document
from pagemill.functions.index import Forest
from pagemill.functions.jsonld import parsed
from pagemill.functions.text import integer
from pagemill.operators.extract import extract_page, result_row
from pagemill.operators.pipeline import Options
from pagemill.operators.rules import PARTIAL_NAMES, partial_pattern

LONG = "9" * 5000
ODD = (
    f'<img src=a.png width="{LONG}" height="{LONG}">', f'<ol start="{LONG}"><li>x</ol>', f'<ol start="-{LONG}"><li>x</ol>', f'<aside><ol start="{LONG}"><li>x</ol></aside>', f"&#{LONG}; &#x{LONG};",
    f'<a title="&#{LONG};" href="#fn{LONG}">{LONG}</a><p id=ftnt{LONG}><p id=ftnt{LONG}1>', '<script type="application/ld+json">{"name": "\\ud800", "articleBody": "\\udfff"}</script>',
    f'<script type="application/ld+json">{{"n": {LONG}, "e": 1e{LONG}}}</script>', f'<table width=900><tr><td>a<td align=center>b<td>c</table><table width="{LONG}"><tr><td>a<td align=center>b<td>c</table>',
    f'<script type="application/ld+json">{"[" * 50_000}</script>', "\ufffe\ufdd0", "<svg><style>" * 30,
)


@pytest.mark.parametrize("inner", ODD)
def test_odd_values_stop_nothing(inner):
    row = extract_page(f"<html><body><article><p>Some text to keep here.</p>{inner}</article></body></html>", "https://e.com/", Options(separate_markdown=True))
    assert row["error"] is None and "Some text to keep here." in row["content"]


def test_an_error_stays_in_its_row(monkeypatch):
    from pagemill.operators import extract

    monkeypatch.setattr(extract, "extract_content", lambda *a: 1 / 0)
    row = result_row("<p>x</p>", "https://e.com/")
    assert row["error"] == "ZeroDivisionError: division by zero" and row["content"] is None
    assert set(row) == set(extract.RESULT.fieldNames())


@pytest.mark.parametrize("part", ["<div class=c>", "<p><span>x ", "<div><p>text and words</p>", "<b>x", "<ul><li>x", "<header><p>a"])
def test_time_grows_with_the_size_of_deep_pages(part):
    took = []
    for n in (2_000, 8_000):
        began = time.process_time()
        row = result_row(part * n, "https://e.com/", Options(separate_markdown=True))
        took.append(time.process_time() - began)
        assert row["error"] is None
    assert took[1] < 10 * took[0] + 1  # four times the size; the square would be 16 times


def test_deep_elements_become_siblings_in_order():
    doc = parse_document("".join(f"<div>{k} " for k in range(2 * MAX_DEPTH)))
    assert doc.text() == "".join(f"{k} " for k in range(2 * MAX_DEPTH))
    assert max(sum(1 for _ in n.ancestors()) for n in doc.elements()) == MAX_DEPTH + 1  # the document is above all


def test_integer():
    assert integer("+007") == 7 and integer("0") == 0 and integer(str((1 << 64) - 1)) == (1 << 64) - 1
    assert all(integer(x) is None for x in (None, "", "-1", "1.0", "٣", LONG, str(1 << 64), "++1", "1 "))
    assert integer("4294967296", (1 << 32) - 1) is None


def test_json_is_the_strict_kind():
    assert parsed('{"a": "\\ud83d\\ude00", "n": 12345678901234567890123}') == {"a": "\U0001f600", "n": 12345678901234567890123.0}
    for bad in ('"\\ud800"', "NaN", "1e999", "[" * 100_000):
        with pytest.raises((ValueError, RecursionError)):
            parsed(bad)


def test_clutter_names():
    pattern = partial_pattern()
    assert len(PARTIAL_NAMES) == 518 and all(pattern.search(n.lower()) for n in PARTIAL_NAMES)
    assert pattern.search("access-wall") and pattern.search("related-list") and not pattern.search("main-access-wall") and not pattern.search("h2-related")
    kept = "error_handling license_text main_menu article_name articleinfo post__date modal_logic search_theory".split()
    assert not any(pattern.search(n) for n in kept)
    inner = "".join(f"<div class={n}><p>{n} block {'words and more words ' * 25}</p></div>" for n in kept)
    content = extract_page(f"<body><article>{inner}<div class=PreviousNext>gone</div></article>")["content"]
    assert all(f"{n} block" in content for n in kept) and "gone" not in content
    own = Options(clutter_names=("mine",))
    content = extract_page(f"<body><article>{inner}<div class=PreviousNext>stays</div><div class=is-Mine>gone</div></article>", None, own)["content"]
    assert "stays" in content and "gone" not in content


PIECES = st.lists(st.sampled_from(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<b>", "</b>", " ", "word", "日本", "é,", "<pre>", "</pre>", "<li>", "<ul>", "</ul>", "<!--c-->", "\u00a0", "<td>", "<table>", "</table>"]), max_size=40).map("".join)


@given(PIECES)
@settings(max_examples=150, deadline=None)
def test_views_answer_as_walks(html):
    doc = parse_document(html)
    view = Forest().view
    for n in doc.elements():
        v = view(n)
        assert v.text == n.text() and v.words == count_words(n.text()) and v.size == len(trim(n.text()).encode()) and v.octets == len(n.text().encode())
        assert v.link_density == link_density(n)
        assert v.count("a", "p") == len(n.elements("a", "p")) and v.within(_is_pre) == (n.tag == "pre" or any(a.tag == "pre" for a in n.ancestors()))
        assert v.above(_is_pre) == any(a.tag == "pre" for a in n.ancestors()) and v.below(_is_pre) == bool(n.elements("pre"))


def _is_pre(n):
    return n.tag == "pre"


@given(PIECES)
@settings(max_examples=60, deadline=None)
def test_random_pages_give_results(html):
    assert result_row(html, "https://e.com/", Options(separate_markdown=True, debug=True))["error"] is None
