"""Scores of elements, and the choice of the content root."""

from __future__ import annotations

import re

from ..functions.css import compiled, select, select_one
from ..functions.dom import Node, class_and_id, count_words
from ..functions.index import Forest, View
from ..functions.text import integer
from . import rules

#: Patterns of class names, navigation words, dates, bylines and profiles.
CONTENT_CLASS = re.compile(r"(?i)content|article|post")
LIKELY_CLASS = re.compile(r"(?i)admonition|article|content|entry|figcaption|figure|font|image|img|main|post|pre|story|table")
CLUTTER_CLASS = re.compile(r"(?i)advert|ad-|ads|banner|cookie|copyright|footer|header|homepage|menu|nav|newsletter|popular|privacy|recommended|related|rights|share|sidebar|social|sponsored|subscribe|terms|trending|widget")
NAV_WORDS = re.compile(
    r"(?i)\b(?:advertisement|all rights reserved|banner|cookie|comments|copyright|follow me|follow us|footer|header|homepage|login|menu|more articles|more like this|most read|nav|navigation|newsletter|popular|privacy|recommended|register|related|responses|share|sidebar|sign in|sign up|signup|social|sponsored|subscribe|terms|trending)\b"
)
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
LOOSE_DATE = re.compile(rf"(?i)\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}|\b(?:{_MONTHS})[a-z]*\s+\d{{1,2}}")
FULL_DATE = re.compile(rf"(?i)\b(?:(?:{_MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})[a-z]*,?\s+\d{{4}})\b")
BYLINE = re.compile(r"\bBy\s+[A-Z]")
AUTHOR = re.compile(r"(?i)\b(?:by|written by|author:)\s+[A-Za-z\s]+\b")
META_LABEL = re.compile(r"(?i)\s*(?:Authors?:?|By |Subjects?:|Keywords?:|Cite as:?|DOI:?|Published:?|Submitted:?|Date:?|Citation:?|Abstract:)")
META_CLASS = re.compile(r"(?i)authors|citation|subjects|keywords|doi|submission")
PROFILE = re.compile(r"(?i)\b(?:linkedin\.com/(?:in|company)/|twitter\.com/(?!intent\b)\w|x\.com/(?!intent\b)\w|facebook\.com/(?!share\b)\w|instagram\.com/\w|threads\.net/\w|mastodon\.\w)")
NOTE_REF, NOTE_LIST = 'a[href^="#fn"], sup.reference', "ol.footnotes, div.footnotes"
#: Parts of texts that numbers, dates and bylines have.
_COMMA, _DIGIT, _BY = re.compile(","), re.compile(r"\d"), re.compile(r"(?i)(?:by|author:)\s")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
STRUCTURE = frozenset("pre table figure picture code blockquote math mjx-container".split())


_ref, _note = compiled(NOTE_REF), compiled(NOTE_LIST)


def _structured(n: Node) -> bool:
    css = n.attrs.get("class", "")
    return n.tag in STRUCTURE or (css != "" and ("katex" in css or "MathJax" in css))


def _is_ref(n: Node) -> bool:
    return n.tag in ("a", "sup") and _ref(n)


def _is_note_list(n: Node) -> bool:
    return n.tag in ("ol", "div") and _note(n)


def _is_main(n: Node) -> bool:
    return n.tag in ("main", "article")


def _is_nav_heading(n: Node) -> bool:
    return n.tag in HEADINGS and NAV_WORDS.search(n.text()) is not None


def _is_profile_link(n: Node) -> bool:
    return n.tag == "a" and "href" in n.attrs and PROFILE.search(n.attrs["href"]) is not None


def is_layout_cell(node: Node) -> bool:
    if node.tag != "td" or not (node.get("align").lower() == "center" or CONTENT_CLASS.search(class_and_id(node))):
        return False
    if node.parent_element is None:
        return False
    row = node.parent.child_elements()
    if node is row[0] or node is row[-1]:
        return False
    table = next((a for a in node.ancestors() if a.tag == "table"), None)
    width = table.get("width").rstrip("px") if table is not None else ""
    return (integer(width, (1 << 32) - 1) or 0) > 400


def is_right_aligned(node: Node) -> bool:
    style = node.get("style").lower()
    return node.get("align").lower() == "right" or any(x in style for x in ("float:right", "float: right", "text-align:right", "text-align: right"))


def score(v: View) -> float:
    """How much the element looks like main content."""
    words = v.words
    value = words + 10.0 * v.count("p") + v.marks(_COMMA) - 3.0 * (v.count("img") / max(words, 1))
    if CONTENT_CLASS.search(class_and_id(v.node)):
        value += 15
    value *= 1 - min(v.link_density, 0.5)
    value += 5 * is_right_aligned(v.node) + 10 * v.finds(FULL_DATE, _DIGIT) + 10 * v.finds(AUTHOR, _BY)
    return value + 10 * v.below(_is_ref) + 10 * v.below(_is_note_list) - 5 * v.count("table") + 10 * is_layout_cell(v.node)


def is_article_metadata(v: View) -> bool:
    return bool(META_CLASS.search(class_and_id(v.node))) or v.matches(META_LABEL)


def is_card_grid(v: View, total: int) -> bool:
    if not 3 <= total < 500 or v.count("h2", "h3", "h4") < 3 or v.count("img") < 2:
        return False
    headings = v.node.elements("h2", "h3", "h4")
    prose = max(0, total - sum(count_words(h.text()) for h in headings))
    return prose / len(headings) < 20


def is_likely_content(v: View) -> bool:
    node = v.node
    if node.get("role") in ("article", "main", "contentinfo") or LIKELY_CLASS.search(class_and_id(node)):
        return True
    if v.above(_is_main) and is_article_metadata(v):
        return True
    if v.below(_structured):
        return True
    words = v.words
    if words < 1000 and v.below(_is_nav_heading) and (words < 200 or v.link_density > 0.2):
        return False
    if is_card_grid(v, words) or (words < 80 and v.below(_is_profile_link)):
        return False
    blocks = v.count("p", "li")
    if words > 100 or (words > 30 and blocks > 0) or (words > 50 and blocks > 1):
        return True
    return words >= 10 and v.link_density < 0.1 and any(c in v.text for c in ".!?")


def clutter_score(v: View) -> float:
    """Below 0 for elements that look like clutter."""
    if v.within(_is_note_list):
        return 0.0
    words = v.words
    if words < 3 or v.below(_is_note_list):
        return 0.0
    text, density, links = v.text, v.link_density, v.count("a")
    value = float(v.marks(_COMMA)) - 10 * len(NAV_WORDS.findall(text))
    value -= 15 * (density > 0.5) + 15 * (links > 1 and words < 80 and density > 0.8)
    value -= 8 * len(CLUTTER_CLASS.findall(class_and_id(v.node)))
    value -= 10 * bool(words < 15 and BYLINE.search(text) and LOOSE_DATE.search(text))
    lists = v.count("ul", "ol")
    value -= 10 * (lists > 0 and links > 3 * lists)
    value -= 15 * (words < 80 and v.below(_is_profile_link)) + 15 * is_card_grid(v, words)
    if words < 50 and v.above(_is_main) and is_article_metadata(v):
        value += 20
    return value


def find_root(doc: Node) -> Node:
    """The element that holds the main content."""
    total, view = len(rules.ENTRY_POINTS), Forest().view
    ranked: list[tuple[float, int, Node]] = []
    for k, selector in enumerate(rules.ENTRY_POINTS):
        ranked += [((total - k) * 40.0 + score(view(n)), k, n) for n in select(doc, selector)]
    body = select_one(doc, "body")
    if all(k == total - 1 for _, k, _ in ranked):
        best, top = None, float("-inf")
        for n in doc.elements("div", "section", "article", "main"):
            value = score(view(n))
            if value > top:
                best, top = n, value
        return best or body or doc
    ranked.sort(key=lambda c: -c[0])
    _, k, best = ranked[0]
    for _, other, node in ranked[1:]:
        if other < k and node.inside(best) and view(node).words > 50:
            return node
    return best
