"""Content patterns: short blocks that are recognised by their words and place.

A rule names the elements it looks at and says which of them go.  Rules run one after
the other; each decides on the tree as the rules before have left it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..functions.dom import Node, count_words, detach_all, link_density, link_targets, trim
from ..functions.index import Forest, View
from .cleanup import Trace, note

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Wording of the blocks.
_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_DATE = rf"(?:{_MONTH})\w*\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}"
READ_TIME = re.compile(r"(?i)\d+\s*min(?:ute)?s?\s*(?:read|to read)")
BYLINE = re.compile(r"(?i)(?:by|written by|author:)\s+\S")
DATE = re.compile(rf"(?i){_DATE}")
BOILERPLATE = re.compile(r"(?i)this article (?:appeared|was published|originally)|originally published|©\s*\d{4}|all rights reserved|comments|leave a reply|loading\.{3}|subscribe to|sign up for")
RELATED = re.compile(r"(?i)related\s*(?:posts|articles|stories)?|you might also like|recommended|more from|subscribe|follow us|share this|newsletter|stay updated|get the newsletter|don'?t miss out|join our community|keep reading")
AUTHOR_DATE = re.compile(rf"(?i)[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,3}}\s*[|·•/,]\s*(?:{_DATE})")
LABEL = re.compile(r"(?i)(?:date|published|updated|posted|from|to|subject|sent|cc|bcc)\s*:")
WEEKDAY = re.compile(r"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b")
COUNTER = re.compile(r"(?i)\s*\d+\s*(?:likes?|comments?|shares?|retweets?|replies|reactions?)\s*")
RELATED_INTRO = re.compile(r"(?i)for more (?:on|about)\b")
TIMEZONE = re.compile(r"(?i)current time in\b")
PINNED = re.compile(r"(?i)\s*pinned\s*")
DATED_CLASS = ("date", "time", "publish", "meta", "byline", "posted")


class Block(View):
    """An element with its text and number of words."""

    __slots__ = ()

    @property
    def flat(self) -> str:
        return trim(self.text)

    @property
    def low(self) -> str:
        return self.flat.lower()

    def any(self, *tags: str) -> bool:
        return self.count(*tags) > 0


class Page(Forest):
    """The tree as it is now, with its blocks."""

    def block(self, node: Node) -> Block:
        v = self.view(node)
        return Block(v.index, v.k, node)

    def words(self, node: Node) -> int:
        return self.view(node).words


Pick = Callable[[Page, Node], Iterator[Node]]


def _below(*tags: str) -> Callable[[Node], list[Node]]:
    return lambda root: [n for t in tags for n in root.elements(t)]


def _children(part: slice, *tags: str, least: int = 0) -> Callable[[Node], list[Node]]:
    def pick(root: Node) -> list[Node]:
        row = root.child_elements()
        return [n for n in row[part] if n.tag in tags] if len(row) >= least else []

    return pick


def _each(elements: Callable[[Node], list[Node]], test: Callable[[Block], bool]) -> Pick:
    def pick(page: Page, root: Node) -> Iterator[Node]:
        return (n for n in elements(root) if test(page.block(n)))

    return pick


def _related_headings(page: Page, root: Node) -> Iterator[Node]:
    for tag in HEADINGS:
        for n in root.elements(tag):
            if RELATED.match(trim(n.text())):
                yield n
                after = n.sibling(1)
                if after is not None and after.tag in ("ul", "ol", "div"):
                    after.flag = True  # goes along, without an entry of its own
                    yield after


def _dated_parents(page: Page, root: Node) -> Iterator[Node]:
    for n in root.elements("time"):
        up = n.parent_element
        if up is not None and up.tag in ("p", "div") and page.words(n) <= 5 and page.words(up) <= 8 and DATE.search(n.text()):
            yield up


def _banners(page: Page, root: Node) -> Iterator[Node]:
    for n in root.child_elements():
        if n.tag in ("h1", "h2", "h3"):
            return
        if n.tag == "a" and page.words(n) <= 15 and n.elements("div"):
            yield n


def _dates_by_title(page: Page, root: Node) -> Iterator[Node]:
    row = root.child_elements()
    at = next((k for k, n in enumerate(row) if n.tag == "h1"), None)
    if at is not None:
        for n in row[max(0, at - 2) : at + 3]:
            if n.tag == "div" and page.words(n) <= 10 and DATE.search(n.text()):
                yield n


def _is_dated_class(n: Node | None) -> bool:
    return n is not None and any(x in n.get("class").lower() for x in DATED_CLASS)


def _standalone_date(b: Block) -> bool:
    if b.words > 5 or not DATE.search(b.text):
        return False
    return b.node.tag == "time" or _is_dated_class(b.node) or _is_dated_class(b.node.parent_element)


def _facts(page: Page, root: Node) -> Iterator[Node]:
    row = root.child_elements()
    edge = row[:3] + [n for n in row[-3:] if not any(n is x for x in row[:3])]
    for n in edge:
        items = n.child_elements()
        if n.tag in ("ul", "ol", "dl") and 1 <= len(items) <= 10 and all(count_words(t) <= 8 and "." not in t and "?" not in t for t in (i.text() for i in items)):
            yield n


def _inner_links(*starts: str) -> Callable[[Block], bool]:
    return lambda b: b.words <= 20 and bool(h := link_targets(b.node)) and all(x.startswith(starts) for x in h)


def _outer_lists(page: Page, root: Node) -> Iterator[Node]:
    row = root.child_elements()
    for k in range(max(1, len(row) - 4), len(row)):
        targets = link_targets(row[k])
        if row[k].tag in ("ul", "ol") and len(targets) >= 2 and all(t.startswith(("http://", "https://")) for t in targets) and row[k - 1].tag in HEADINGS:
            yield row[k]
            row[k - 1].flag = True
            yield row[k - 1]


def _mostly_links(b: Block) -> bool:
    row = b.node.elements("p")
    return bool(row) and sum(link_density(p) > 0.5 for p in row) / len(row) > 0.5


def _thin_tail(page: Page, root: Node) -> Iterator[Node]:
    row, total, thin = root.child_elements(), page.words(root), 0
    if len(row) < 3 or not total:
        return
    for n in reversed(row):
        b = page.block(n)
        if b.words >= 25 or not b.any(*HEADINGS):
            return
        thin += b.words
        if thin / total >= 0.15:
            return
        yield n


def _newsletter(b: Block) -> bool:
    low = b.text.lower() if b.words <= 80 else ""
    return any(x in low for x in ("subscribe", "sign up", "signup")) and any(x in low for x in ("newsletter", "email", "inbox"))


def _contact(b: Block) -> bool:
    return b.words <= 60 and any(x in b.text.lower() for x in ("email:", "phone:", "contact:", "tel:", "e-mail:"))


def _names_authors(low: str) -> bool:
    return low.startswith(("authors:", "author:")) or (low.startswith("authors") and "," in low)


def _widget(b: Block) -> bool:
    if b.words > 12:
        return False
    by = b.low.startswith(("author", "written by", "posted by"))
    return not (by and _names_authors(b.low)) and (by or b.low.startswith("share"))


def _card_grid(b: Block) -> bool:
    cards = b.node.child_elements()
    return len(cards) >= 2 and all(c.elements("img") and c.elements("a", *HEADINGS) for c in cards)


_ALL, _LAST3, _LAST4, _FIRST3 = slice(None), slice(-3, None), slice(-4, None), slice(0, 3)

#: (reason, elements that go), in the order in which they run.
RULES: tuple[tuple[str, Pick], ...] = (
    ("read time", _each(_below("p", "span", "div", "time"), lambda b: b.words <= 10 and bool(READ_TIME.search(b.text)))),
    ("byline", _each(_below("p", "span", "div"), lambda b: b.words <= 15 and len(b.text.encode()) <= 600 and bool(BYLINE.match(b.flat)))),
    ("boilerplate", _each(_below("p", "div", "span"), lambda b: b.words <= 30 and bool(BOILERPLATE.search(b.text)))),
    ("related heading", _related_headings),
    ("boundary time", _dated_parents),
    ("trailing link list", _each(_children(_LAST3, "div", "section", "aside", least=2), lambda b: b.words < 100 and b.link_density > 0.5)),
    ("hero header", _each(_children(_FIRST3, "div", "header", "section"), lambda b: b.words < 30 and b.any("h1") and b.any("time"))),
    ("breadcrumb list", _each(_children(_FIRST3, "ul", "ol", "nav"), _inner_links("/", "#", "."))),
    ("promotional banner", _banners),
    ("article metadata header", _dates_by_title),
    ("author date byline", _each(_below("p", "span", "div"), lambda b: b.words <= 15 and not LABEL.match(b.flat) and not WEEKDAY.match(b.flat) and bool(AUTHOR_DATE.match(b.flat)))),
    ("standalone date", _each(lambda root: [n for n in root.child_elements()[:5] if n.tag in ("p", "span", "div", "time")], _standalone_date)),
    ("blog metadata list", _facts),
    ("section breadcrumb", _each(_below("nav"), _inner_links("/", "."))),
    ("trailing external links", _outer_lists),
    ("trailing related posts", _each(_children(_LAST3, "div", "section", "aside", "footer", least=2), _mostly_links)),
    ("trailing thin section", _thin_tail),
    ("newsletter signup", _each(_below("div", "section", "aside", "form"), _newsletter)),
    ("author contact block", _each(_children(_LAST4, "div", "section", "aside", least=2), _contact)),
    ("author/share widget", _each(_below("div", "span", "aside", "section"), _widget)),
    ("social counter", _each(_below("span", "div", "p", "li"), lambda b: b.words <= 2 and bool(COUNTER.fullmatch(b.flat)))),
    ("related intro paragraph", _each(_below("p"), lambda b: b.words <= 25 and bool(RELATED_INTRO.match(b.flat)) and b.link_density > 0.3)),
    ("related post card grid", _each(_children(_ALL, "div", "section"), _card_grid)),
    ("pinned label", _each(_below("span", "div", "p", "label"), lambda b: b.words <= 3 and bool(PINNED.fullmatch(b.text)))),
    ("timezone widget", _each(_below("div", "span", "p", "section"), lambda b: b.words <= 15 and bool(TIMEZONE.search(b.text)))),
)


def remove_patterns(root: Node, trace: Trace | None = None) -> None:
    page = Page()
    for reason, pick in RULES:
        found = list(pick(page, root))
        for node in found:
            if not node.flag:
                note(trace, node, "removeByContentPattern", None, reason)
            node.flag = False
        if found:
            detach_all(found)


def remove_metadata_block(root: Node) -> None:
    """Of the three elements after the first h1, the first short one with a date goes."""
    title = next(iter(root.elements("h1")), None)
    node = title
    for _ in range(3):
        node = node.sibling(1) if node is not None else None
        if node is None:
            return
        text = trim(node.text())
        if text and len(text.encode()) < 300 and any(DATE.search(trim(n.text())) for n in (node, *node.elements("p", "time"))):
            node.detach()
            return
