"""One page: cleanup of a parsed document, and retries with fewer rules where little is left."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.css import select, select_one
from ..functions.dom import Node, outer_html, selector_path
from ..functions.htmlparse import parse_document
from ..functions.index import Forest
from ..functions.text import count_words_html, first_words
from . import canonical, cleanup, footnotes, patterns, rules, scoring, standardize


@dataclass(frozen=True)
class Options:
    """What to do with a page.  ``url`` is per page; see :func:`pagemill.operators.extract.extract`.

    ``clutter_names``: parts of class names, ids and test ids whose elements go with ``remove_partial_selectors``.
    """

    url: str | None = None
    content_selector: str | None = None
    debug: bool = False
    markdown: bool = False
    separate_markdown: bool = False
    remove_exact_selectors: bool = True
    remove_partial_selectors: bool = True
    remove_images: bool = False
    remove_hidden_elements: bool = True
    remove_low_scoring: bool = True
    remove_small_images: bool = True
    remove_content_patterns: bool = True
    standardize: bool = True
    include_replies: bool = True
    clutter_names: tuple[str, ...] = rules.PARTIAL_NAMES


@dataclass
class Pass:
    content: str
    words: int
    selector: str
    removals: list[dict] = field(default_factory=list)


class Page:
    """A page's HTML; each pass works on a copy of one parsed tree."""

    def __init__(self, source: str):
        self.source = source
        self.parsed = parse_document(source)
        self._prepared: Node | None = None

    def tree(self) -> Node:
        if self._prepared is None:
            self._prepared = self.parsed.copy()
            canonical.resolve_noscript_images(self._prepared)
            canonical.resolve_streamed(self._prepared)
            standardize.remove_unsafe(self._prepared)
        return self._prepared.copy()


def run_pass(page: Page, o: Options) -> Pass:
    doc = page.tree()
    root = (select_one(doc, o.content_selector) if o.content_selector else None) or scoring.find_root(doc)
    path = selector_path(root)
    trace: list[dict] | None = [] if o.debug else None
    clean(doc, root, o, trace)
    content = outer_html(root)
    return Pass(content, count_words_html(content), path, trace or [])


def clean(doc: Node, root: Node, o: Options, trace: list[dict] | None) -> None:
    if o.standardize:
        canonical.standardize_math(root)
    footnotes.standardize_footnotes(root)
    canonical.standardize_callouts(root)
    if o.remove_images:
        cleanup.remove_images(root)
    if o.remove_small_images:
        cleanup.remove_small_images(root)
    if o.remove_exact_selectors:
        cleanup.remove_exact(doc, root, trace)
        cleanup.remove_headers(doc, root, trace)
    elements = doc.elements()  # one snapshot for the next three
    if o.remove_hidden_elements:
        cleanup.remove_hidden(root, elements, trace)
    if o.remove_partial_selectors:
        cleanup.remove_partial(root, elements, trace, o.clutter_names)
    if o.remove_low_scoring:
        cleanup.remove_low_scoring(root, elements, trace)
    if root is doc or any(a is doc for a in root.ancestors()):
        patterns.remove_metadata_block(root)
    if o.remove_content_patterns:
        patterns.remove_patterns(root, trace)
    if o.standardize:
        canonical.standardize_code(root)
        standardize.standardize_content(root)
    if o.url:
        standardize.resolve_urls(doc, root, o.url)
    cleanup.dedupe_images(root)


def _unique_selector(doc: Node, n: Node) -> str:
    if "id" in n.attrs and len(select(doc, f"#{n.attrs['id']}")) == 1:
        return f"#{n.attrs['id']}"
    return selector_path(n)


def _largest_hidden(page: Page) -> str | None:
    best, most, view = None, 29, Forest().view
    for n in page.parsed.elements():
        if cleanup.is_hidden(n) and (size := view(n).words) > most:
            best, most = n, size
    return _unique_selector(page.parsed, best) if best is not None else None


def _element_with(page: Page, text: str) -> str | None:
    """Selector of the smallest element that holds the start and most words of ``text``."""
    start = first_words(text, 100)
    if not start:
        return None
    least, best, size, view = count_words_html(text) * 4 // 5, None, None, Forest().view
    for n in page.parsed.elements():
        v = view(n)
        if v.words >= least and v.holds(start) and (size is None or v.octets < size):
            best, size = n, v.octets
    return _unique_selector(page.parsed, best) if best is not None else None


def extract_content(page: Page, o: Options, schema_text: str | None = None) -> Pass:
    """The content of the page; each retry starts from ``o`` and must gain enough to be taken."""
    best = run_pass(page, o)
    if o.content_selector is not None:
        return best
    if best.words < 200:
        retry = run_pass(page, replace(o, remove_partial_selectors=False))
        if retry.words > best.words * (5 if best.words < 50 else 2):
            best = retry
    if best.words < 50:
        retry = run_pass(page, replace(o, remove_hidden_elements=False))
        if retry.words > 2 * best.words:
            best = retry
        selector = _largest_hidden(page)
        if selector is not None:
            retry = run_pass(page, replace(o, remove_hidden_elements=False, remove_partial_selectors=False, content_selector=selector))
            enough = retry.words > max(20, best.words * 7 // 10) and len(retry.content.encode()) < len(best.content.encode())
            if retry.words > best.words or enough:
                best = retry
    if best.words < 30:
        relaxed = replace(o, remove_low_scoring=False, remove_partial_selectors=False, remove_content_patterns=False, remove_hidden_elements=False)
        retry = run_pass(page, relaxed)
        if retry.words > best.words:
            best = retry
        if best.words < 50:
            retry = run_pass(page, replace(relaxed, content_selector="body"))
            if retry.words > best.words:
                best = retry
    return _by_schema(page, o, schema_text, best)


def _by_schema(page: Page, o: Options, text: str | None, best: Pass) -> Pass:
    if text is None or count_words_html(text) <= best.words * 3 // 2:
        return best
    selector = _element_with(page, text)
    if selector is not None:
        return run_pass(page, replace(o, content_selector=selector))
    return Pass(standardize.sanitize(text, attributes=False), count_words_html(text), "schema.org/articleBody")
