"""Removal of clutter around and inside the content root.

Every operator looks at the whole document, as it was before the operator began, and
never removes an ancestor of the root.  ``trace`` gets (step, selector, reason, text).
"""

from __future__ import annotations

from ..functions.css import compiled, tags_of
from ..functions.dom import ELEMENT, Node, detach_all, words
from ..functions.index import Forest, Index
from ..functions.text import integer
from . import rules, scoring

Trace = list


def preview(text: str, limit: int = 80) -> str:
    """White space collapsed, cut at ``limit`` characters."""
    flat = " ".join(words(text))
    return flat if len(flat) <= limit else flat[:limit] + "..."


def note(trace: Trace | None, node: Node, step: str, selector: str | None, reason: str) -> None:
    if trace is not None:
        trace.append({"step": step, "selector": selector, "reason": reason, "text": preview(node.text())})


def _around(root: Node) -> set[int]:
    return {id(a) for a in root.ancestors()}


def remove_exact(doc: Node, root: Node, trace: Trace | None = None) -> None:
    around, tags, index = _around(root), tags_of(tuple(rules.EXACT)), Index(doc)
    place, gone = {id(n): k for k, n in enumerate(index.nodes)}, bytearray(len(index.nodes))
    likely = [n for n in doc.elements() if n.attrs or n.tag in tags]  # no other element can match
    for selector in rules.EXACT:
        test = compiled(selector)
        found = [n for n in likely if test(n) and id(n) not in around]
        for node in found:
            note(trace, node, "removeBySelector", selector, "exact selector match")
            node.detach()
            k = place[id(node)]
            gone[k : index.last[k]] = b"\1" * (index.last[k] - k)
        if found:
            likely = [n for n in likely if not gone[place[id(n)]]]


def _has_two_paragraphs(node: Node) -> bool:
    """Two paragraphs next to each other under one element."""
    row = [c.tag for c in node.children if c.kind == ELEMENT]
    return any(a == b == "p" for a, b in zip(row, row[1:]))


def remove_headers(doc: Node, root: Node, trace: Trace | None = None) -> None:
    around, view = _around(root), Forest().view
    headers = [n for n in doc.elements("header") if id(n) not in around]
    found = [n for n in headers if not _has_two_paragraphs(n) and not view(n).below(_has_two_paragraphs)]
    for node in found:
        note(trace, node, "removeBySelector", "header", "header without content paragraphs")
    detach_all(found)


def is_hidden(node: Node) -> bool:
    style = node.get("style").lower()
    if style and any(f"{k}:{gap}{v}" in style for k, v in (("display", "none"), ("visibility", "hidden"), ("opacity", "0")) for gap in ("", " ")):
        return True
    if "hidden" in node.attrs or node.get("aria-hidden") == "true" or "inert" in node.attrs:
        return True
    names = node.classes
    if any(f"{w}:{k}" in c for c in names for w in ("sm", "md", "lg", "xl") for k in ("block", "flex")):
        return False
    return any(c in ("hidden", ":hidden", "invisible") for c in names)


def _is_code(n: Node) -> bool:
    return n.tag in ("pre", "code")


def _is_note_id(node: Node) -> bool:
    name = node.get("id")
    return name == "footnotes" or name.startswith("fn:")


def _is_note_list(n: Node) -> bool:
    css = n.get("class")
    return _is_note_id(n) or (n.tag in ("div", "section", "ol", "ul", "aside") and any(x in css for x in ("footnotes", "footnote-footer", "reflist")))


def _is_note_part(n: Node) -> bool:
    css = n.get("class")
    return _is_note_id(n) or any(x in css for x in ("footnote", "reflist", "references"))


def remove_hidden(root: Node, elements: list[Node], trace: Trace | None = None) -> None:
    around = _around(root)
    found = [n for n in elements if id(n) not in around and is_hidden(n)]
    for node in found:
        note(trace, node, "removeHiddenElements", None, "hidden element")
    detach_all(found)


def remove_partial(root: Node, elements: list[Node], trace: Trace | None = None, names: tuple[str, ...] = rules.PARTIAL_NAMES) -> None:
    around, found, pattern, view = _around(root), [], rules.partial_pattern(names), Forest().view
    top = view(root)
    for node in elements:
        if id(node) in around or not any(pattern.search(node.attrs[a].lower()) for a in rules.PARTIAL_ATTRIBUTES if a in node.attrs):
            continue
        v = view(node)
        if v.within(_is_code) or v.within(_is_note_list) or v.count("pre"):
            continue
        if v.inside(top) and scoring.is_article_metadata(v):
            continue
        found.append(node)
    for node in found:
        note(trace, node, "removeBySelector", None, "partial selector match")
    detach_all(found)


_SCORED = frozenset("div section article main aside header footer nav".split())


def remove_low_scoring(root: Node, elements: list[Node], trace: Trace | None = None) -> None:
    around, found, view = _around(root), [], Forest().view
    for node in reversed(elements):
        if node.tag not in _SCORED or node is root or id(node) in around:
            continue
        v = view(node)
        if v.within(_is_code) or v.within(_is_note_part) or scoring.is_likely_content(v):
            continue
        near = node.parent_element is not None and (node.parent is root or node.parent.parent_element is root)
        if near and scoring.is_article_metadata(v):
            continue
        value = scoring.clutter_score(v)
        if value < 0:
            note(trace, node, "scoreAndRemove", None, f"score: {value:.1f}")
            found.append(node)
    detach_all(found)


def remove_images(root: Node) -> None:
    detach_all(root.elements("img", "picture"))


def remove_small_images(root: Node) -> None:
    for node in root.elements("img"):
        w, h = (integer(node.attrs.get(x), (1 << 32) - 1) for x in ("width", "height"))
        src = node.attrs.get("src")
        if (w is not None and w < 33) or (h is not None and h < 33) or not src or src.startswith("data:image/gif"):
            node.detach()


def dedupe_images(root: Node) -> None:
    """Of images with the same alt text the best stays; the earlier wins ties."""
    best: dict[str, Node] = {}
    for node in root.elements("img"):
        alt = node.get("alt")
        if not alt:
            continue
        if alt not in best:
            best[alt] = node
        elif _quality(node) > _quality(best[alt]):
            best[alt].detach()
            best[alt] = node
        else:
            node.detach()


def _quality(node: Node) -> int:
    w, h = integer(node.attrs.get("width")), integer(node.attrs.get("height"))
    size = w * h if w and h else (w or 0) + (h or 0)
    return size + (10000 if "srcset" in node.attrs else 0) + len(node.get("src").encode())
