"""Footnotes of many kinds brought into one form.

Finders collect notes (number, key that references use, HTML).  Then references in the
text become ``sup#fnref:N > a[href="#fn:N"]``, what held the notes goes, and
``div#footnotes`` with ``div.footnote#fn:N`` is appended to the root.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..functions.css import select, select_one
from ..functions.dom import ELEMENT, TEXT, WHITE, Node, element, inner_html, outer_html, trim
from ..functions.htmlparse import parse_fragment
from ..functions.text import integer
from . import rules

#: Signs and wording of notes.
ARROWS = "↩↥↑↵⤴⤵⏎︎️"
_ARROW_LINK = re.compile(rf"<a\s[^>]*>\s*[{ARROWS}]+\s*</a>")
_CLASS_LINK = re.compile(r'<a\s[^>]*class="[^"]*footnote-backref[^"]*"[^>]*>[^<]*</a>')
_WORD_LINK = re.compile(r'<sup>\s*<a\s[^>]*href="[^"]*#_ftnref\d+"[^>]*>[^<]*</a>\s*</sup>')
_LEADING_LINK = re.compile(r"\s*(?:<a\s[^>]*>)?\s*\[?\d+\]?\s*(?:</a>)?\s*")
_MARKER = re.compile(r"\s*<(?:sup|strong)>[^<]*</(?:sup|strong)>\s*")
_SECTION = re.compile(r"(?i)(?:foot\s*notes?|end\s*notes?|notes?|references?)")
_LINK_NUMBER = re.compile(r"[\[(]?(\d{1,4})[\])]?")
_GENERIC_NUMBER = re.compile(r"\[?\(?\d{1,4}\)?\]?")
_SIDENOTES = "span.footnote-container, span.sidenote-container, span.inline-footnote"


@dataclass
class Notes:
    """Notes by number: (key, HTML); and the elements that go once references are set."""

    root: Node
    found: dict[int, tuple[str, str]] = field(default_factory=dict)
    holders: list[Node] = field(default_factory=list)

    def add(self, key: str, content: str, number: int | None = None) -> None:
        self.found[len(self.found) + 1 if number is None else number] = (key, content)


def without_backlinks(content: str) -> str:
    """HTML of a note without links back to the text and what they leave at its end."""
    for pattern in (_ARROW_LINK, _CLASS_LINK, _WORD_LINK):
        content = pattern.sub("", content)
    content = content.rstrip(WHITE + ",;")
    if content.startswith("<a") and "ftnt_ref" in content:
        content = content[_LEADING_LINK.match(content).end() :]
    return trim(content)


def _fragment(href: str) -> str:
    return href.rpartition("#")[2].lower()


def _reference(number: int, name: str) -> Node:
    return element("sup", {"id": name}, element("a", {"href": f"#fn:{number}"}, str(number)))


# -- finders -----------------------------------------------------------


def _sidenotes(notes: Notes) -> None:
    holders = select(notes.root, _SIDENOTES)
    if not holders:  # they repeat what a list of notes says
        for n in select(notes.root, "span.sidenote"):
            n.detach()
    number = len(notes.found) + 1
    for holder in holders:
        body = select_one(holder, "span.footnote, span.sidenote, span.footnoteContent")
        content = inner_html(body) if body is not None else ""
        if trim(content):
            notes.add(str(number), content, number)
            holder.replace(_reference(number, f"fnref:{number}"))
            number += 1


def _item_key(item: Node) -> str:
    key = item.get("id").lower()
    for prefix in ("fn:", "fn"):
        if key.startswith(prefix):
            return key[len(prefix) :]
    if "cite_note-" in key:
        return key.split("cite_note-")[1]
    if "data-counter" in item.attrs:
        return item.get("data-counter").rstrip(".").lower()
    return key


def _items(holder: Node) -> Iterator[tuple[str, Node]]:
    """(key, element with the content) of the notes in a list."""
    definitions = select(holder, "div.footnote-definition")
    for d in definitions:
        mark, body = select_one(d, "sup[id]"), select_one(d, ".footnote-body")
        if mark is not None and body is not None:
            yield mark.get("id").lower(), body
    if not definitions:
        for item in select(holder, 'li, div[role="listitem"]'):
            yield _item_key(item), item


def _wraps_notes(n: Node | None) -> bool:
    return n is not None and n.tag in ("section", "div") and ("footnote" in n.get("class") or any(r in n.get("role") for r in ("doc-endnotes", "doc-footnotes")))


def _lists(notes: Notes) -> None:
    seen: set[str] = set()
    number = len(notes.found) + 1
    for selector in rules.FOOTNOTE_LISTS:
        for holder in select(notes.root, selector):
            for key, body in _items(holder):
                if key and key not in seen:
                    seen.add(key)
                    notes.add(key, without_backlinks(inner_html(body)), number)
                    number += 1
            notes.holders.append(holder)
    notes.holders += [n.parent for n in list(notes.holders) if n.parent is not notes.root and _wraps_notes(n.parent_element)]


def _asides(notes: Notes) -> None:
    for ol in select(notes.root, "aside > ol[start]"):
        start = integer(ol.get("start"))
        items = ol.elements("li")
        if start and items:
            content = inner_html(items[0]) if len(items) == 1 else "".join(f"<p>{inner_html(i)}</p>" for i in items)
            notes.add(str(start), without_backlinks(content), start)
            notes.holders.append(ol.parent)


def _word(notes: Notes) -> None:
    links = select(notes.root, 'a[href*="#_ftnref"]')
    for link in links if len(links) >= 2 else []:
        m = re.fullmatch(r"_ftnref(\d+)", link.get("href").rpartition("#")[2])
        holder = link.parent_element
        while holder is not None and holder is not notes.root and holder.tag not in ("p", "div", "li"):
            holder = holder.parent_element
        number = integer(m[1]) if m else None
        if number is not None and holder is not None and holder is not notes.root:
            notes.add(f"_ftn{number}", without_backlinks(inner_html(holder)), number)
            notes.holders.append(holder)


def _is_only_child(n: Node) -> bool:
    up = n.parent_element
    return up is not None and up.tag == "div" and len(up.child_elements()) == 1


def _note_heading(first: Node) -> list[Node]:
    """The heading "Footnotes" or the like before the first note."""
    at = first.parent if _is_only_child(first) else first
    before = at.sibling(-1)
    if before is not None and len(before.tag) == 2 and before.tag[0] == "h" and _SECTION.fullmatch(trim(before.text())):
        return [before]
    return []


def _google_docs(notes: Notes) -> None:
    named = [(integer(m[1]), p) for p in select(notes.root, 'p[id^="ftnt"]') if (m := re.fullmatch(r"ftnt(\d+)", p.get("id")))]
    pairs = [(number, p) for number, p in named if number is not None]
    if len(pairs) < 2:
        return
    pairs.sort(key=lambda x: x[0])
    for number, p in pairs:
        notes.add(f"ftnt{number}", without_backlinks(inner_html(p)))
        notes.holders.append(p)
        if _is_only_child(p):
            notes.holders.append(p.parent)
    notes.holders += _note_heading(pairs[0][1])


def _targets(holder: Node, fragments: set[str]) -> list[tuple[Node, str]]:
    """Elements below that links of the text lead to, each key once."""
    out: dict[str, Node] = {}
    for n in holder.elements("li", "p", "div"):
        key = n.get("id").lower()
        if not key:
            a = next((a for a in n.elements("a") if a.get("id") or a.get("name")), None)
            key = (a.get("id") or a.get("name")).lower() if a is not None else ""
        if key and key in fragments:
            out.setdefault(key, n)
    return [(n, key) for key, n in out.items()]


def _generic(notes: Notes) -> None:
    links: dict[str, list[Node]] = {}
    for a in select(notes.root, 'a[href*="#"]'):
        key = _fragment(a.get("href"))
        if key and _GENERIC_NUMBER.fullmatch(trim(a.text())):
            links.setdefault(key, []).append(a)
    if len(links) < 2:
        return
    best, most = None, 2
    for holder in notes.root.elements("div", "section", "aside", "footer", "ol", "ul"):
        n = len(_targets(holder, set(links)))
        if n >= most:
            best, most = holder, n
    if best is None:
        return
    ordered = _targets(best, set(links))
    outside = [key for key, row in links.items() if not any(a.inside(best) for a in row)]
    hits = len(set(outside) & {key for _, key in ordered})
    if hits < max(2, -(-len(outside) * 3 // 4)):
        return
    for n, key in ordered:
        content = inner_html(n)
        name = re.escape(key)
        content = re.sub(rf'<a\s[^>]*id="{name}"[^>]*>(?:\d+[.)\s]*)?</a>', "", content, count=1)
        content = re.sub(rf'<a\s[^>]*name="{name}"[^>]*>[^<]*</a>', "", content, count=1)
        content = re.sub(r"\A\s*\d+\.\s*", "", content)
        notes.add(key, without_backlinks(content))
    notes.holders.append(best)


def _number_of(n: Node) -> int | None:
    """Number of a paragraph that starts with a numbered sup or strong element."""
    first = next(iter(n.child_elements()), None)
    if first is None or first.tag not in ("sup", "strong"):
        return None
    text = trim(first.text())
    return integer(text) if text[:1] not in ("0", "+") else None


def _confirmed(root: Node, rows: list[tuple[int, Node]]) -> bool:
    """Two or more of the numbers stand in the text as sup elements without links."""
    numbers, hits = {str(n) for n, _ in rows}, set()
    for sup in root.elements("sup"):
        text = trim(sup.text())
        if text in numbers and not sup.elements("a") and not any(sup.inside(p) for _, p in rows):
            hits.add(text)
    return len(hits) >= 2


def _last_row(root: Node) -> list[Node]:
    """The children among which the last paragraph is."""
    last = root.elements("p")[-1:]
    return ((last[0].parent_element or root) if last else root).child_elements()


def _loose_rows(root: Node) -> tuple[list[tuple[int, Node]], list[Node]]:
    row = _last_row(root)
    line = max((k for k, n in enumerate(row) if n.tag == "hr"), default=None)
    if line is not None:
        found = [(x, n) for n in row[line + 1 :] if (x := _number_of(n)) is not None]
        if len(found) >= 2 and _confirmed(root, found):
            return found, row[line:]
    found, first = [], len(row)
    for k in range(len(row) - 1, -1, -1):
        if row[k].tag == "p" and (x := _number_of(row[k])) is not None:
            found.insert(0, (x, row[k]))
            first = k
        elif row[k].tag not in ("ul", "ol", "blockquote"):
            break
    if len(found) >= 2 and _confirmed(root, found):
        return found, row[first:] + _note_heading(found[0][1])
    return [], []


def _unmarked(n: Node) -> str:
    content = inner_html(n)
    m = _MARKER.match(content)
    return content[m.end() :] if m else content


def _loose(notes: Notes) -> None:
    found, gone = _loose_rows(notes.root)
    stops = [n for _, n in found]
    for k, (number, n) in enumerate(found):
        content, after = _unmarked(n), n.sibling(1)
        while after is not None and (k + 1 >= len(stops) or after is not stops[k + 1]):
            content += outer_html(after)
            after = after.sibling(1)
        notes.add(str(number), without_backlinks(content))
    notes.holders += gone


def _by_class(notes: Notes) -> None:
    for p in select(notes.root, "p.footnote"):
        if (number := _number_of(p)) is not None:
            notes.add(str(number), without_backlinks(_unmarked(p)))
            notes.holders.append(p)


#: These always run; of the others, the first that finds notes ends the search.
ALWAYS: tuple[Callable[[Notes], None], ...] = (_sidenotes, _lists, _asides)
ELSE: tuple[Callable[[Notes], None], ...] = (_word, _google_docs, _generic, _loose, _by_class)


# -- references --------------------------------------------------------


class _References:
    def __init__(self, notes: Notes):
        self.root = notes.root
        self.by_key = {key.lower(): n for n, (key, _) in notes.found.items()}
        self.numbers = set(notes.found)
        self.used: dict[int, int] = {}

    def put(self, at: Node, number: int) -> None:
        count = self.used[number] = self.used.get(number, 0) + 1
        if at.parent is not None:
            at.replace(_reference(number, f"fnref:{number}" if count == 1 else f"fnref:{number}-{count}"))

    def number(self, ref: Node) -> int | None:
        href = ref.attrs.get("href")
        if href is None:
            link = next(iter(ref.elements("a")), None)
            href = link.attrs.get("href") if link is not None else None
        keys = []
        if href is not None and (key := _fragment(href)):
            keys = [key, *key.split("cite_note-")[1:2], *(key[len(p) :] for p in ("fn:", "fn") if key.startswith(p))]
        name = ref.get("id")
        keys += [name[len(p) :].lower() for p in ("fnref:", "fnref") if name.startswith(p)]
        found = next((self.by_key[k] for k in keys if k in self.by_key), None)
        if found is not None:
            return found
        text = trim(ref.text()).strip("[]()")
        number = integer(text)
        return number if number in self.numbers and str(number) == text else None


def _is_set(n: Node) -> bool:
    up = n.parent_element
    return n.get("id").startswith("fnref:") or (up is not None and up.get("id").startswith("fnref:"))


def _among_notes(n: Node) -> bool:
    for a in n.ancestors():
        css = a.get("class")
        if a.get("id").startswith("fnref:") or a.get("id") == "footnotes" or any(x in css for x in ("footnote", "reflist", "references")):
            return True
    return False


def _outermost(n: Node) -> Node:
    """The outermost span or sup around a reference that holds nothing else."""
    while (up := n.parent_element) is not None and up.tag in ("span", "sup"):
        if up.tag == "span" and any(c is not n and ((c.kind == TEXT and trim(c.data)) or (c.kind == ELEMENT and c.tag != "sup")) for c in up.children):
            break
        n = up
    return n


def _set_references(notes: Notes) -> None:
    refs, root = _References(notes), notes.root
    for selector in rules.FOOTNOTE_REFS:
        for n in select(root, selector):
            if not _is_set(n) and trim(n.text()) and (number := refs.number(n)) is not None:
                refs.put(_outermost(n), number)
    for n in select(root, 'sup[id^="ftnt_ref"]'):
        if (number := refs.by_key.get("ftnt" + n.get("id")[8:].lower())) is not None:
            refs.put(n, number)
    free = {key.lower(): n for n, (key, _) in notes.found.items() if n not in refs.used}
    for a in select(root, 'a[href*="#"]') if free else []:
        number = free.get(_fragment(a.get("href")))
        if number is not None and _LINK_NUMBER.fullmatch(trim(a.text())) and not _among_notes(a):
            refs.put(_outermost(a), number)
    open_numbers = {n for n in notes.found if n not in refs.used}
    for n in select(root, "sup, span.footnote-ref") if open_numbers else []:
        m = _LINK_NUMBER.fullmatch(trim(n.text()))
        number = integer(m[1]) if m else None
        if number in open_numbers and not n.get("id").startswith("fnref:") and not _among_notes(n):
            refs.put(_outermost(n), number)


def _note_list(found: dict[int, tuple[str, str]]) -> Node:
    holder = element("div", {"id": "footnotes"})
    for number in sorted(found):
        item = element("div", {"class": "footnote", "id": f"fn:{number}"})
        content = found[number][1]
        if trim(content):
            first = next(iter(parse_fragment(f"<div>{content}</div>").elements("div")))
            for child in list(first.children):
                item.append(child)
        holder.append(item)
    return holder


def standardize_footnotes(root: Node) -> None:
    notes = Notes(root)
    for find in ALWAYS:
        find(notes)
    for find in ELSE:
        if not notes.found:
            find(notes)
    if not notes.found:
        return
    _set_references(notes)
    for n in notes.holders:
        n.detach()
    for n in reversed(_last_row(root)):
        if n.tag != "hr":
            break
        n.detach()
    root.append(_note_list(notes.found))


