"""Unsafe parts go, attributes are cut to an allow-list, structure is tidied, URLs become absolute."""

from __future__ import annotations

import re

from ..functions import urls
from ..functions.dom import Node, detach_all, inner_html, trim, words
from ..functions.htmlparse import parse_fragment
from ..functions.index import Forest

#: Attributes that stay, elements that may be empty, and what is unsafe.
ATTRIBUTES = frozenset(
    """accent accentunder align alt allow allowfullscreen aria-label checked class colspan columnalign columnlines columnspacing
    columnspan controls data-callout data-callout-fold data-callout-title data-lang data-latex data-mjx-texclass data-src data-srcset
    depth dir display displaystyle fence frame frameborder framespacing headers height href id kind label lang linethickness lspace
    mathsize mathvariant maxsize minsize movablelimits notation poster role rowalign rowlines rowspacing rowspan rspace scriptlevel
    separator src srclang srcset stretchy symmetric title type voffset width xmlns""".split()
)
MAY_BE_EMPTY = frozenset(
    """area audio base br circle col defs ellipse embed figure g hr iframe img input line link mask meta object param path pattern
    picture polygon polyline rect source stop svg td th track use video wbr""".split()
)
SVG_PARTS = frozenset(
    """svg path circle rect line polygon polyline g defs use mask ellipse stop pattern text tspan clippath lineargradient
    radialgradient filter fegaussianblur feoffset feblend marker symbol image foreignobject desc metadata style""".split()
)
UNSAFE = ("frame", "frameset", "object", "embed", "applet", "base")
URL_ATTRIBUTES = frozenset(("href", "src", "action", "formaction"))
SAFE_DATA = frozenset(("image/png", "image/jpeg", "image/gif", "image/webp", "image/avif"))
BLOCKS = frozenset("article section div main p blockquote figure table ul ol dl h1 h2 h3 h4 h5 h6".split())
RESOLVED = (("a", "href"), ("img", "src"), ("img", "srcset"), ("video", "poster"), ("source", "src"), ("source", "srcset"), ("iframe", "src"))


def is_unsafe_uri(value: str) -> bool:
    value = trim(value.lower())
    if value.startswith("data:"):
        return trim(trim(value[5:].split(",")[0]).split(";")[0]) not in SAFE_DATA
    return value.startswith("javascript:")


def srcset_parts(value: str) -> list[str]:
    """Candidates of a srcset; commas inside a data URI do not part them."""
    out, start = [], 0
    for m in re.finditer(",", value):
        part = trim(value[start : m.start()])
        row = words(part)
        if row and row[0].startswith("data:") and not (len(row) > 1 and row[-1].endswith(("x", "w"))):
            continue
        out.append(value[start : m.start()])
        start = m.end()
    return out + ([value[start:]] if start < len(value) else [])


def _is_svg(n: Node) -> bool:
    return n.tag == "svg"


def remove_unsafe(doc: Node) -> None:
    detach_all(doc.elements(*UNSAFE))
    view = Forest().view
    for n in doc.elements():
        if n.tag == "style" and view(n).above(_is_svg):
            continue
        for name in list(n.attrs):
            if name.startswith("on") or name == "srcdoc" or (name in URL_ATTRIBUTES and is_unsafe_uri(n.attrs[name])):
                del n.attrs[name]
            elif name in ("srcset", "data-srcset"):
                n.attrs[name] = ",".join(p for p in srcset_parts(n.attrs[name]) if not is_unsafe_uri((words(p) or [""])[0]))


def clean_attributes(root: Node) -> None:
    view = Forest().view
    for n in root.elements():
        if n.tag not in SVG_PARTS and not view(n).above(_is_svg):
            n.attrs = {k: v for k, v in n.attrs.items() if k in ATTRIBUTES}


def _is_empty(n: Node) -> bool:
    if n.tag in MAY_BE_EMPTY:
        return False
    if not n.children:
        return True
    row = n.child_elements()
    return n.tag == "p" and bool(row) and all(c.tag == "br" for c in row) and not trim(n.text())


def standardize_content(root: Node) -> None:
    detach_all(root.elements("wbr"))
    clean_attributes(root)
    detach_all([n for n in root.elements() if _is_empty(n)])
    for n in root.elements("h1")[1:]:
        n.tag = "h2"
    _unwrap_divs(root)


def _unwrap_divs(root: Node) -> None:
    """A div around one block and nothing else goes."""
    found, view = [], Forest().view
    for n in root.elements("div"):
        row = n.child_elements()
        if n.get("id") == "footnotes" or n.get("id").startswith("fn:") or len(row) != 1 or row[0].tag not in BLOCKS:
            continue
        if view(n).size == view(row[0]).size:
            found.append(n)
    for n in reversed(found):
        n.unwrap()


def _absolute(value: str, base: urls.Url) -> str:
    found = urls.parse(value, base)
    return value if found is None else str(found)


def _absolute_srcset(value: str, base: urls.Url) -> str:
    out = []
    for part in srcset_parts(value):
        row = words(part)
        if row and not is_unsafe_uri(row[0]):
            head = row[0] if row[0].startswith(("http://", "https://")) else _absolute(row[0], base)
            out.append(" ".join([head, *row[1:]]))
    return ", ".join(out)


def resolve_urls(doc: Node, root: Node, url: str) -> None:
    base = urls.parse(url)
    if base is None:
        hrefs = (urls.parse(n.get("href")) for n in doc.elements("base") if "href" in n.attrs)
        base = next((b for b in hrefs if b is not None), None)
    if base is None:
        return
    for tag, name in RESOLVED:
        for n in root.elements(tag):
            if name not in n.attrs:
                continue
            value = n.attrs[name]
            if name == "srcset":
                n.set(name, _absolute_srcset(value, base))
            elif not value.startswith(("http://", "https://", "//")) and (found := urls.parse(value, base)) is not None:
                n.set(name, str(found))


def sanitize(html: str, url: str | None = None, attributes: bool = True) -> str:
    """A fragment without unsafe parts; with ``attributes`` cut to the allow-list and URLs absolute."""
    doc = parse_fragment(html)
    remove_unsafe(doc)
    if attributes:
        if url:
            resolve_urls(doc, doc, url)
        clean_attributes(doc)
    return inner_html(doc)


