"""Title, author, dates, site and the other facts of a page, each from the first source that has it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..functions import jsonld, urls
from ..functions.css import select, select_one
from ..functions.dom import ELEMENT, Node, trim, words

#: Separators in titles, spellings of Dublin Core names, months.
SEPARATORS = (" | ", " - ", " -- ", " / ", " · ")
DUBLIN = ("DC.", "dc.", "dc:", "dcterm:", "DCTERMS.", "dcterms.")
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(MONTHS)
_TEXT_DATE = re.compile(rf"(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}")
_DATE_PLACES = ('li[id*="lastmod"]', 'li[id*="date"]', '[class*="dateline"]', "h2", "h3", "h6", '[class*="byline"]', '[class*="meta"]', "p", "span")
#: Where each field is looked for, best first.  ``p:`` property, ``n:`` name, ``h:``
#: http-equiv of a meta element, ``d:`` a Dublin Core name, ``s:`` a path in schema.org data.
SOURCES = {
    "title": "p:og:title n:twitter:title p:twitter:title s:headline d:title n:title n:sailthru.title n:parsely-title",
    "published": "s:datePublished n:publishDate p:article:published_time d:date n:DCTERMS.created n:DCTERMS.issued n:parsely-pub-date",
    "modified": "s:dateModified p:article:modified_time p:og:updated_time n:DCTERMS.modified n:dcterms.modified h:last-modified",
    "description": "n:description p:og:description d:description p:twitter:description n:twitter:description n:sailthru.description s:description",
    "image": "p:og:image p:twitter:image n:twitter:image n:twitter:image:src n:parsely-image-url n:thumbnail",
    "language": "n:content-language h:content-language d:language p:og:locale s:inLanguage",
    "keywords": "n:keywords d:subject n:news_keywords n:parsely-tags",
    "content_type": "p:og:type d:type",
    "site": "s:publisher.name p:og:site_name",
    "site_more": "s:sourceOrganization.name n:copyright s:copyrightHolder.name s:isPartOf.name d:publisher n:application-name",
    "author": "p:author n:author p:article:author p:article:author_name n:sailthru.author",
}


@dataclass
class Metadata:
    title: str | None = None
    description: str | None = None
    domain: str | None = None
    favicon: str | None = None
    image: str | None = None
    language: str | None = None
    published: str | None = None
    modified: str | None = None
    author: str | None = None
    site: str | None = None
    canonical_url: str | None = None
    content_type: str | None = None
    keywords: list[str] = field(default_factory=list)


def first(*sources: Callable[[], str | None]) -> str | None:
    return next((v for s in sources if (v := s()) is not None), None)


def _text(n: Node | None) -> str | None:
    return (trim(n.text()) or None) if n is not None else None


class Facts:
    """What the fields are made of: first meta element of each name, schema.org data, the document."""

    def __init__(self, doc: Node, schema: Any, url: str | None):
        self.doc, self.schema = doc, schema
        self.base = urls.parse(url) if url else None
        self.meta: dict[tuple[str, str], str] = {}
        for n in doc.elements("meta"):
            for attr in ("property", "name", "http-equiv"):
                if attr in n.attrs:
                    key = n.attrs[attr].lower() if attr == "http-equiv" else n.attrs[attr]
                    self.meta.setdefault((attr, key), trim(n.get("content")))

    def source(self, spec: str) -> str | None:
        kind, name = spec.split(":", 1)
        if kind == "s":
            return jsonld.text_at(self.schema, name)
        if kind == "d":
            return next((v for p in DUBLIN if (v := self.meta.get(("name", p + name)))), None)
        return self.meta.get(({"p": "property", "n": "name", "h": "http-equiv"}[kind], name)) or None

    def chain(self, field_name: str) -> str | None:
        return next((v for s in SOURCES[field_name].split() if (v := self.source(s)) is not None), None)

    def html_title(self) -> str | None:
        return _text(next(iter(self.doc.elements("title")), None))

    def absolute(self, href: str) -> str:
        if href.startswith(("http://", "https://")) or self.base is None:
            return href
        found = urls.parse(href, self.base)
        return href if found is None else str(found)


# -- title -------------------------------------------------------------


def _parts(title: str, separators: Iterable[str] = SEPARATORS) -> Iterable[tuple[str, str]]:
    """What stands before and after the last of each separator."""
    for sep in separators:
        before, found, after = title.rpartition(sep)
        if found and trim(before) and trim(after):
            yield trim(before), trim(after)


def _is_site(part: str, site: str) -> bool:
    if part in site or site in part:
        return True
    if " " in part:
        return False
    a, b = (words(part) or [""])[0], (words(site) or [""])[0]
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a.encode()) >= 4 and same >= 5


def without_site(title: str, site: str) -> str:
    site = site.lower()
    for before, after in _parts(title):
        left, right = _is_site(before.lower(), site), _is_site(after.lower(), site)
        if left and right:
            return before if len(before.encode()) >= len(after.encode()) else after
        if left or right:
            return after if left else before
    return title


def _without_crumb(title: str) -> str:
    return next((before for before, after in _parts(title) if "/" in after or len(words(after)) <= 3), title)


def clean_title(title: str, site: str, meta: str | None = None, html: str | None = None) -> str:
    """The title without its site's name."""
    if meta is not None and html is not None:
        if site:
            if meta == without_site(html, site) and (shorter := _without_crumb(meta)) != meta:
                return shorter
            return without_site(meta, site)
        if len(html.encode()) > len(meta.encode()) and html.startswith(meta):
            return meta
    return without_site(title, site) if site else title


def site_of_domain(domain: str) -> str:
    head, dot, rest = domain.partition(".")
    if domain.startswith("www."):
        domain = domain[4:]
    elif dot and re.fullmatch("[a-z]{2}", head):
        domain = rest
    name = domain.split(".")[0]
    return name[:1].upper() + name[1:]


def _title(f: Facts, site: str | None, domain: str | None) -> str | None:
    meta, html = f.chain("title"), f.html_title()
    title = meta or html
    if title is None:
        return None
    return clean_title(title, site if site is not None else site_of_domain(domain or ""), meta, html) or None


# -- author ------------------------------------------------------------


def _schema_names(value: Any) -> str | None:
    def name(v: Any) -> str:
        found = v.get("name") if isinstance(v, dict) else v
        return trim(found) if isinstance(found, str) else ""

    if isinstance(value, list):
        return ", ".join(x for v in value if (x := name(v))) or None
    return name(value) or None


def _schema_author(schema: Any) -> str | None:
    rows = (item["author"] for item in jsonld.each(schema) if isinstance(item, dict) and "author" in item)
    return next((v for r in rows if (v := _schema_names(r))), None)


def _citation(name: str | None) -> str | None:
    if name is None:
        return None
    last, comma, given = name.partition(",")
    return f"{trim(given)} {trim(last)}" if trim(last) and trim(given) else name


def _in_comments(n: Node) -> bool:
    return any(a.kind == ELEMENT and any(x in a.get("class").lower() for x in ("comment", "mention", "repli", "backlink")) for a in (n, *n.ancestors()))


def _marked_author(doc: Node) -> str | None:
    for selector in ('[rel="author"]', '[itemprop="author"]', ".author"):
        for n in select(doc, selector):
            text = trim(n.text())
            if text and len(words(text)) <= 6 and not _in_comments(n):
                return text
    return None


def _names(doc: Node, selector: str) -> str | None:
    return ", ".join([t for n in select(doc, selector) if (t := trim(n.text()))][:3]) or None


def clean_author(author: str) -> str:
    for sep in (" - ", " | ", " · "):
        before, found, after = author.partition(sep)
        if found and trim(after).startswith(("http://", "https://")):
            author = trim(before)
    return "" if author.startswith(("http://", "https://")) else author


def _author(f: Facts) -> str | None:
    found = first(
        lambda: f.chain("author"),
        lambda: _schema_author(f.schema),
        lambda: f.source("n:byl"),
        lambda: f.source("n:authorList"),
        lambda: _citation(f.source("n:citation_author")),
        lambda: f.source("d:creator"),
        lambda: f.source("n:parsely-author"),
        lambda: _text(select_one(f.doc, '[itemprop="author"]')),
        lambda: _marked_author(f.doc),
        lambda: _names(f.doc, '[href*="/author/"]'),
        lambda: _names(f.doc, ".authors a"),
    )
    return (clean_author(found) or None) if found is not None else None


# -- dates -------------------------------------------------------------


def iso_date(text: str) -> str | None:
    """``YYYY-MM-DD``, ``Month D, YYYY`` or ``D Month YYYY`` as ``YYYY-MM-DD``; plausible numbers only."""
    if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text):
        year, month, day = map(int, m.groups())
        return text if 1900 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= 31 else None
    m = re.match(rf"(?:({_MONTH})\s*,?\s*(\d{{1,2}}),?\s+(\d{{4}})|(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}}))", text)
    if not m:
        return None
    month, day, year = (m[1], int(m[2]), int(m[3])) if m[1] else (m[5], int(m[4]), int(m[6]))
    return f"{year}-{MONTHS.index(month) + 1:02}-{day:02}" if 1 <= day <= 31 and 1900 <= year <= 2100 else None


def _time_element(doc: Node) -> str | None:
    row = doc.elements("time")[:5]
    return next((t for t in [trim(n.get("datetime")) for n in row] + [trim(n.text()) for n in row] if t), None)


def _date_in_text(doc: Node) -> str | None:
    for selector in _DATE_PLACES:
        for n in select(doc, selector)[:20]:
            text = trim(n.text())
            if len(text.encode()) <= 300 and (m := _TEXT_DATE.search(text)):
                return iso_date(m[0])
    return None


def _published(f: Facts) -> str | None:
    abbr = select_one(f.doc, 'abbr[itemprop="datePublished"]')
    relative = select_one(f.doc, "relative-time[datetime]")
    return first(
        lambda: f.chain("published"),
        lambda: (trim(abbr.get("datetime")) or _text(abbr)) if abbr is not None else None,
        lambda: f.source("n:sailthru.date"),
        lambda: _time_element(f.doc),
        lambda: (trim(relative.get("datetime")) or None) if relative is not None else None,
        lambda: _date_in_text(f.doc),
    )


# -- the rest ----------------------------------------------------------


def _graph_site(schema: Any) -> str | None:
    for item in jsonld.each(schema):
        graph = item.get("@graph") if isinstance(item, dict) else None
        for node in graph if isinstance(graph, list) else ():
            kind = node.get("@type") if isinstance(node, dict) else None
            if (kind == "WebSite" or isinstance(kind, list) and "WebSite" in kind) and isinstance(node.get("name"), str) and trim(node["name"]):
                return trim(node["name"])
    return None


def _site_in_title(title: str | None) -> str | None:
    for before, after in _parts(title or "", (" | ", " - ")):
        if len(words(after)) <= 4 and len(words(before)) >= 2 and len(before.encode()) >= len(after.encode()):
            return after
    return None


def _site(f: Facts, author: str | None) -> str | None:
    by = author if author is not None and len(words(author)) <= 4 and "," not in author and "http" not in author else None
    found = first(lambda: f.chain("site"), lambda: _graph_site(f.schema), lambda: f.chain("site_more"), lambda: by, lambda: _site_in_title(f.html_title()))
    return found if found is not None and len(words(found)) <= 6 else None


def _schema_image(value: Any) -> str | None:
    if isinstance(value, list):
        return next((v for x in value if (v := _schema_image(x))), None)
    found = value.get("url") if isinstance(value, dict) else value
    return (trim(found) or None) if isinstance(found, str) else None


def _schema_type(schema: Any) -> str | None:
    if isinstance(schema, dict):
        return schema["@type"] if isinstance(schema.get("@type"), str) else None
    kinds = (item.get("@type") for item in schema or () if isinstance(item, dict))
    return next((k for k in kinds if isinstance(k, str) and k not in ("WebSite", "WebPage", "BreadcrumbList")), None)


def _icon(f: Facts, rel: str) -> str | None:
    link = select_one(f.doc, f'link[rel="{rel}"]')
    href = trim(link.get("href")) if link is not None else ""
    return f.absolute(href) if href else None


def _favicon(f: Facts) -> str | None:
    def fallback() -> str | None:
        if f.base is None or not f.base.hostname:
            return None
        port = f":{f.base.port}" if f.base.port else ""
        return f"{f.base.scheme}://{f.base.hostname}{port}/favicon.ico"

    return first(lambda: f.source("p:og:image:favicon"), lambda: _icon(f, "icon"), lambda: _icon(f, "shortcut icon"), fallback)


def _keywords(f: Facts) -> list[str]:
    raw = f.chain("keywords")
    rows = raw.split(",") if raw is not None else [n.get("content") for n in select(f.doc, 'meta[property="article:tag"]')]
    return [t for r in rows if (t := trim(r))]


def extract_metadata(doc: Node, url: str | None, schema: Any) -> Metadata:
    f = Facts(doc, schema, url)
    author = _author(f)
    site = _site(f, author)
    domain = f.base.hostname or None if f.base is not None else None
    page = next(iter(doc.elements("html")), None)
    lang = first(lambda: (trim(page.get("lang")) or None) if page is not None else None, lambda: f.chain("language"))
    canonical = select_one(doc, 'link[rel="canonical"]')
    own = first(lambda: (trim(canonical.get("href")) or None) if canonical is not None else None, lambda: f.source("p:og:url"))
    image = schema.get("image") if isinstance(schema, dict) else None
    return Metadata(
        title=_title(f, site, domain),
        description=f.chain("description"),
        domain=domain,
        favicon=_favicon(f),
        image=first(lambda: f.chain("image"), lambda: _schema_image(image)),
        language=lang.replace("_", "-") if lang is not None else None,
        published=_published(f),
        modified=f.chain("modified"),
        author=author,
        site=site,
        canonical_url=f.absolute(own) if own is not None else None,
        content_type=first(lambda: f.chain("content_type"), lambda: _schema_type(schema)),
        keywords=_keywords(f),
    )


def meta_tags(doc: Node) -> list[dict[str, str | None]]:
    return [{k: n.attrs.get(k) for k in ("name", "property", "content")} for n in doc.elements("meta")]
