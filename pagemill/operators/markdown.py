"""HTML to Markdown: ATX headings, ``*`` bullets, fenced code, pipe tables, ``[^N]`` footnotes."""

from __future__ import annotations

import re

from ..functions.dom import ELEMENT, TEXT, Node, trim
from ..functions.htmlparse import parse_document
from ..functions.index import Forest
from ..functions.text import integer

#: Elements that stand on lines of their own.
BLOCKS = frozenset(
    """address article aside blockquote body canvas center details dialog dir div dl dt dd fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe li main menu nav noframes noscript ol output p pre section table
    tbody td tfoot th thead tr ul video audio""".split()
)
#: Elements that leave nothing.
DROPPED = frozenset("head script style".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_AT_START = re.compile(r"(?:(\d+)(\.)(?=\s)|(-|\+ |=+|#{1,6} |~~~|>))")


def _escape(text: str, at_start: bool = True) -> str:
    """Marks that Markdown would read, behind a backslash; some only where a text starts."""
    m = _AT_START.match(text) if at_start else None
    text = re.sub(r"([\\*_`\[\]])", r"\\\1", text)
    if m:
        text = f"{m[1]}\\{text[m.start(2) :]}" if m[1] else "\\" + text
    return re.sub(r"<(?=[A-Za-z/!?])", r"\<", text)


def _join(left: str, right: str) -> str:
    """Parts meet with the larger of their line ends, two at most."""
    a, b = left.rstrip("\n"), right.lstrip("\n")
    return a + "\n" * min(2, max(len(left) - len(a), len(right) - len(b))) + b


def _indent(text: str, by: str) -> str:
    return "\n".join(by + line if line else line for line in text.split("\n"))


def _fence(text: str, least: int) -> str:
    runs = [len(m) for m in re.findall("`+", text)]
    return "`" * max(least, max(runs, default=0) + 1)


def _is_code(n: Node) -> bool:
    return n.tag in ("code", "pre")


def _is_pre(n: Node) -> bool:
    return n.tag == "pre"


def _is_math(n: Node) -> bool:
    return n.tag == "math"


class Converter:
    def __init__(self):
        self.view = Forest().view  # the tree stays as it is
        self.listed: tuple[Node | None, dict[int, int]] = None, {}  # the last ordered list and the places of its items

    def children(self, n: Node) -> str:
        if n.tag == "code" or self.view(n).above(_is_code):
            return "".join(map(self.node, n.children))
        out = ""
        for k, c in enumerate(n.children):
            if c.kind == TEXT and not c.data.strip(" \t\n\r\f") and n.tag in BLOCKS and n.tag != "p" and self.ends_line(n.children[k + 1 :]):
                out = out.removesuffix(" ")
                continue
            part = self.node(c)
            if c.tag == "br" and out.removesuffix(" ").endswith("  \n"):  # one of several
                out = out.removesuffix(" ") + part
                continue
            if not part:
                continue
            if part == " " and ((not out and n.tag in BLOCKS) or out.endswith(("\n\n", " "))):
                continue
            if not out and c.kind == TEXT and n.tag in BLOCKS:
                part = part.lstrip(" ")
            if out.endswith(" ") or (out.endswith("\n") and not out.endswith("  \n")) and c.kind == TEXT:
                part = part.lstrip(" ")
            if part.startswith("\n"):
                out = out.rstrip(" ") if out.rstrip(" ").endswith("\n") or not out.strip(" ") else out
            out = _join(out, part)
        return out

    @staticmethod
    def ends_line(after: list[Node]) -> bool:
        """Nothing that shows stands before the next block."""
        n = next((x for x in after if x.kind == ELEMENT or (x.kind == TEXT and trim(x.data))), None)
        return n is not None and n.kind == ELEMENT and n.tag in BLOCKS

    def node(self, n: Node) -> str:
        if n.kind == TEXT:
            return self.text(n)
        if n.kind != ELEMENT or n.tag in DROPPED:
            return ""
        handler = getattr(self, "_" + n.tag.replace("-", "_"), None)
        return handler(n) if handler else self.plain(n)

    def text(self, n: Node) -> str:
        up = self.view(n.parent)
        if up.within(_is_code):
            return n.data
        return _escape(_SPACE.sub(" ", n.data), at_start=not up.within(_is_math))

    def block(self, n: Node) -> str:
        content = self.lines(n)
        return f"\n\n{content}\n\n" if content.strip() else ""

    def plain(self, n: Node) -> str:
        return self.block(n) if n.tag in BLOCKS else self.children(n)

    def lines(self, n: Node) -> str:
        """Content of a block without the line ends around it."""
        return self.children(n).strip("\n")

    _p = block

    def heading(self, n: Node) -> str:
        content = trim(self.children(n).replace("\n", " "))
        return f"\n\n{'#' * int(n.tag[1])} {content}\n\n" if content else ""

    _h1 = _h2 = _h3 = _h4 = _h5 = _h6 = heading

    def _hr(self, n: Node) -> str:
        return "\n\n* * *\n\n"

    def _br(self, n: Node) -> str:
        return "  \n"

    def wrapped(self, n: Node, mark: str) -> str:
        content = self.children(n)
        inner = content.strip()
        if not inner:
            return content
        lead, tail = content[: len(content) - len(content.lstrip())], content[len(content.rstrip()) :]
        return f"{lead}{mark}{inner}{mark}{tail}"

    def _strong(self, n: Node) -> str:
        return self.wrapped(n, "**")

    def _em(self, n: Node) -> str:
        return self.wrapped(n, "*")

    _b, _i = _strong, _em

    def _code(self, n: Node) -> str:
        content = self.children(n)
        if self.view(n).above(_is_pre):
            return content
        content = content.strip()
        if not content:
            return ""
        fenced = re.fullmatch(r"```\w*\n(.*)\n```", content, re.S)
        if fenced:
            return f"\n\n````\n{fenced[1]}\n````\n\n"
        ticks = _fence(content, 1)
        gap = " " if content[0] == "`" or content[-1] == "`" else ""
        return f"{ticks}{gap}{content}{gap}{ticks}"

    def _pre(self, n: Node) -> str:
        content = self.children(n).strip("\n")
        code = next(iter(n.elements("code")), None)
        lang = next((c[9:] for c in code.classes if c.startswith("language-")), "") if code is not None else ""
        ticks = _fence(content, 3) if "```" in content else "```"
        return f"\n\n{ticks}{lang}\n{content}\n{ticks}\n\n"

    def _blockquote(self, n: Node) -> str:
        content = self.children(n).strip("\n").strip(" ")
        if not content:
            return ""
        quoted = "\n".join("> " + line for line in content.split("\n"))
        return f"\n\n{quoted}\n\n"

    def _ul(self, n: Node) -> str:
        content = self.children(n).strip("\n")
        if not content.strip():
            return ""
        nested = n.parent_element is not None and n.parent_element.tag == "li"
        return f"\n{content}\n" if nested else f"\n\n{content}\n\n"

    _ol = _menu = _ul

    def _li(self, n: Node) -> str:
        content = self.children(n).strip("\n").strip(" ")
        up = n.parent_element
        if up is not None and up.tag == "ol":
            start = up.get("start")
            if up is not self.listed[0]:
                self.listed = up, {id(c): k for k, c in enumerate(c for c in up.child_elements() if c.tag == "li")}
            first = integer(start.removeprefix("-")) if "+" not in start else None
            number = (1 if first is None else -first if start[0] == "-" else first) + self.listed[1][id(n)]
            mark = f"{number}.  "
        else:
            mark = "*   "
        body = _indent(content, " " * len(mark)).lstrip(" ") if content else ""
        return f"\n{mark}{body}\n"

    def _img(self, n: Node) -> str:
        src = n.attrs.get("src")
        if src is None:
            return ""
        alt, title = _SPACE.sub(" ", n.get("alt")), n.get("title")
        return f"![{alt}]({_target(src)}{_title(title)})"

    def _a(self, n: Node) -> str:
        if "footnote-backref" in n.get("class"):
            return ""
        content, href = self.children(n), n.attrs.get("href")
        if href is None:
            return content
        inner = content.strip("\n")
        lead, tail = inner[: len(inner) - len(inner.lstrip(" "))], inner[len(inner.rstrip(" ")) :]
        inner = inner.strip(" ")
        before, after = content[: len(content) - len(content.lstrip("\n"))], content[len(content.rstrip("\n")) :]
        if not inner:
            return f"[]({_target(href)}{_title(n.get('title'))})"
        return f"{before}{lead}[{inner}]({_target(href)}{_title(n.get('title'))}){tail}{after}"

    def _iframe(self, n: Node) -> str:
        src = n.attrs.get("src")
        if src is None:
            return ""
        return f"\n![]({src.replace('/embed/', '/watch?v=') if 'youtube.com/embed/' in src else src})"

    def _sup(self, n: Node) -> str:
        if n.get("id").startswith("fnref:"):
            return f"[^{n.get('id')[6:].split('-')[0]}]"
        return self.children(n)

    def formula_or(self, n: Node) -> str | None:
        latex = n.get("data-latex")
        if not latex:
            return None
        return f"\n$$\n{latex}\n$$\n" if n.tag == "div" else f"${latex}$"

    def _span(self, n: Node) -> str:
        return self.formula_or(n) or self.children(n)

    def _div(self, n: Node) -> str:
        found = self.formula_or(n)
        if found:
            return found
        name = n.get("id")
        if name.startswith("fn:"):
            return f"\n\n[^{name[3:].split('-')[0]}]: {trim(self.children(n))}\n\n"
        return self.plain(n)

    # -- tables --------------------------------------------------------
    def _table(self, n: Node) -> str:
        head = next((c for c in n.child_elements() if c.tag == "thead"), None)
        rows = [r for r in n.elements("tr") if next((a for a in r.ancestors() if a.tag == "table"), None) is n]
        if head is None or not rows:
            return self.block(n)
        table = [[_cell(self.children(c)) for c in r.child_elements() if c.tag in ("td", "th")] for r in rows]
        columns = max(map(len, table))
        table = [r + [""] * (columns - len(r)) for r in table]
        widths = [max(3, *(len(r[k]) for r in table)) for k in range(columns)]
        line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |"
        caption = next((c for c in n.child_elements() if c.tag == "caption"), None)
        lead = f"{trim(self.children(caption))}\n" if caption is not None else ""
        return "\n\n" + lead + "\n".join([line(table[0]), line(["-" * w for w in widths]), *map(line, table[1:])]) + "\n\n"


def _cell(content: str) -> str:
    return trim(re.sub(r"\s*\n\s*", " ", content)).replace("|", "\\|")


def _target(url: str) -> str:
    url = re.sub(r"([()])", r"\\\1", url)
    return f"<{url}>" if " " in url else url


def _title(title: str) -> str:
    if not title:
        return ""
    return ' "' + re.sub(r"\s*\n\s*", "\n", title).replace('"', '\\"') + '"'


# -- afterwards --------------------------------------------------------

_FORMULA = re.compile(r"\$\$[\s\S]+?\$\$|\$[^\$\n]+?\$")


def _tidy(text: str) -> str:
    text = re.sub(r"(\w!)(?=\[?!\[)", r"\1 ", text)
    text = _FORMULA.sub(lambda m: re.sub(r"\\([\\_*\[\]{}#~|>.!\-()+])", r"\1", m[0]), text)
    lines = text.split("\n")
    marks = ("-", "+", "*")
    kept = [x for k, x in enumerate(lines) if not (trim(x) in marks and (k + 1 == len(lines) or trim(lines[k + 1]) in ("", *marks)))]
    out, fenced, blank = [], False, 0
    for line in kept:
        fenced ^= trim(line).startswith(("```", "~~~"))
        blank = 0 if line else blank + 1
        if line or fenced or blank <= 1:
            out.append(line)
    return "\n".join(out)


def to_markdown(html: str) -> str:
    """Markdown of a page's content."""
    text = Converter().children(parse_document(html))
    return _tidy(text.strip("\n").strip(" ").strip("\n"))
