"""Markdown of issue trackers to HTML: blocks first, then what stands inside lines."""

from __future__ import annotations

import re

from ..functions.text import html_escape

_BARE = re.compile(r"https?://[^\s<>\[\])\]]+")
_UNSAFE = ("javascript:", "vbscript:", "data:")


def linkify(text: str) -> str:
    """Bare addresses as Markdown links; not in code, links, or link definitions."""
    out, fenced = [], False
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and not (line.lstrip().startswith("[") and "]: http" in line):
            parts, at = [], 0
            for m in _BARE.finditer(line):
                if line[m.start() - 1 : m.start()] in ("(", "[", "]", "<") and m.start() or line[at : m.start()].count("`") % 2:
                    continue
                url = m[0].rstrip(".,;:!?")
                parts += [line[at : m.start()], f"[{url}]({url})", m[0][len(url) :]]
                at = m.end()
            line = "".join([*parts, line[at:]])
        out.append(line)
    return "\n".join(out[:-1] if out and out[-1] == "" else out)


# -- inside lines ------------------------------------------------------

_INLINE = re.compile(
    r"""(?P<code>(?P<ticks>`+)(?P<body>.+?)(?<!`)(?P=ticks)(?!`))
    |(?P<escape>\\[!-/:-@\[-`{-~])
    |(?P<note>\[\^(?P<name>[^\]\s]+)\])
    |(?P<image>!\[(?P<alt>(?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?(?P<src>[^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*)>?(?:\s+"(?P<ititle>[^"]*)")?\s*\))
    |(?P<link>\[(?P<label>(?:[^\[\]]|\[[^\]]*\](?:\([^)]*\))?)*)\]\(\s*<?(?P<href>[^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*)>?(?:\s+"(?P<title>[^"]*)")?\s*\))
    |(?P<auto><(?P<url>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>)
    |(?P<mail><(?P<address>[\w.+-]+@[\w.-]+)>)
    |(?P<strong>(?P<s>\*\*|__)(?=\S)(?P<bold>.+?)(?<=\S)(?P=s))
    |(?P<em>(?P<e>\*|(?<!\w)_)(?=\S)(?P<light>.+?)(?<=\S)(?P=e)(?!\*)(?!(?<=_)\w))
    |(?P<strike>~~?(?=\S)(?P<gone>.+?)(?<=\S)~~?)
    |(?P<break>(?:[ ]{2,}|\\)\n)""",
    re.X | re.S,
)


class _Notes:
    def __init__(self):
        self.order: list[str] = []

    def number(self, name: str) -> int:
        if name not in self.order:
            self.order.append(name)
        return self.order.index(name) + 1


def _href(url: str) -> str:
    return "" if url.strip().lower().startswith(_UNSAFE) else html_escape(url)


def inline(text: str, notes: _Notes, known: dict[str, str]) -> str:
    out, at = [], 0

    def plain(s: str) -> str:
        return html_escape(re.sub(r" *\n *", "\n", s))

    def label(m: re.Match) -> str:
        url = known.get(m[2].lower() or m[1].lower())
        return f'<a href="{_href(url)}">{inline(m[1], notes, known)}</a>' if url is not None else plain(m[0])

    for m in _INLINE.finditer(text):
        out.append(plain(text[at : m.start()]))
        kind = m.lastgroup if m.lastgroup in ("escape", "break") else next(k for k in ("code", "escape", "note", "image", "link", "auto", "mail", "strong", "em", "strike", "break") if m[k] is not None)
        title = f' title="{html_escape(m["title"] or m["ititle"])}"' if m["title"] or m["ititle"] else ""
        if kind == "code":
            body = m["body"].replace("\n", " ")
            out.append(f"<code>{html_escape(body[1:-1] if body[:1] == body[-1:] == ' ' and body.strip() else body)}</code>")
        elif kind == "escape":
            out.append(html_escape(m["escape"][1]))
        elif kind == "note":
            if f"^{m['name']}" in known:
                out.append(f'<sup class="footnote-reference"><a href="#{html_escape(m["name"])}">{notes.number(m["name"])}</a></sup>')
            else:
                out.append(plain(m[0]))
        elif kind == "image":
            out.append(f'<img src="{html_escape(m["src"])}" alt="{html_escape(m["alt"])}"{title} />')
        elif kind == "link":
            out.append(f'<a href="{_href(m["href"])}"{title}>{inline(m["label"], notes, known)}</a>')
        elif kind == "auto":
            out.append(f'<a href="{_href(m["url"])}">{html_escape(m["url"])}</a>')
        elif kind == "mail":
            out.append(f'<a href="mailto:{html_escape(m["address"])}">{html_escape(m["address"])}</a>')
        elif kind == "break":
            out.append("<br />\n")
        else:
            tag, body = {"strong": ("strong", "bold"), "em": ("em", "light"), "strike": ("del", "gone")}[kind]
            out.append(f"<{tag}>{inline(m[body], notes, known)}</{tag}>")
        at = m.end()
    out.append(plain(text[at:]))
    return "".join(out)


# -- blocks ------------------------------------------------------------

_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_COLUMNS = re.compile(r" {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_DEFINITION = re.compile(r" {0,3}\[(\^?[^\]]+)\]:\s*(.*)$")


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _starts_block(line: str) -> bool:
    return bool(_RULE.match(line) or _HEADING.match(line) or _FENCE.match(line) or re.match(r" {0,3}>", line) or ((m := _ITEM.match(line)) and (m[2] in "-+*" or m[2][:-1] == "1") and line[m.end() :].strip()))


class _Blocks:
    def __init__(self, known: dict[str, str], notes: _Notes):
        self.known, self.notes = known, notes

    def text(self, s: str) -> str:
        return inline(s, self.notes, self.known)

    def render(self, lines: list[str], tight: bool = False) -> str:
        out, k = [], 0
        while k < len(lines):
            line = lines[k]
            if not line.strip():
                k += 1
            elif m := _FENCE.match(line):
                body, k = [], k + 1
                while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[k]):
                    body.append(lines[k])
                    k += 1
                k += 1
                lang = m[2].split()
                css = f' class="language-{html_escape(lang[0])}"' if lang else ""
                out.append(f"<pre><code{css}>{html_escape(''.join(x + chr(10) for x in body))}</code></pre>\n")
            elif m := _HEADING.match(line):
                out.append(f"<h{len(m[1])}>{self.text((m[2] or '').strip())}</h{len(m[1])}>\n")
                k += 1
            elif _RULE.match(line):
                out.append("<hr />\n")
                k += 1
            elif re.match(r" {0,3}>", line):
                body = []
                while k < len(lines) and lines[k].strip() and (re.match(r" {0,3}>", lines[k]) or not _starts_block(lines[k])):
                    body.append(re.sub(r"^ {0,3}> ?", "", lines[k]))
                    k += 1
                out.append(f"<blockquote>\n{self.render(body)}</blockquote>\n")
            elif _ITEM.match(line):
                html, k = self.items(lines, k)
                out.append(html)
            elif line.startswith(("    ", "\t")):
                body = []
                while k < len(lines) and (lines[k].startswith(("    ", "\t")) or not lines[k].strip()):
                    body.append(re.sub(r"^(?: {4}|\t)", "", lines[k]))
                    k += 1
                while body and not body[-1].strip():
                    body.pop()
                out.append(f"<pre><code>{html_escape(''.join(x + chr(10) for x in body))}</code></pre>\n")
            elif k + 1 < len(lines) and "|" in line and _COLUMNS.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
                html, k = self.table(lines, k)
                out.append(html)
            else:
                body = []
                while k < len(lines) and lines[k].strip() and (not body or not _starts_block(lines[k])):
                    under = re.match(r" {0,3}(=+|-+)\s*$", lines[k]) if body else None
                    if under:
                        break
                    body.append(lines[k].strip() if not lines[k].endswith("  ") else lines[k].strip() + "  ")
                    k += 1
                content = self.text("\n".join(body).strip())
                if k < len(lines) and body and (under := re.match(r" {0,3}(=+|-+)\s*$", lines[k])):
                    level = 1 if under[1][0] == "=" else 2
                    out.append(f"<h{level}>{content}</h{level}>\n")
                    k += 1
                else:
                    out.append(content + "\n" if tight else f"<p>{content}</p>\n")
        html = "".join(out)
        return html.removesuffix("\n") if tight and html.count("\n") == 1 else html

    def items(self, lines: list[str], k: int) -> tuple[str, int]:
        first = _ITEM.match(lines[k])
        ordered, mark = first[2][0].isdigit(), first[2][-1]
        rows: list[list[str]] = []
        loose = False
        while k < len(lines):
            m = _ITEM.match(lines[k])
            if not m or m[2][-1] != mark or m[2][0].isdigit() != ordered or _RULE.match(lines[k]):
                break
            indent = len(m[0]) if 1 <= len(m[3]) <= 4 else len(m[1]) + len(m[2]) + 1
            body, k = [lines[k][min(indent, len(lines[k])) :]], k + 1
            while k < len(lines):
                if not lines[k].strip():
                    after = next((x for x in lines[k:] if x.strip()), "")
                    if not after.startswith(" " * indent):
                        break
                    body.append("")
                elif lines[k].startswith(" " * indent):
                    body.append(lines[k][indent:])
                elif _ITEM.match(lines[k]) or _starts_block(lines[k]) or not body[-1].strip():
                    break
                else:
                    body.append(lines[k].strip())
                k += 1
            rows.append(body)
            loose = loose or any(not x.strip() for x in body[:-1])
            blank = k
            while blank < len(lines) and not lines[blank].strip():
                blank += 1
            if blank > k and blank < len(lines) and (m := _ITEM.match(lines[blank])) and m[2][-1] == mark:
                loose, k = True, blank
        out = []
        for body in rows:
            task = re.match(r"\[([ xX])\] ", body[0])
            box = ""
            if task:
                body[0] = body[0][4:]
                box = f'<input disabled="" type="checkbox"{" checked=" + chr(34) * 2 if task[1] != " " else ""}/>\n'
            inner = self.render(body, tight=not loose)
            if loose:
                inner = "\n" + (inner.replace("<p>", "<p>" + box, 1) if box else inner)
            else:
                inner = box + inner
            out.append(f"<li>{inner}</li>\n")
        start = int(first[2][:-1]) if ordered else 1
        head = "<ul>" if not ordered else "<ol>" if start == 1 else f'<ol start="{start}">'
        return f"{head}\n{''.join(out)}</{'ol' if ordered else 'ul'}>\n", k

    def table(self, lines: list[str], k: int) -> tuple[str, int]:
        head = _cells(lines[k])
        sides = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":"))) for c in _cells(lines[k + 1])]

        def row(cells: list[str], tag: str) -> str:
            cells = (cells + [""] * len(head))[: len(head)]
            return "".join(f"<{tag}{f' style={chr(34)}text-align: {s}{chr(34)}' if s else ''}>{self.text(c)}</{tag}>" for c, s in zip(cells, sides))

        k += 2
        body = []
        while k < len(lines) and lines[k].strip() and not _starts_block(lines[k]):
            body.append(f"<tr>{row(_cells(lines[k]), 'td')}</tr>\n")
            k += 1
        rows = f"<tbody>\n{''.join(body)}</tbody>" if body else "<tbody></tbody>"
        return f"<table><thead><tr>{row(head, 'th')}</tr></thead>{rows}</table>\n", k


def markdown_to_html(source: str) -> str:
    """HTML of GitHub's Markdown; raw HTML stays as text, unsafe link targets are blanked."""
    lines, known, rest, fenced = linkify(source).split("\n"), {}, [], False
    for line in lines:
        fenced ^= bool(_FENCE.match(line))
        m = None if fenced else _DEFINITION.match(line)
        if m:
            known[m[1].lower() if m[1][0] != "^" else m[1]] = m[2] if m[1][0] == "^" else m[2].split(" ")[0].strip("<>")
        else:
            rest.append(line)
    notes = _Notes()
    blocks = _Blocks(known, notes)
    out = blocks.render(rest)
    for name, body in known.items():
        if name[0] == "^":
            out += f'<div class="footnote-definition" id="{html_escape(name[1:])}"><sup class="footnote-definition-label">{notes.number(name[1:])}</sup>\n<p>{blocks.text(body)}</p>\n</div>\n'
    return out
