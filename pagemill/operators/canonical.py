"""Images behind noscript, streamed segments, formulas, callouts and code in one form each."""

from __future__ import annotations

import re

from ..functions.css import matches, select, select_one
from ..functions.dom import COMMENT, ELEMENT, TEXT, Node, element, trim
from ..functions.htmlparse import parse_fragment

# -- images ------------------------------------------------------------

#: Starts of sources that only hold a place.
PLACEHOLDERS = ("data:image/gif;base64,R0lGOD", "data:image/png;base64,iVBOR", "data:image/svg+xml", "data:image/webp")


def _holds_place(src: str) -> bool:
    src = trim(src)
    return src in ("", "#", "about:blank") or src.startswith(PLACEHOLDERS)


def resolve_noscript_images(doc: Node) -> None:
    """An image inside noscript replaces the source of a placeholder next to it."""
    found = []
    for n in doc.elements("noscript"):
        text = n.text()
        if not trim(text):
            continue
        images = n.elements("img") + parse_fragment(text).elements("img")
        src = next((i.get("src") for i in images if not _holds_place(i.get("src"))), None)
        if src is None or n.parent is None:
            continue
        row, at = n.parent.children, n.index()
        near = row[max(0, at - 3) : at][::-1] + row[at + 1 : at + 4]
        inside = (i for s in near if s.kind == ELEMENT for i in ([s] if s.tag == "img" else []) + s.elements("img"))
        image = next((i for i in inside if "data-src" in i.attrs or _holds_place(i.get("src"))), None)
        if image is not None:
            found.append((n, image, src))
    for n, image, src in found:
        image.set("src", src)
        n.detach()


_SEGMENT = re.compile(r"\$RC\(([^)]*)\)")


def resolve_streamed(doc: Node) -> None:
    """Segments that a page's script would move take the place of their templates."""
    calls = [(s, m[1].split(",")) for s in select(doc, "script:not([src])") for m in _SEGMENT.finditer(s.text())]
    for script, args in calls:
        names = [trim(a).strip('"') for a in args[:2]]
        if len(names) < 2 or not all(names):
            continue
        hole = next((t for t in doc.elements("template") if t.get("id") == names[0]), None)
        segment = next((n for n in doc.elements() if n.get("id") == names[1]), None)
        if hole is None or segment is None:
            continue
        for child in list(segment.children):
            hole.before(child)
        row = hole.parent.children
        after = row[hole.index() + 1 :]
        end = next((k for k, n in enumerate(after) if n.kind == COMMENT and trim(n.data) == "/$"), len(after) - 1)
        for n in (*after[: end + 1], hole, segment, script):
            n.detach()


# -- formulas ----------------------------------------------------------

_TEX = 'script[type="math/tex"], script[type="math/tex; mode=display"]'
_ANNOTATION = 'annotation[encoding="application/x-tex"]'


def _within(root: Node, selector: str) -> list[Node]:
    return ([root] if root.kind == ELEMENT and matches(root, selector) else []) + select(root, selector)


def _first_text(root: Node | None, selector: str) -> str | None:
    texts = (trim(n.text()) for n in _within(root, selector)) if root is not None else ()
    return next((t for t in texts if t), None)


def _is_block(n: Node) -> bool:
    up = n.parent_element
    return n.get("display") in ("block", "true") or "MathJax_Display" in n.classes or (up is not None and any(c in up.classes for c in ("MathJax_Display", "katex-display")))


def _formula(n: Node, latex: str | None, block: bool) -> None:
    if latex is not None and n.parent is not None:
        n.replace(element("div" if block else "span", {"data-latex": latex}, latex))


def standardize_math(root: Node) -> None:
    for n in _within(root, ".katex-display, .katex:not(.katex-display .katex)"):
        _formula(n, _first_text(n, f".katex-mathml {_ANNOTATION}") or _first_text(n, _ANNOTATION), "katex-display" in n.classes)
    for n in _within(root, ".temml"):
        _formula(n, _first_text(n, _ANNOTATION), "temml-display" in n.classes)
    for n in _within(root, ".MathJax, .MathJax_Display, .MathJax_MathML"):
        up = n.parent_element
        latex = n.get("data-latex") or _first_text(up, _TEX) or _first_text(n, _ANNOTATION)
        block = _is_block(n)
        if latex:
            for s in _within(up, f"{_TEX}, .MathJax_Preview") if up is not None else []:
                s.detach()
            _formula(n, latex, block)
    for n in _within(root, "mjx-container"):
        _formula(n, n.get("data-latex") or _first_text(n, _TEX) or _first_text(n, _ANNOTATION), _is_block(n))
    for n in _within(root, ".MathJax_SVG"):
        _formula(n, n.get("data-latex") or _first_text(n, "title") or _first_text(n, _ANNOTATION), _is_block(n))
    for n in _within(root, "math:not([data-latex])"):
        latex = n.attrs.get("alttext", _first_text(n, _ANNOTATION))
        if latex is not None:
            n.set("data-latex", latex)
            if "xmlns" not in n.attrs:
                n.set("xmlns", "http://www.w3.org/1998/Math/MathML")
    for n in _within(root, f"{_TEX}, .MathJax_Preview"):
        n.detach()


# -- callouts ----------------------------------------------------------

#: Kinds of callouts.
ADMONITIONS = "info warning note tip danger caution important abstract success question failure bug example quote".split()
QUOTE_KINDS = ("note", "warning", "tip", "important", "caution")


def _capital(s: str) -> str:
    return s[:1].upper() + s[1:]


def _kind(n: Node, prefix: str) -> str:
    return next((c[len(prefix) :] for c in n.classes if c.startswith(prefix) and len(c) > len(prefix)), "note")


def _callout(n: Node, kind: str, title: str | None = None) -> None:
    n.set("data-callout", kind)
    n.set("data-callout-title", title or _capital(kind))


def _title(n: Node, selector: str) -> str | None:
    first = select_one(n, selector)
    return (trim(first.text()) or None) if first is not None else None


def standardize_callouts(root: Node) -> None:
    for n in select(root, ".callout.is-collapsed, .callout.is-collapsible"):
        if "data-callout-fold" not in n.attrs:
            n.set("data-callout-fold", "-" if "is-collapsed" in n.classes else "+")
    new = lambda selector: (n for n in select(root, selector) if "data-callout" not in n.attrs)
    for n in new(".markdown-alert"):
        _callout(n, _kind(n, "markdown-alert-"))
    for n in new(".admonition"):
        _callout(n, next((c for c in n.classes if c in ADMONITIONS), "note"), _title(n, ".admonition-title"))
    for n in new('.alert[class*="alert-"]'):
        if (kind := _kind(n, "alert-")) != "dismissible":
            _callout(n, kind, _title(n, ".alert-heading, .alert-title"))
    for n in new("blockquote"):
        m = re.match(r"\[!([^\]]*)\]", trim(n.text()))
        if m and m[1].lower() in QUOTE_KINDS:
            _callout(n, m[1].lower())


# -- code --------------------------------------------------------------

#: Marks of line numbers, copy buttons and languages.
NUMBER_CLASSES = frozenset("linenumber line-number line-numbers lineno linenos rouge-gutter hljs-ln-numbers hljs-ln-line lnt react-syntax-highlighter-line-number code-line-number gutter".split())
BUTTON_CLASSES = frozenset("copy-button copy-code-button copybutton code-copy btn-copy copy".split())
BUTTON_ATTRIBUTES = ("data-copy", "data-clipboard-text")
LANGUAGE_PREFIXES = ("language-", "lang-", "syntax-", "highlight-", "code-", "cm-s-")
LANGUAGE_SUFFIXES = ("-code", "-snippet")
LANGUAGES = frozenset(
    """actionscript ada agda apache applescript arduino asm assembly astro awk bash basic batch brainfuck bsl c ceylon clojure cmake
    cobol coffeescript cpp crystal csharp css csv cuda d dart delphi diff django dockerfile dotnet eiffel elixir elm emacs erb erlang
    excel fish fortran fsharp gdscript gherkin glsl go graphql groovy haml handlebars haskell haxe hlsl html http ini io java javascript
    jinja json jsonnet jsx julia jupyter kotlin latex lean less liquid lisp livescript llvm lua makefile markdown markup mathematica
    matlab mdx mermaid mips moonscript nginx nim nix nushell objc objective-c ocaml openscad pascal perl php plaintext plsql postcss
    powershell prisma processing prolog protobuf puppet purescript python r racket razor regex rescript rest ruby rust sass scala scheme
    scss sh shell smalltalk smarty solidity sparql sql stan stylus svelte svg swift tcl terraform tex text toml tsx twig typescript v
    vala vb vbnet verilog vhdl vim vue wasm wolfram xml xquery xslt yaml zig zsh js ts rb py rs cs hs yml md""".split()
)


def _language_of(n: Node) -> str | None:
    for name in ("data-language", "data-lang", "language"):
        if n.get(name).lower() in LANGUAGES:
            return n.get(name).lower()
    for css in (c.lower() for c in n.classes):
        names = [css[len(p) :] for p in LANGUAGE_PREFIXES if css.startswith(p)] + [css[: -len(s)] for s in LANGUAGE_SUFFIXES if css.endswith(s)] + [css]
        found = next((x for x in names if x in LANGUAGES), None)
        if found:
            return found
    return None


def language(pre: Node) -> str | None:
    """The language that a code block, its code elements or three ancestors name."""
    around = [a for a in pre.ancestors() if a.kind == ELEMENT][:3]
    return next((x for n in (pre, *pre.elements("code"), *around) if (x := _language_of(n))), None)


def code_text(n: Node) -> str:
    parts: list[str] = []

    def add(node: Node) -> None:
        if node.kind == TEXT:
            parts.append(node.data)
        elif node.kind == ELEMENT and node.tag == "br":
            parts.append("\n")
        elif node.kind == ELEMENT and node.tag not in ("button", "style"):
            for c in node.children:
                add(c)

    add(n)
    text = trim("".join(parts).replace("\t", "    ").replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", text)


def standardize_code(root: Node) -> None:
    for n in root.elements():
        if any(c.lower() in NUMBER_CLASSES for c in n.classes) or (n.tag == "td" and "hljs-ln-numbers" in n.get("class")):
            n.detach()
    for n in root.elements():
        if any(a in n.attrs for a in BUTTON_ATTRIBUTES) or any(c.lower() in BUTTON_CLASSES for c in n.classes):
            n.detach()
    for pre in root.elements("pre"):
        lang, text = language(pre), code_text(pre)
        for c in list(pre.children):
            c.detach()
        pre.append(element("code", {"data-lang": lang} if lang else {}, text))
        pre.attrs.clear()
