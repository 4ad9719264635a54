"""HTML tree construction: tokens by regular expressions, insertion by the HTML standard's modes.

Scripting counts as enabled (``noscript`` holds raw text), attributes are kept
sorted by name, doctypes are dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from html.entities import html5 as _NAMED

from .dom import COMMENT, DOCUMENT, ELEMENT, TEXT, Node

_WS = "\t\n\f\r "
_RAWTEXT = frozenset("style xmp iframe noembed noframes script noscript".split())
_RCDATA = frozenset(("title", "textarea"))
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
_VOID_IN = frozenset("area br embed img keygen wbr input param source track hr col base link meta basefont bgsound frame".split())
_BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
#: Names that keep capitals inside svg.
_SVG_TAGS = {x.lower(): x for x in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()}
_SVG_ATTRS = {x.lower(): x for x in "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan".split()}

#: Prefixed attributes of svg and math: prefix -> local names; the prefix goes, and they come last.
_PREFIXED = {"xlink": "actuate arcrole href role show title type".split(), "xml": ["lang", "space"], "xmlns": ["xlink"]}


def _foreign_attrs(attrs: dict[str, str], svg: bool) -> dict[str, str]:
    plain, last = {}, {}
    for name, value in attrs.items():
        prefix, colon, local = name.partition(":")
        if colon and local in _PREFIXED.get(prefix, ()):
            last[local] = value
        elif svg:
            plain[_SVG_ATTRS.get(name, name)] = value
        else:
            plain["definitionURL" if name == "definitionurl" else name] = value
    return dict(sorted(plain.items(), key=lambda x: (x[0] == "xmlns", x[0]))) | last


_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />\0]*")
_GAP = re.compile(r"[\t\n\f\r /]*")
_ATTR = re.compile(r"(=?[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|([^\t\n\f\r >]*)))?")
_ATTR_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


def _attr_text(raw: str) -> str:
    """Character references in an attribute: a name without ``;`` before ``=`` or a letter stays."""
    if "&" not in raw:
        return raw

    def sub(m: re.Match) -> str:
        ref = m[0]
        if ref[1] == "#" or ref.endswith(";") and ref[1:] in _NAMED:
            return _ref(ref)
        after = raw[m.end() : m.end() + 1]
        if ref[1:] in _NAMED and not (after == "=" or after.isalnum()):
            return _NAMED[ref[1:]]
        return ref

    return _ATTR_REF.sub(sub, raw)


_LONG_REF = re.compile(r"&#(?:([0-9]{9,})|[xX]([0-9a-fA-F]{9,}))")


def _shorter(m: re.Match) -> str:
    """A numeric reference without leading zeros; beyond all characters, one that stands for U+FFFD."""
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return f"&#{'' if m[1] else 'x'}{digits if len(digits) < 9 else '110000' if m[2] else '1114112'}"


def _ref(ref: str) -> str:
    return html.unescape(_LONG_REF.sub(_shorter, ref))


def _text(raw: str) -> str:
    return _ref(raw) if "&" in raw else raw


#: Fixed value: what is nested deeper becomes siblings, in document order, as browsers do it.
MAX_DEPTH = 512


class _Open(list):
    """The stack of open elements, with the number of open elements of each tag."""

    __slots__ = ("tags",)

    def __init__(self, nodes: Iterable[Node] = ()):
        super().__init__(nodes)
        self.tags = Counter(n.tag for n in self)

    def append(self, node: Node) -> None:
        super().append(node)
        self.tags[node.tag] += 1

    def insert(self, at: int, node: Node) -> None:
        super().insert(at, node)
        self.tags[node.tag] += 1

    def pop(self) -> Node:
        node = super().pop()
        self.tags[node.tag] -= 1
        return node

    def __delitem__(self, at: int | slice) -> None:
        gone = self[at]
        super().__delitem__(at)
        for n in gone if isinstance(gone, list) else [gone]:
            self.tags[n.tag] -= 1


class Builder:
    def __init__(self, fragment: bool = False):
        self.doc = Node(DOCUMENT)
        self.stack = _Open()
        self.active: list[Node | None] = []  # formatting elements; None is a marker
        self.head: Node | None = None
        self.form: Node | None = None
        self.mode = "initial"
        self.foster = False
        self.fragment = fragment
        self.drop_newline = False
        if fragment:
            self.push("html", {})
            self.mode = "body"

    # -- places --------------------------------------------------------
    @property
    def top(self) -> Node:
        return self.stack[-1]

    def place(self) -> tuple[Node, int]:
        target = self.stack[-1]
        if len(self.stack) > MAX_DEPTH and target.parent is not None and target.tag not in _RAWTEXT and target.tag not in _RCDATA:
            return target.parent, len(target.parent.children)
        if self.foster and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for k in range(len(self.stack) - 1, -1, -1):
                n = self.stack[k]
                if n.tag == "table":
                    if n.parent is not None:
                        return n.parent, n.index()
                    return self.stack[k - 1], len(self.stack[k - 1].children)
                if n.tag == "template":
                    return n, len(n.children)
            return self.stack[0], len(self.stack[0].children)
        return target, len(target.children)

    def push(self, tag: str, attrs: dict[str, str], ns: str = "html", keep: bool = True) -> Node:
        node = Node(ELEMENT, tag, attrs, ns=ns)
        if self.stack:
            parent, at = self.place()
            parent.insert(at, node)
        else:
            self.doc.append(node)
        if keep:
            self.stack.append(node)
        return node

    def put_text(self, data: str) -> None:
        if not data:
            return
        parent, at = self.place()
        if at and parent.children[at - 1].kind == TEXT:
            parent.children[at - 1].data += data
        else:
            parent.insert(at, Node(TEXT, data=data))

    def comment(self, data: str) -> None:
        node = Node(COMMENT, data=data)
        if not self.stack or self.mode in ("initial", "before html", "after after"):
            self.doc.append(node)
        elif self.mode == "after body":
            self.stack[0].append(node)
        else:
            parent, at = self.place()
            parent.insert(at, node)

    # -- scopes --------------------------------------------------------
    def in_scope(self, tags, extra=()) -> bool:
        if not any(self.stack.tags[t] for t in tags):
            return False
        for n in reversed(self.stack):
            if n.ns == "html" and n.tag in tags:
                return True
            if (n.ns == "html" and (n.tag in _SCOPE or n.tag in extra)) or (n.ns == "svg" and n.tag in ("foreignObject", "desc", "title")) or (n.ns == "math" and n.tag in ("mi", "mo", "mn", "ms", "mtext", "annotation-xml")):
                return False
        return False

    def in_table_scope(self, tags) -> bool:
        if not any(self.stack.tags[t] for t in tags):
            return False
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in ("html", "table", "template"):
                return False
        return False

    def pop_until(self, tags) -> None:
        while len(self.stack) > 1:
            n = self.stack.pop()
            if n.ns == "html" and n.tag in tags:
                return

    def imply(self, but: str = "") -> None:
        while self.top.tag in _IMPLIED and self.top.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope(("p",), ("button",)):
            self.imply("p")
            self.pop_until(("p",))

    def clear_to(self, tags) -> None:
        while self.top.tag not in tags and self.top.tag != "html":
            self.stack.pop()

    # -- formatting elements -------------------------------------------
    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        k = len(self.active) - 1
        while k > 0 and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            self.active[i] = self.push(old.tag, dict(old.attrs))

    def add_formatting(self, node: Node) -> None:
        same = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same.append(n)
        if len(same) >= 3:
            self._forget(same[-1])
        self.active.append(node)

    def _forget(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def clear_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency: closes a formatting element that other elements overlap."""
        if self.top.tag == tag and not any(n is self.top for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    fmt = n
                    break
            if fmt is None:
                self.any_end(tag)
                return
            if not any(n is fmt for n in self.stack):
                self._forget(fmt)
                return
            if not self.in_scope((tag,)):
                return
            at = next(k for k, n in enumerate(self.stack) if n is fmt)
            block = next((n for n in self.stack[at + 1 :] if n.tag in _SPECIAL and n.ns == "html"), None)
            if block is None:
                del self.stack[at:]
                self._forget(fmt)
                return
            common = self.stack[at - 1]
            mark = next(k for k, n in enumerate(self.active) if n is fmt)
            k = next(i for i, n in enumerate(self.stack) if n is block)
            last, count = block, 0
            while True:
                count += 1
                k -= 1
                node = self.stack[k]
                if node is fmt:
                    break
                here = next((i for i, n in enumerate(self.active) if n is node), None)
                if count > 3 and here is not None:
                    del self.active[here]
                    if here < mark:
                        mark -= 1
                    here = None
                if here is None:
                    del self.stack[k]
                    continue
                twin = Node(ELEMENT, node.tag, dict(node.attrs))
                self.active[here] = self.stack[k] = twin
                if last is block:
                    mark = here + 1
                twin.append(last)
                last = twin
            if last.parent is not None:
                last.detach()
            if common.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                keep, self.foster = self.foster, True
                saved, self.stack = self.stack, _Open(self.stack[: next(i for i, n in enumerate(self.stack) if n is common) + 1])
                parent, where = self.place()
                self.stack, self.foster = saved, keep
                parent.insert(where, last)
            else:
                common.append(last)
            twin = Node(ELEMENT, fmt.tag, dict(fmt.attrs))
            for child in list(block.children):
                twin.append(child)
            block.append(twin)
            old = next(i for i, n in enumerate(self.active) if n is fmt)
            del self.active[old]
            self.active.insert(mark - (old < mark), twin)
            self.stack = _Open(n for n in self.stack if n is not fmt)
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is block) + 1, twin)

    def any_end(self, tag: str) -> None:
        if not self.stack.tags[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            n = self.stack[k]
            if n.tag == tag and n.ns == "html":
                self.imply(tag)
                del self.stack[k:]
                return
            if n.ns == "html" and n.tag in _SPECIAL:
                return

    # -- modes ---------------------------------------------------------
    def need_html(self, attrs: dict | None = None) -> None:
        if self.mode in ("initial", "before html"):
            self.push("html", attrs or {})
            self.mode = "before head"

    def need_head(self, attrs: dict | None = None) -> None:
        self.need_html()
        if self.mode == "before head":
            self.head = self.push("head", attrs or {})
            self.mode = "head"

    def leave_head(self) -> None:
        self.need_head()
        if self.mode == "head":
            self.stack.pop()
            self.mode = "after head"

    def need_body(self, attrs: dict | None = None) -> None:
        if self.mode in ("initial", "before html", "before head", "head", "after head"):
            self.leave_head()
            self.push("body", attrs or {})
            self.mode = "body"
        elif self.mode in ("after body", "after after"):
            self.mode = "body"

    def foreign(self) -> bool:
        return bool(self.stack) and self.top.ns != "html"

    def text(self, data: str) -> None:
        data = data.replace("\0", "")
        if self.drop_newline:
            self.drop_newline = False
            data = data[1:] if data.startswith("\n") else data
        if not data:
            return
        if self.foreign():
            self.put_text(data)
            return
        if self.mode in ("initial", "before html", "before head"):
            data = data.lstrip(_WS)
            if not data:
                return
            self.need_body()
        elif self.mode in ("head", "after head"):
            rest = data.lstrip(_WS)
            if rest != data:
                self.put_text(data[: len(data) - len(rest)])
            if not rest:
                return
            data = rest
            self.need_body()
        elif self.mode in ("after body", "after after"):
            if data.strip(_WS):
                self.mode = "body"
        elif self.mode == "frameset":
            return
        if self.mode == "colgroup":
            rest = data.lstrip(_WS)
            if rest != data:
                self.put_text(data[: len(data) - len(rest)])
            if not rest:
                return
            data = rest
            self.stack.pop()
            self.mode = "table"
        if self.top.tag in ("table", "tbody", "tfoot", "thead", "tr") and self.mode in ("table", "tbody", "row"):
            if data.strip(_WS):
                self.foster = True
                self.reconstruct()
                self.put_text(data)
                self.foster = False
            else:
                self.put_text(data)
            return
        if self.mode != "select":
            self.reconstruct()
        self.put_text(data)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self.drop_newline = False
        if self.foreign() and not self._html_here(tag):
            self._foreign_start(tag, attrs, closed)
            return
        mode = self.mode
        if tag == "html":
            self.need_html(attrs)
            for k, v in attrs.items():
                self.stack[0].attrs.setdefault(k, v)
            return
        if mode in ("initial", "before html", "before head"):
            self.need_html()
            if tag == "head":
                self.need_head(attrs)
                return
            self.need_head()
            mode = self.mode
        if mode == "head":
            if tag in _HEAD_TAGS:
                self._head_tag(tag, attrs)
                return
            if tag == "head":
                return
            self.leave_head()
            mode = self.mode
        if mode == "after head":
            if tag == "body":
                self.need_body(attrs)
                return
            if tag == "frameset":
                self.push("frameset", attrs)
                self.mode = "frameset"
                return
            if tag in _HEAD_TAGS:
                self.stack.append(self.head)
                self._head_tag(tag, attrs)
                self.stack = _Open(n for n in self.stack if n is not self.head)
                return
            if tag == "head":
                return
            self.need_body()
            mode = self.mode
        if mode in ("after body", "after after"):
            self.mode = mode = "body"
        if mode == "frameset":
            if tag in ("frameset", "frame"):
                self.push(tag, attrs, keep=tag == "frameset")
            return
        if mode in ("table", "tbody", "row", "cell", "caption", "colgroup"):
            if self._table_start(tag, attrs, closed):
                return
        if mode == "select":
            self._select_start(tag, attrs)
            return
        self._body_start(tag, attrs, closed)

    def _html_here(self, tag: str) -> bool:
        top = self.top
        if top.ns == "math" and top.tag in ("mi", "mo", "mn", "ms", "mtext") and tag not in ("mglyph", "malignmark"):
            return True
        if top.ns == "math" and top.tag == "annotation-xml" and (tag == "svg" or top.get("encoding").lower() in ("text/html", "application/xhtml+xml")):
            return True
        return top.ns == "svg" and top.tag in ("foreignObject", "desc", "title")

    def _foreign_start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in _BREAKOUT or tag == "font" and attrs.keys() & {"color", "face", "size"}:
            while self.foreign() and not self._html_here("p"):
                self.stack.pop()
            self.start(tag, attrs, closed)
            return
        ns = self.top.ns
        if ns == "svg":
            tag = _SVG_TAGS.get(tag, tag)
        self.push(tag, _foreign_attrs(attrs, ns == "svg"), ns, keep=not closed)

    def _head_tag(self, tag: str, attrs: dict[str, str]) -> None:
        self.push(tag, attrs, keep=tag not in ("base", "basefont", "bgsound", "link", "meta"))
        if tag == "template":
            self.active.append(None)
            self.mode = "body" if self.mode in ("head", "after head") else self.mode

    def _body_start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in _HEAD_TAGS:
            if tag == "noscript":
                self.reconstruct()
            self._head_tag(tag, attrs)
        elif tag == "body":
            if len(self.stack) > 1 and self.stack[1].tag == "body":
                for k, v in attrs.items():
                    self.stack[1].attrs.setdefault(k, v)
        elif tag in ("head", "frameset", *_TABLE_PARTS, "frame"):
            return
        elif tag in _BLOCKS:
            self.close_p()
            self.push(tag, attrs)
        elif tag in _HEADINGS:
            self.close_p()
            if self.top.tag in _HEADINGS:
                self.stack.pop()
            self.push(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.push(tag, attrs)
            self.drop_newline = True
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.push(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.tag in same:
                    self.imply(n.tag)
                    self.pop_until((n.tag,))
                    break
                if n.tag in _SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.push(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.push(tag, attrs)
        elif tag == "button":
            if self.in_scope(("button",)):
                self.imply()
                self.pop_until(("button",))
            self.reconstruct()
            self.push(tag, attrs)
        elif tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adopt("a")
                    self._forget(n)
                    self.stack = _Open(x for x in self.stack if x is not n)
                    break
            self.reconstruct()
            self.add_formatting(self.push(tag, attrs))
        elif tag == "nobr":
            self.reconstruct()
            if self.in_scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.add_formatting(self.push(tag, attrs))
        elif tag in _FORMATTING:
            self.reconstruct()
            self.add_formatting(self.push(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.push(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            self.close_p()
            self.push(tag, attrs)
            self.mode = "table"
        elif tag == "hr":
            self.close_p()
            self.push(tag, attrs, keep=False)
        elif tag in ("area", "br", "embed", "img", "image", "keygen", "wbr", "input"):
            self.reconstruct()
            self.push("img" if tag == "image" else tag, attrs, keep=False)
        elif tag in ("param", "source", "track"):
            self.push(tag, attrs, keep=False)
        elif tag in ("textarea", "iframe", "noembed", "xmp"):
            if tag == "xmp":
                self.close_p()
                self.reconstruct()
            self.push(tag, attrs)
            self.drop_newline = tag == "textarea"
        elif tag == "select":
            self.reconstruct()
            self.push(tag, attrs)
            self.mode = "select"
        elif tag in ("optgroup", "option"):
            if self.top.tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.push(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope(("ruby",)):
                self.imply("rtc" if tag in ("rp", "rt") else "")
            self.push(tag, attrs)
        elif tag in ("math", "svg"):
            self.reconstruct()
            self.push(tag, _foreign_attrs(attrs, tag == "svg"), tag, keep=not closed)
        else:
            self.reconstruct()
            self.push(tag, attrs)

    def _select_start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("option", "optgroup", "hr"):
            if self.top.tag == "option":
                self.stack.pop()
            if tag != "option" and self.top.tag == "optgroup":
                self.stack.pop()
            self.push(tag, attrs, keep=tag != "hr")
        elif tag in ("select", "input", "keygen", "textarea", *_TABLE_PARTS, "table"):
            self.pop_until(("select",))
            self.reset()
            if tag != "select":
                self.start(tag, attrs, False)
        elif tag in ("script", "template"):
            self._head_tag(tag, attrs)

    def reset(self) -> None:
        """The mode that the open elements ask for."""
        modes = {"select": "select", "td": "cell", "th": "cell", "tr": "row", "tbody": "tbody", "thead": "tbody", "tfoot": "tbody", "caption": "caption", "colgroup": "colgroup", "table": "table", "body": "body", "frameset": "frameset", "template": "body"}
        self.mode = next((modes[n.tag] for n in reversed(self.stack) if n.ns == "html" and n.tag in modes), "body")

    def _table_start(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        """True if the table modes took the tag."""
        mode = self.mode
        if mode == "cell":
            if tag in _TABLE_PARTS and self.in_table_scope(("td", "th")):
                self._close_cell()
                self.start(tag, attrs, closed)
                return True
            return False
        if mode == "caption":
            if tag in _TABLE_PARTS:
                if self.in_table_scope(("caption",)):
                    self.pop_until(("caption",))
                    self.clear_marker()
                    self.mode = "table"
                    self.start(tag, attrs, closed)
                return True
            return False
        if mode == "colgroup":
            if tag == "col":
                self.push(tag, attrs, keep=False)
                return True
            if tag == "template":
                self._head_tag(tag, attrs)
                return True
            if self.top.tag == "colgroup":
                self.stack.pop()
            self.mode = "table"
            self.start(tag, attrs, closed)
            return True
        if mode == "row" and tag in ("td", "th"):
            self.clear_to(("tr", "template"))
            self.push(tag, attrs)
            self.active.append(None)
            self.mode = "cell"
            return True
        if mode == "row" and tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if self.in_table_scope(("tr",)):
                self.clear_to(("tr", "template"))
                self.stack.pop()
                self.mode = "tbody"
                self.start(tag, attrs, closed)
            return True
        if mode == "tbody":
            if tag == "tr":
                self.clear_to(("tbody", "tfoot", "thead", "template"))
                self.push(tag, attrs)
                self.mode = "row"
                return True
            if tag in ("td", "th"):
                self.start("tr", {}, False)
                self.start(tag, attrs, closed)
                return True
            if tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
                if self.in_table_scope(("tbody", "thead", "tfoot")):
                    self.clear_to(("tbody", "tfoot", "thead", "template"))
                    self.stack.pop()
                    self.mode = "table"
                    self.start(tag, attrs, closed)
                return True
        if mode == "table":
            if tag == "caption":
                self.clear_to(("table", "template"))
                self.active.append(None)
                self.push(tag, attrs)
                self.mode = "caption"
                return True
            if tag == "colgroup":
                self.clear_to(("table", "template"))
                self.push(tag, attrs)
                self.mode = "colgroup"
                return True
            if tag == "col":
                self.start("colgroup", {}, False)
                self.start(tag, attrs, closed)
                return True
            if tag in ("tbody", "tfoot", "thead"):
                self.clear_to(("table", "template"))
                self.push(tag, attrs)
                self.mode = "tbody"
                return True
            if tag in ("td", "th", "tr"):
                self.start("tbody", {}, False)
                self.start(tag, attrs, closed)
                return True
        if tag == "table":
            if self.in_table_scope(("table",)):
                self.pop_until(("table",))
                self.reset()
                self.start(tag, attrs, closed)
            return True
        if tag in ("style", "script", "template"):
            self._head_tag(tag, attrs)
            return True
        if tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.push(tag, attrs, keep=False)
            return True
        if tag == "form":
            if self.form is None:
                self.form = self.push(tag, attrs, keep=False)
            return True
        self.foster = True
        self._body_start(tag, attrs, closed)
        self.foster = False
        return True

    def _close_cell(self) -> None:
        self.imply()
        self.pop_until(("td", "th"))
        self.clear_marker()
        self.mode = "row"

    def end(self, tag: str) -> None:
        self.drop_newline = False
        if self.foreign():
            for k in range(len(self.stack) - 1, 0, -1):
                n = self.stack[k]
                if n.ns == "html":
                    break
                if n.tag.lower() == tag:
                    del self.stack[k:]
                    return
            if tag in ("br", "p"):
                while self.foreign():
                    self.stack.pop()
        mode = self.mode
        if mode in ("initial", "before html", "before head", "head", "after head"):
            if mode == "head" and tag == "head":
                self.leave_head()
            elif tag in ("body", "html", "br"):
                self.need_body()
                self.end(tag)
            elif tag == "template" and mode == "head":
                self.pop_until(("template",))
            return
        if tag == "template":
            if any(n.tag == "template" for n in self.stack):
                self.pop_until(("template",))
                self.clear_marker()
                self.reset()
                if not any(n.tag in ("body", "frameset") for n in self.stack) and not self.fragment:
                    self.mode = "head" if self.head in self.stack else "after head"
            return
        if mode == "frameset":
            if tag == "frameset" and len(self.stack) > 1:
                self.stack.pop()
            return
        if mode in ("after body", "after after"):
            if tag == "html":
                self.mode = "after after"
                return
            self.mode = mode = "body"
        if tag in ("body", "html"):
            if mode == "body" and self.in_scope(("body",)) or self.in_scope(("body",)):
                self.mode = "after body"
            return
        if mode == "select":
            if tag == "select":
                self.pop_until(("select",))
                self.reset()
            elif tag in ("option", "optgroup"):
                if tag == "optgroup" and self.top.tag == "option" and self.stack[-2].tag == "optgroup":
                    self.stack.pop()
                if self.top.tag == tag:
                    self.stack.pop()
            elif tag in _TABLE_PARTS or tag == "table":
                if self.in_table_scope((tag,)):
                    self.pop_until(("select",))
                    self.reset()
                    self.end(tag)
            return
        if mode in ("table", "tbody", "row", "cell", "caption", "colgroup") and self._table_end(tag):
            return
        self._body_end(tag)

    def _table_end(self, tag: str) -> bool:
        mode = self.mode
        if mode == "cell":
            if tag in ("td", "th"):
                if self.in_table_scope((tag,)):
                    self.imply()
                    self.pop_until((tag,))
                    self.clear_marker()
                    self.mode = "row"
                return True
            if tag in ("table", "tbody", "tfoot", "thead", "tr"):
                if self.in_table_scope((tag,)):
                    self._close_cell()
                    self.end(tag)
                return True
            return tag in ("caption", "col", "colgroup")
        if mode == "caption":
            if tag in ("caption", "table"):
                if self.in_table_scope(("caption",)):
                    self.imply()
                    self.pop_until(("caption",))
                    self.clear_marker()
                    self.mode = "table"
                    if tag == "table":
                        self.end(tag)
                return True
            return tag in _TABLE_PARTS
        if mode == "colgroup":
            if tag == "colgroup":
                if self.top.tag == "colgroup":
                    self.stack.pop()
                    self.mode = "table"
                return True
            if tag == "col":
                return True
            if self.top.tag == "colgroup":
                self.stack.pop()
            self.mode = "table"
            self.end(tag)
            return True
        if mode == "row" and tag in ("tr", "table", "tbody", "tfoot", "thead"):
            if self.in_table_scope((tag,)) and self.in_table_scope(("tr",)):
                self.clear_to(("tr", "template"))
                self.stack.pop()
                self.mode = "tbody"
                if tag != "tr":
                    self.end(tag)
            return True
        if mode == "tbody" and tag in ("tbody", "tfoot", "thead", "table"):
            if self.in_table_scope((tag,)):
                self.clear_to(("tbody", "tfoot", "thead", "template"))
                self.stack.pop()
                self.mode = "table"
                if tag == "table":
                    self.end(tag)
            return True
        if mode == "table" and tag == "table":
            if self.in_table_scope(("table",)):
                self.pop_until(("table",))
                self.reset()
            return True
        if tag in _TABLE_PARTS or tag in ("body", "html"):
            return True
        self.foster = True
        self._body_end(tag)
        self.foster = False
        return True

    def _body_end(self, tag: str) -> None:
        if tag == "p":
            if not self.in_scope(("p",), ("button",)):
                self.push("p", {})
            self.imply("p")
            self.pop_until(("p",))
        elif tag == "br":
            self.reconstruct()
            self.push("br", {}, keep=False)
        elif tag in _BLOCKS or tag in ("button", "listing", "pre", "select"):
            if self.in_scope((tag,)):
                self.imply()
                self.pop_until((tag,))
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and any(n is node for n in self.stack) and self.in_scope(("form",)):
                self.imply()
                self.stack = _Open(n for n in self.stack if n is not node)
        elif tag in ("li", "dd", "dt"):
            if self.in_scope((tag,), ("ol", "ul") if tag == "li" else ()):
                self.imply(tag)
                self.pop_until((tag,))
        elif tag in _HEADINGS:
            if self.in_scope(_HEADINGS):
                self.imply()
                self.pop_until(_HEADINGS)
        elif tag in _FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope((tag,)):
                self.imply()
                self.pop_until((tag,))
                self.clear_marker()
        else:
            self.any_end(tag)

    # -- input ---------------------------------------------------------
    def feed(self, source: str) -> Node:
        source = source.replace("\r\n", "\n").replace("\r", "\n")
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self.text(_text(source[at:]))
                break
            following = source[lt + 1 : lt + 2]
            if not (following.isascii() and following.isalpha() or following in ("!", "/", "?")) or not following:
                nxt = source.find("<", lt + 1)
                stop = size if nxt < 0 else nxt
                self.text(_text(source[at:stop]))
                at = stop
                continue
            if lt > at:
                self.text(_text(source[at:lt]))
            at = self._markup(source, lt, following)
        self.need_body() if not self.fragment else None
        return self.doc

    def _markup(self, source: str, lt: int, following: str) -> int:
        size = len(source)
        if source.startswith("<!--", lt):
            if source.startswith(">", lt + 4) or source.startswith("->", lt + 4):
                self.comment("")
                return source.index(">", lt + 4) + 1
            m = re.compile(r"--!?>").search(source, lt + 4)
            self.comment(source[lt + 4 : m.start() if m else size])
            return m.end() if m else size
        if following == "!":
            stop = source.find(">", lt)
            stop = size if stop < 0 else stop
            if source[lt + 2 : lt + 9].lower() == "doctype":
                if self.mode == "initial":
                    self.mode = "before html"
            elif source.startswith("<![CDATA[", lt) and self.foreign():
                end = source.find("]]>", lt)
                self.put_text(source[lt + 9 : size if end < 0 else end])
                return size if end < 0 else end + 3
            else:
                self.comment(source[lt + 2 : stop])
            return stop + 1
        if following == "?":
            stop = source.find(">", lt)
            stop = size if stop < 0 else stop
            self.comment(source[lt + 1 : stop])
            return stop + 1
        closing = following == "/"
        m = _NAME.match(source, lt + 1 + closing)
        if not m:  # an end tag without a name
            if source.startswith("</>", lt):
                return lt + 3
            stop = source.find(">", lt)
            stop = size if stop < 0 else stop
            self.comment(source[lt + 2 : stop])
            return stop + 1
        tag, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        closed = False
        while True:
            gap = _GAP.match(source, at)
            at = gap.end()
            if at >= size:
                return size  # an unfinished tag is dropped
            if source[at] == ">":
                closed = gap[0].endswith("/")
                at += 1
                break
            a = _ATTR.match(source, at)
            at = a.end()
            value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
            if a[1]:
                attrs.setdefault(a[1].lower().replace("\0", "�"), _attr_text(value))
            elif a.end() == a.start():
                at += 1
        if closing:
            self.end(tag)
            return at
        self.start(tag, dict(sorted(attrs.items())), closed)
        if not self.stack:
            return at
        top = self.top
        if top.ns == "html" and top.tag == tag and (tag in _RAWTEXT or tag in _RCDATA) and not top.children:
            end = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I)
            m = end.search(source, at)
            if tag == "script" and m:
                m = _script_end(source, at, end) or m
            stop = m.start() if m else size
            raw = source[at:stop].replace("\0", "�")
            if self.drop_newline and raw.startswith("\n"):
                raw = raw[1:]
            self.drop_newline = False
            raw = _text(raw) if tag in _RCDATA else raw
            if raw:
                top.append(Node(TEXT, data=raw))
            self.stack.pop()
            if not m:
                return size
            close = source.find(">", m.end())
            return size if close < 0 else close + 1
        if top.tag == "plaintext" and tag == "plaintext":
            self.put_text(source[at:])
            return size
        return at


def _script_end(source: str, at: int, end: re.Pattern) -> re.Match | None:
    """End of a script whose text opens a comment that holds another script."""
    inside = False
    for m in re.compile(r"<!--|-->|<script(?=[\t\n\f\r />])|</script(?=[\t\n\f\r />])", re.I).finditer(source, at):
        x = m[0].lower()
        if x == "<!--":
            inside = inside or "open"
        elif x == "-->":
            inside = False
        elif x == "<script":
            inside = "nested" if inside else inside
        elif inside == "nested":
            inside = "open"
        else:
            return end.match(source, m.start())
    return None


def parse_document(source: str) -> Node:
    return Builder().feed(source)


def parse_fragment(source: str) -> Node:
    """A document whose ``html`` element holds the fragment's nodes."""
    return Builder(fragment=True).feed(source)
