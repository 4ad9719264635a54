"""A small mutable HTML tree: nodes, text, serialisation and walks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Elements without an end tag, in output.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DOCUMENT, ELEMENT, TEXT, COMMENT = range(4)
#: Counts changes of any tree, so that lists of elements can be kept while nothing changes.
_changes = [0]


class Node:
    """A document, element, text or comment.  ``data`` is the text of the last two."""

    __slots__ = ("kind", "tag", "ns", "attrs", "data", "parent", "children", "flag", "listed")

    def __init__(self, kind: int, tag: str = "", attrs: dict[str, str] | None = None, data: str = "", ns: str = "html"):
        self.kind, self.tag, self.ns, self.data = kind, tag, ns, data
        self.attrs = attrs if attrs is not None else {}
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.flag = False
        self.listed: tuple[int, list[Node]] | None = None

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    @property
    def is_element(self) -> bool:
        return self.kind == ELEMENT

    # -- reading -------------------------------------------------------
    def walk(self) -> Iterator[Node]:
        """The nodes below, in document order, as they are when the walk starts below each."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack.extend(node.children[::-1])

    def elements(self, *tags: str) -> list[Node]:
        """Elements below, in document order; with ``tags`` only those.  The list is shared: it is not to be changed."""
        if self.listed is None or self.listed[0] != _changes[0]:
            found: list[Node] = []
            stack = self.children[::-1]
            while stack:
                node = stack.pop()
                if node.kind == ELEMENT:
                    found.append(node)
                    if node.children:
                        stack += node.children[::-1]
            self.listed = (_changes[0], found)
        return [n for n in self.listed[1] if n.tag in tags] if tags else self.listed[1]

    def child_elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == ELEMENT]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inside(self, other: Node) -> bool:
        """True for strict descendants of ``other``."""
        return any(a is other for a in self.ancestors())

    @property
    def parent_element(self) -> Node | None:
        return self.parent if self.parent is not None and self.parent.kind == ELEMENT else None

    def index(self) -> int:
        return self.parent.children.index(self)

    def sibling(self, step: int) -> Node | None:
        """Next (1) or previous (-1) sibling that is an element."""
        if self.parent is None:
            return None
        row, k = self.parent.children, self.index() + step
        while 0 <= k < len(row):
            if row[k].kind == ELEMENT:
                return row[k]
            k += step
        return None

    def text(self) -> str:
        """Text of the element and all below; comments have none."""
        if self.kind == TEXT:
            return self.data
        if self.kind not in (ELEMENT, DOCUMENT):
            return ""
        return "".join([n.data for n in self.walk() if n.kind == TEXT])

    # -- changing ------------------------------------------------------
    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None
            _changes[0] += 1

    def append(self, node: Node) -> Node:
        if node.parent is not None:
            node.detach()
        node.parent = self
        self.children.append(node)
        _changes[0] += 1
        return node

    def insert(self, at: int, node: Node) -> Node:
        if node.parent is not None:
            node.detach()
        node.parent = self
        self.children.insert(at, node)
        _changes[0] += 1
        return node

    def before(self, node: Node) -> None:
        """Puts ``node`` before this one."""
        if node.parent is not None:
            node.detach()
        self.parent.insert(self.index(), node)

    def replace(self, node: Node) -> None:
        self.before(node)
        self.detach()

    def unwrap(self) -> None:
        at, up = self.index(), self.parent
        for child in self.children:
            child.parent = up
        up.children[at : at + 1] = self.children
        self.parent, self.children = None, []
        _changes[0] += 1

    def set(self, name: str, value: str) -> None:
        """Sets an attribute; it moves to the end."""
        self.attrs.pop(name, None)
        self.attrs[name] = value

    def copy(self) -> Node:
        twin = Node(self.kind, self.tag, dict(self.attrs), self.data, self.ns)
        todo = [(self, twin)]
        while todo:
            old, new = todo.pop()
            for child in old.children:
                below = Node(child.kind, child.tag, dict(child.attrs), child.data, child.ns)
                below.parent = new
                new.children.append(below)
                if child.children:
                    todo.append((child, below))
        return twin

    def __repr__(self) -> str:
        return f"<{self.tag or self.kind} {self.attrs}>"


def detach_all(nodes: Iterable[Node]) -> None:
    """Detaches all nodes; each parent's row is made anew once."""
    gone = {id(n) for n in nodes}
    for up in {id(n.parent): n.parent for n in nodes if n.parent is not None}.values():
        for c in up.children:
            if id(c) in gone:
                c.parent = None
        up.children = [c for c in up.children if id(c) not in gone]
    _changes[0] += 1


def element(tag: str, attrs: dict[str, str] | None = None, *children: Node | str) -> Node:
    node = Node(ELEMENT, tag, attrs)
    for c in children:
        node.append(text_node(c) if isinstance(c, str) else c)
    return node


def text_node(data: str) -> Node:
    return Node(TEXT, data=data)


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def outer_html(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == TEXT:
            out.append(escape_text(n.data))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.data}-->")
        else:
            if n.kind == ELEMENT:
                out.append("<" + n.tag + "".join([f' {k}="{escape_attr(v)}"' for k, v in n.attrs.items()]) + ">")
                if n.tag in VOID:
                    continue
                todo.append(f"</{n.tag}>")
            todo.extend(n.children[::-1])
    return "".join(out)


def inner_html(node: Node) -> str:
    return "".join([outer_html(c) for c in node.children])


def class_and_id(node: Node) -> str:
    return f"{node.get('class')} {node.get('id')}"


_CJK = "぀-ゟ゠-ヿ㐀-䶿一-鿿豈-﫿가-힯"
#: Unicode white space (the information separators are none).
_WS = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[{_CJK}]|[^{_WS}{_CJK}]+")
#: Characters that trimming takes off.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def count_words(text: str) -> int:
    """Runs of non-space characters; each CJK character is a word."""
    return len(_WORDS.findall(text))


def trim(s: str) -> str:
    return s.strip(WHITE)


def words(s: str) -> list[str]:
    """The text split at Unicode white space."""
    return [w for w in re.split(f"[{_WS}]+", s) if w]


def link_density(node: Node, text: str | None = None) -> float:
    """Bytes of link texts over bytes of the text, both trimmed."""
    total = len(trim(node.text() if text is None else text).encode())
    if not total:
        return 0.0
    return sum(len(trim(a.text()).encode()) for a in node.elements("a")) / total


def link_targets(node: Node) -> list[str]:
    return [a.attrs["href"] for a in node.elements("a") if "href" in a.attrs]


def selector_path(node: Node) -> str:
    """``tag#id`` or ``tag.class`` of the element and its ancestors, joined by " > "."""
    parts = []
    for n in (node, *node.ancestors()):
        if n.kind == ELEMENT:
            first = n.classes[:1]
            parts.append(n.tag + (f"#{n.attrs['id']}" if n.get("id") else f".{first[0]}" if first else ""))
    return " > ".join(parts[::-1])
