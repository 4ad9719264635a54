"""Trees as arrays, for many questions about elements of a tree that does not change meanwhile.

What lies below an element is a range of elements and a range of the text, so counts below it are two
look-ups in sorted lists, and what its ancestors are is handed down once.  Building takes one walk;
no question takes a walk up or down, however deep the tree is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from .dom import _WORDS, ELEMENT, TEXT, Node, _changes

Test = Callable[[Node], bool]


class Index:
    def __init__(self, top: Node):
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        self.start: list[int] = []  # text below element k: from start[k] to stop[k]
        self.stop: list[int] = []
        self.last: list[int] = []  # elements below element k: from k + 1 up to last[k]
        parts: list[str] = []
        at, path, todo = 0, [-1], [top]
        while todo:
            n = todo.pop()
            if n.__class__ is int:
                self.stop[n], self.last[n] = at, len(self.nodes)
                path.pop()
            elif n.kind == TEXT:
                parts.append(n.data)
                at += len(n.data)
            elif n.kind == ELEMENT or n is top:
                k = len(self.nodes)
                self.nodes.append(n)
                self.parent.append(path[-1])
                self.start.append(at)
                self.stop.append(at)
                self.last.append(k + 1)
                if n.children:
                    path.append(k)
                    todo.append(k)
                    todo += n.children[::-1]
        self.text = "".join(parts)
        self._hits: dict = {}
        self._handed: dict = {}
        self._spans: tuple[list[int], list[int]] | None = None
        self._octets: list[int] | None = None
        self._links: tuple[list[int], list[int]] | None = None
        self._places: dict[re.Pattern, list[int]] = {}
        self._tags: dict[str, list[int]] | None = None

    def spans(self) -> tuple[list[int], list[int]]:
        """Starts and ends of the words of the text."""
        if self._spans is None:
            found = [m.span() for m in _WORDS.finditer(self.text)]
            self._spans = [a for a, _ in found], [b for _, b in found]
        return self._spans

    def words(self, a: int, b: int) -> int:
        starts, ends = self.spans()
        first = bisect_left(starts, a)
        return bisect_left(starts, b) - first + (first > 0 and ends[first - 1] > a and a < b)

    def octets(self, at: int) -> int:
        """Bytes of the text before a place."""
        if self.text.isascii():
            return at
        starts, _ = self.spans()
        if self._octets is None:
            cuts = [0, *starts]
            self._octets = [0, *accumulate(len(self.text[x:y].encode()) for x, y in zip(cuts, starts))]
        k = bisect_right(starts, at)
        return self._octets[k] + len(self.text[starts[k - 1] if k else 0 : at].encode())

    def size(self, k: int) -> int:
        """Bytes of the trimmed text below element k."""
        a, b = self.start[k], self.stop[k]
        starts, ends = self.spans()
        first, last = bisect_left(starts, a), bisect_left(starts, b) - 1
        begins = a if first > 0 and ends[first - 1] > a else starts[first] if first < len(starts) and starts[first] < b else b
        return self.octets(min(ends[last], b)) - self.octets(begins) if begins < b else 0

    def tagged(self, tag: str) -> list[int]:
        if self._tags is None:
            self._tags = {}
            for k, n in enumerate(self.nodes):
                self._tags.setdefault(n.tag, []).append(k)
        return self._tags.get(tag, [])

    def links(self) -> tuple[list[int], list[int]]:
        """Places of links, and the bytes of the texts of all links before each."""
        if self._links is None:
            places = self.tagged("a")
            self._links = places, [0, *accumulate(self.size(k) for k in places)]
        return self._links

    def places(self, pattern: re.Pattern) -> list[int]:
        """Where in the text a pattern is found."""
        if pattern not in self._places:
            self._places[pattern] = [m.start() for m in pattern.finditer(self.text)]
        return self._places[pattern]

    def hits(self, test: Test) -> list[int]:
        """Places of the elements that pass a test."""
        if test not in self._hits:
            self._hits[test] = [k for k, n in enumerate(self.nodes) if n.kind == ELEMENT and test(n)]
        return self._hits[test]

    def handed(self, test: Test) -> bytearray:
        """For each element, whether it or an ancestor passes a test."""
        if test not in self._handed:
            flags = bytearray(len(self.nodes))
            for k in self.hits(test):
                if not flags[k]:
                    flags[k : self.last[k]] = b"\1" * (self.last[k] - k)
            self._handed[test] = flags
        return self._handed[test]


class View:
    """An element in its index."""

    __slots__ = ("index", "k", "node")

    def __init__(self, index: Index, k: int, node: Node):
        self.index, self.k, self.node = index, k, node

    @property
    def text(self) -> str:
        return self.index.text[self.index.start[self.k] : self.index.stop[self.k]]

    @property
    def words(self) -> int:
        return self.index.words(self.index.start[self.k], self.index.stop[self.k])

    @property
    def size(self) -> int:
        return self.index.size(self.k)

    @property
    def octets(self) -> int:
        """Bytes of the text below, as it is."""
        return self.index.octets(self.index.stop[self.k]) - self.index.octets(self.index.start[self.k])

    def holds(self, part: str) -> bool:
        return self.index.text.find(part, self.index.start[self.k], self.index.stop[self.k]) >= 0

    def marks(self, pattern: re.Pattern) -> int:
        """How often a pattern is found that starts in the text below."""
        found = self.index.places(pattern)
        return bisect_left(found, self.index.stop[self.k]) - bisect_left(found, self.index.start[self.k])

    def finds(self, pattern: re.Pattern, part: re.Pattern) -> bool:
        """Whether a pattern is found in the text; ``part`` is found wherever it is, so that most texts are not searched."""
        return self.marks(part) > 0 and pattern.search(self.text) is not None

    def matches(self, pattern: re.Pattern) -> bool:
        """Whether the text starts with a pattern that looks at nothing around it."""
        return pattern.match(self.index.text, self.index.start[self.k], self.index.stop[self.k]) is not None

    def _range(self, places: list[int]) -> tuple[int, int]:
        return bisect_left(places, self.k + 1), bisect_left(places, self.index.last[self.k])

    def count(self, *tags: str) -> int:
        """Elements below with one of the tags."""
        return sum(b - a for a, b in (self._range(self.index.tagged(t)) for t in tags))

    def below(self, test: Test) -> bool:
        """Whether an element below passes the test; a test is asked once for each element of the tree."""
        a, b = self._range(self.index.hits(test))
        return b > a

    def above(self, test: Test) -> bool:
        up = self.index.parent[self.k]
        return up >= 0 and bool(self.index.handed(test)[up])

    def within(self, test: Test) -> bool:
        """Whether the element or one above it passes the test."""
        return bool(self.index.handed(test)[self.k])

    def inside(self, other: View) -> bool:
        return other.index is self.index and other.k < self.k < other.index.last[other.k]

    @property
    def link_density(self) -> float:
        """Bytes of link texts over bytes of the text, both trimmed."""
        total = self.size
        if not total:
            return 0.0
        places, sums = self.index.links()
        a, b = self._range(places)
        return (sums[b] - sums[a]) / total


class Forest:
    """Views of elements of any trees; indexes are made when first asked for, and anew after a change."""

    def __init__(self):
        self._version, self._where = -1, {}

    def view(self, node: Node) -> View:
        if self._version != _changes[0]:
            self._version, self._where = _changes[0], {}
        found = self._where.get(id(node))
        if found is None:
            top = node
            while top.parent is not None:
                top = top.parent
            index = Index(top)
            self._where.update((id(n), (index, k)) for k, n in enumerate(index.nodes))
            found = self._where[id(node)]
        return View(*found, node)
