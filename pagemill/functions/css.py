"""CSS selectors over the tree of :mod:`pagemill.functions.dom`."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from .dom import DOCUMENT, ELEMENT, Node

Test = Callable[[Node], bool]
_IDENT = r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*|--[\w-]*"
_SIMPLE = re.compile(
    rf"""(?P<tag>\*|{_IDENT})|\#(?P<id>(?:[\w\u0080-\U0010ffff-]|\\.)+)|\.(?P<cls>{_IDENT})
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?P<open>\()?""",
    re.X,
)
#: Attributes whose values HTML compares without case.
_CASELESS = frozenset("type lang dir rel media charset http-equiv method".split())


class SelectorError(ValueError):
    pass


def _attribute(m: re.Match) -> Test:
    name, op = m["attr"].lower(), m["op"]
    if op is None:
        return lambda n: name in n.attrs
    want = next(x for x in (m["dq"], m["sq"], m["bare"]) if x is not None)
    fold = (m["flag"] or "").lower() == "i" or (name in _CASELESS and (m["flag"] or "").lower() != "s")
    if fold:
        want = want.lower()

    def value(n: Node) -> str | None:
        v = n.attrs.get(name)
        return v.lower() if fold and v is not None else v

    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v == want,
        "~=": lambda v: bool(want) and want in v.split(),
        "|=": lambda v: v == want or v.startswith(want + "-"),
        "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want),
        "*=": lambda v: bool(want) and want in v,
    }
    test = tests[op]
    return lambda n: (v := value(n)) is not None and test(v)


def _position(n: Node, same: bool = False, back: bool = False) -> int:
    row = [c for c in n.parent.children if c.kind == ELEMENT and (not same or c.tag == n.tag)] if n.parent else [n]
    k = next(i for i, c in enumerate(row) if c is n)
    return len(row) - k if back else k + 1


def _nth(arg: str) -> Callable[[int], bool]:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        raise SelectorError(arg)
    if m[3]:
        return lambda k: k == int(m[3])
    step = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    first = int(m[2] or 0)
    return lambda k: (k - first) % step == 0 and (k - first) // step >= 0 if step else k == first


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> bool:
        m = re.compile(r"\s*").match(self.text, self.at)
        self.at = m.end()
        return bool(m[0])

    def group(self, closing: bool = False) -> list[Test]:
        out = [self.complex(closing)]
        while self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            out.append(self.complex(closing))
        return out

    def complex(self, closing: bool, relative: bool = False) -> Test:
        self.space()
        first = None
        if relative and self.text[self.at] in ">+~":
            first, self.at = self.text[self.at], self.at + 1
            self.space()
        test = self.compound()
        while True:
            spaced = self.space()
            c = self.text[self.at : self.at + 1]
            if c in ("", ",") or (closing and c == ")"):
                break
            if c in ">+~":
                self.at += 1
                self.space()
            elif spaced:
                c = " "
            else:
                raise SelectorError(self.text)
            test = _combined(test, c, self.compound())
        if relative:
            test.lead = first  # type: ignore[attr-defined]
        return test

    def compound(self) -> Test:
        tests: list[Test] = []
        while m := _SIMPLE.match(self.text, self.at):
            if m["tag"] and tests:
                break
            self.at = m.end()
            if m["tag"]:
                tag = m["tag"].lower()
                tests.append((lambda n: True) if tag == "*" else (lambda n, t=tag: n.tag == t))
            elif m["id"]:
                tests.append(lambda n, v=re.sub(r"\\(.)", r"\1", m["id"]): n.attrs.get("id") == v)
            elif m["cls"]:
                tests.append(lambda n, v=re.sub(r"\\(.)", r"\1", m["cls"]): v in n.classes)
            elif m["attr"]:
                tests.append(_attribute(m))
            else:
                tests.append(self.pseudo(m["pseudo"], bool(m["open"])))
        if not tests:
            raise SelectorError(self.text)
        test = tests[0]
        for more in tests[1:]:
            test = _both(test, more)
        return test

    def pseudo(self, name: str, opened: bool) -> Test:
        if opened and name in ("not", "is", "where", "matches"):
            inner = self.group(closing=True)
            self.close()
            return (lambda n: not any(t(n) for t in inner)) if name == "not" else (lambda n: any(t(n) for t in inner))
        if opened and name == "has":
            inner = [self.complex(True, relative=True)]
            while self.text[self.at : self.at + 1] == ",":
                self.at += 1
                inner.append(self.complex(True, relative=True))
            self.close()
            return lambda n: any(_has(n, t) for t in inner)
        if opened and name.startswith("nth-"):
            end = self.text.index(")", self.at)
            fits = _nth(self.text[self.at : end])
            self.at = end + 1
            return lambda n: fits(_position(n, name.endswith("of-type"), "last" in name))
        fixed: dict[str, Test] = {
            "first-child": lambda n: _position(n) == 1,
            "last-child": lambda n: _position(n, back=True) == 1,
            "only-child": lambda n: _position(n) == 1 == _position(n, back=True),
            "first-of-type": lambda n: _position(n, True) == 1,
            "last-of-type": lambda n: _position(n, True, True) == 1,
            "empty": lambda n: not n.children,
            "root": lambda n: n.parent is not None and n.parent.kind == DOCUMENT,
        }
        if opened or name not in fixed:
            raise SelectorError(self.text)
        return fixed[name]

    def close(self) -> None:
        self.space()
        if self.text[self.at : self.at + 1] != ")":
            raise SelectorError(self.text)
        self.at += 1


def _both(a: Test, b: Test) -> Test:
    return lambda n: a(n) and b(n)


def _combined(left: Test, how: str, right: Test) -> Test:
    if how == ">":
        return lambda n: right(n) and n.parent_element is not None and left(n.parent_element)
    if how == " ":
        return lambda n: right(n) and any(a.kind == ELEMENT and left(a) for a in n.ancestors())
    if how == "+":
        return lambda n: right(n) and (p := n.sibling(-1)) is not None and left(p)

    def after(n: Node) -> bool:
        p = n.sibling(-1)
        while p is not None:
            if left(p):
                return True
            p = p.sibling(-1)
        return False

    return lambda n: right(n) and after(n)


def _has(n: Node, test: Test) -> bool:
    lead = getattr(test, "lead", None)
    if lead == ">":
        return any(test(c) for c in n.child_elements())
    if lead == "+":
        return (s := n.sibling(1)) is not None and test(s)
    return any(test(c) for c in n.elements())


_LAST = re.compile(r"([^\s>+~]*(?:\[[^\]]*\][^\s>+~]*)*)\s*\Z")


@functools.lru_cache(maxsize=4096)
def tags_of(selectors: tuple[str, ...]) -> frozenset[str]:
    """Tags that elements without attributes must have to match one of some selectors that name no element twice."""
    return frozenset(m[0].lower() for s in selectors if (m := re.match(r"[A-Za-z][\w-]*", _LAST.search(s)[1])))


@functools.lru_cache(maxsize=4096)
def compiled(selector: str) -> Test | None:
    """A test for elements, or None if the selector is invalid."""
    try:
        parser = _Parser(selector)
        tests = parser.group()
        parser.space()
        if parser.at != len(selector):
            return None
    except (SelectorError, IndexError, ValueError):
        return None
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests)


@functools.lru_cache(maxsize=4096)
def _likely(selector: str) -> tuple[frozenset[str], bool] | None:
    """(tags, whether elements with attributes may match too); None if any element may match."""
    tags, with_attributes = set(), False
    for one in re.split(r",(?![^\[(]*[\])])", selector):
        last = _LAST.search(one)[1]
        if m := re.match(r"[A-Za-z][\w-]*", last):
            tags.add(m[0].lower())
        elif last[:1] in (".", "#", "["):
            with_attributes = True
        else:
            return None
    return frozenset(tags), with_attributes


def _candidates(root: Node, selector: str) -> list[Node]:
    likely = _likely(selector)
    if likely is None:
        return root.elements()
    tags, with_attributes = likely
    if with_attributes:
        return [n for n in root.elements() if n.attrs or n.tag in tags]
    return [n for n in root.elements() if n.tag in tags]


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that match, in document order; none for an invalid selector."""
    test = compiled(selector)
    return [n for n in _candidates(root, selector) if test(n)] if test else []


def select_one(root: Node, selector: str) -> Node | None:
    test = compiled(selector)
    return next((n for n in _candidates(root, selector) if test(n)), None) if test else None


def matches(node: Node, selector: str) -> bool:
    test = compiled(selector)
    return bool(test) and test(node)
