"""schema.org data of a page: JSON-LD scripts, cleaned, decoded and flattened."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from .css import select
from .dom import Node, trim

_NOISE = re.compile(r'"(?:\\.|[^"\\])*"?|//[^\n]*\n?|/\*.*?(?:\*/|\Z)', re.S)
_NUMBER = re.compile(r"&#([xX]?)([0-9a-fA-F]+);")


def without_comments(text: str) -> str:
    """JSON without a CDATA wrapper and without comments outside strings."""
    text = trim(trim(text).removeprefix("<![CDATA["))
    text = trim(text.removesuffix("]]>"))
    return _NOISE.sub(lambda m: m[0] if m[0][0] == '"' else "", text)


def _character(m: re.Match) -> str:
    digits = m[2].lstrip("0") or "0"
    if len(digits) > 8 or not (m[1] or digits.isdigit()):
        return m[0]
    code = int(digits, 16 if m[1] else 10)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def _decode(text: str) -> str:
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = text.replace(name, char)
    return _NUMBER.sub(_character, text)


def _decoded(value: Any) -> Any:
    if isinstance(value, str):
        return _decode(value)
    if isinstance(value, list):
        return [_decoded(v) for v in value]
    if isinstance(value, dict):
        return {k: _decoded(v) for k, v in value.items()}
    return value


def _items(value: Any) -> list[dict]:
    if isinstance(value, list):
        return [x for v in value for x in _items(v)]
    if not isinstance(value, dict):
        return []
    graph = value.get("@graph")
    if not isinstance(graph, list):
        return [value]
    rest = {k: v for k, v in value.items() if k != "@graph"}
    return [*graph, *([rest] if rest.keys() - {"@context"} else [])]


def _reject(name: str) -> Any:
    raise ValueError(name)


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _reject(text)


def _integer(text: str) -> int | float:
    """Whole numbers of 64 bits; others are floating-point numbers."""
    value = int(text) if len(text) <= 20 else None
    return value if value is not None and -(1 << 63) <= value < 1 << 64 else _finite(text)


def parsed(text: str) -> Any:
    """JSON without lone surrogates, non-finite numbers or constants beyond the standard; ValueError for those."""
    value = json.loads(text, parse_constant=_reject, parse_float=_finite, parse_int=_integer)
    if "\\u" in text:
        json.dumps(value, ensure_ascii=False).encode()  # UnicodeEncodeError, a ValueError, for a lone surrogate
    return value


def schema_data(doc: Node) -> Any:
    """None, the one item, or the list of items of all scripts that parse."""
    items: list = []
    for script in select(doc, 'script[type="application/ld+json"]'):
        try:
            items += _items(_decoded(parsed(without_comments(script.text()))))
        except (ValueError, RecursionError):
            continue
    return None if not items else items[0] if len(items) == 1 else items


def each(data: Any) -> list[Any]:
    """The data itself, then its items if it is a list."""
    return [] if data is None else [data, *data] if isinstance(data, list) else [data]


def text_at(data: Any, path: str) -> str | None:
    """The first non-blank string at a dotted path of the data or its items."""
    for item in each(data):
        for key in path.split("."):
            item = item.get(key) if isinstance(item, dict) else None
        if isinstance(item, str) and trim(item):
            return trim(item)
    return None


def article_text(data: Any) -> str | None:
    for item in data if isinstance(data, list) else [data]:
        for key in ("text", "articleBody"):
            if isinstance(item, dict) and isinstance(item.get(key), str) and item[key]:
                return item[key]
    return None


def property_at(data: Any, path: str) -> str | None:
    """A string, number or truth value at a path where ``[]`` steps into lists; else anywhere below."""
    steps = path.split(".")

    def leaf(v: Any) -> str | None:
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (str, int, float)) else None

    def walk(v: Any, k: int) -> str | None:
        if k == len(steps):
            return leaf(v)
        if steps[k] == "[]":
            return next((r for x in v if (r := walk(x, k + 1)) is not None), None) if isinstance(v, list) else None
        return walk(v[steps[k]], k + 1) if isinstance(v, dict) and steps[k] in v else None

    def search(v: Any) -> str | None:
        found = walk(v, 0) if isinstance(v, dict) else None
        if found is not None:
            return found
        below = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        return next((r for x in below if (r := search(x)) is not None), None)

    found = walk(data, 0)
    return found if found is not None else search(data)
