"""Scalar text functions of pages."""

from __future__ import annotations

import re

from .dom import count_words, trim

#: Entities that plain text knows.
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…", "copy": "©", "reg": "®", "trade": "™", "eacute": "é", "egrave": "è", "agrave": "à",
    "uuml": "ü", "ouml": "ö", "auml": "ä", "ccedil": "ç", "ntilde": "ñ", "szlig": "ß", "laquo": "«", "raquo": "»", "sect": "§", "deg": "°",
    "times": "×", "divide": "÷", "minus": "−", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
}
_TAG, _OPEN = re.compile(r"<[^>]*>"), re.compile(r"<[^>]*\Z")
_ENTITY = re.compile(r"&([^;]{0,11});|&[^;]{0,12}", re.S)
_PAIR = re.compile(r"(?i)&#(?:x(d[89ab][0-9a-f]{2})|(5[56]\d{3}));((?:<[^>]*>)*)&#(?:x(d[c-f][0-9a-f]{2})|(5[67]\d{3}));")
_COMMENT = re.compile(r"<!--(.*?)-->", re.S)


def strip_tags(html: str) -> str:
    """Tags become a space each; so does a stray ``>``; an unclosed ``<`` takes the rest along."""
    return _OPEN.sub("", _TAG.sub(">", html)).replace(">", " ")


def _char(name: str) -> str | None:
    if name[:2] in ("#x", "#X"):
        digits, base = name[2:], 16
    elif name[:1] == "#":
        digits, base = name[1:], 10
    else:
        return ENTITIES.get(name)
    digits = digits.removeprefix("+")
    try:
        code = int(digits, base) if digits.isascii() and digits.isalnum() else -1
    except ValueError:
        return None
    return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def decode_entities(text: str) -> str:
    """Known entities as characters; what was looked at as a name is not looked at again."""

    def sub(m: re.Match) -> str:
        found = _char(m[1]) if m[1] is not None else None
        return m[0] if found is None else found

    return _ENTITY.sub(sub, text)


def strip_html_tags(html: str) -> str:
    return decode_entities(strip_tags(html))


def count_words_html(html: str) -> int:
    return count_words(strip_html_tags(html))


def hide_comment_tags(html: str) -> str:
    """Angle brackets inside closed comments become U+FFFD."""
    return _COMMENT.sub(lambda m: "<!--" + m[1].replace("<", "�").replace(">", "�") + "-->", html)


def join_surrogates(html: str) -> str:
    """A high and a low surrogate reference, with only tags between, become the tags and the character."""

    def sub(m: re.Match) -> str:
        high = int(m[1], 16) if m[1] else int(m[2])
        low = int(m[4], 16) if m[4] else int(m[5])
        if not (0xD800 <= high < 0xDC00 <= low < 0xE000):
            return m[0]
        return m[3] + chr(((high - 0xD800) << 10) + low - 0xDC00 + 0x10000)

    return _PAIR.sub(sub, html)


def prepare(html: str) -> str:
    return join_surrogates(hide_comment_tags(html))


def integer(text: str | None, most: int = (1 << 64) - 1) -> int | None:
    """An unsigned decimal number, a plus sign allowed; None for anything else and above ``most``."""
    digits = text.removeprefix("+") if text is not None else ""
    if not (digits.isascii() and digits.isdigit()) or len(digits.lstrip("0")) > 20:
        return None
    value = int(digits.lstrip("0") or "0")
    return value if value <= most else None


def error_text(e: Exception) -> str:
    """Kind and message of an error, short and without anything that Arrow can't hold."""
    return f"{type(e).__name__}: {e}"[:300].encode(errors="replace").decode()


def html_escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def first_words(html: str, limit: int) -> str:
    """The first ``limit`` characters of the first paragraph of the text."""
    return trim(trim(strip_html_tags(html)).split("\n\n")[0])[:limit]


def non_empty(s: str | None) -> str | None:
    s = trim(s) if s is not None else None
    return s or None
