"""Absolute and relative URLs as browsers read them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote

#: Ports that go without saying.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_SAFE_PATH = "/:@!$&'()*+,;=-._~%|[]^\\"
_SAFE_QUERY = "/:@!$&()*+,;=-._~%|[]^\\?`{}"
_SAFE_FRAGMENT = "/:@!$&'()*+,;=-._~%|[]^\\?{}#"


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str  # with user and port; empty for schemes without a host
    path: str
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    @property
    def hostname(self) -> str:
        host = self.host.rpartition("@")[2]
        return re.sub(r":\d*\Z", "", host)

    @property
    def port(self) -> str | None:
        m = re.search(r":(\d+)\Z", self.host)
        return m[1] if m else None

    def __str__(self) -> str:
        head = f"{self.scheme}:" if self.opaque else f"{self.scheme}://{self.host}"
        return head + self.path + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for k, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        last = k == len(parts) - 1
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def _split(s: str) -> tuple[str, str | None, str | None]:
    s, mark, fragment = s.partition("#")
    s, ask, query = s.partition("?")
    return s, (quote(query, safe=_SAFE_QUERY) if ask else None), (quote(fragment, safe=_SAFE_FRAGMENT) if mark else None)


def _host(raw: str, scheme: str) -> str | None:
    user, at, host = raw.rpartition("@")
    host, colon, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    if not host or re.search(r"[\s<>^|%#?\\/]", host) or (port and not port.isdigit()):
        return None
    try:
        host = host.lower() if host.isascii() else host.lower().encode("idna").decode()
    except UnicodeError:
        return None
    return user + at + host + (f":{port}" if port and port != PORTS.get(scheme) else "")


def parse(raw: str, base: Url | None = None) -> Url | None:
    """The URL, relative to ``base`` if there is one; None if it is none."""
    s = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = _SCHEME.match(s)
    if m:
        scheme, rest = m[1].lower(), s[m.end() :]
        if scheme not in PORTS:
            path, query, fragment = _split(rest)
            if path.startswith("//"):
                host, slash, tail = path[2:].partition("/")
                return Url(scheme, host, slash + tail, query, fragment)
            return Url(scheme, "", path, query, fragment, opaque=True)
        if base is None or rest.startswith(("//", "\\")) or scheme != base.scheme:
            return _absolute(scheme, rest.replace("\\", "/").lstrip("/"))
        s = rest
    if base is None or base.opaque and not s.startswith("#"):
        return None
    path, query, fragment = _split(s)
    path = path.replace("\\", "/")
    if path.startswith("//"):
        return _absolute(base.scheme, s.replace("\\", "/", 2).lstrip("/"))
    path = quote(path, safe=_SAFE_PATH)
    if path.startswith("/"):
        return Url(base.scheme, base.host, _dots(path), query, fragment)
    if path:
        return Url(base.scheme, base.host, _dots(base.path.rpartition("/")[0] + "/" + path), query, fragment)
    return Url(base.scheme, base.host, base.path, base.query if query is None else query, fragment, base.opaque)


def _absolute(scheme: str, rest: str) -> Url | None:
    path, query, fragment = _split(rest)
    raw, slash, tail = path.replace("\\", "/").partition("/")
    host = _host(raw, scheme)
    return None if host is None else Url(scheme, host, _dots("/" + quote(tail, safe=_SAFE_PATH)), query, fragment)
