"""URL filters: pattern rules found through their rarest literal token.

A rule is ``(action, host, path)``: it fits a URL whose host is ``host`` or a
subdomain of it and whose path starts with ``path``.  Every rule is filed under
one literal token that any fitting URL must contain: of its whole tokens, the one
that the fewest URLs of the table have.  A URL's own tokens then fetch the
candidate rules, and only those run their regular expression.  Rules without a
whole token are candidates for every URL.

The index is a literal in the plan: an array of small maps, into which a token's checksum
points, so a look-up takes as long with many rules as with few.  It works inside a row, so
there is no join, no shuffle of pages and no skew: a hot host costs nothing extra.

Cases: a null URL or one without ``://`` has empty host and path, fits no rule and
gets the default verdict.  Repeated rows each get their verdict.  Of several
fitting rules the longest ``host + path`` wins, then the longer host, then block
before allow, then the earlier in the list.  An empty table gives an empty result.
Other columns of the input are not read, whatever they are called.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    action: str  # "allow" or "block"
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        """Java regular expression over ``host + path``; a host holds no slash."""
        quoted = "".join(c if c.isalnum() and c.isascii() else "\\" + c if c.isascii() and not c.isspace() else f"\\x{{{ord(c):x}}}" for c in self.text)
        return rf"(?s)\A(?:[^/]*\.)?{quoted}"

    def tokens(self) -> list[str]:
        """Tokens that a fitting URL has as whole tokens: the last may go on in the URL, if the rule ends in it."""
        return [m[0] for m in _TOKEN.finditer(self.text) if m.end() < len(self.text)]


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(target, "[^A-Za-z0-9]+"))


def token_counts(targets: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many rows of ``targets(target)`` each of the rules' tokens occurs; as many results as rule tokens."""
    if not tokens:
        return {}
    found = F.filter(_tokens(F.col("target")), lambda t: F.size(_looked_up(_index({t: [0] for t in tokens}), t)) > 0)
    rows = targets.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in rows}


def _literal(value: object, kind: str) -> Column:
    """A literal of any size: read from JSON once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _index(filed: dict[str, list[int]]) -> tuple[Column, int]:
    """Maps of token -> numbers, one per remainder of the tokens' checksums, and how many they are."""
    slots = 1 << max(0, len(filed) - 1).bit_length()
    maps: list[dict[str, list[int]]] = [{} for _ in range(slots)]
    for token, numbers in sorted(filed.items()):
        maps[zlib.crc32(token.encode()) % slots][token] = numbers
    return _literal(maps, "array<map<string,array<int>>>"), slots


def _looked_up(index: tuple[Column, int], token: Column) -> Column:
    maps, slots = index
    return F.coalesce(F.try_element_at(F.get(maps, F.pmod(F.crc32(token.cast("binary")), F.lit(slots)).cast("int")), token), F.array().cast("array<int>"))


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> numbers of the rules filed under it; numbers of the rules that have no whole token."""
    filed: dict[str, list[int]] = {}
    always: list[int] = []
    for k, rule in enumerate(rules):
        own = sorted(set(rule.tokens()), key=lambda t: (counts.get(t, 0), -len(t), t))
        (filed.setdefault(own[0], []) if own else always).append(k)
    return filed, always


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """Columns ``keep``, then host, path, rule (its text or null), verdict and n_candidates, for every row.

    ``rules`` is a parameter held by the driver and shipped inside the plan.
    """
    rows = pages.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(keep)], F.col(url).alias("__url"))
    rows = rows.withColumns({"__host": url_host(F.col("__url")), "__path": url_path(F.col("__url"))})
    target = F.concat("__host", "__path")
    names = sorted({t for r in rules for t in r.tokens()})
    counts = token_counts(rows.select(target.alias("target")), names)
    filed, always = index_rules(rules, counts)

    number = F.lit(None).cast("int")
    none = F.array().cast("array<int>")
    if filed:
        index = _index(filed)
        found = F.flatten(F.transform(_tokens(target), lambda t: _looked_up(index, t)))
    else:
        found = none
    candidates = F.concat(found, _literal(always, "array<int>")) if always else found
    if rules:
        order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), -len(rules[k].host), rules[k].action != "block", k))
        at = {k: n for n, k in enumerate(order)}
        place, by_place = _literal([at[k] for k in range(len(rules))], "array<int>"), _literal(order, "array<int>")
        patterns = _literal([r.regex() for r in rules], "array<string>")
        fits = F.filter("__candidates", lambda k: F.regexp_like(F.concat("__host", "__path"), F.get(patterns, k)))
        number = F.get(by_place, F.array_min(F.transform(fits, lambda k: F.get(place, k))))
    rows = rows.withColumn("__candidates", candidates).withColumn("__rule", number)
    texts, actions = _literal([r.text for r in rules], "array<string>"), _literal([r.action for r in rules], "array<string>")
    return rows.select(
        *[F.col(f"__{k}").alias(c) for k, c in enumerate(keep)],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.get(texts, F.col("__rule")).alias("rule"),
        F.coalesce(F.get(actions, F.col("__rule")), F.lit(default)).alias("verdict"),
        F.size("__candidates").cast("long").alias("n_candidates"),
    )
