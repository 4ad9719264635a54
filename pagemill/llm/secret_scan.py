"""Secret scans: probabilistic automata inferred from labelled credentials.

Per credential format, labelled examples give a prefix tree with counts.  States
whose futures are statistically alike (Hoeffding bound on the shares of each next
symbol and of ending, recursively) are merged, red and blue states in turn, which
leaves a small probabilistic automaton.  A background automaton is inferred in the
same way from ordinary strings (words, numbers, slugs, identifiers).  Every
candidate of every text is scored: bits that the best format gives it beyond the
background.  Spans of fixed base patterns are always reported; the automata add
spans that overlap none of them: of a candidate that touches base spans, each part
outside them that is long enough is scored by itself, and all parts are reported if
the whole candidate scores that much more than its base spans do.

Labelled examples are a parameter (:func:`labelled_examples` takes a bounded number from a table); without them they
are drawn by a seeded rule from public formats.  Their number
is a documented bound of the fit and the automata travel with the task.  Added spans that only a
dot parts are one span.  Scanning
is one pass inside a row: no shuffle, no state, whole texts.

Cases: a null text is empty and has no spans; repeated rows are scanned each; very
long texts are one string and take memory in proportion; an empty table gives an
empty result.  Positions count code points, ends are exclusive.  Other columns are
not read by :func:`scan`; :func:`redact` carries all of them.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
ACCESS, ACCESS_CHARS = re.compile(r"AKIA[A-Z0-9]+"), 20
HEX, HEX_CHARS = re.compile(r"[0-9a-f]+"), 24
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "format")
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: A run of hex digits is never reported if shorter, so shorter ones are not looked at.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE, CANDIDATE_CHARS = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Public credential formats: pieces of fixed text, or (characters, least, most).
FORMATS: dict[str, list] = {
    "access_key": ["AKIA", (UPPER + "234567", 16, 16)],
    "forge_token": ["ghp_", (UPPER + LOWER + DIGITS, 36, 36)],
    "chat_token": ["xoxb-", (DIGITS, 10, 13), "-", (DIGITS, 10, 13), "-", (UPPER + LOWER + DIGITS, 24, 24)],
    "cloud_key": ["AIza", (UPPER + LOWER + DIGITS + "-_", 35, 35)],
    "payment_key": ["sk_live_", (UPPER + LOWER + DIGITS, 24, 32)],
    "base64_key": [(UPPER + LOWER + DIGITS + "+/", 40, 64), "=="],
    "hex_key": [(DIGITS + "abcdef", 32, 64)],
}
_SYLLABLES = "an be con der es for ging hal in ki lo ment no or pre qui ra st tion un ver wa".split()


def draw_format(name: str, rng: random.Random) -> str:
    return "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2]))) for p in FORMATS[name])


def draw_background(rng: random.Random) -> str:
    """An ordinary string of candidate characters: words, numbers, slugs, paths, identifiers, dates, UUIDs."""
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 8)))
    number = lambda n=24: "".join(rng.choices(DIGITS, k=rng.randint(1, n)))
    kind = rng.randrange(10)
    if kind == 0:
        return word() + word()
    if kind == 1:
        return number()
    if kind == 2:
        return "-".join([*(word() for _ in range(rng.randint(2, 6))), *[number(4)] * rng.randrange(2)])
    if kind == 3:
        return "/" * rng.randrange(3) + "/".join([*(word() for _ in range(rng.randint(1, 4))), *[number(4), number(2)] * rng.randrange(2), word()])
    if kind == 4:
        return "_".join([*(word() for _ in range(rng.randint(2, 5))), *[number(4)] * rng.randrange(2)])
    if kind == 5:
        return "".join(word().capitalize() for _ in range(rng.randint(2, 5))) + number(3) * rng.randrange(2)
    if kind == 6:
        return (word() + word()).upper()
    if kind == 7:
        return "-".join("".join(rng.choices(DIGITS + "abcdef", k=n)) for n in (8, 4, 4, 4, 12))
    if kind == 8:
        return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(100000, 235959)}Z{number(4)}"
    return rng.choice("=-_+/") * rng.randint(4, 60)


def symbol(c: str) -> str:
    """Class of a character: digits, hex letters, other lower, upper; other characters are their own."""
    return "d" if c in DIGITS else "h" if c in "abcdef" else "l" if c in LOWER else "U" if c in UPPER else c


_SIZE = {"d": 10, "h": 6, "l": 20, "U": 26}


class Automaton:
    """``steps[state][symbol] = (next, log2 share)`` and ``ends[state]``; unseen steps cost ``floor`` bits."""

    def __init__(self, steps: list[dict[str, tuple[int, float]]], ends: list[float], floor: float = -14.0):
        self.steps, self.ends, self.floor = steps, ends, floor

    def bits(self, text: str) -> float:
        """log2 of the probability of ``text``."""
        state, total = 0, 0.0
        for c in text:
            s = symbol(c)
            total -= math.log2(_SIZE.get(s, 1))
            step = self.steps[state].get(s)
            if step is None:
                total += self.floor
            else:
                state, share = step
                total += share
        return total + max(self.floor, self.ends[state])


def infer(samples: Sequence[str], alpha: float = 0.05) -> Automaton:
    """State merging over the prefix tree of ``samples``: a larger ``alpha`` merges less."""
    kids: list[dict[str, int]] = [{}]  # next state by symbol
    flow: list[dict[str, int]] = [{}]  # how often that step is taken
    end = [0]
    for text in samples:
        node = 0
        for s in map(symbol, text):
            if s not in kids[node]:
                kids[node][s] = len(end)
                kids.append({})
                flow.append({})
                end.append(0)
            flow[node][s] = flow[node].get(s, 0) + 1
            node = kids[node][s]
        end[node] += 1
    visits = [e + sum(f.values()) for e, f in zip(end, flow)]
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = visits[p], visits[q]
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(end[p] / n - end[q] / m) > bound:
                return False
            for s in kids[p].keys() | kids[q].keys():
                if abs(flow[p].get(s, 0) / n - flow[q].get(s, 0) / m) > bound:
                    return False
                if s in kids[p] and s in kids[q]:
                    todo.append((kids[p][s], kids[q][s]))
        return True

    def fold(p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            end[p] += end[q]
            visits[p] += visits[q]
            for s, below in kids[q].items():
                flow[p][s] = flow[p].get(s, 0) + flow[q][s]
                if s in kids[p]:
                    todo.append((kids[p][s], below))
                else:
                    kids[p][s] = below

    red = [0]
    while True:
        known = set(red)
        blue = [(-visits[q], r, s) for r in red for s, q in kids[r].items() if q not in known]
        if not blue:
            break
        _, parent, s = min(blue)  # the state with most evidence first
        q = kids[parent][s]
        match = next((p for p in red if alike(p, q)), None)
        if match is None:
            red.append(q)
        else:
            kids[parent][s] = match
            fold(match, q)
    number = {r: k for k, r in enumerate(red)}
    steps = [{s: (number[kids[r][s]], math.log2(n / visits[r])) for s, n in flow[r].items()} for r in red]
    return Automaton(steps, [math.log2(end[r] / visits[r]) if end[r] else -14.0 for r in red])


class Scanner:
    """Formats and background, fitted to labelled strings, or where there are none to ``samples`` drawn examples a format (a bound of the fit).

    ``labelled``: format -> credentials; ``ordinary``: strings that are none.
    """

    def __init__(self, samples: int = 300, seed: int = 11, min_bits: float = 40.0, labelled: Mapping[str, Sequence[str]] | None = None, ordinary: Sequence[str] | None = None):
        rng = random.Random(seed)
        self.min_bits = min_bits
        if labelled is None:
            labelled = {name: [draw_format(name, rng) for _ in range(samples)] for name in FORMATS}
        self.formats = {name: infer(list(texts)) for name, texts in labelled.items() if texts}
        self.background = infer(list(ordinary) if ordinary is not None else [draw_background(rng) for _ in range(24 * samples)])

    def score(self, text: str) -> float:
        """Bits of the best format beyond the background."""
        return max((a.bits(text) for a in self.formats.values()), default=-math.inf) - self.background.bits(text)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start, then by kind as listed in :data:`KINDS`."""
        if not text:
            return []
        found = []
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
        if _LONG_HEX.search(text):
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
        base = _merged(found)
        added, near = [], 0  # candidates and merged base spans both run forward
        for m in CANDIDATE.finditer(text):
            start, end, run = m.start(), m.end(), m[0]
            while near < len(base) and base[near][1] <= start:
                near += 1
            inner, k = [], near
            while k < len(base) and base[k][0] < end:
                inner.append((max(base[k][0], start), min(base[k][1], end)))
                k += 1
            if not inner:
                if self.score(run) >= self.min_bits:
                    added.append((start, end))
                continue
            edges = [start, *(x for span in inner for x in span), end]
            parts = [(s, e) for s, e in zip(edges[::2], edges[1::2]) if s < e]  # outside base spans
            if not parts:
                continue
            whole = self.score(run) - sum(max(0.0, self.score(text[s:e])) for s, e in inner) >= self.min_bits
            added += [(s, e) for s, e in parts if whole or e - s >= CANDIDATE_CHARS and self.score(text[s:e]) >= self.min_bits]
        dotted: list[tuple[int, int]] = []
        for s, e in added:
            if dotted and s == dotted[-1][1] + 1 and text[s - 1] == ".":
                s = dotted.pop()[0]
            dotted.append((s, e))
        found += [(s, e, "format") for s, e in dotted]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def labelled_examples(examples: DataFrame, format_col: str = "format", text_col: str = "text", limit: int = 1000) -> dict[str, list[str]]:
    """Credentials by format for :class:`Scanner`: of each format those ``limit`` with the smallest hash, a bound of the fit; nulls and empty texts go."""
    rows = examples.select(F.col(format_col).cast("string").alias("f"), F.col(text_col).alias("t")).where("f is not null and t <> ''").distinct()
    nth = F.row_number().over(Window.partitionBy("f").orderBy(F.xxhash64("t"), "t"))
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("n", nth).where(F.col("n") <= limit).orderBy("f", "n").select("f", "t").collect():
        out.setdefault(r["f"], []).append(r["t"])
    return out


@functools.cache
def default_scanner() -> Scanner:
    return Scanner()


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256 and spans of every document."""
    tool = scanner or default_scanner()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                spans = tool.spans(text)
                kinds = [k for _, _, k in spans]
                base = _joined([s for s in spans if s[2] != "format"])
                out.append((*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            names = ["n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]
            yield pd.concat([batch[["doc_id"]].astype("Int64"), pd.DataFrame(out, columns=names, index=batch.index)], axis=1)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def redact(docs: DataFrame, scanner: Scanner | None = None, text_col: str = "text", n_chars_col: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (joined where spans overlap); all rows and columns stay."""
    tool = scanner or default_scanner()

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, tool.spans(t), mask) if t else t)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
