"""Exact, cached encoding of whole texts with the ``tokenizers`` library.

Byte-level BPE first cuts a text into words with a pattern and then merges inside
each word only.  A single space between two non-space characters always starts a
new word of that pattern, whatever stands around it, so a text may be cut there
and its parts encoded one by one: the ids, joined, are those of the whole text.
Parts repeat a great deal, so each worker keeps a bounded table of parts it has
already encoded; the table only saves work and never changes a result.  Texts are
cut and their different parts found a run at a time, so a part is looked up once a run;
a full table drops the parts that were not asked for lately, not all of them.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends of words that are no letters, digits, white space or apostrophes.
_MARKS = ".,!?;:%$&#*"
#: The letters below U+0250.
_LATIN = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_PLAIN = f"({_LATIN})([{re.escape(_MARKS)}]*)"
_TWO_LINES = re.compile(f"{_PLAIN}\n{_PLAIN}")
#: Byte-level BPE writes each byte as one printable character: the printable ones
#: of Latin-1 as themselves, the others, in order, from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
_BYTE_CHARS = "".join(chr(b) if b in set(_PRINTABLE) else chr(256 + _OTHERS.index(b)) for b in range(256))
_SPACE = _BYTE_CHARS[32]
#: Bytes of text that are cut at once, but for a longer text.
_RUN = 1 << 21
#: Characters of the longest key that a table keeps.
_LONGEST = 100
#: A cut: a single space between two characters that are no white space.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A line break that is a word of its own: one between two characters that are no white space.
_LINE_CUT = re.compile(r"(?<=\S)\n(?=\S)")


def _splits_at_spaces(path: str) -> bool:
    """True if the tokenizer file is plain byte-level BPE, the kind that the cut is proven for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec["model"]["type"] == "BPE"
        and spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
    )


class _Table(dict):
    """At most ``most`` values by key; what it lacks it makes.  Long keys and those of two lines, which hardly repeat, are not kept.

    Half of them are new.  When that half is full it becomes the old one, and what was not asked for since the last time goes.
    """

    def __init__(self, make: Callable[[str], bytes | None], most: int):
        self.make, self.half, self.old = make, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes | None:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > _LONGEST or "\n" in key:
                return value
        if len(self) >= self.half:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


def _strings(column: pa.Array) -> list[str]:
    """The values of a column of strings that hold no space, one at least."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), pa.scalar(" ", column.type))[0].as_py().split(" ")


def _gather(ids: list[bytes] | tuple[np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``which`` of ``ids``, joined, and how many each has."""
    if isinstance(ids, list):
        ids = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, sizes = ids
    sizes = sizes.astype(np.int32)
    counts = sizes[which]
    to = np.cumsum(counts, dtype=np.int32)
    at = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[which] - to + counts, counts)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], counts


class TextEncoder:
    """Encodes texts to little-endian ``uint32`` bytes; one per Python worker.

    ``max_parts`` and ``max_words`` bound the two tables (parts behind a space,
    words of the pattern that no space begins); they save work only.  Null encodes like the empty text: to no
    ids.  Tokenizers that are not plain byte-level BPE encode whole texts.
    """

    def __init__(self, path: str, max_parts: int = 500_000, max_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._cut = _splits_at_spaces(path)
        self._max, self._model = max_parts, self._tok.model
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._known = _Table(self._after_space, max_parts)  # part -> ids of a space and the part
        self._words = _Table(self._word, max_words)
        self._newline = self._word("\n") if self._cut else b""

    def _whole(self, texts: list[str]) -> list[bytes]:
        enc = self._tok.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in enc]

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pattern: the library's merges over its bytes."""
        return array("I", [t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _after_space(self, part: str) -> bytes | None:
        """Ids of a space and ``part``; none if white space begins or ends the part, or it is empty: no cut is proven there."""
        if part.isascii() and part.isalpha():
            return array("I", [t.id for t in self._model.tokenize(_SPACE + part)]).tobytes()
        if two := _TWO_LINES.fullmatch(part):
            first, ends, second, more = two.groups()
            return self._known[first] + (self._words[ends] if ends else b"") + self._newline + self._words[second] + (self._words[more] if more else b"")
        core = part.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # letters, then marks: two words
            if len(core) < len(part):
                return self._known[core] + self._words[part[len(core) :]]
            return self._word(" " + core)
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        return self._part(part)

    def _part(self, part: str, lead: str = " ") -> bytes:
        """Ids of ``lead + part``, line by line, however many there are."""
        if "\n" not in part:
            return self._line(part, lead)
        first, *lines = _LINE_CUT.split(part)
        return self._newline.join([self._line(first, lead), *(self._line(x, "") for x in lines)])

    def _line(self, part: str, lead: str) -> bytes:
        """Ids of ``lead + part``.  Latin letters, then marks, are two words; the rest the library splits."""
        core = part.rstrip(_MARKS)
        if core.isalpha() and max(core) < "\u0250":
            ids = self._known[core] if lead else self._words[core]
            return ids + self._words[part[len(core) :]] if len(core) < len(part) else ids
        if any(a in part for a in self._added):
            return self._whole([lead + part])[0]
        out = []
        for mapped, _ in self._tok.pre_tokenizer.pre_tokenize_str(lead + part):
            out.append(array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes())
        return b"".join(out)

    def arrays(self, texts: pa.Array, run_bytes: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text of a column of strings, as ``uint32``; ``run_bytes`` of text are cut at once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (run_bytes or _RUN), side="right")))
            run = texts.slice(at, to - at)
            yield from self._run(run) if self._cut else (np.frombuffer(ids, "<u4") for ids in self._whole(run.to_pylist()))
            at = to

    def batch(self, texts: list[str | None]) -> list[bytes]:
        return [ids.tobytes() for ids in self.arrays(pa.array(texts, pa.large_string()))]

    def _run(self, texts: pa.Array) -> Iterator[np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        ends, n = cut.offsets.to_numpy() - cut.offsets[0].as_py(), len(texts)
        coded = cut.flatten().dictionary_encode()
        parts, which, firsts = coded.dictionary, coded.indices.to_numpy().copy(), ends[:-1]
        heads = parts.take(pa.array(which[firsts])).to_pylist()
        which[firsts] = len(parts) + np.arange(n)
        del cut, coded
        behind = np.bincount(which, minlength=len(parts) + n)[: len(parts)] > 0  # what only begins texts needs no ids behind a space
        flat, sizes = self._behind_spaces(parts, behind)
        # A space next to other white space or an end: such texts are cut at other places, one by one.
        whole = np.array([not p or p[-1].isspace() for p in heads], bool) & (np.diff(ends) > 1)
        whole[np.searchsorted(ends, np.flatnonzero(np.append(behind & (sizes == 0), [False] * n)[which]), side="right") - 1] = True
        own = []
        for k, (p, w) in enumerate(zip(heads, whole.tolist())):
            if w:
                which[firsts[k] + 1 : ends[k + 1]] = len(parts) + n
            own.append(self._spaced(texts[k].as_py()) if w else self._part(p, "") if p else b"")
        more = np.fromiter(map(len, own), np.int64, n) // 4
        out, counts = _gather((np.concatenate([flat, np.frombuffer(b"".join(own), "<u4")]), np.concatenate([sizes, more, [0]])), which)
        to = np.append(0, np.cumsum(counts))[ends].tolist()
        return (out[a:b] for a, b in zip(to, to[1:]))

    def _behind_spaces(self, parts: pa.Array, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each part, joined, and how many each has: none where they are not needed or :meth:`_after_space` has none."""
        plain = pc.match_substring_regex(parts, f"^{_PLAIN}$")  # letters, then marks: two words
        words = pc.if_else(pa.array(needed), pc.if_else(plain, pc.utf8_rtrim(parts, _MARKS), parts), "")
        marked = np.flatnonzero(needed & (pc.binary_length(words).to_numpy() < pc.binary_length(parts).to_numpy()))
        words = words.dictionary_encode()
        pieces = np.full((len(parts), 2), len(words.dictionary))  # its word, its marks
        pieces[:, 0] = words.indices.to_numpy()
        ids = [*map(self._known.__getitem__, _strings(words.dictionary)), None]
        if len(marked):
            marks = pc.replace_substring_regex(parts.take(pa.array(marked)), f"^{_LATIN}", "").dictionary_encode()
            pieces[marked, 1] = marks.indices.to_numpy().astype(np.int64) + len(ids)
            ids += map(self._words.__getitem__, _strings(marks.dictionary))
        flat, counts = _gather([x or b"" for x in ids], pieces.ravel())
        return flat, counts.reshape(-1, 2).sum(axis=1)

    def _spaced(self, text: str) -> bytes:
        """Ids of a text, cut only at the spaces between two characters that are no white space."""
        first, *parts = _SAFE_CUT.split(text)
        return self._part(first, "") + b"".join([self._part(p) if p[-1].isspace() else self._known[p] for p in parts])


@lru_cache(maxsize=1)
def worker_encoder(path: str, max_parts: int = 400_000, max_words: int = 100_000) -> TextEncoder:
    """The encoder of this Python worker, which keeps its tables from task to task.

    Smaller tables that are full already take the same time as larger ones that each task fills anew, and less memory.
    """
    return TextEncoder(path, max_parts, max_words)
