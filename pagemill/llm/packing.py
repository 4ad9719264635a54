"""Packing: bounded-space online packing of token sequences.

Each task reads its documents as they come, encodes them and keeps a fixed number of
open windows.  A piece goes to the open window that it fills best.  When none has
room, the fullest is topped up with a cut of the piece and emitted, and a new one
is opened.  At the end of a task its open windows are merged into full sequences
and one leftover; the leftovers of all tasks are merged in rounds of a fixed
number per task.  What is left of the whole table, less than one window, is cut into
sequences whose lengths are powers of two, which need no padding.

A task holds the open windows and one batch of documents.  Its pieces are written
once to the shared folder, so a lost executor costs its own tasks only, and the
rounds read stored pieces.  Sequence numbers are made of the round, the task's
partition and a count; a task that runs again gets the same numbers.

Cases: a null text is empty: its end token alone; repeated rows are documents of
their own; very long documents fill whole windows first; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import stored
from ._tokens import worker_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Partition numbers and counts share the 63 bits of a sequence number with the round.
_ROUND, _PART = 1 << 58, 1 << 34
#: Bytes of text encoded at once and entries of the encoder's tables: small, as in a chain of stages the worker keeps them beside what others hold.
_RUN, _TABLES = 1 << 20, (200_000, 50_000)


class Packer:
    """Windows of ``width`` tokens; a piece is [doc_id, start, ids, doc_tokens]."""

    def __init__(self, width: int, windows: int, first_id: int):
        self.width, self.windows, self.next_id = width, windows, first_id
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.done: list[tuple] = []

    def _emit(self, pieces: list, tokens: int) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at, tokens))
            at += len(ids)
        self.next_id += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        w = self.width
        while len(ids) >= w:
            self._emit([(doc, start, ids[:w], total)], w)
            start, ids = start + w, ids[w:]
        if not len(ids):
            return
        best = max((k for k, (n, _) in enumerate(self.open) if n + len(ids) <= w), key=lambda k: self.open[k][0], default=None)
        if best is None and len(self.open) < self.windows:
            self.open.append((len(ids), [(doc, start, ids, total)]))
            return
        if best is None:
            best = max(range(len(self.open)), key=lambda k: self.open[k][0])
            room = w - self.open[best][0]
            tokens, pieces = self.open.pop(best)
            self._emit([*pieces, (doc, start, ids[:room], total)], w)
            self.open.append((len(ids) - room, [(doc, start + room, ids[room:], total)]))
            return
        tokens, pieces = self.open[best]
        pieces.append((doc, start, ids, total))
        self.open[best] = (tokens + len(ids), pieces)
        if self.open[best][0] == w:
            self._emit(pieces, w)
            self.open.pop(best)

    def merge(self) -> list:
        """Emits what the open windows fill together; returns the pieces of less than one window."""
        held, tokens = [], 0
        for _, pieces in sorted(self.open, key=lambda x: -x[0]):
            for doc, start, ids, total in pieces:
                while tokens + len(ids) >= self.width:
                    room = self.width - tokens
                    self._emit([*held, (doc, start, ids[:room], total)], self.width)
                    held, tokens, start, ids = [], 0, start + room, ids[room:]
                if len(ids):
                    held.append((doc, start, ids, total))
                    tokens += len(ids)
        self.open = []
        return held

    def keep(self, pieces: list, group: int) -> None:
        """Hands pieces on to the next round: their number is negative and says where they come from."""
        tokens, at = sum(len(ids) for _, _, ids, _ in pieces), 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), ids.tobytes(), total, -1 - group, at, tokens))
            at += len(ids)

    def powers(self, pieces: list) -> None:
        """Emits the last pieces as sequences whose lengths are powers of two."""
        ids = [(d, s, i, t) for d, s, i, t in pieces]
        left = sum(len(i) for _, _, i, _ in ids)
        while left:
            size = 1 << (left.bit_length() - 1)
            seq, need = [], size
            while need:
                doc, start, own, total = ids.pop(0)
                seq.append((doc, start, own[:need], total))
                if len(own) > need:
                    ids.insert(0, (doc, start + need, own[need:], total))
                need -= min(need, len(own))
            self._emit(seq, size)
            left -= size


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)}, schema=_ARROW)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _merger(width: int, level: int, last: bool):
    """Merges the leftovers of one group of tasks (or of groups of the round before)."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer(width, 1, level * _ROUND + group * _PART)
        table = table.sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        packer.open = [(0, [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in table.to_pylist()])]
        held = packer.merge()
        if last:
            packer.powers(held)
        else:
            packer.keep(held, group)
        return pa.Table.from_batches([_table(packer.done)], _ARROW)

    return merge


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, windows: int = 32, end_id: int = 0, merge_width: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces as :data:`SCHEMA`: their token ids (little-endian unsigned 32-bit) and place in a sequence.

    ``tokenizer`` is the path of a tokenizers file on every machine; ``width`` a power of two.
    """
    if width & (width - 1):
        raise ValueError("width is a power of two")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _partition()
        packer, encoder = Packer(width, windows, part * _PART), worker_encoder(tokenizer, *_TABLES)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.arrays(batch.column(1), _RUN)):
                ids = np.concatenate([raw, end])
                packer.add(doc, 0, ids, len(ids))
                if len(packer.done) >= 512:
                    yield _table(packer.done)
                    packer.done = []
        packer.keep(packer.merge(), part)
        if packer.done:
            yield _table(packer.done)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = stored(rows.mapInArrow(first, SCHEMA))
    full, left = packed.where("sequence_id >= 0"), packed.where("sequence_id < 0")
    span = left.agg(F.max(-1 - F.col("sequence_id"))).first()[0]
    results, level = [full], 0
    while span is not None:
        level += 1
        last = span < merge_width

        group = F.floor((-1 - F.col("sequence_id")) / merge_width).cast("long").alias("grp")
        merged = stored(left.groupBy(group).applyInArrow(_merger(width, level, last), SCHEMA))
        results.append(merged.where("sequence_id >= 0"))
        left, span = merged.where("sequence_id < 0"), None if last else span // merge_width
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
