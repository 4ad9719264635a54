"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says, per role, which control strings open and close a turn and
whether the turn's text bears loss.  Texts are escaped so that no control string
can occur inside them: a backslash is doubled, and wherever a control string
starts, a backslash is put after its first character.  :func:`read_back` parses a
formatted conversation into its turns again, so formatting loses nothing.

Rows are dealt by a hash of the conversation and sorted by turn; each task then
streams its rows with one conversation open at a time, so memory is bounded by the
longest conversation, not by a partition.  A conversation is one row of the result, so all its
turns meet in one task, however many they are.

Cases: null text and null role count as empty; a null turn sorts first; rows with
the same turn are ordered by role, then text; repeated rows are repeated turns; a
null conv_id is a conversation of its own.  A role the template does not know is
written with its name and bears no loss.  A conversation whose turn order the
machine rejects is still formatted, with ``valid`` false and ``first_bad_turn``
the position of the first turn out of order.  Other input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """``roles``: how known roles are written; ``other``: opening, middle and closing strings of any other role.

    ``order``: state -> role -> next state; a turn without an entry is out of order.  ``final``: states to end in.
    """

    begin: str = "<s>"
    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>", False),
            "user": Turn("[INST]", "[/INST]", False),
            "assistant": Turn("<ANS>", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    start: str = "start"
    final: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        found = [self.begin, *self.other, *(x for t in self.roles.values() for x in (t.open, t.close))]
        return sorted({x for x in found if x}, key=lambda x: (-len(x), x))

    def __post_init__(self):
        for c in self.controls():
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"control strings have two characters at least and no backslash: {c!r}")
        for a in self.controls():
            for b in self.controls():
                if any(a.endswith(b[:n]) for n in range(1, len(b))) or (a != b and a in b):
                    raise ValueError(f"control strings may not overlap: {a!r}, {b!r}")


class Formatter:
    def __init__(self, template: Template | None = None):
        self.template = t = template or Template()
        alternatives = "|".join(map(re.escape, t.controls()))
        self._risky = re.compile(rf"\\|(?={alternatives}).", re.S)
        self._control = re.compile(rf"\\.|({alternatives})", re.S)

    def escape(self, text: str) -> str:
        return self._risky.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def check(self, roles: list[str]) -> tuple[bool, int | None]:
        """Whether the machine accepts the roles, and the position of the first turn out of order."""
        state = self.template.start
        for k, role in enumerate(roles):
            state = self.template.order.get(state, {}).get(role)
            if state is None:
                return False, k
        return state in self.template.final, None

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """Text segments in order, each with its loss flag."""
        t = self.template
        out = [(t.begin, False)]
        for role, text in turns:
            if known := t.roles.get(role):
                out += [(known.open, False), (self.escape(text), known.loss), (known.close, False)]
            else:
                out += [(t.other[0] + self.escape(role) + t.other[1], False), (self.escape(text), False), (t.other[2], False)]
        return out

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        """Turns (role, text) of a formatted conversation."""
        t = self.template
        opens, out = {x.open: (role, x) for role, x in t.roles.items()}, []
        marks = [(m.start(), m.end(), m[1]) for m in self._control.finditer(formatted) if m[1]]
        if not marks or marks[0][:2] != (0, len(t.begin)):
            raise ValueError("not a formatted conversation")
        k = 1
        while k < len(marks):
            _, end, mark = marks[k]
            if mark in opens:
                (role, turn), k = opens[mark], k + 1
                text, want = formatted[end : marks[k][0]], turn.close
            else:
                role, k = self.unescape(formatted[end : marks[k + 1][0]]), k + 2
                text, want = formatted[marks[k - 1][1] : marks[k][0]], t.other[2]
            if marks[k][2] != want:
                raise ValueError("not a formatted conversation")
            out.append((role, self.unescape(text)))
            k += 1
        return out


FORMATTED = "conv_id long, n_turns long, formatted string, segments array<struct<text:string,loss:boolean>>, valid boolean, first_bad_turn long"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, as :data:`FORMATTED`; ``turns`` has conv_id, turn, role, text."""
    shape = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fmt, open_id, held, ready = Formatter(shape), ..., [], []

        def close() -> None:
            valid, bad = fmt.check([r for r, _ in held])
            parts = fmt.segments(held)
            ready.append((open_id, len(held), "".join(x for x, _ in parts), [{"text": x, "loss": y} for x, y in parts], valid, bad))

        def table() -> pd.DataFrame:
            out = pd.DataFrame(ready, columns=["conv_id", "n_turns", "formatted", "segments", "valid", "first_bad_turn"]).astype({"conv_id": "Int64", "first_bad_turn": "Int64"})
            ready.clear()
            return out

        for batch in batches:
            for conv, null, role, text in zip(batch["conv_id"], batch["no_id"], batch["role"], batch["text"]):
                conv = None if null else int(conv)
                if conv != open_id:
                    if open_id is not ...:
                        close()
                    open_id, held = conv, []
                held.append((role, text))
            if ready:
                yield table()
        if open_id is not ...:
            close()
            yield table()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("no_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    dealt = rows.repartition("conv_id", "no_id").sortWithinPartitions("conv_id", "no_id", "turn", "role", "text")
    return dealt.drop("turn").mapInPandas(run, FORMATTED)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader finds in the output alone: turns in the formatted strings, loss text in the segments that are flagged.

    Segments that don't join to the formatted string raise an error.
    """
    shape = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fmt = Formatter(shape)
        for batch in batches:
            out = []
            for text, segments in zip(batch["formatted"], batch["segments"]):
                turns, all_turns, loss, chars = fmt.read_back(text), hashlib.sha256(), hashlib.sha256(), 0
                if "".join([s["text"] for s in segments]) != text:
                    raise ValueError("the segments are not the formatted conversation")
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                for said in [fmt.unescape(s["text"]) for s in segments if s["loss"]]:
                    loss.update(said.encode())
                    chars += len(said)
                out.append((len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            yield pd.concat([batch[["conv_id", "valid", "first_bad_turn"]], pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], index=batch.index)], axis=1).astype({"conv_id": "Int64", "first_bad_turn": "Int64"})

    return formatted.select("conv_id", "formatted", "segments", "valid", "first_bad_turn").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad_turn long")
