"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to a string. Successive prefixes of a
conversation are rendered and each output is compared with the one before: if it
extends it, the new part is the span of the new turn; if it does not, the template
rewrites history, which is reported with the turn that showed it. Where a turn's
text lies in its span is found with probe texts, so nothing is assumed of the
template. The loss mask covers the texts of the trained role.

Every prefix of every conversation is rendered. The template is called once a turn and the
comparison with the output before is one pass over bytes; the default template keeps the
escaped form of its last short turns, so a longer prefix costs a copy of what was there.

Rows of a conversation come together by its id and are read in order of turn. One
conversation is one document and one value of the result, so the longest sets the
memory of a task; the number of rows of all others does not.

Defined cases: null texts and roles are empty; turns with equal numbers are ordered
by role, then text, nulls first; repeated rows are turns of their own; rows with a
null conv_id form one conversation; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No control string can stand in the result; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def _marked(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


_marked_short = lru_cache(1 << 14)(_marked)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: every turn between a start mark with its role and an end mark."""
    return "".join([(_marked_short if len(text) < 4_096 else _marked)(role, text) for role, text in turns])


def read_back(formatted: str) -> list[Turn]:
    """The turns that ``marked_turns`` was given."""
    out = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    contents: list[tuple[int, int] | None] = field(default_factory=list)
    rewritten_at: int | None = None


class Renderer:
    """Renders conversations with one template and remembers the frames of its roles."""

    def __init__(self, template: Template):
        self.template = template
        self.frames: dict[str, tuple[str, str]] = {}

    def _shared(self, a: str, b: str) -> int:
        if a.startswith(b) or b.startswith(a):
            return min(len(a), len(b))
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
        return lo

    def _frame(self, before: list[Turn], role: str, context: str) -> tuple[str, str]:
        """What the template writes before and after a text of this role: the same around two probes."""
        a, b = (self.template([*before, (role, probe)])[len(context) :] for probe in ("a", "b"))
        head = self._shared(a, b)
        tail = self._shared(a[head:][::-1], b[head:][::-1])
        return a[:head], a[len(a) - tail :] if tail else ""

    def _content(self, before: list[Turn], turn: Turn, context: str, added: str) -> tuple[int, int] | None:
        role = turn[0]
        for fresh in (False, True):
            if fresh or role not in self.frames:
                self.frames[role] = self._frame(before, role, context)
            head, tail = self.frames[role]
            if len(added) >= len(head) + len(tail) and added.startswith(head) and added.endswith(tail):
                return len(head), len(added) - len(tail)
        return None

    def render(self, turns: list[Turn]) -> Rendered:
        """Renders one turn more each time; what is new is the turn's span, unless what was there has changed."""
        out = Rendered("")
        for i, turn in enumerate(turns):
            now = self.template(turns[: i + 1])
            at = len(out.text)
            if not now.startswith(out.text):
                out.rewritten_at, out.text = i, self.template(turns)
                return out
            added = now[at:]
            found = self._content(turns[:i], turn, out.text, added)
            out.spans.append((at, at + len(added)))
            out.contents.append(found and (at + found[0], at + found[1]))
            out.text = now
        return out


_FORMATTED = "conv_id long, formatted string, roles array<string>, spans array<array<long>>, loss array<array<long>>, rewritten_at int"
_PAIRS = pa.list_(pa.list_(pa.int64()))
_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("roles", pa.list_(pa.string())), ("spans", _PAIRS), ("loss", _PAIRS), ("rewritten_at", pa.int32())])


def _format(template: Template, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer = Renderer(template)
        rows: list[tuple] = []

        def finish(conv_id: int | None, turns: list[Turn]) -> None:
            r = renderer.render(turns)
            stable = r.rewritten_at is None
            loss = [list(c) for (role, _), c in zip(turns, r.contents, strict=False) if role == trained and c] if stable else []
            rows.append((conv_id, r.text, [t[0] for t in turns], [list(s) for s in r.spans], loss, r.rewritten_at))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        conv, turns, begun, size = None, [], False, 0
        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if begun and c != conv:
                    finish(conv, turns)
                    size += sum(len(t) for _, t in turns)
                    turns = []
                    if size > 4 << 20:
                        yield batch()
                        rows, size = [], 0
                conv, begun = c, True
                turns.append((role or "", text or ""))
        if begun:
            finish(conv, turns)
        yield batch()

    return run


def format_conversations(conversations: DataFrame, template: Template = marked_turns, trained: str = "assistant") -> DataFrame:
    """One row per conversation: its formatted text, the role and span of each turn, the loss mask
    (code points), and the turn at which the template rewrote history (else null; then the mask is empty)."""
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(template, trained), _FORMATTED)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_at int"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            text = r["formatted"]
            turns = read_back(text)
            every = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
            loss = "".join(unescape(text[s:e]) for s, e in r["loss"])
            rows.append((r["conv_id"], len(turns), every, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), r["rewritten_at"]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and the loss mask alone tell: turns, their digest, the trained text."""
    return formatted.mapInArrow(_digests, _DIGEST)
