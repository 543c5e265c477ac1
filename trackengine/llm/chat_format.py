"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string; nothing is known of its inside. Successive prefixes
of a conversation are rendered and each output is compared with the one before: what is new is that turn's span. If an
output does not begin with the one before, the template rewrites history; such a conversation is flagged and gets no
loss mask. Inside an assistant turn's span the text is found by rendering the turn once more with a probe character as
its text: what stands before and after the probe is mark-up, what lies between in the real output is the (escaped) text.
It must read back, by ``unescape``, as the turn's text; a template that trims or changes texts is flagged like one that
rewrites history.

Rows are sorted by turn inside a Spark partition and streamed, so memory holds one conversation and its output. Every
prefix is rendered whole, whatever the template does with it, so the time for one conversation grows with the square of
its length. Once a conversation is known to be rewritten, only its whole is rendered: that is its ``formatted``.

Edge cases: a null role or text counts as empty. Equal turn numbers go by role, then text; repeated rows stay. Null
turns come first. Rows without a conversation id form one conversation. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "formatted string, loss array<struct<start:long,`end`:long>>, rewrites boolean"
Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# --- fixed values: the marks of the default template
START, END = "<|im_start|>", "<|im_end|>\n"
# ---
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """No ``<|`` is left: one backslash more stands between ``<`` and ``|``. ``unescape`` takes it away."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _marked_turn(role: str, text: str) -> str:
    return f"{START}{_escape_role(role)}\n{escape(text)}{END}"


#: Short turns stand in many prefixes; some 8 MB at most are kept.
_short_turn = lru_cache(4096)(_marked_turn)


def marked(turns: list[Turn]) -> str:
    """The default template: every turn between marks, control strings in texts escaped."""
    return "".join([_short_turn(role, text) if len(role) + len(text) <= 1_000 else _marked_turn(role, text) for role, text in turns])


def parse(formatted: str) -> list[Turn]:
    """Reads the turns back from what ``marked`` wrote."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _probe(span: str) -> str:
    """A mark that the span doesn't have; its first character stands in it once, so it can't overlap itself."""
    length = 1
    while (mark := f"\ue000{chr(0xE001) * length}\ue002") in span:
        length += 1
    return mark


class Renderer:
    """Renders one conversation turn by turn."""

    def __init__(self, template: Template, trained: str, unescape: Callable[[str], str] = unescape):
        self.template, self.trained, self.unescape = template, trained, unescape
        self.turns: list[Turn] = []
        self.last = ""  # the output so far
        self.rewrites = False
        self.loss: list[dict[str, int]] = []

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        if self.rewrites:
            return
        out = self.template(self.turns)
        if not out.startswith(self.last):
            self.rewrites = True
            return
        if role == self.trained:
            start = len(self.last)
            span = out[start:]
            mark = _probe(span)
            probed = self.template([*self.turns[:-1], (role, mark)])
            head, found, tail = probed[start:].partition(mark)
            whole = probed.startswith(self.last) and found and span.startswith(head) and span.endswith(tail) and len(head) + len(tail) <= len(span)
            if whole and self.unescape(span[len(head) : len(span) - len(tail)]) == text:
                self.loss.append({"start": start + len(head), "end": len(out) - len(tail)})
            else:
                self.rewrites = True
        self.last = out

    def row(self) -> tuple[str, list[dict[str, int]], bool]:
        return (self.template(self.turns), [], True) if self.rewrites else (self.last, self.loss, False)


def render(conversations: DataFrame, template: Template = marked, trained: str = "assistant", unescape: Callable[[str], str] = unescape) -> DataFrame:
    """conv_id, formatted, loss (spans of trained text in ``formatted``, end exclusive) and rewrites, one row a conversation.

    ``unescape`` undoes what the template does to control strings in texts."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        now, at, done, held, id_kind = None, None, [], 0, pa.int64()

        def batch_of():
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], id_kind), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], loss_kind), pa.array([d[3] for d in done], pa.bool_())],
                ["conv_id", "formatted", "loss", "rewrites"],
            )

        for batch in batches:
            id_kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv != at:
                    if now is not None:
                        done.append((at, *now.row()))
                        held += len(done[-1][1])
                        if held > 4_000_000:
                            yield batch_of()
                            done, held = [], 0
                    now, at = Renderer(template, trained, unescape), conv
                now.add(role, text)
        if now is not None:
            done.append((at, *now.row()))
            yield batch_of()

    return rows.mapInArrow(run, f"conv_id {kind}, {OUT}")
