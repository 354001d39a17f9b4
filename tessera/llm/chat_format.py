"""Chat formatting with a grammar round trip.

Template of a turn:  <|im_start|>ROLE newline TEXT <|im_end|> newline

The grammar is regular and every turn delimits itself, so a deterministic parser
reads turns back from left to right without looking ahead. A turn is rendered as
it is, parsed again and compared; where the recovered turn differs, conflicting
content is escaped and the turn rendered again until it is identical. The grammar
takes no control string inside a role or text, so each of them is conflicting content
and a rendered turn holds one of each, its own. Escaping
puts one more backslash into every "<", backslashes, "|" of the text, reading takes one
out, so it is reversible at any depth. In roles, a backslash stands before
backslash, "<" (written l) and a line break (written n).

Turns are rendered and tested where they lie. Only the rendered pieces move to
their conversation, where they are read back as one stream, a batch at a time: a
digest of a whole conversation is sequential, but a conversation of any length
needs the memory of one turn.

Edge cases: a null text or role is empty; ties of `turn` go by role, then text, null
first; repeated rows are turns of their own; a null conv_id is a conversation;
an empty table gives the extra conversations only; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>((?:[^\\<\n]|\\[\\ln])*)\n((?:[^<]++|<(?!\|im_(?:start|end)\|>))*+)<\|im_end\|>\n")
_ROLE_OUT = {"\\": "\\\\", "<": "\\l", "\n": "\\n"}
_ROLE_IN = {"\\": "\\", "l": "<", "n": "\n"}


def _role_out(role: str) -> str:
    return re.sub(r"[\\<\n]", lambda m: _ROLE_OUT[m[0]], role)


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ROLE_IN[m[1]], role)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """Turns of a rendered text, or nothing if it isn't made of whole turns only."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            return None
        turns.append((_role_in(m[1]), _UNESCAPE.sub(r"<\1|", m[2])))
        at = m.end()
    return turns


def render(role: str | None, text: str | None) -> str:
    """One turn, escaped until its parse gives the turn again."""
    role, text = role or "", text or ""
    shown, body = _role_out(role), text
    while parse(out := f"{START}{shown}\n{body}{END}\n") != [(role, text)]:
        body = _ESCAPE.sub(r"<\\\1|", body)
    return out


def rendered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, the sort keys of ties, and the rendered piece of every turn."""
    def run(batches):
        for b in batches:
            pieces = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(pieces, pa.string())], names=["conv_id", "turn", "role", "piece"])
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    return (turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
            .mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, piece string"))


class _ReadBack:
    """Digest columns of one conversation, from its rendered pieces in order."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str):
        self.chars += len(piece)
        for role, text in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == TRAINED:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """Per conversation: turns, digests and lengths, read back from the rendered text."""
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def run(batches):
        none = object()
        current, state, done = none, None, []

        def flush(rows):
            cols = list(zip(*((c, s.turns, s.all.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars) for c, s in rows), strict=True))
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                              names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        for b in batches:
            id_type = b.schema.field(0).type
            for conv, piece in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, state))
                    current, state = conv, _ReadBack()
                state.add(piece)
            if len(done) > 5000:
                yield flush(done)
                done.clear()
        if state is not None:
            yield flush([*done, (current, state)])
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(turns: DataFrame) -> DataFrame:
    return conversation_digests(rendered_turns(turns))
