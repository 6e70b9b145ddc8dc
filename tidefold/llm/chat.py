r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation = { turn }
    turn         = "### " role ": " body "</turn>" LF
    role         = { char - control | escape }
    body         = { char - control | escape }
    escape       = "\" char
    control      = "\" | "### " | "</turn>" | ": " (in a role) | LF (in a role)

``parse`` is deterministic: it reads exactly this grammar and fails on anything else. A turn is first
rendered as it is; if reparsing it doesn't give the source turn back, its conflicting content is
escaped, first the control strings, then every backslash as well, until the two are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
END = CLOSE.rstrip("\n")
ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
NAMES = {v: k for k, v in ROLES.items()}
#: Escapes of each attempt: none, the control strings alone, control strings and backslashes.
ATTEMPTS = (None, re.compile(r"### |</turn>"), re.compile(r"\\|### |</turn>"))
IN_ROLE = re.compile(r"[\\\n:<#@]")
SEGMENTS = "conv_id long, turn long, role string, segment string, body_start long, body_end long, loss boolean"


class GrammarError(ValueError):
    """The text isn't a formatted turn."""


def _escape(text: str, pattern: re.Pattern[str] | None) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text) if pattern else text


def _unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render_role(role: str) -> str:
    return ROLES.get(role) or "@" + IN_ROLE.sub(lambda m: "\\" + m[0], role)


TURN = re.compile(r"### ((?:[^\\:\n]++|\\(?s:.))*+): ((?:[^\\<#]++|\\(?s:.)|<(?!/turn>)|#(?!## ))*+)</turn>\n")


def parse(text: str, at: int = 0) -> tuple[str, str, tuple[int, int], int]:
    """(role, text, span of the body in ``text``, end) of the turn at ``at``."""
    m = TURN.match(text, at)
    if not m:
        raise GrammarError(text[at : at + 60])
    role = m[1]
    if role.startswith("@"):
        role = _unescape(role[1:])
    elif role in NAMES:
        role = NAMES[role]
    else:
        raise GrammarError(role)
    return role, _unescape(m[2]), m.span(2), m.end()


def parse_all(text: str) -> list[tuple[str, str]]:
    """The turns of a whole formatted conversation."""
    at, out = 0, []
    while at < len(text):
        role, body, _, at = parse(text, at)
        out.append((role, body))
    return out


def render(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The formatted turn and the span of its body; escaped no more than the round trip needs."""
    for pattern in ATTEMPTS:
        out = f"{OPEN}{render_role(role)}{SEP}{_escape(text, pattern)}{CLOSE}"
        try:
            r, t, span, end = parse(out)
        except GrammarError:
            continue
        if (r, t, end) == (role, text, len(out)):
            return out, span
    raise GrammarError(f"no round trip for {text[:60]!r}")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A formatted segment per turn; a conversation is its segments in order of turn, role and formatted text.

    body_start and body_end are the body's code-point span in the segment, loss tells whether it is
    trained on. Defined results: a null text or role is empty; a null turn comes first; turns with
    equal numbers are ordered by role, then formatted text; repeated rows are turns of their own; rows with a
    null conversation form one conversation; an empty table gives no segment; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, spans, roles = [], [], []
            for role, text in zip(batch.column(2), batch.column(3), strict=True):
                role, text = role.as_py() or "", text.as_py() or ""
                segment, span = render(role, text)
                segments.append(segment)
                spans.append(span)
                roles.append(role)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(segments, pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), pa.array([r in loss_roles for r in roles], pa.bool_())],
                names=["conv_id", "turn", "role", "segment", "body_start", "body_end", "loss"],
            )

    return turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, SEGMENTS)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest their turns and loss masks, a row for each conversation.

    Rows are dealt by conversation and sorted by turn, and stream through one hash state at a time:
    a conversation of any length takes no more memory than its longest turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv, state, done = None, None, []

        def close() -> None:
            n, turns, chars, loss, formatted = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def out() -> pa.RecordBatch:
            rows = list(done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for c, segment, loss, start, end in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text, at = segment.as_py(), 0
                state[4] += len(text)
                while at < len(text):
                    role, body, span, at = parse(text, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    if loss:
                        masked = _unescape(text[start:end])
                        if span != (start, end) or masked != body:
                            raise GrammarError("the loss mask isn't the turn's body")
                        state[2] += len(masked)
                        state[3].update(masked.encode("utf-8", "surrogatepass"))
            if len(done) >= 1024:
                yield out()
        if state is not None:
            close()
        if done:
            yield out()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "segment"]
    dealt = segments.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment", "loss", "body_start", "body_end")
    return dealt.mapInArrow(run, SUMMARY)
