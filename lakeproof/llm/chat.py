"""Chat formatting whose output parses back to the source.

Grammar of a formatted conversation, one piece per turn:

    conversation := turn*
    turn         := "[INST]" role newline text "[/INST]"      any role but the assistant's
                  | "<s>" role newline text "</s>"            the assistant's; its text is under the loss mask

Rendering is checked by a round trip: the piece is parsed by the grammar, and if the recovered turn is not the source,
conflicting content is escaped and the piece is rendered again, until it is identical. Control strings in a text get a
backslash after their first character, and a control string that has backslashes there already gets one more, so the
parser takes exactly one away: escaping is reversible. Line ends and backslashes of roles are written ``\\n`` and ``\\\\``.

A conversation is never gathered. Its turns are dealt by conversation, sorted, and streamed: formatting and reading back hold
one turn at a time and, per conversation, running digests. A conversation of any length takes bounded memory; but its
digests need its turns in order, so they are read one after the other by one task (pieces are not: ``pieces`` is row by row).

Defined cases: NULL texts and roles count as empty; turns are ordered by turn (NULL first), role and text, so ties and
repeated rows have a fixed order; rows with a NULL conversation id are one conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import quoted

ASSISTANT = "assistant"
#: Control strings by whether the turn is the assistant's.
MARKS = {False: ("[INST]", "[/INST]"), True: ("<s>", "</s>")}
_CONTROL = re.compile(r"\[/?INST\]|</?s>")
_PLAIN = re.compile(r"(\[)(\\*)(/?INST\])|(<)(\\*)(/?s>)")


class Conflict(ValueError):
    """A piece that is not one turn of the grammar."""


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}" if m[1] else f"{m[4]}\\{m[5]}{m[6]}", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: (f"{m[1]}{m[2][1:]}{m[3]}" if m[1] else f"{m[4]}{m[5][1:]}{m[6]}"), text)


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def parse(piece: str) -> tuple[str, str, int, int]:
    """(role, text, start and end of the text as written) of a piece that is one turn."""
    first = _CONTROL.match(piece)
    if not first or first[0] not in ("[INST]", "<s>"):
        raise Conflict("a turn starts with an opening mark")
    assistant = first[0] == "<s>"
    last = _CONTROL.search(piece, first.end())
    if not last or last[0] != MARKS[assistant][1] or last.end() != len(piece):
        raise Conflict("a turn ends with the first mark after its start")
    role, line, text = piece[first.end() : last.start()].partition("\n")
    role = _unescape_role(unescape(role))
    if not line or (role == ASSISTANT) != assistant:
        raise Conflict("a turn has a role that fits its marks")
    return role, unescape(text), last.start() - len(text), last.start()


def render(role: str, text: str) -> tuple[str, int]:
    """The piece of a turn, and how often content had to be escaped: 0, 1 (text) or 2 (role, too)."""
    opening, closing = MARKS[role == ASSISTANT]
    for level, (shown, body) in enumerate(((role, text), (role, escape(text)), (escape(_escape_role(role)), escape(text)))):
        piece = f"{opening}{shown}\n{body}{closing}"
        try:
            if parse(piece)[:2] == (role, text):
                return piece, level
        except Conflict:
            continue
    raise AssertionError("an escaped turn parses")


PIECES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.string()), ("escaped", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shown = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        masks = [(p.index("\n") + 1, len(p) - len("</s>")) if p.startswith("<s>") else (None, None) for p, _ in shown]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), batch.column("turn"), pa.array([p for p, _ in shown], pa.string()), pa.array([n for _, n in shown], pa.int32()),
                pa.array([a for a, _ in masks], pa.int64()), pa.array([b for _, b in masks], pa.int64()),
            ],
            schema=PIECES,
        )


def pieces(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, piece, escaped, loss_start, loss_end): one row per turn, in order within the tasks.

    A formatted conversation is its pieces one after the other. The loss mask is a span of code points of the piece.
    """
    rows = turns.select(
        quoted(conv_col).cast("bigint").alias("conv_id"),
        quoted(turn_col).cast("bigint").alias("turn"),
        F.coalesce(quoted(role_col), F.lit("")).alias("role"),
        F.coalesce(quoted(text_col), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_render, "conv_id bigint, turn bigint, piece string, escaped int, loss_start bigint, loss_end bigint")


DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()), ("n_escaped", pa.int64()),
    ]
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses the pieces of conversations that come in order; state is one conversation's digests and counts."""
    rows: list[tuple] = []
    current, state = None, None

    def closed() -> tuple:
        n, turns, loss_chars, loss, chars, escaped = state
        return (current[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, escaped)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "piece", "loss_start", "loss_end", "escaped")]
        for conv, piece, start, end, escaped in zip(*columns, strict=True):
            if current is None or current[0] != conv:
                if current is not None:
                    rows.append(closed())
                current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text, _, _ = parse(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescape(piece[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(piece)
            state[5] += escaped > 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGESTS, strict=True)], schema=DIGESTS)
            rows = []
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(closed(), DIGESTS, strict=True)], schema=DIGESTS)


def report(turns: DataFrame, **names) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped), read back from the pieces."""
    return pieces(turns, **names).mapInArrow(
        _read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_escaped bigint"
    )
