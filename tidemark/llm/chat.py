"""Chat formatting with a grammar round trip: text is rendered, read back by a parser, and escaped until nothing is lost."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: A control string, or one that already carries escapes. Escaping adds a backslash after `<`, reading takes one away.
_CONTROL = re.compile(r"<(\\*)(\|im_(?:start|end)\|>)")
_ESCAPED = re.compile(r"<\\(\\*\|im_(?:start|end)\|>)")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)
SCHEMA = "conv_id long, formatted string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long, loss_spans array<struct<start:long,end:long>>"
_LONG, _TEXT = pa.int64(), pa.string()
_ARROW = pa.schema([("conv_id", _LONG), ("formatted", _TEXT), ("n_turns", _LONG), ("turns_sha256", _TEXT), ("loss_chars", _LONG), ("loss_sha256", _TEXT), ("formatted_chars", _LONG), ("escaped_turns", _LONG), ("loss_spans", pa.list_(pa.struct([("start", _LONG), ("end", _LONG)])))])


def escape(content: str) -> str:
    return _CONTROL.sub(r"<\\\1\2", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"<\1", content)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN}{role}\n{content}{CLOSE}\n" for role, content in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, content and its place (start, end) of every turn; raises on text that is no sequence of turns, or where a
    control string stands inside one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None or any(mark in part for mark in (OPEN, CLOSE) for part in m.groups()):
            raise ValueError(f"no turn at character {at}")
        turns.append((m[1], m[2], m.start(2), m.end(2)))
        at = m.end()
    return turns


def _reads_back(role: str, content: str, wanted: tuple[str, str]) -> bool:
    try:
        back = parse(render([(role, content)]))
    except ValueError:
        return False
    return [(_unescape_role(r), unescape(c)) for r, c, _, _ in back] == [wanted]


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]], int]:
    """(formatted, parsed turns, number of escaped turns). Turns are written as they are, read back alone, and escaped
    when what is read differs; then the whole is read once more and must equal the source."""
    written, escaped = [], 0
    for role, content in turns:
        pair = (role, content)
        if not _reads_back(*pair, (role, content)):
            pair, escaped = (_escape_role(role), escape(content)), escaped + 1
        written.append(pair)
    formatted = render(written)
    read = [(_unescape_role(r), unescape(c), a, b) for r, c, a, b in parse(formatted)]
    if [(r, c) for r, c, _, _ in read] != turns:
        raise ValueError("the formatted text does not read back")
    return formatted, read, escaped


def _describe(conv_id, turns) -> tuple:
    formatted, read, escaped = round_trip([(t["role"] or "", t["text"] or "") for t in turns])
    every, loss, spans = hashlib.sha256(), hashlib.sha256(), []
    loss_chars = 0
    for role, content, start, end in read:
        every.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":
            loss.update(content.encode("utf-8", "surrogatepass"))
            loss_chars += len(content)
            spans.append({"start": start, "end": end})
    return conv_id, formatted, len(read), every.hexdigest(), loss_chars, loss.hexdigest(), len(formatted), escaped, spans


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # ids stay Arrow columns: as pandas numbers, those beside a null would be doubles
        rows = [_describe(c, t) for c, t in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation of `conversations` (conv_id, turn, role, text): the formatted text, the places of the
    assistant texts in it (the loss mask, code points), and digests read back from the formatted text.

    Turns go by `turn` (null first), equal turns by role, then text; a repeated row is a turn of its own. Null role and
    null text are empty. A row of a null conv_id belongs to no other row: it is a conversation of one turn, so rows without
    an id, however many, do not meet. An empty table gives no rows; other columns are ignored. A conversation is one
    string in the result, so its turns, very long ones as well, meet in one task; conversations do not."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv_id = F.col("conv_id").cast("long")
    apart = F.when(conv_id.isNull(), F.monotonically_increasing_id())
    whole = conversations.select(conv_id.alias("conv_id"), apart.alias("_apart"), turn.alias("_turn")).groupBy("conv_id", "_apart").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    return whole.select("conv_id", "turns").mapInArrow(_format_batches, SCHEMA)
