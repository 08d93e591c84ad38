"""Operator 2, chat formatting: conversations to training text by a compiled template.

``render`` sorts the rows of each conversation by turn and streams them through the template: a
conversation is taken message by message and leaves as chunks of about ``chunk_chars`` characters with
the ranges that are under the loss mask, so neither side of a conversation of any length is held whole.

The default template marks each turn by its role and an end mark. Inside roles and texts a backslash
goes before the characters of control strings, and before every backslash, so nothing a user writes
reads as a mark, and ``messages`` takes the conversation from the formatted text again, character by
character as it was.

Defined results: null roles and texts count as empty; a null conversation id is a conversation; turns
with equal or null numbers are ordered by role and text, null numbers first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorpulse.llm.common import text_or_empty
from sectorpulse.llm.templates import compile_template

#: Marks of the default template. A colon only matters in a role.
START, END = "### ", "</turn>"
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape_role }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
CHUNK_CHARS = 1 << 16

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(text: str) -> str:
    return _ROLE_CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role}


@cache
def _template(text: str) -> Callable:
    return compile_template(text, FILTERS)


def _by_row(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple], schema: str, limit: int = 64) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a few rows, since a row may be a whole chunk."""
    spans = pa.list_(pa.int64())
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": spans}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(x, kinds[kind]) for x, kind in zip(zip(*held, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, list(names))

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == limit:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


FORMATTED = "conversation long, chunk long, text string, first long, loss_starts array<long>, loss_ends array<long>"


def _chunks(name: int | None, pieces: Iterator[tuple[str, bool]], chunk_chars: int) -> Iterator[tuple]:
    """The rows of one conversation; starts and ends are code points from its beginning."""
    held, size, first, number = [], 0, 0, 0
    starts, ends = [], []
    for text, loss in pieces:
        for at in range(0, len(text), chunk_chars):
            part = text[at : at + chunk_chars]
            if loss and ends and ends[-1] == first + size:
                ends[-1] += len(part)
            elif loss:
                starts.append(first + size)
                ends.append(first + size + len(part))
            held.append(part)
            size += len(part)
            if size >= chunk_chars:
                yield name, number, "".join(held), first, starts, ends
                held, size, first, number, starts, ends = [], 0, first + size, number + 1, [], []
    if held or not number:
        yield name, number, "".join(held), first, starts, ends


def render(
    conversations: DataFrame,
    template: str = TEMPLATE,
    chunk_chars: int = CHUNK_CHARS,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """The chunks (conversation, chunk, text, first, loss_starts, loss_ends) of every conversation."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        compiled = _template(template)

        def rows() -> Iterator[tuple]:
            for name, turns in groupby(_by_row(batches), key=lambda row: row["conversation"]):
                messages = ({"role": row["role"], "text": row["text"]} for row in turns)
                yield from _chunks(name, compiled({"messages": messages}), chunk_chars)

        return _batches(rows(), FORMATTED)

    messages = conversations.select(
        F.col(id_column).alias("conversation"),
        F.col(turn_column).alias("turn"),
        text_or_empty(role_column).alias("role"),
        text_or_empty(text_column).alias("text"),
    )
    dealt = messages.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")
    return dealt.select("conversation", "role", "text").mapInArrow(run, FORMATTED)


def _turns(rows: Iterator[dict]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in the chunks of one conversation, in order."""
    left = ""
    for row in rows:
        left += row["text"]
        at = 0
        while found := _TURN.match(left, at):
            yield unescape(found[1]), unescape(found[2])
            at = found.end()
        left = left[at:]
    if left:
        raise ValueError("the text does not end with a turn")


def messages(formatted: DataFrame) -> DataFrame:
    """(conversation, place, role, text): the turns of conversations in the default template's text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name, chunks in groupby(_by_row(batches), key=lambda row: row["conversation"]):
                for place, (role, text) in enumerate(_turns(chunks)):
                    yield name, place, role, text

        return _batches(rows(), MESSAGES)

    return _in_order(formatted).mapInArrow(run, MESSAGES)


MESSAGES = "conversation long, place long, role string, text string"
DIGESTS = "conversation long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _in_order(formatted: DataFrame) -> DataFrame:
    return formatted.repartition("conversation").sortWithinPartitions("conversation", "chunk")


class _Unescaped:
    """Unescapes text that comes in parts; a part may end between a backslash and its character."""

    def __init__(self):
        self.open = False

    def __call__(self, part: str) -> str:
        if self.open:
            part = "\\" + part
        closed = _ESCAPED.sub("", part)
        self.open = closed.endswith("\\")
        return unescape(part[:-1] if self.open else part)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, from formatted text."""

    def described(name: int | None, rows: Iterator[dict]) -> tuple:
        loss, plain, counts = hashlib.sha256(), _Unescaped(), {"loss": 0, "all": 0}

        def seen() -> Iterator[dict]:
            for row in rows:
                counts["all"] += len(row["text"])
                for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    part = plain(row["text"][a - row["first"] : b - row["first"]])
                    counts["loss"] += len(part)
                    loss.update(part.encode())
                yield row

        turns, n = hashlib.sha256(), 0
        for role, text in _turns(seen()):
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        return name, n, turns.hexdigest(), counts["loss"], loss.hexdigest(), counts["all"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        found = groupby(_by_row(batches), key=lambda row: row["conversation"])
        return _batches((described(name, rows) for name, rows in found), DIGESTS, 1024)

    return _in_order(formatted).mapInArrow(run, DIGESTS)
