r"""Conversations as training texts with a loss mask, each turn proven by reading it back.

The template is a grammar that a deterministic parser reads from left to right (fixed values: its control strings):

    conversation = "<s>" turn*
    turn         = "[INST]" text "[/INST]"                      a user's
                 | "<<SYS>>" text "<</SYS>>"                    the system's
                 | "[ROLE]" role "[/ROLE]" text "[END]"         any other role's
                 | text "</s>"                                  an assistant's: its text is what the loss mask covers

A text may hold no control string. Each turn is first rendered as it is and parsed; if that fails or gives another turn,
as for a text that holds a control string or an escaped one, each of these gets one more backslash behind its first
character, until the parser returns the source's turn. The parser takes one backslash from each.

Turns are sorted over ranges of (conversation, turn) and not gathered by conversation, so one with a third of all rows is
rendered by many tasks. They are joined to pieces of about max_chars code points, which end between turns: most
conversations are one row, and no task holds a long one. Only what stands at the two ends of a range may go on in another
one: these pieces alone are dealt by conversation and joined. Digests of a conversation of several pieces pass through a
task piece by piece.

Defined results: null texts and roles are empty; turns of one number are ordered by role and the text's SHA-256, a null
number is first; repeated rows are turns, each; rows without a conversation's id form one; an empty table gives an empty
result; a text longer than max_chars is a piece of its own. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

# The control strings, and how each role's turn begins and ends.
BEGIN, ANSWER_END, ROLE, ROLE_END, END = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>")}
ASSISTANT = "assistant"
_CONTROL = re.compile(r"</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[END\]")
#: A control string, or one with backslashes behind its first character.
FAMILY = r"(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?INST\]|/?ROLE\]|END\])"
_FAMILY = re.compile(FAMILY)
_OPENED = {start: (role, end) for role, (start, end) in MARKS.items()}

#: Rows of a batch and code points at which one is passed on: pieces are long.
BATCH_ROWS, BATCH_CHARS = 2048, 4_000_000
PIECE = "conv_id long, place long, formatted string, n_turns long, loss array<struct<start: long, stop: long>>, last boolean"


def escape(text: str) -> str:
    return _FAMILY.sub(lambda m: m[1] + "\\" + m[2] + m[3] if m[1] else m[4] + "\\" + m[5] + m[6], text)


def unescape(text: str) -> str:
    return _FAMILY.sub(lambda m: m[1] + m[2][1:] + m[3] if m[1] else m[4] + m[5][1:] + m[6], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the start and stop of its text."""
    if role == ASSISTANT:
        before, after = "", ANSWER_END
    else:
        before, after = MARKS.get(role, (f"{ROLE}{role}{ROLE_END}", END))
    return before + text + after, len(before), len(before) + len(text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, start and stop of each turn; a ValueError at what isn't of the grammar."""
    at, marks = 0, _CONTROL.finditer(formatted)

    def expect(*wanted: str) -> re.Match:
        found = next(marks, None)
        if found is None or found[0] not in wanted:
            raise ValueError(f"no {wanted} behind {at}")
        return found

    while at < len(formatted):
        mark = expect(ANSWER_END, ROLE, *_OPENED)
        if mark[0] == ANSWER_END:
            role, start, end = ASSISTANT, at, mark
        elif mark.start() != at:
            raise ValueError(f"text outside of a turn at {at}")
        elif mark[0] == ROLE:
            named = expect(ROLE_END)
            role, start, end = unescape(formatted[mark.end() : named.start()]), named.end(), expect(END)
        else:
            role, closing = _OPENED[mark[0]]
            start, end = mark.end(), expect(closing)
        yield role, unescape(formatted[start : end.start()]), start, end.start()
        at = end.end()


def _reads_as(turn: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(turn)] == [(role, text)]
    except ValueError:
        return False


def proven(role: str, text: str) -> tuple[str, int, int]:
    """render(), escaped where the parser wouldn't give back the turn otherwise."""
    shown = role, text
    for _ in range(2):
        turn = render(*shown)
        if _reads_as(turn[0], role, text):
            return turn
        shown = escape(shown[0]) if role not in (ASSISTANT, *MARKS) else role, escape(shown[1])
    raise ValueError(f"a turn of {role[:40]} can't be read back")


class _Piece:
    """Turns, or shorter pieces, of one conversation in a row."""

    def __init__(self, conv: int | None, place: int, start: str = ""):
        self.conv, self.place, self.parts, self.chars, self.turns, self.loss = conv, place, [start], len(start), 0, []

    def add(self, text: str, turns: int, loss: list[tuple[int, int]]) -> None:
        self.loss += [{"start": a + self.chars, "stop": b + self.chars} for a, b in loss]
        self.parts.append(text)
        self.chars += len(text)
        self.turns += turns

    def row(self) -> dict:
        return {"conv_id": self.conv, "place": self.place, "formatted": "".join(self.parts), "n_turns": self.turns, "loss": self.loss}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("formatted") or "")
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_PIECE = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("loss", _LOSS), ("last", pa.bool_())])
#: done: null, or of a piece at the end of a range the pieces of its conversation that stand before it.
_OPEN = pa.schema([*_PIECE, ("done", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):  # Python objects of a few rows at a time
            yield from batch.slice(i, 64).to_pylist()


def format_conversations(conversations: DataFrame, max_chars: int = 262_144) -> DataFrame:
    """conv_id, place, formatted, n_turns, loss (start and stop of the texts to learn, in code points of the piece) and last.

    place counts a conversation's pieces from 0, last marks the last of them. conversations: conv_id, turn, role, text. The
    result is read from tables that are written out by then.
    """

    def joined(rows: Iterator[dict]) -> Iterator[dict]:
        piece, number, first = None, TaskContext.get().partitionId() << 33, True
        for r in rows:
            same = piece is not None and piece.conv == r["conv_id"]
            if not same or piece.chars >= max_chars:
                if piece:  # of a range's first conversation any piece may go on from the range before
                    yield piece.row() | ({"place": number, "done": 0, "last": False} if first else {"last": not same})
                    number, first = number + 1, first and same
                piece = _Piece(r["conv_id"], piece.place + 1) if same else _Piece(r["conv_id"], 0, BEGIN if piece else "")
            turn, start, stop = proven(r["role"], r["text"])
            piece.add(turn, 1, [(start, stop)] if r["role"] == ASSISTANT else [])
        if piece:
            yield piece.row() | {"place": number, "done": 0 if first else piece.place, "last": False}

    def merged(rows: Iterator[dict]) -> Iterator[dict]:
        piece = None
        for r in rows:
            same = piece is not None and piece.conv == r["conv_id"]
            if not same or piece.chars + len(r["formatted"]) > max_chars:
                if piece:
                    yield piece.row() | {"last": not same}
                piece = _Piece(r["conv_id"], piece.place + 1) if same else _Piece(r["conv_id"], r["done"], BEGIN if r["bare"] else "")
            piece.add(r["formatted"], r["n_turns"], [(s["start"], s["stop"]) for s in r["loss"]])
        if piece:
            yield piece.row() | {"last": True}

    none = F.lit("")
    text = F.coalesce("text", none)
    turns = conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    # Rows that are equal but for _row are the same turn: it only lets ranges part them.
    order = ["conv_id", "turn", "role", "_digest", "_row"]
    ranges = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    pieces = materialize(ranges.mapInArrow(lambda b: _batches(joined(_rows(b)), _OPEN), f"{PIECE}, done long"))
    ends = pieces.where("done is not null").withColumn("bare", ~F.startswith("formatted", F.lit(BEGIN)) & (F.col("done") == 0))
    rest = ends.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(lambda b: _batches(merged(_rows(b)), _PIECE), PIECE)
    return pieces.where("done is null").drop("done").unionByName(materialize(rest))


class _Digests:
    """What the pieces of one conversation hold, read so far."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars, self.all, self.loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def read(self, r: dict) -> None:
        text = r["formatted"]
        self.chars += len(text)
        begin = len(BEGIN) if r["place"] == 0 else 0
        for role, said, _, _ in parse(text[begin:]):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for span in r["loss"]:
            said = unescape(text[span["start"] : span["stop"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_REPORT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame) -> DataFrame:
    """A row for each conversation, from its formatted pieces alone: see format_report(). pieces is read twice."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[dict]:
            now = None
            for r in _rows(batches):
                if now is None or r["place"] == 0:
                    if now:
                        yield now.row()
                    now = _Digests(r["conv_id"])
                now.read(r)
            if now:
                yield now.row()

        yield from _batches(conversations(), _REPORT)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    used = pieces.select("conv_id", "place", "last", "formatted", "loss")
    one = (F.col("place") == 0) & F.col("last")
    long = used.where(~one).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return used.where(one).mapInArrow(read, schema).unionByName(long.mapInArrow(read, schema))


def format_report(conversations: DataFrame, max_chars: int = 262_144) -> DataFrame:
    """conv_id, n_turns, digest of roles and texts, code points and digest of what is learnt, code points of the formatted text.

    All of it is read from the formatted pieces once they are written out.
    """
    return read_back(format_conversations(conversations, max_chars))


def with_conflict(conversations: DataFrame) -> DataFrame:
    """conversations and number -7, whose two turns look like the template."""
    looks = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", looks), (-7, 1, ASSISTANT, looks)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


SQL = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown as (
  select *, length(regexp_replace(text, '{FAMILY}', '\1\4\\\2\5\3\6', 'g')) + case role
    when 'user' then {sum(map(len, MARKS["user"]))} when 'system' then {sum(map(len, MARKS["system"]))} when 'assistant' then {len(ANSWER_END)}
    else {len(ROLE + ROLE_END + END)} + length(regexp_replace(role, '{FAMILY}', '\1\4\\\2\5\3\6', 'g')) end as chars
  from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, sha256(text))) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, sha256(text)) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) + {len(BEGIN)} as bigint) as formatted_chars
from shown group by conv_id"""
