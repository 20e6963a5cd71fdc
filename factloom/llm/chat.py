"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Template.  A turn is ``<|turn|>role`` newline ``text<|end|>`` newline; a turn that is
repeated from an earlier window starts with ``<|again|>``.  In roles and texts a
backslash is doubled and a backslash is put after the first character of every
control string (``CONTROLS``), so no control string of a text survives and every turn
can be read back exactly.

Windows.  Turns come by turn number.  The running sum of turn tokens chooses the spans:
a window takes turns while they fit ``budget`` tokens.  A turn's tokens are the word
pieces of all that is written for it, marks and escapes included; as a turn ends with a
newline, the tokens of a window are the sum of its turns'.  Later windows begin with the
system turn (the first turn, if its role is ``system``) and the latest turns of at most
``history`` tokens, both marked as repeated, as far as the budget allows beside the new
turn (the system turn first).  Nothing is cut: a turn longer than the budget gets a
window of its own, and only such a window is over the budget.  The loss mask holds the
text of each assistant turn where it first occurs, never of repeated turns.

Conversations are sorted within partitions and read as a stream: a window, the system
turn and the history (at most ``history`` tokens, of which each turn has some) are all
that is held, however long a conversation is.  The spans depend on all turns before
them, so one conversation is one task's stream.

Edge cases: null roles and texts are empty; rows without an id form one conversation;
equal turn numbers are ordered by role and text; null turns come first; empty texts are
turns like others; an empty table gives no windows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokencount import Automaton, count_tokens, read_vocabulary

BUDGET, HISTORY = 1024, 256
#: Control strings of this template and of common ones; none survives in a text.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
END = "<|end|>\n"
_TURN = re.compile(r"<\|(turn|again)\|>(.*?)\n(.*?)<\|end\|>\n", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)
FORMATTED = "conv_id long, window int, text string, n_tokens long, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    """Reversible; the result holds no control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Inverse of ``escape`` (and of the escaped newline of a role)."""
    return _BACK.sub(lambda m: "\n" if m[1] == "N" else m[1], text)


def heading(role: str, again: bool) -> str:
    """The first line of a turn."""
    return f"<|{'again' if again else 'turn'}|>{escape(role).replace(chr(10), chr(92) + 'N')}\n"


@dataclass
class Turn:
    """One turn: its escaped body and its tokens when new and when repeated."""

    role: str
    body: str
    tokens: int
    again: int


class Window:
    """One window under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = self.tokens = 0
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, turn: Turn, again: bool) -> None:
        head = heading(turn.role, again)
        if turn.role == "assistant" and not again:
            self.starts.append(self.size + len(head))
            self.ends.append(self.size + len(head) + len(turn.body))
        self.parts += [head, turn.body, END]
        self.size += len(head) + len(turn.body) + len(END)
        self.tokens += turn.again if again else turn.tokens


def windows(turns: Iterable[Turn], budget: int = BUDGET, history: int = HISTORY) -> Iterator[Window]:
    """Windows of one conversation's turns, as a stream."""
    system, recent, held, now = None, deque(), 0, Window()
    for i, turn in enumerate(turns):
        if now.parts and now.tokens + turn.tokens > budget:
            yield now
            now, room = Window(), budget - turn.tokens
            if system and system.again <= room:
                now.add(system, again=True)
                room -= system.again
            room, kept = min(room, history), 0
            for old in reversed(recent):
                if old.again > room:
                    break
                room -= old.again
                kept += 1
            for old in islice(recent, len(recent) - kept, None):
                now.add(old, again=True)
        now.add(turn, again=False)
        if i == 0 and turn.role == "system":
            system = turn
            continue
        recent.append(turn)
        held += turn.again
        while held > history:
            held -= recent.popleft().again
    if now.parts:
        yield now


def measured(automaton: Automaton, rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, turn) of record batches (key, role, text), with the tokens of all that is written for a turn."""
    heads: dict[str, list[int]] = {}
    for batch in rows:
        for lo in range(0, batch.num_rows, 1024):
            keys, roles, texts = (batch.column(c).slice(lo, 1024).to_pylist() for c in range(3))
            bodies = [escape(t) for t in texts]
            for role in set(roles) - heads.keys():
                if len(heads) > 10_000:
                    heads.clear()
                heads[role] = count_tokens(automaton, pa.array([heading(role, False), heading(role, True)])).tolist()
            counts = count_tokens(automaton, pa.array([b + END for b in bodies], pa.large_string())).tolist()
            for key, role, body, n in zip(keys, roles, bodies, counts, strict=True):
                new, again = heads.get(role) or count_tokens(automaton, pa.array([heading(role, False), heading(role, True)])).tolist()
                yield key, Turn(role, body, new + n, again + n)


def read_back(formatted) -> tuple[int, str, int, str, int]:
    """(turns, their sha256, loss characters, their sha256, formatted characters) of a stream of (text, starts, ends)."""
    turns, all_turns, loss, all_loss, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
    for text, starts, ends in formatted:
        size += len(text)
        for m in _TURN.finditer(text):
            if m[1] == "turn":
                turns += 1
                all_turns.update(f"{unescape(m[2])}\n{unescape(m[3])}\n".encode("utf-8", "surrogatepass"))
        for s, e in zip(starts, ends, strict=True):
            part = unescape(text[s:e])
            loss += len(part)
            all_loss.update(part.encode("utf-8", "surrogatepass"))
    return turns, all_turns.hexdigest(), loss, all_loss.hexdigest(), size


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, stream of rows) for runs of an equal first field; each run is used up before the next."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run():
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        stream = run()
        yield key, stream
        for _ in stream:
            pass


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_conversations(rows: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of rows (conv_id, turn, role, text), in order within each partition."""
    if budget < 1 or history < 0:
        raise ValueError("budget must be positive and history not negative")
    held = rows.sparkSession.sparkContext.broadcast(Automaton(*read_vocabulary(vocabulary)))
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = slim.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = pa.schema(
        [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for key, stream in _runs(measured(held.value, batches)):
                for i, w in enumerate(windows((row[1] for row in stream), budget, history)):
                    yield key, i, "".join(w.parts), w.tokens, w.starts, w.ends

        yield from _batched(made(), schema)

    return ordered.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from its windows (in the order they were written)."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True)

        def read():
            for key, stream in _runs(rows()):
                yield key, *read_back(row[1:] for row in stream)

        yield from _batched(read(), schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
