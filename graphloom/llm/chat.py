r"""Chat formatting in budgeted windows.

A turn is written as ``### role: text </turn>`` and a newline. Inside a role or text a backslash
comes before each backslash, each ``#`` of a run of three or more and each ``</turn>`` (in a role,
before ``:`` too), so the marks can't be forged and the writing can be undone.

A conversation is cut at turns. Running sums of the turns' tokens choose the longest span of new
turns that fits the budget beside what is repeated: the system turn, if the conversation opens
with one, and up to ``history`` turns before the span that fit a quarter of the budget. Tokens are
what ``tokens`` counts in a written turn: the length of a tokenizer's ids, or words by default. Spans
are of whole turns and the system turn is always retained, so a window is over the budget only if its
one new turn and the system turn alone are; then nothing else is repeated. The loss covers the texts of the span's
assistant turns; repeated turns are never covered, so each assistant text counts once.

Rows are dealt by conversation and sorted in it, then written as a stream: a task holds one window
and the turns that may be repeated, however long a conversation is.

Null roles and texts count as empty. Turns of equal number are taken in the order of role and
text, repeated rows one after the other, null numbers first. Rows without a conversation id make up
one conversation. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_ROLE = re.compile(r"((?:[^\\:]|\\.)*): ", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_RUN = re.compile("#{3,}")

WINDOWS = "conv_id {id}, window long, text string, context_turns int, turns int, tokens long, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("</turn>", "\\</turn>")
    return _RUN.sub(lambda m: "\\#" * len(m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its escaped text begins and ends in it."""
    head = OPEN + escape(role).replace(":", "\\:") + COLON
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the place of the escaped text, for each turn of a window."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("a turn doesn't begin with its mark")
        role = _ROLE.match(text, at + len(OPEN))
        end = text.find(CLOSE, role.end() if role else at)
        if role is None or end < 0:
            raise ValueError("a turn doesn't end with its mark")
        yield unescape(role[1]), unescape(text[role.end() : end]), role.end(), end
        at = end + len(CLOSE)


def word_tokens(text: str) -> int:
    return len(text.split())


class Windower:
    """Windows of one conversation, from its turns in order."""

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]) -> None:
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple | None = None
        self.recent: list[tuple] = []
        self.context: list[tuple] = []
        self.span: list[tuple] = []
        self.total, self.seen, self.number = 0, 0, 0

    def add(self, role: str, text: str) -> dict | None:
        turn = (*write_turn(role, text), role)
        turn = (*turn, self.tokens(turn[0]))
        done = None
        if self.span and self.total + turn[4] > self.budget:
            done = self.close()
            self.context = self._repeated()
            self.total = sum(t[4] for t in self.context)
            while len(self.context) > (self.system is not None) and self.total + turn[4] > self.budget:
                self.total -= self.context.pop(1 if self.system is not None else 0)[4]
        self.span.append(turn)
        self.total += turn[4]
        if not self.seen and role == "system":
            self.system = turn
        else:
            self.recent = [*self.recent, turn][-self.history :] if self.history else []
        self.seen += 1
        return done

    def _repeated(self) -> list[tuple]:
        kept, room = [], self.budget // 4
        for turn in reversed(self.recent):
            if turn[4] > room:
                break
            kept.insert(0, turn)
            room -= turn[4]
        return ([self.system] if self.system is not None else []) + kept

    def close(self) -> dict | None:
        if not self.span:
            return None
        at, starts, ends = sum(len(t[0]) for t in self.context), [], []
        for written, start, end, role, _ in self.span:
            if role == "assistant":
                starts.append(at + start)
                ends.append(at + end)
            at += len(written)
        out = {"window": self.number, "text": "".join(t[0] for t in (*self.context, *self.span)), "context_turns": len(self.context), "turns": len(self.span), "tokens": self.total, "loss_starts": starts, "loss_ends": ends}
        self.span, self.number = [], self.number + 1
        return out


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 2, tokens: Callable[[str], int] = word_tokens) -> DataFrame:
    """One row per window; a conversation's windows follow each other in order, in one partition.

    ``context_turns`` of a window's turns are repeated; the loss spans are code points of ``text``.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [None]

        def windows() -> Iterator[dict]:
            key, of = object(), None
            for batch in batches:
                if schema[0] is None:
                    longs = pa.list_(pa.int64())
                    schema[0] = pa.schema([("conv_id", batch.column(0).type), ("window", pa.int64()), ("text", pa.string()), ("context_turns", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64()), ("loss_starts", longs), ("loss_ends", longs)])
                for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if of is None or conv != key:
                        if of is not None and (last := of.close()):
                            yield {"conv_id": key, **last}
                        key, of = conv, Windower(budget, history, tokens)
                    if done := of.add(role or "", text or ""):
                        yield {"conv_id": key, **done}
            if of is not None and (last := of.close()):
                yield {"conv_id": key, **last}

        held: list[dict] = []
        for window in windows():
            held.append(window)
            if len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, schema=schema[0])
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema[0])

    return rows.mapInArrow(run, WINDOWS.format(id=kind))


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say of each conversation: its turns' and its loss texts' digests and lengths.

    ``windows``: as ``format_windows`` gives them (in order, a conversation within one partition).
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    source = windows.select("conv_id", "text", "context_turns", "loss_starts", "loss_ends")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done, id_type = None, None, [], None

        def finish() -> tuple:
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def out() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for conv, text, context, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(finish())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, said, _, _) in enumerate(read_turns(text)):
                    if i >= context:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(done) >= 1024:
                yield out()
                done = []
        if state is not None:
            done.append(finish())
            yield out()

    return source.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
