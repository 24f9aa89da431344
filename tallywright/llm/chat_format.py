"""Operator 9: chat formatting in budgeted windows.

A conversation becomes windows of whole turns. The running sum of the turns'
tokens decides where a window ends; each later window repeats the system turn
and a limited number of the turns before it. Loss falls on the text of
assistant turns that are new in their window, so each target counts once.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. In texts and roles
every ``<``, any number of ``~``, ``|`` gets one more ``~``; so no control
string can occur inside them, and taking one away restores them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import partitions, table
from .wordpieces import byte_encoder

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_MARKS = 1024, 2, 256, 4
SCHEMA = "conv_id long, window long, n_history int, has_system boolean, n_tokens long, over_budget boolean, text string, loss array<struct<begin:int,end:int>>"

_MARK, _MARKED = re.compile(r"<(~*)\|"), re.compile(r"<~(~*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<~\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Window:
    """State of one conversation: what the open window holds. Never more than a
    window and its history, however long the conversation."""

    conv_id: int | None
    system: tuple[str, str, int] | None = None
    history: list[tuple[str, str, int]] = field(default_factory=list)
    fresh: list[tuple[str, str, int]] = field(default_factory=list)
    #: Tokens of all turns so far, and where the open window's new turns began.
    prefix: int = 0
    opened: int = 0
    index: int = 0
    turns: int = 0

    def fixed(self) -> int:
        return (self.system[2] if self.system and self.index else 0) + sum(t[2] for t in self.history)

    def add(self, role: str, text: str, tokens: int, budget: int, history_turns: int, history_tokens: int) -> Iterator[tuple]:
        if self.fresh and self.fixed() + self.prefix + tokens - self.opened > budget:
            yield self.close(budget)
            past = self.history + self.fresh
            past = [t for t in past if t is not self.system]
            self.history, used = [], 0
            for turn in reversed(past[-history_turns:] if history_turns else []):
                used += turn[2]
                if used > history_tokens:
                    break
                self.history.insert(0, turn)
            self.fresh, self.opened, self.index = [], self.prefix, self.index + 1
            while self.history and self.fixed() + tokens > budget:
                self.history.pop(0)
        turn = (role, text, tokens)
        if self.turns == 0 and role == "system":
            self.system = turn
        self.fresh.append(turn)
        self.prefix += tokens
        self.turns += 1

    def close(self, budget: int) -> tuple:
        repeated = ([self.system] if self.system and self.index else []) + self.history
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate([*repeated, *self.fresh]):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if role == "assistant" and i >= len(repeated):
                loss.append({"begin": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        n = self.fixed() + self.prefix - self.opened
        return (self.conv_id, self.index, len(self.history), bool(self.system and self.index), n, n > budget, "".join(parts), loss)


def format_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text), one row each;
    ``loss`` holds spans of code points in ``text``.

    Turns go by turn, then role and text, so ties have one order; repeated rows
    are repeated turns. Null roles and texts count as empty; turns without
    conv_id make one conversation. Tokens are those of the formatted turn: its role and
    text as they are written, escapes included, and TURN_MARKS for the marks and
    line breaks around them. A turn that alone exceeds the budget keeps
    its whole text in a window marked over_budget. An empty table gives no
    window. Further columns are not read. A conversation is streamed in the
    order of its turns: memory is bounded by the budget and the longest turn."""

    def run(batches):
        count, state = byte_encoder(tokenizer).count, None
        out: list[tuple] = []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv_id != state.conv_id:
                    if state is not None:
                        out.append(state.close(budget))
                    state = Window(conv_id)
                out += state.add(role, text, count(escape_role(role)) + count(escape(text)) + TURN_MARKS, budget, history_turns, history_tokens)
                if len(out) >= 200:
                    yield _batch(out, SCHEMA_ARROW)
                    out = []
        if state is not None:
            out.append(state.close(budget))
        if out:
            yield _batch(out, SCHEMA_ARROW)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


SCHEMA_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_history", pa.int32()), ("has_system", pa.bool_()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
BACK_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window, unescaped."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        found.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted window")
    return found


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, parsed from their text: turns
    that aren't repetitions, and the unescaped text under the loss mask.
    Windows are streamed in order; digests are updated as they pass."""

    def run(batches):
        now, out = None, []

        def done():
            conv_id, turns, text_hash, loss_chars, loss_hash, chars, n = now
            return (conv_id, turns, text_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, n)

        for batch in batches:
            for conv_id, n_history, has_system, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_history", "has_system", "text", "loss")), strict=True):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        out.append(done())
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse_turns(text)[n_history + has_system :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["begin"] : span["end"]])
                    now[3] += len(body)
                    now[4].update(body.encode())
                now[5] += len(text)
                now[6] += 1
            if len(out) >= 500:
                yield _batch(out, BACK_ARROW)
                out = []
        if now is not None:
            out.append(done())
        if out:
            yield _batch(out, BACK_ARROW)

    dealt = windows.repartition(partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.select("conv_id", "n_history", "has_system", "text", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_windows(turns))
