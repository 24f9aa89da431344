"""Judges of laws: a client protocol, retries, replay of recorded answers, and
one row per attempt and judge. Networks are for clients of one's own."""

from __future__ import annotations

import json
import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks an error as worth a retry.
RETRY_WORDS = (
    "rate limit", "ratelimit", "rate-limit", "429", "resource_exhausted", "resource exhausted", "resourceexhausted", "quota",
    "overloaded", "service unavailable", "503", "502", "504", "timeout", "timed out", "temporar", "connection", "apiconnection",
)
LEVELS = 5
T = TypeVar("T")


@dataclass
class Answer:
    parsed: dict | None = None
    raw_text: str = ""
    latency_s: float = 0.0
    tokens_in: int = 0
    tokens_out: int = 0
    error: str | None = None


class Judge(Protocol):
    name: str

    def call(self, system: str, user: str, schema: dict) -> Answer: ...


def likert_schema(fields: tuple[str, ...] = ("name", "statement", "formula", "overall")) -> dict:
    properties = {f: {"type": "integer", "minimum": 0, "maximum": LEVELS - 1} for f in fields} | {"justification": {"type": "string"}}
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def without_keys(schema, dropped: frozenset[str]):
    """A JSON schema without some keys, at any depth."""
    if isinstance(schema, dict):
        return {k: without_keys(v, dropped) for k, v in schema.items() if k not in dropped}
    return [without_keys(v, dropped) for v in schema] if isinstance(schema, list) else schema


def worth_retry(message: Column) -> Column:
    """Native form of the test for a retry."""
    rule = F.lit(False)
    for word in RETRY_WORDS:
        rule = rule | F.lower(message).contains(word)
    return rule


def with_retries(call: Callable[[], object], attempts: int = 5, delay: float = 2.0, jitter: float = 0.4, sleep: Callable[[float], None] = time.sleep):
    """``call()``; on a passing error again, after twice the time."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if not any(w in str(e).lower() for w in RETRY_WORDS) or i == attempts - 1:
                raise
            sleep(delay * 2**i * (1 + random.random() * jitter))


@dataclass
class Replay:
    """Answers from a recording: prompt -> JSON text."""

    name: str
    recorded: dict[str, str]

    def call(self, system: str, user: str, schema: dict) -> Answer:
        if user not in self.recorded:
            return Answer(error="no recorded answer")
        raw = self.recorded[user]
        try:
            return Answer(json.loads(raw), raw, tokens_in=len(user.split()), tokens_out=len(raw.split()))
        except ValueError as e:
            return Answer(raw_text=raw, error=f"JSONDecodeError: {e}")


def ask(judge: Judge, system: str, user: str, schema: dict) -> Answer:
    """One answer; an error that retries don't mend is an answer too."""
    try:
        return with_retries(lambda: judge.call(system, user, schema))
    except Exception as e:
        return Answer(error=f"{type(e).__name__}: {e}")


def fan_out(calls: Iterable[Callable[[], T]], concurrency: int) -> Iterator[T]:
    """Results of ``calls`` in their order. At most ``concurrency`` run at a time, and
    as many more are taken from ``calls`` ahead of the result that is due, so a
    slow call neither stops the others at once nor lets results pile up. What a
    call raises is raised in its turn."""
    waiting: deque[Future] = deque()
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        try:
            for call in calls:
                waiting.append(pool.submit(call))
                if len(waiting) >= 2 * concurrency:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for left in waiting:
                left.cancel()


def side_by_side(call: Callable[[dict], T], rows: list[dict], concurrency: int) -> list[T | None]:
    """``call`` of each of a batch's rows, in their order: ``concurrency`` threads take
    the next row each until none is left, so a slow call stops no other and no
    row costs a task of a pool."""
    out: list[T | None] = [None] * len(rows)
    left = iter(range(len(rows)))

    def work() -> None:
        for i in left:
            out[i] = call(rows[i])

    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        for thread in [pool.submit(work) for _ in range(min(concurrency, len(rows)))]:
            thread.result()
    return out


ANSWERED = "scores string, raw_response string, latency_s double, tokens_in long, tokens_out long, judge_error string"


def _answer_columns(answers: list[Answer]) -> list[pa.Array]:
    return [
        pa.array([json.dumps(a.parsed) if a.parsed else None for a in answers], pa.string()), pa.array([a.raw_text for a in answers], pa.string()), pa.array([a.latency_s for a in answers], pa.float64()),
        pa.array([a.tokens_in for a in answers], pa.int64()), pa.array([a.tokens_out for a in answers], pa.int64()), pa.array([a.error for a in answers], pa.string()),
    ]


def answered(work: DataFrame, judges: list[Judge], schema: dict | None = None, concurrency: int = 8, system: str = "system", user: str = "user", judge: str = "judge_model") -> DataFrame:
    """``work`` (a row per call: which judge, system and user prompt) with the answers'
    columns, in the rows' order. A row with a null user prompt isn't asked: its
    columns are null. ``concurrency`` calls run at a time in each Spark task, over
    rows and judges alike, so several judges of an attempt are asked together."""
    schema, by_name = schema or likert_schema(), {j.name: j for j in judges}
    kept = [c for c in work.columns if c not in (system, user)]
    types = dict(work.dtypes)
    nothing = Answer(None, None, None, None, None, None)

    def call(row: dict) -> Answer:
        chosen = by_name.get(row[judge])
        return Answer(error=f"no judge {row[judge]}") if chosen is None else ask(chosen, row[system], row[user], schema)

    def run(batches):
        for batch in batches:
            asked = batch.select([system, user, judge]).to_pylist()
            answers = [nothing] * len(asked)
            at = [i for i, row in enumerate(asked) if row[user] is not None]
            for i, answer in zip(at, side_by_side(call, [asked[i] for i in at], concurrency), strict=True):
                answers[i] = answer
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *_answer_columns(answers)], names=[*kept, *(c.split()[0] for c in ANSWERED.split(", "))])

    return work.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + ANSWERED)


def judged(prompts: DataFrame, keys: list[str], judges: list[Judge], system: str, schema: dict | None = None, user: str = "prompt", concurrency: int = 8) -> DataFrame:
    """One row per prompt and judge, in the judges' order."""
    named = F.explode(F.array(*(F.lit(j.name) for j in judges))).alias("judge_model")
    return answered(prompts.select(*keys, F.lit(system).alias("system"), F.col(user).alias("user"), named), judges, schema, concurrency)
