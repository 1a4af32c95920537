"""What surrounds model calls and runs: budgets, routing of models, retries, prompts under a lock, and an event log."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators.ordering import running_sums


def within_budget(calls: DataFrame, order: list[str], calls_limit: int | None = None, tokens_limit: int | None = None,
    usd_limit: float | None = None) -> DataFrame:
    """calls (input_tokens, output_tokens, usd, others) with allowed: whether the call, in this order, still fits every limit.

    A limit holds for what the calls before it and the call itself may spend. The first call that does not fit stops
    the run: no later one is allowed, and what it was to check stays unchecked."""
    sums = {"_calls": F.lit(1), "_tokens": F.col("input_tokens") + F.col("output_tokens"), "_usd": F.coalesce("usd", F.lit(0.0))}
    x = running_sums(calls, order, sums)
    fits: Column = F.lit(True)
    for limit, spent in ((calls_limit, F.col("_calls") + 1), (tokens_limit, F.col("_tokens") + sums["_tokens"]),
        (usd_limit, F.col("_usd") + sums["_usd"])):
        if limit is not None:
            fits = fits & (spent <= F.lit(limit))
    x = x.withColumn("allowed", fits)
    stop = x.where("NOT allowed").agg(F.min(F.struct(*order)).alias("_stop"))  # one row
    return x.crossJoin(F.broadcast(stop)).withColumn("allowed",
        F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))).select(*calls.columns, "allowed")


def delay(retry: int, retry_after: float | None = None, base: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait before try number `retry` (from 0): what the service asked for, else doubling, `most` at most."""
    return min(most, retry_after if retry_after is not None and retry_after >= 0 else base * 2 ** retry)


class Models:
    """Callables by provider; a model is named `provider:model`, and a bare name takes the only provider."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[[str], Callable]] = {}

    def register(self, provider: str, make: Callable[[str], Callable]) -> None:
        self._made[provider] = make

    def resolve(self, spec: str) -> Callable:
        provider, _, model = spec.rpartition(":")
        if not provider and len(self._made) == 1:
            provider = next(iter(self._made))
        if provider not in self._made:
            raise ValueError(f"{spec!r}: no such provider; known: {', '.join(sorted(self._made)) or 'none'}")
        return self._made[provider](model)


@dataclass(frozen=True)
class Prompt:
    id: str
    version: str
    text: str

    def key(self) -> str:
        return f"{self.id}@{self.version}"

    def sha256(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


@dataclass
class Prompts:
    """Prompts by id and version, and a lock of their hashes: a changed text under a known version is an error."""

    found: dict[str, Prompt] = field(default_factory=dict)

    def add(self, prompt: Prompt) -> Prompt:
        if prompt.key() in self.found and self.found[prompt.key()] != prompt:
            raise ValueError(f"{prompt.key()}: already there with another text")
        self.found[prompt.key()] = prompt
        return prompt

    def lock(self) -> dict[str, str]:
        return {k: self.found[k].sha256() for k in sorted(self.found)}

    def check(self, lock: dict[str, str]) -> list[str]:
        """Keys whose text has changed since the lock, and keys that it lacks or that are gone."""
        mine = self.lock()
        return sorted(k for k in mine.keys() | lock.keys() if mine.get(k) != lock.get(k))


class EventLog:
    """Events of a run as JSON rows: run, ord, at, event and its fields. Events are kept on the driver, a few for each stage, and
    written at once."""

    def __init__(self, command: str, run: str | None = None, clock: Callable[[], float] = time.time):
        self.run, self.command, self._clock, self.events = run or uuid.uuid4().hex[:12], command, clock, []

    def emit(self, event: str, **fields) -> None:
        self.events.append({"run": self.run, "command": self.command, "ord": len(self.events), "at": self._clock(), "event": event,
            **fields})

    def observed(self, df: DataFrame, stage: str, **measures: Column) -> tuple[DataFrame, Observation]:
        """df with counts taken while it is computed: rows, and the given aggregates. `close` turns them into an event."""
        o = Observation(stage)
        return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]), o

    def close(self, o: Observation, stage: str) -> dict:
        got = dict(o.get)
        self.emit("stage", stage=stage, **got)
        return got

    def write(self, spark: SparkSession, path: str) -> None:
        lines = [(json.dumps(e, default=str),) for e in self.events]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)


def double_stages(done_by_platform: set[str], configured: set[str]) -> list[str]:
    """Stages that a platform already does and the configuration does again."""
    return [f"{s}: the platform does this already; leave it out or delegate it" for s in sorted(done_by_platform & configured)]
