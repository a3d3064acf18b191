"""Models as pluggable functions, with deterministic defaults that need no network, and what calls to them need."""

from __future__ import annotations

import functools
import random
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def first_sentences(prompts: list[str], count: int = 2) -> list[str]:
    """The default model: the first sentences of what it is given."""
    out = []
    for p in prompts:
        parts = (p or "").replace("\n", " ").split(". ")
        out.append(". ".join(parts[:count]).strip())
    return out


def retry(times: int = 3, first_wait: float = 0.1, factor: float = 2.0, most: float = 30.0, jitter: float = 0.0, errors: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """Calls again after an error, with growing waits of at most ``most`` seconds; the last error is raised."""

    def wrap(f):
        @functools.wraps(f)
        def run(*a, **k):
            wait = first_wait
            for n in range(times):
                try:
                    return f(*a, **k)
                except errors:
                    if n == times - 1:
                        raise
                    sleep(min(most, wait) * (1 + jitter * random.random()))
                    wait *= factor

        return run

    return wrap


class RateLimiter:
    """At most ``limit`` units in any ``window`` seconds; the clock and the sleep can be given for tests."""

    def __init__(self, limit: float, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limit, self.window, self.clock, self.sleep = limit, window, clock, sleep
        self.used: deque[tuple[float, float]] = deque()

    def acquire(self, units: float = 1.0) -> float:
        """Waits until the units fit, and says how long; more units than the limit go once nothing else is in the window."""
        waited = 0.0
        while True:
            now = self.clock()
            while self.used and self.used[0][0] <= now - self.window:
                self.used.popleft()
            if not self.used or sum(u for _, u in self.used) + units <= self.limit:
                self.used.append((now, units))
                return waited
            pause = max(1e-3, self.used[0][0] + self.window - now)
            self.sleep(pause)
            waited += pause


class TtlCache:
    """The last ``size`` values, each for ``ttl`` seconds."""

    def __init__(self, size: int = 1000, ttl: float = float("inf"), clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.values: OrderedDict[Any, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        if key in self.values and self.clock() - self.values[key][0] < self.ttl:
            self.hits += 1
            self.values.move_to_end(key)
            return self.values[key][1]
        self.misses += 1
        value = make()
        self.values[key] = (self.clock(), value)
        self.values.move_to_end(key)
        while len(self.values) > self.size:
            self.values.popitem(last=False)
        return value


class Prompts:
    """Named templates with versions; the last one is current."""

    def __init__(self) -> None:
        self.by_name: dict[str, list[str]] = {}

    def register(self, name: str, template: str) -> int:
        self.by_name.setdefault(name, []).append(template)
        return len(self.by_name[name])

    def render(self, prompt: str, /, version: int | None = None, **values: Any) -> str:
        return self.by_name[prompt][(version or len(self.by_name[prompt])) - 1].format(**values)


def complete(rows: DataFrame, prompt: Column, model: Model = first_sentences, out: str = "answer", threads: int = 4, a_minute: float | None = None, tries: int = 3) -> DataFrame:
    """``rows`` with the model's answer to each prompt: Arrow batches, several calls at a time in a task, a limiter of its
    own for each task, and retries."""
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(a_minute) if a_minute else None
        call = retry(tries)(lambda p: model([p])[0])

        def one(p: str) -> str:
            if limiter:
                limiter.acquire()
            return call(p)

        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                part[out] = list(pool.map(one, part["_prompt"].fillna("").tolist()))
                yield part[[*names, out]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` string"
    return rows.withColumn("_prompt", prompt).mapInPandas(run, schema)


def structured(rows: DataFrame, prompt: Column, schema: str, model: Model, out: str = "parsed") -> DataFrame:
    """Answers as structs of a schema, null where an answer is no JSON object of that shape."""
    return complete(rows, prompt, model, "_answer").withColumn(out, F.from_json("_answer", schema)).drop("_answer")
