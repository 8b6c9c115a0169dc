"""Circuit breaker, token bucket and capacity gate as folds over ordered calls.

Each is a pure step over a small state; the batch form folds the calls of a key in time order, and the
streaming form keeps the state in the engine (``corpusloom.streaming``).
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.functions.constants import (
    BUCKET_CAPACITY,
    BUCKET_PER_MINUTE,
    CIRCUIT_FAILURES,
    CIRCUIT_SECONDS,
)


class Circuit:
    """Opens after ``failures`` failures in a row; after ``seconds`` lets one probe through."""

    def __init__(self, failures: int = CIRCUIT_FAILURES, seconds: float = CIRCUIT_SECONDS, state: tuple = (0, None, False)):
        self.limit, self.seconds = max(1, failures), max(0.1, seconds)
        self.failures, self.opened, self.probing = state

    @property
    def state(self) -> tuple:
        return self.failures, self.opened, self.probing

    def allow(self, now: float) -> bool:
        if self.opened is None:
            return True
        if now - self.opened < self.seconds or self.probing:
            return False
        self.probing = True
        return True

    def result(self, now: float, ok: bool) -> None:
        self.probing = False
        if ok:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.limit:
                self.opened = now

    def name(self, now: float) -> str:
        return "closed" if self.opened is None else "open" if now - self.opened < self.seconds else "half_open"


class Bucket:
    """Tokens up to ``capacity``, refilled by the second; a refused call learns how long to wait."""

    def __init__(self, capacity: int = BUCKET_CAPACITY, per_second: float = BUCKET_PER_MINUTE / 60, tokens: float | None = None, at: float | None = None):
        self.capacity, self.rate = max(1, capacity), max(0.01, per_second)
        self.tokens, self.at = float(self.capacity) if tokens is None else tokens, at

    def take(self, now: float) -> tuple[bool, int]:
        if self.at is not None:
            self.tokens = min(float(self.capacity), self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        if self.tokens >= 1:
            self.tokens -= 1
            return True, 0
        return False, max(1, int((1 - self.tokens) / self.rate) + 1)


def _chunked(calls: DataFrame, key: str, schema: str, start, step) -> DataFrame:
    """Fold of each key's calls, streamed in time order: rows are sorted by the shuffle and only the state is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                k = getattr(r, key)
                if k != current:
                    current, state = k, start()
                rows.append(step(state, r))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return calls.repartition(n, key).sortWithinPartitions(key, "at", "call_id").mapInPandas(run, schema)


def circuit_states(calls: DataFrame) -> DataFrame:
    """``call_id, shard, allowed, state`` of calls (call_id, shard, at in seconds, ok), each known to the next."""

    def step(c: Circuit, r) -> tuple:
        ok = c.allow(r.at)
        if ok:
            c.result(r.at, bool(r.ok))
        return r.call_id, r.shard, ok, c.name(r.at)

    return _chunked(calls, "shard", "call_id long, shard int, allowed boolean, state string", Circuit, step)


def token_buckets(calls: DataFrame, capacity: int = BUCKET_CAPACITY, per_second: float = BUCKET_PER_MINUTE / 60) -> DataFrame:
    """``call_id, client, allowed, wait_s`` of calls (call_id, client, at)."""

    def step(b: Bucket, r) -> tuple:
        return (r.call_id, r.client, *b.take(r.at))

    return _chunked(calls, "client", "call_id long, client string, allowed boolean, wait_s int", lambda: Bucket(capacity, per_second), step)


def capacity_gate(calls: DataFrame, capacity: int) -> DataFrame:
    """``call_id, node, admitted, inflight`` of calls (call_id, node, at, seconds): a full node refuses at once."""

    def step(ends: list, r) -> tuple:
        while ends and ends[0] <= r.at:
            heappop(ends)
        ok = len(ends) < max(1, capacity)
        if ok:
            heappush(ends, r.at + r.seconds)
        return r.call_id, r.node, ok, len(ends)

    return _chunked(calls, "node", "call_id long, node int, admitted boolean, inflight int", list, step)
