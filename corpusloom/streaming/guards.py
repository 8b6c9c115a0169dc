"""Circuit breaker and token bucket with engine-kept state, for streams of calls.

A call has call_id, a key, at (seconds) and, for circuits, ok.  Within a micro-batch a key's calls are
folded in time order; states of silent keys expire after ``idle_ms`` of processing time instead of being
evicted.  With an expiry a query never comes to an end of its own, so runs to the end of what there is
pass None.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.constants import BUCKET_CAPACITY, BUCKET_PER_MINUTE
from corpusloom.operators.guards import Bucket, Circuit

IDLE_MS = 3_600_000


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "call_id"])


def circuits(stream: DataFrame, key: str = "shard", idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``shard, call_id, allowed, state`` of each call."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, opened, probing = 0, None, False
        if state.exists:
            n, opened, probing = state.get
            opened = None if opened < 0 else opened
        c, rows = Circuit(state=(n, opened, probing)), []
        for r in _sorted(frames).itertuples(index=False):
            ok = c.allow(r.at)
            if ok:
                c.result(r.at, bool(r.ok))
            rows.append((k[0], r.call_id, ok, c.name(r.at)))
        n, opened, probing = c.state
        state.update((n, -1.0 if opened is None else opened, probing))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[key, "call_id", "allowed", "state"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, call_id long, allowed boolean, state string", "failures int, opened double, probing boolean", "append", _timeout(idle_ms))


def buckets(stream: DataFrame, key: str = "client", capacity: int = BUCKET_CAPACITY, per_second: float = BUCKET_PER_MINUTE / 60, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``client, call_id, allowed, wait_s`` of each call."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = Bucket(capacity, per_second, *(state.get if state.exists else ()))
        rows = [(k[0], r.call_id, *b.take(r.at)) for r in _sorted(frames).itertuples(index=False)]
        state.update((b.tokens, b.at))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[key, "call_id", "allowed", "wait_s"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, call_id long, allowed boolean, wait_s int", "tokens double, at double", "append", _timeout(idle_ms))
