"""Operational metrics over ``events`` as the call log.

``value`` is the latency in ms, ``event_type = 'error'`` a failure, ``user_id % 3`` the shard and
``user_id`` the client.
"""

from __future__ import annotations

from corpusloom.functions.dialect import Spark
from corpusloom.plans.sql import both

SHARD = "cast(user_id % 3 AS int)"
#: A failure is a refusal (status 503) for every fourth event, else an error.
REFUSED, ERROR = "event_type = 'error' AND event_id % 4 = 0", "event_type = 'error' AND event_id % 4 <> 0"
#: Bucket bounds of the exposition format's default histogram, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def _floor(d: Spark, q: str) -> str:
    """Element at the floor rank of a sorted list."""
    i = f"cast(floor(({d.size('v')} - 1) * {q}) AS int) + 1"
    return f"round({d.at('v', i)}, 6)"


def _last_1000(d: Spark) -> str:
    collected = "sort_array(collect_list(value))" if d.name == "spark" else "list_sort(list(value))"
    return f"""(SELECT shard, {collected} AS v FROM (SELECT {SHARD} AS shard, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn <= 1000 GROUP BY shard)"""


def _percentile(d: Spark, q: float) -> str:
    return f"round({'percentile' if d.name == 'spark' else 'quantile_cont'}(value, {q}), 6)"


def _seconds(d: Spark) -> str:
    """Seconds from the first to the last call of a level."""
    us = "unix_micros(cast({} AS timestamp))" if d.name == "spark" else "epoch_us({})"
    return f"(({us.format('max(ts)')} - {us.format('min(ts)')}) / 1e6)"


def _histogram(d: Spark) -> str:
    """All bounds in one scan, then a row for each."""
    bounds = [f"'{le}'" for le in BUCKETS] + ["'+Inf'"]
    sums = ", ".join([*(f"count_if(value / 1e2 <= {le}) AS b{i}" for i, le in enumerate(BUCKETS)), f"count(*) AS b{len(BUCKETS)}"])
    pair = (lambda le, i: f"named_struct('le', {le}, 'n', b{i})") if d.name == "spark" else (lambda le, i: f"{{'le': {le}, 'n': b{i}}}")
    pairs = ", ".join(pair(le, i) for i, le in enumerate(bounds))
    rows = d.lists(f"(SELECT {SHARD} AS shard, {sums} FROM events GROUP BY user_id % 3) h", "shard", f"array({pairs})" if d.name == "spark" else f"[{pairs}]", "st")
    return f"SELECT shard, st.le AS le, st.n AS n FROM {rows} x"


STATEMENTS = {
    # A7, ST9: the last 1000 calls of each shard, floor rank
    "latency_floor_percentiles": lambda d: f"SELECT shard, {_floor(d, '5e-1')} AS p50, {_floor(d, '95e-2')} AS p95, round({'aggregate(v, 0D, (a, x) -> a + x) / size(v)' if d.name == 'spark' else 'list_avg(v)'}, 4) AS avg FROM {_last_1000(d)} x",
    # A8, A9, A27
    "latency_interp_percentiles": lambda d: f"SELECT {SHARD} AS shard, {_percentile(d, 0.5)} AS p50, {_percentile(d, 0.95)} AS p95, {_percentile(d, 0.99)} AS p99 FROM events GROUP BY user_id % 3",
    "latency_median": lambda d: "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type",
    "bench_summary": lambda d: f"""SELECT {SHARD} AS level, count(*) AS requests, count_if({ERROR}) AS error_count, count_if({REFUSED}) AS rejected_count, count_if(event_type <> 'error') AS success_count, round(1e2 * count_if(event_type <> 'error') / count(*), 2) AS success_rate,
        round(count_if(event_type <> 'error') / greatest(1e-3, {_seconds(d)}), 6) AS throughput_rps,
        {_percentile(d, 0.5)} AS p50_ms, {_percentile(d, 0.95)} AS p95_ms, {_percentile(d, 0.99)} AS p99_ms, round(avg(value), 4) AS avg_ms, round(max(value), 6) AS max_ms FROM events GROUP BY user_id % 3""",
    # W4: running total and number of the last 1000 calls of a client
    "rolling_latency_1000": lambda d: "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 2) AS total, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS n FROM events",
    # A10, A25, A30, ST10
    "cluster_stats": lambda d: """SELECT count(*) AS shards, sum(CASE WHEN last_type <> 'error' THEN 1 ELSE 0 END) AS healthy, sum(calls) AS calls FROM
        (SELECT user_id % 3 AS shard, count(*) AS calls, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id % 3) x""",
    "shard_health": lambda d: f"SELECT {SHARD} AS shard, max_by(event_type, event_id) <> 'error' AS healthy FROM events GROUP BY user_id % 3",
    "gauges": lambda d: f"SELECT {SHARD} AS shard, max_by(value, event_id) AS last_value, max(ts) AS at FROM events GROUP BY user_id % 3",
    "readiness": lambda d: "SELECT count_if(healthy) >= 2 AS ready, count_if(healthy) AS healthy, count(*) AS total FROM (SELECT max_by(event_type, event_id) <> 'error' AS healthy FROM events GROUP BY user_id % 3) x",
    # A23, A24
    "event_counters": lambda d: f"SELECT event_type, {SHARD} AS shard, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n FROM events GROUP BY event_type, user_id % 3",
    "histogram_buckets": _histogram,
    # ST5
    "consumer_lag": lambda d: "SELECT partition_no, batch_no, greatest(0, high - max(delivery_id) - 1) AS lag FROM (SELECT partition_no, batch_no, delivery_id, max(delivery_id) OVER (PARTITION BY partition_no) + 1 AS high FROM index_events) x GROUP BY partition_no, batch_no, high",
    # ST7 without feedback: calls under way by the sweep of +1 and -1, a call lasting ``value`` minutes
    "inflight_sweep": lambda d: """SELECT user_id, max(inflight) AS peak FROM (SELECT user_id, sum(delta) OVER (PARTITION BY user_id ORDER BY moment, delta ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inflight FROM
        (SELECT user_id, unix_micros(ts) AS moment, 1 AS delta FROM events UNION ALL SELECT user_id, unix_micros(ts) + cast(value * 6e7 AS bigint), -1 FROM events) x) y GROUP BY user_id""".replace("unix_micros(ts)", "unix_micros(cast(ts AS timestamp))" if d.name == "spark" else "epoch_us(ts)"),
    "hourly_errors": lambda d: "SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, count_if(event_type = 'error') AS errors FROM events GROUP BY date_trunc('hour', ts)",
}

QUERIES, ORACLE = both(STATEMENTS)
