"""Adaptive plan: retrieval mode and limits for every (query, system state), as one CASE chain."""

from __future__ import annotations

from corpusloom.functions.constants import CUTOFF_LOAD, EMERGENCY_LOAD, LATENCY_BUDGET_MS, MIN_HEALTH, WARN_LOAD
from corpusloom.functions.dialect import Spark
from corpusloom.functions.text import query_profile, query_tokens


def plan(d: Spark, source: str, budget: float = LATENCY_BUDGET_MS, enabled: bool = True) -> str:
    """Over rows of id, query, requested, inflight, capacity, healthy, total, unavailable, p95_ms.

    ``inflight`` counts the current request.  A request for a mode is kept as it is; ``auto`` gives
    ``survival``, ``balanced`` or ``quality``.
    """
    facts = f"""SELECT *, {query_profile(d, 'query')} AS profile, {query_tokens(d, 'query')} AS query_tokens, least(1e0, greatest(0e0, inflight / cast(greatest(1, capacity) AS double))) AS load_ratio,
        healthy / cast(greatest(1, total) AS double) AS health_ratio FROM {source}"""
    flags = f"""SELECT *, total > 1 AND health_ratio < {MIN_HEALTH}e0 AS bad_health, load_ratio >= {EMERGENCY_LOAD}e0 AS bad_load, p95_ms > 0 AND p95_ms >= 2e0 * {budget}e0 AS bad_latency,
        total > 1 AND healthy < total AS low_health, load_ratio >= {WARN_LOAD}e0 AS high_load, p95_ms > {budget}e0 AS high_latency FROM f"""
    manual = f"requested <> 'auto' OR NOT {str(enabled).lower()}"
    tiers = f"""SELECT *, CASE WHEN {manual} THEN 'manual' WHEN bad_health OR bad_load OR bad_latency THEN 'survival' WHEN low_health OR unavailable > 0 OR high_load OR high_latency THEN 'balanced' ELSE 'quality' END AS tier FROM g"""
    pct = "cast(cast(round(load_ratio * 100) AS int) AS string)"
    ms = "cast(cast(round(p95_ms) AS int) AS string)"
    share = "cast(healthy AS string), '/', cast(total AS string)"
    reasons = d.compact([
        "CASE WHEN tier = 'manual' THEN CASE WHEN requested <> 'auto' THEN 'explicit retrieval-mode override' ELSE 'autopilot disabled by configuration' END END",
        f"CASE WHEN tier = 'survival' AND bad_health THEN concat('healthy shard ratio ', {share}, ' below {MIN_HEALTH:.2f}') END",
        f"CASE WHEN tier = 'survival' AND bad_load THEN concat('inflight utilization ', {pct}, '% above emergency threshold') END",
        f"CASE WHEN tier = 'survival' AND bad_latency THEN concat('observed p95 ', {ms}, ' ms exceeds 2x latency budget') END",
        f"CASE WHEN tier = 'balanced' AND low_health THEN concat('cluster degraded to ', {share}, ' healthy shards') END",
        "CASE WHEN tier = 'balanced' AND unavailable > 0 THEN concat(cast(unavailable AS string), ' shard circuit(s) unavailable/probing') END",
        f"CASE WHEN tier = 'balanced' AND high_load THEN concat('inflight utilization ', {pct}, '% above warning threshold') END",
        f"CASE WHEN tier = 'balanced' AND high_latency THEN concat('observed p95 ', {ms}, ' ms above {budget:.0f} ms budget') END",
        "CASE WHEN tier = 'quality' THEN CASE WHEN profile = 'exact' THEN 'exact/identifier-style query favors lexical precision' ELSE 'healthy cluster and latency budget allow hybrid retrieval' END END",
    ])
    return f"""WITH f AS ({facts}), g AS ({flags}), t AS ({tiers})
        SELECT id, state, tier, CASE WHEN tier = 'manual' THEN CASE WHEN requested <> 'auto' THEN requested ELSE 'hybrid' END WHEN tier = 'survival' OR profile = 'exact' THEN 'lexical' ELSE 'hybrid' END AS selected_mode,
        profile, query_tokens, round(load_ratio, 3) AS load_ratio, CASE WHEN tier = 'survival' THEN false WHEN tier = 'balanced' THEN NOT (load_ratio >= {CUTOFF_LOAD}e0 OR health_ratio < {MIN_HEALTH}e0) ELSE true END AS generation_allowed,
        {d.join(reasons, '; ')} AS reasons FROM t"""
