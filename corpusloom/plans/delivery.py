"""Queries over the delivery log."""

from __future__ import annotations

from corpusloom.operators.delivery import exactly_once, redundant_deliveries
from corpusloom.runtime import table

#: White space at the ends, for engines whose \s is ASCII only.
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(event_id, '^{WS}+|{WS}+$', '', 'g'))
    ORDER BY attempt, created_at, delivery_id) AS rn FROM index_events WHERE event_id IS NOT NULL"""

QUERIES = {
    "p4_found": lambda spark, d: redundant_deliveries(table(spark, d, "index_events")),
    "p4_exactly_once": lambda spark, d: exactly_once(table(spark, d, "index_events").select("delivery_id", "batch_no", "event_id", "attempt", "created_at")),
}
ORACLE = {
    "p4_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE rn > 1",
    "p4_exactly_once": f"""SELECT delivery_id, batch_no, event_id, attempt, created_at FROM index_events
        WHERE delivery_id NOT IN (SELECT delivery_id FROM ({_RANKED}) WHERE rn > 1)""",
}
