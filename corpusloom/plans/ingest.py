"""Ingestion over ``documents_in``, ``nexus_documents`` (the store) and ``index_events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.constants import RETRY_MAX
from corpusloom.functions.dialect import DUCK
from corpusloom.operators import events, store
from corpusloom.plans.text_rules import SHARDS
from corpusloom.runtime import table


def incoming(spark: SparkSession, d: str) -> DataFrame:
    return store.store_rows(table(spark, d, "documents_in"), SHARDS)


def stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nexus_documents").select(*store.ROW)


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """The whole log as raw messages, and beside it a message cut off by a broken producer for every fiftieth (with negative ids)."""
    e = table(spark, d, "index_events").select("delivery_id", F.to_json(F.struct("event_id", "document", "attempt", "created_at")).alias("value"))
    return e.unionByName(e.where("delivery_id % 50 = 0").select((-F.col("delivery_id") - 1).alias("delivery_id"), F.substring("value", 1, 20).alias("value")))


def _failing(c: str) -> str:
    """Deliveries that a shard refuses: every ninth always, every fifth until its second retry."""
    return f"({c}.delivery_id % 9 = 0 OR ({c}.delivery_id % 5 = 0 AND {c}.attempt < 2))"


QUERIES = {
    "document_normalise": lambda spark, d: incoming(spark, d),
    "dedup_first_wins": lambda spark, d: store.first_wins(incoming(spark, d)).select("shard_id", "document_id", "input_id", "copies"),
    "new_documents": lambda spark, d: store.new_rows(incoming(spark, d), stored(spark, d)).select("shard_id", "document_id", "input_id"),
    "restore_scan": lambda spark, d: stored(spark, d).where("shard_id = 'shard-1'").orderBy("indexed_at", "document_id").select("document_id", "title", "indexed_at"),
    "upsert_docs": lambda spark, d: store.upsert(stored(spark, d), incoming(spark, d)).select("shard_id", "document_id", "content_hash", "title", "url", "indexed_at"),
    "replace_slices": lambda spark, d: store.replace_slices(stored(spark, d), incoming(spark, d)).select("shard_id", "document_id", "content_hash", "title", "url", "indexed_at"),
    "replace_url": lambda spark, d: store.replace_urls(stored(spark, d), incoming(spark, d)),
    "newly_created": lambda spark, d: incoming(spark, d).select("document_id").exceptAll(stored(spark, d).select("document_id")).distinct(),
    "ingest_batches": lambda spark, d: store.micro_batches(incoming(spark, d)).groupBy("shard_id", "batch").agg(F.count("*").alias("documents"), F.min("input_id").alias("first_input")),
    "ingest_totals": lambda spark, d: store.first_wins(incoming(spark, d)).groupBy("shard_id").agg(F.count("*").alias("added"), F.sum(F.col("copies") - 1).alias("skipped")),
    "ingest_retries": lambda spark, d: store.ingest_outcome(store.micro_batches(incoming(spark, d)), "pmod(batch, 5)"),
    "refresh_pages": lambda spark, d: incoming(spark, d).where("length(url) > 0").groupBy("url", "shard_id").agg(F.count("*").alias("documents"), F.countDistinct("content_hash").alias("texts")),
    "refresh_totals": lambda spark, d: store.replace_urls(stored(spark, d), incoming(spark, d)).agg(F.sum("added").alias("added"), F.sum("skipped").alias("skipped"), F.sum("removed").alias("removed"), F.count_if(~F.col("unchanged")).alias("refreshed"), F.count_if("unchanged").alias("unchanged")),
    "dlq_split": lambda spark, d: events.parsed(raw_events(spark, d)).select("delivery_id", F.when(F.col("valid"), "parsed").otherwise("dead_letter").alias("status")),
    "retry_rounds": lambda spark, d: events.retried(table(spark, d, "index_events").select("delivery_id", "attempt"), _failing("e")),
    "event_ids": lambda spark, d: events.event_ids(table(spark, d, "index_events")),
    "index_event_messages": lambda spark, d: events.messages(table(spark, d, "index_events")).select("key", "value"),
}

_INC = f"""inc AS (SELECT input_id, {t.rendezvous(DUCK, 'k', SHARDS)} AS shard_id, substring(content_hash, 1, 16) AS document_id, {DUCK.strip('title')} AS title, {DUCK.collapse("coalesce(text, '')")} AS body,
    url, coalesce(source, 'manual') AS source, content_hash, received_at AS indexed_at FROM (SELECT *, CASE WHEN length(url) > 0 THEN url ELSE content_hash END AS k FROM (SELECT *, {t.content_hash(DUCK, "coalesce(text, '')")} AS content_hash FROM documents_in)))"""
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, content_hash ORDER BY input_id DESC) AS rn FROM inc) WHERE rn = 1)"
_COLS = "shard_id, document_id, content_hash, title, url, indexed_at"
_FIRST = "first AS (SELECT shard_id, document_id, min(input_id) AS input_id, count(*) AS copies, content_hash FROM inc GROUP BY shard_id, document_id, content_hash)"
_REPLACE = f"""{_INC}, i AS (SELECT url, content_hash, title, source FROM inc WHERE length(url) > 0), o AS (SELECT url, lower(content_hash) AS content_hash, {DUCK.strip('title')} AS title, source FROM nexus_documents WHERE length(url) > 0),
  g AS (SELECT url, count(*) AS items, list_sort(list(DISTINCT (content_hash, title, source))) AS sig FROM i GROUP BY url), h AS (SELECT url, count(*) AS old_rows, list_sort(list(DISTINCT (content_hash, title, source))) AS sig FROM o GROUP BY url),
  fresh AS (SELECT url, count(*) AS fresh FROM (SELECT DISTINCT url, content_hash FROM i) x WHERE NOT EXISTS (SELECT 1 FROM nexus_documents n WHERE lower(n.content_hash) = x.content_hash AND coalesce(n.url, '') <> x.url) GROUP BY url),
  r AS (SELECT g.url, items, coalesce(old_rows, 0) AS old_rows, coalesce(fresh, 0) AS fresh, coalesce(g.sig = h.sig AND len(g.sig) = old_rows, false) AS unchanged FROM g LEFT JOIN h USING (url) LEFT JOIN fresh USING (url)),
  out AS (SELECT url, CASE WHEN unchanged THEN 0 ELSE fresh END AS added, CASE WHEN unchanged THEN items ELSE items - fresh END AS skipped, CASE WHEN unchanged THEN 0 ELSE old_rows END AS removed, unchanged FROM r)"""



def _object(*fields: tuple[str, str]) -> str:
    """A JSON object of the fields that aren't null."""
    parts = ", ".join(f"""CASE WHEN {v} IS NOT NULL THEN '"{n}":' || {v} END""" for n, v in fields)
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}'"


_TEXT = lambda c: f"to_json({c})::VARCHAR"
_DOCUMENT = _object(*((n, f"CASE WHEN document.{n} IS NOT NULL THEN {_TEXT(f'document.{n}')} END") for n in ("title", "text", "url", "source")))
_MESSAGE = _object(("event_id", f"CASE WHEN event_id IS NOT NULL THEN {_TEXT('event_id')} END"), ("document", f"CASE WHEN document IS NOT NULL THEN {_DOCUMENT} END"), ("attempt", "attempt::VARCHAR"),
                   ("created_at", "strftime(created_at, '\"%Y-%m-%dT%H:%M:%S.%g\"')"), ("last_error", f"CASE WHEN last_error IS NOT NULL THEN {_TEXT('last_error')} END"))

ORACLE = {
    "index_event_messages": f"SELECT event_id AS key, {_MESSAGE} AS value FROM index_events",
    "document_normalise": f"WITH {_INC} SELECT * FROM inc",
    "dedup_first_wins": f"WITH {_INC}, {_FIRST} SELECT shard_id, document_id, input_id, copies FROM first",
    "new_documents": f"WITH {_INC}, {_FIRST} SELECT shard_id, document_id, input_id FROM first f WHERE NOT EXISTS (SELECT 1 FROM nexus_documents n WHERE n.shard_id = f.shard_id AND lower(n.content_hash) = f.content_hash)",
    "restore_scan": "SELECT document_id, title, indexed_at FROM nexus_documents WHERE shard_id = 'shard-1' ORDER BY indexed_at, document_id",
    "upsert_docs": f"WITH {_INC}, {_LAST} SELECT {_COLS} FROM last UNION ALL SELECT {_COLS} FROM nexus_documents n WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.shard_id = n.shard_id AND l.content_hash = lower(n.content_hash))",
    "replace_slices": f"""WITH {_INC}, {_LAST} SELECT {_COLS} FROM last UNION ALL SELECT {_COLS} FROM nexus_documents n WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.shard_id = n.shard_id AND l.content_hash = lower(n.content_hash))
        AND NOT EXISTS (SELECT 1 FROM inc l WHERE l.shard_id = n.shard_id AND l.url = n.url)""",
    "replace_url": f"WITH {_REPLACE} SELECT * FROM out",
    "newly_created": f"WITH {_INC} SELECT DISTINCT document_id FROM inc WHERE document_id NOT IN (SELECT document_id FROM nexus_documents)",
    "ingest_batches": f"WITH {_INC}, b AS (SELECT *, (row_number() OVER (PARTITION BY shard_id ORDER BY input_id) - 1) // 25 AS batch FROM inc) SELECT shard_id, batch, count(*) AS documents, min(input_id) AS first_input FROM b GROUP BY shard_id, batch",
    "ingest_totals": f"WITH {_INC}, {_FIRST} SELECT shard_id, count(*) AS added, sum(copies - 1)::BIGINT AS skipped FROM first GROUP BY shard_id",
    "ingest_retries": f"""WITH {_INC}, b AS (SELECT *, (row_number() OVER (PARTITION BY shard_id ORDER BY input_id) - 1) // 25 AS batch FROM inc),
        t AS (SELECT shard_id, batch, count(*) AS n, batch % 5 AS failures FROM b GROUP BY shard_id, batch), g AS (SELECT shard_id, count(DISTINCT content_hash) AS added FROM b WHERE batch % 5 <= 2 GROUP BY shard_id)
        SELECT shard_id, count(*) AS batches, count(*) FILTER (WHERE failures > 2) AS failed, sum(least(failures + 1, 3))::BIGINT AS attempts, coalesce(any_value(added), 0) AS added, (sum(n) - coalesce(any_value(added), 0))::BIGINT AS skipped FROM t LEFT JOIN g USING (shard_id) GROUP BY shard_id""",
    "refresh_pages": f"WITH {_INC} SELECT url, shard_id, count(*) AS documents, count(DISTINCT content_hash) AS texts FROM inc WHERE length(url) > 0 GROUP BY url, shard_id",
    "refresh_totals": f"WITH {_REPLACE} SELECT sum(added)::BIGINT AS added, sum(skipped)::BIGINT AS skipped, sum(removed)::BIGINT AS removed, count(*) FILTER (WHERE NOT unchanged) AS refreshed, count(*) FILTER (WHERE unchanged) AS unchanged FROM out",
    "dlq_split": """SELECT delivery_id, CASE WHEN event_id IS NULL OR document IS NULL OR attempt < 0 THEN 'dead_letter' ELSE 'parsed' END AS status FROM index_events
        UNION ALL SELECT -delivery_id - 1, 'dead_letter' FROM index_events WHERE delivery_id % 50 = 0""",
    "retry_rounds": f"""SELECT delivery_id, CASE WHEN delivery_id % 9 = 0 THEN greatest(attempt, {RETRY_MAX}) + 1 WHEN delivery_id % 5 = 0 THEN CASE WHEN attempt < 2 THEN 2 ELSE attempt END ELSE attempt END::INT AS attempt,
        CASE WHEN delivery_id % 9 = 0 THEN 'dead_letter' ELSE 'indexed' END AS outcome FROM index_events""",
    "event_ids": f"""SELECT delivery_id, {t.content_hash(DUCK, "coalesce(document.text, '')")} AS event_id FROM index_events WHERE document IS NOT NULL""",
}
