"""Planner, guards and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as rules
from corpusloom.functions.constants import CIRCUIT_FAILURES, CIRCUIT_SECONDS
from corpusloom.functions.dialect import DUCK
from corpusloom.operators import guards, pages, planner
from corpusloom.plans.sql import run
from corpusloom.runtime import table

#: System states that every query is planned for: state, requested, inflight, capacity, healthy, total, unavailable, p95_ms.
STATES = [(0, "auto", 1, 32, 3, 3, 0, 120.0), (1, "auto", 22, 32, 3, 3, 1, 900.0), (2, "auto", 25, 32, 2, 3, 0, 1500.0), (3, "auto", 30, 32, 1, 3, 2, 2500.0), (4, "semantic", 1, 32, 3, 3, 0, 10.0), (5, "auto", 1, 32, 1, 1, 0, 0.0)]
_COLS = "state, requested, inflight, capacity, healthy, total, unavailable, p95_ms"
_NAMES = _COLS.split(", ")


def _asked(d) -> str:
    """Every case with every state, a row of each from an array of constants."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)
    if d.name == "spark":
        states = "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {value(v)}" for n, v in zip(_NAMES, s)) + ")" for s in STATES) + ")"
    else:
        states = "[" + ", ".join("{" + ", ".join(f"'{n}': {value(v)}" for n, v in zip(_NAMES, s)) + "}" for s in STATES) + "]"
    return "(SELECT id, query, " + ", ".join(f"st.{n} AS {n}" for n in _NAMES) + f" FROM {d.lists('eval_cases', 'id, query', states, 'st')} x) q"


def _plan(d):
    return planner.plan(d, _asked(d))


def calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("user_id") % 3).cast("int").alias("shard"), F.col("user_id").cast("string").alias("client"), (F.col("event_type") != "error").alias("ok"), (F.col("value") * 60).alias("seconds"))


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the texts handed in: each line a paragraph, the page's neighbours as links."""
    e = table(spark, d, "documents_in").where("length(url) > 0")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    body = F.concat(F.lit("<p>"), F.regexp_replace(esc, "\r?\n", "</p><p>"), F.lit("</p>"))
    link = F.concat(F.lit('<nav><a href="'), F.col("url"), F.lit('?utm_source=nav">self</a><a href="/kb/index.html">index</a></nav>'))
    return e.select("url", F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body>"), link, F.lit("<article><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>"), body, F.lit("</article></body></html>")).alias("html"), F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"))


def crawled(spark: SparkSession, d: str) -> DataFrame:
    p = html_pages(spark, d).groupBy("url").agg(F.min("html").alias("html"), F.min("status").alias("status"), F.min("content_type").alias("content_type"))
    seeds = [r[0] for r in p.select("url").orderBy("url").limit(10).collect()]  # a crawl has at most ten seeds
    return pages.crawl(spark, p, seeds, 100, 2)[0].select("url", "depth", "ok")


QUERIES = {
    "adaptive_plan": lambda spark, d: run(spark, d, _plan),
    "circuit_states": lambda spark, d: guards.circuit_states(calls(spark, d).select("call_id", "shard", "at", "ok")),
    "circuit_state_counts": lambda spark, d: guards.circuit_states(calls(spark, d).select("call_id", "shard", "at", "ok")).groupBy("shard").agg(F.max_by("state", "call_id").alias("state")).groupBy("state").agg(F.count("*").alias("shards")),
    "token_bucket": lambda spark, d: guards.token_buckets(calls(spark, d).select("call_id", "client", "at"), capacity=3, per_second=0.0005),
    "capacity_gate": lambda spark, d: guards.capacity_gate(calls(spark, d).select("call_id", F.col("shard").alias("node"), "at", "seconds"), 4),
    "chunk_text": lambda spark, d: pages.chunked(table(spark, d, "documents_in"), ["input_id"], "text"),
    "html_extract": lambda spark, d: pages.extracted(html_pages(spark, d)),
    "same_domain_links": lambda spark, d: pages.links(html_pages(spark, d)),
    "crawl_bfs": crawled,
    "robots_gate": lambda spark, d: pages.allowed(html_pages(spark, d).select("url").distinct(), spark.createDataFrame([("https://wiki.ulzisk.example", "User-agent: *\nDisallow: /de/")], "origin string, rules string")),
}

def _ordered(key: str) -> str:
    """Calls of each key, numbered in time order."""
    return f"""c AS (SELECT {key} AS k, event_id AS call_id, epoch_us(ts) / 1e6 AS at, event_type <> 'error' AS ok, value * 60 AS seconds, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events)"""


# The folds once more, as recursive queries that go from call to call.
_CIRCUIT = f"""WITH RECURSIVE {_ordered('(user_id % 3)::INT')}, f AS (
    SELECT DISTINCT k, 0::BIGINT AS rn, NULL::BIGINT AS call_id, NULL::DOUBLE AS at, 0 AS failures, NULL::DOUBLE AS opened, true AS allowed FROM c
    UNION ALL SELECT c.k, c.rn, c.call_id, c.at, CASE WHEN NOT a.allow THEN f.failures WHEN c.ok THEN 0 ELSE f.failures + 1 END,
        CASE WHEN NOT a.allow THEN f.opened WHEN c.ok THEN NULL WHEN f.failures + 1 >= {CIRCUIT_FAILURES} THEN c.at ELSE f.opened END, a.allow
      FROM f JOIN c ON c.k = f.k AND c.rn = f.rn + 1, LATERAL (SELECT f.opened IS NULL OR c.at - f.opened >= {CIRCUIT_SECONDS} AS allow) a),
  s AS (SELECT call_id, k AS shard, allowed, CASE WHEN opened IS NULL THEN 'closed' WHEN f.at - opened < {CIRCUIT_SECONDS} THEN 'open' ELSE 'half_open' END AS state FROM f WHERE rn > 0)"""
# A bucket of 3 that gains a token in 100 seconds, the slowest rate there is.
_BUCKET = f"""WITH RECURSIVE {_ordered('user_id::VARCHAR')}, f AS (
    SELECT DISTINCT k, 0::BIGINT AS rn, NULL::BIGINT AS call_id, NULL::DOUBLE AS at, 3e0 AS tokens, true AS allowed, 0 AS wait_s FROM c
    UNION ALL SELECT c.k, c.rn, c.call_id, c.at, CASE WHEN t.have >= 1 THEN t.have - 1 ELSE t.have END, t.have >= 1, CASE WHEN t.have >= 1 THEN 0 ELSE greatest(1, trunc((1 - t.have) / 1e-2)::INT + 1) END
      FROM f JOIN c ON c.k = f.k AND c.rn = f.rn + 1, LATERAL (SELECT CASE WHEN f.at IS NULL THEN f.tokens ELSE least(3e0, f.tokens + greatest(0e0, c.at - f.at) * 1e-2) END AS have) t)
  SELECT call_id, k AS client, allowed, wait_s FROM f WHERE rn > 0"""
_GATE = f"""WITH RECURSIVE {_ordered('(user_id % 3)::INT')}, f AS (
    SELECT DISTINCT k, 0::BIGINT AS rn, NULL::BIGINT AS call_id, true AS admitted, []::DOUBLE[] AS ends FROM c
    UNION ALL SELECT c.k, c.rn, c.call_id, len(e.left_over) < 4, CASE WHEN len(e.left_over) < 4 THEN list_append(e.left_over, c.at + c.seconds) ELSE e.left_over END
      FROM f JOIN c ON c.k = f.k AND c.rn = f.rn + 1, LATERAL (SELECT list_filter(f.ends, lambda x: x > c.at) AS left_over) e)
  SELECT call_id, k AS node, admitted, len(ends)::INT AS inflight FROM f WHERE rn > 0"""

ORACLE = {
    "circuit_states": f"{_CIRCUIT} SELECT * FROM s",
    "circuit_state_counts": f"{_CIRCUIT}, l AS (SELECT shard, max_by(state, call_id) AS state FROM s GROUP BY shard) SELECT state, count(*) AS shards FROM l GROUP BY state",
    "token_bucket": _BUCKET,
    "capacity_gate": _GATE,
    "adaptive_plan": _plan(DUCK),
    "same_domain_links": f"""SELECT url, link, row_number() OVER (PARTITION BY url)::INT AS place FROM (SELECT url, {rules.canonical_url(DUCK, "concat(url, '?utm_source=nav')")} AS link FROM documents_in WHERE length(url) > 0)
        WHERE link <> '' AND NOT {rules.localized(DUCK, 'link')}""",
    "robots_gate": "SELECT DISTINCT url, NOT starts_with(url, 'https://wiki.ulzisk.example/de/') AS allowed FROM documents_in WHERE length(url) > 0",
}
