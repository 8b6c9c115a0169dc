"""Row-level rules: tokens, identities, routing, urls, blocks, query profiles and small schedules."""

from __future__ import annotations

from corpusloom.functions import text as t
from corpusloom.functions.constants import RETRY_BASE, RETRY_CAP, TOP_K
from corpusloom.functions.dialect import Spark
from corpusloom.plans.sql import both

SHARDS = ["shard-0", "shard-1", "shard-2"]


def indexed(d: Spark) -> str:
    return "concat(coalesce(title, ''), chr(10), coalesce(text, ''))"


def _domains(d: Spark) -> str:
    """Preferred, then acceptable domains, each once."""
    if d.name == "spark":
        return "array_join(array_union(coalesce(preferred_domains, cast(array() AS array<string>)), coalesce(acceptable_domains, cast(array() AS array<string>))), ' ')"
    both_lists = "list_concat(coalesce(preferred_domains, []), coalesce(acceptable_domains, []))"
    return f"array_to_string(list_filter({both_lists}, lambda v, i: list_position({both_lists}, v) = i), ' ')"


def _asked(d: Spark) -> str:
    """Every endpoint with sizes at and beyond its bounds."""
    rows = [(e, k) for e, m in TOP_K.items() for k in (0, 1, m, m + 1)]
    if d.name == "spark":
        return "array(" + ", ".join(f"named_struct('endpoint', '{e}', 'top_k', {k})" for e, k in rows) + ")"
    return "[" + ", ".join(f"{{'endpoint': '{e}', 'top_k': {k}}}" for e, k in rows) + "]"


STATEMENTS = {
    # P1, P2, P6
    "tokenize_terms": lambda d: f"SELECT doc_id, {d.join(t.tokens(d, indexed(d)), ' ')} AS terms FROM documents",
    "term_counts": lambda d: f"SELECT doc_id, term, count(*) AS tf FROM {d.lists('documents', 'doc_id', t.tokens(d, indexed(d)), 'term')} x GROUP BY doc_id, term",
    "indexed_text": lambda d: f"SELECT doc_id, {indexed(d)} AS body FROM documents",
    # P3, P4, P5
    "content_hash_ids": lambda d: f"""SELECT doc_id, {t.content_hash(d, "coalesce(text, '')")} AS content_hash, substring({t.content_hash(d, "coalesce(text, '')")}, 1, 16) AS id,
        trim(title) AS title, {d.collapse('text')} AS text, coalesce(source, 'manual') AS source FROM documents""",
    # P7, P21, R11, J7, S2
    "routing_key": lambda d: f"SELECT input_id, {t.routing_key(d, 'url', 'text')} AS routing_key FROM documents_in",
    "rendezvous_assign": lambda d: f"SELECT input_id, {t.rendezvous(d, 'k', SHARDS)} AS shard_id FROM (SELECT input_id, {t.routing_key(d, 'url', 'text')} AS k FROM documents_in) x",
    "seed_partition_scan": lambda d: f"SELECT input_id, title FROM (SELECT input_id, title, {t.rendezvous(d, t.routing_key(d, 'url', 'text'), SHARDS)} AS shard_id FROM documents_in) x WHERE shard_id = 'shard-1'",
    "shard_balance": lambda d: f"SELECT shard_id, count(*) AS documents FROM (SELECT {t.rendezvous(d, t.routing_key(d, 'url', 'text'), SHARDS)} AS shard_id FROM documents_in) x GROUP BY shard_id",
    "shard_list_parse": lambda d: f"""SELECT i + 1 AS position, CASE WHEN contains(part, '=') THEN {d.group('part', '^([^=]*)=')} ELSE concat('shard-', cast(i + 1 AS string)) END AS shard_id,
        {d.group('part', '([^=]*)$')} AS url FROM {d.lists("(SELECT 'alpha=http://a:1,http://b:2,gamma=http://c:3' AS raw) r", 'raw', d.split('raw', ','), 'part', 'i')} x""",
    # P8-P13, P17, P18, J11, J12
    "url_canonicalize": lambda d: f"SELECT input_id, {t.canonical_url(d, 'url')} AS canonical FROM documents_in WHERE url IS NOT NULL",
    "asset_filter": lambda d: f"SELECT input_id, url FROM documents_in WHERE length(url) > 0 AND {t.canonical_url(d, 'url')} = ''",
    "localized_filter": lambda d: f"SELECT input_id, {t.localized(d, 'url')} AS localized FROM documents_in WHERE length(url) > 0",
    "low_value_filter": lambda d: f"SELECT input_id, {t.low_value(d, 'title', 'text')} AS low_value FROM documents_in",
    "low_value_lines": lambda d: f"SELECT input_id, i, {t.low_value(d, 'title', 'line')} AS low_value FROM {d.lists('documents_in', 'input_id, title', d.split('text', chr(92) + 'n') if d.name == 'spark' else 'string_split(text, chr(10))', 'line', 'i')} x",
    "domain_of": lambda d: f"SELECT shard_id, document_id, {t.domain_of(d, 'url')} AS domain FROM nexus_documents WHERE url IS NOT NULL",
    "source_host": lambda d: f"SELECT shard_id, document_id, {t.source_host(d, 'url', 'source')} AS host FROM nexus_documents",
    "public_host": lambda d: f"""SELECT input_id, NOT ({t.host(d, 'url')} IN ('localhost', 'localhost.localdomain', '') OR {d.like(t.host(d, 'url'), '^(0|10|127|169[.]254|192[.]168|172[.](1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]')}) AS public FROM documents_in WHERE url IS NOT NULL""",
    "same_domain_filter": lambda d: f"""SELECT input_id, h AS host FROM (SELECT input_id, {t.domain_of(d, 'url')} AS h FROM documents_in WHERE length(url) > 0) x
        WHERE h IN (SELECT {d.replace('lower(trim(domain))', '^www[.]')} FROM trusted_sources)""",
    "registry_filter": lambda d: f"""SELECT name, lower(trim(tier)) AS tier, least(100, greatest(1, max_pages)) AS max_pages, least(3, greatest(0, max_depth)) AS max_depth,
        {d.join("coalesce(seeds, " + ("array(seed)" if d.name == 'spark' else "[seed]") + ")", ' ')} AS seeds FROM trusted_sources WHERE lower(trim(tier)) = 'core' OR contains(lower(name), 'docs')""",
    # P15, P16, P22, P24
    "snippet": lambda d: f"SELECT doc_id, {t.snippet(d, 'text', 'title')} AS snippet FROM documents WHERE text IS NOT NULL",
    "query_validation": lambda d: f"""SELECT id, endpoint, top_k, coalesce(length(query) BETWEEN 2 AND 500, false) AND top_k BETWEEN 1 AND CASE endpoint {' '.join(f"WHEN '{e}' THEN {m}" for e, m in TOP_K.items())} END AS accepted, length(trim(query)) AS chars
        FROM (SELECT id, query, e.endpoint AS endpoint, e.top_k AS top_k FROM {d.lists('eval_cases', 'id, query', _asked(d), 'e')} x) y""",
    "query_profile": lambda d: f"SELECT id, {t.query_profile(d, 'query')} AS profile, {t.query_tokens(d, 'query')} AS tokens FROM eval_cases",
    "case_filter": lambda d: "SELECT id, query FROM eval_cases WHERE category IN ('definition', 'identifier') ORDER BY id LIMIT 10",
    "judged_domains": lambda d: f"SELECT id, {_domains(d)} AS domains FROM eval_cases",
    # P19, P20, ST3
    "retry_schedule": lambda d: f"SELECT delivery_id, attempt, least({RETRY_CAP}e0, {RETRY_BASE}e0 * pow(2e0, least(30, greatest(0, attempt - 1)))) AS delay_s, least(1e0, 25e-2 * pow(2e0, least(30, attempt))) AS batch_delay_s FROM index_events",
    # P26
    "client_key": lambda d: """SELECT event_id, coalesce(nullif(trim(CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('u', cast(user_id AS string)) END), ''),
        CASE WHEN event_id % 3 = 0 THEN trim(' 10.0.0.1 ') ELSE NULL END, 'unknown') AS client FROM events""",
}

QUERIES, ORACLE = both(STATEMENTS)
