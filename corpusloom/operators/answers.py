"""Evidence gate over a table of retrieved candidates, as a chain of named steps.

``candidates`` has qid, query, doc_id, rank, score, title, url, source, snippet.  Each stage is keyed by
query and document, or query, document and sentence; only the last ones group by query.  Nulls in title,
snippet, url and source count as empty.  A query without candidates has no row before the summary,
where it appears if it is in ``queries`` (qid, query).
"""

from __future__ import annotations

from corpusloom.functions import evidence as e
from corpusloom.functions import text
from corpusloom.functions.constants import DEFINES_WITH_TITLE, MIN_RELEVANCE, RELATIVE_FLOOR
from corpusloom.functions.dialect import Spark

#: Results that survive the relevance stage.
LIMIT = 5

# Texts of reasons and answers.
LOW_COVERAGE = "Relevant passages cover too little of the query."
LOW_RELEVANCE = "Retrieved evidence has weak direct query relevance."
LOW_AUTHORITY = "Sources are not sufficiently authoritative for this specific query."
LOW_BOTH = "Direct relevance and topical authority are both too weak to support generation."
FEW_SOURCES = "Evidence comes from fewer than two independent relevant sources."
CONFLICT = "Potentially conflicting claims were detected across comparable relevant sources."
CONSISTENT = "Comparable relevant sources provide mutually consistent support."
DIFFERENT = "Relevant sources discuss different aspects, so cross-source agreement is limited."
UNDERSPECIFIED = "The query is underspecified, so more context is required before making a recommendation."
SUFFICIENT = "Relevant evidence has sufficient coverage, topical authority, and source diversity."
NO_RESULT = "No retrieved result passed the minimum query-relevance threshold."
NO_CLAIM = "Retrieved results matched the query, but none contained enough claim-level support to answer safely."
NO_DEFINITION = "Retrieved passages mention the requested concept, but none directly define or explain it well enough to answer a definition query."
FALLBACK = "The indexed sources matched the query, but no sentence with enough direct support for a grounded answer was found."
ABSTAIN = "No reliable evidence was found in the trusted sources. Unsupported answers are not generated. Try rephrasing the query or search a broader source set."
ABSTAIN_UNDERSPECIFIED = "Related evidence was found, but the question is too underspecified for a reliable recommendation. Add the failure type, operation, or system context you are deciding about."
CAVEAT_CONFLICT = "Relevant sources contain potentially conflicting claims, so treat this answer as qualified rather than definitive. "
CAVEAT_PARTIAL = "Evidence is partial, so treat this answer as qualified rather than complete. "


def steps(d: Spark) -> dict[str, str]:
    """Name and statement of each step; a step uses earlier ones and ``candidates`` and ``queries``."""
    q = "coalesce(query, '')"
    out = {
        "query_facts": f"""SELECT qid, query, {e.query_terms(d, q)} AS terms, {e.identifiers(d, q)} AS ids, {e.definition_terms(d, q)} AS defs, {e.is_judgment(d, q)} AS judgment FROM queries""",
        "asked": f"SELECT *, {e.is_underspecified(d, q, 'terms', 'ids', 'defs')} AS underspecified FROM query_facts",
        "found": """SELECT c.qid, c.query, c.doc_id, c.rank, c.score, coalesce(c.title, '') AS title, coalesce(c.url, '') AS url, coalesce(c.source, '') AS source,
            coalesce(c.snippet, '') AS snippet, a.terms, a.ids, a.defs, a.judgment FROM candidates c JOIN asked a ON c.qid = a.qid""",
        "judged": f"""SELECT *, {e.relevance(d, 'terms', 'defs', 'title', 'snippet')} AS relevance, {text.source_host(d, 'url', 'source')} AS host FROM found""",
        "scored": f"""SELECT *, {e.authority(d, 'host', 'source')} AS authority,
            max(CASE WHEN relevance >= {MIN_RELEVANCE}e0 THEN relevance END) OVER (PARTITION BY qid) AS best FROM judged""",
        "floored": f"""SELECT *, {e.topic_authority(d, 'host', 'authority', 'relevance', 'terms')} AS topic_authority, greatest({MIN_RELEVANCE}e0, {RELATIVE_FLOOR}e0 * best) AS floor,
            {d.size(d.filter('ids', 'fi', "NOT contains(lower(concat(title, ' ', snippet)), fi)"))} = 0 AS has_ids FROM scored""",
        "relevant": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, score DESC, rank) AS place
            FROM floored WHERE relevance >= floor AND has_ids) x WHERE place <= {LIMIT}""",
        "sentences": f"SELECT qid, doc_id, pos, {d.strip('piece')} AS sentence FROM {d.lists('floored', 'qid, doc_id', d.sentences('''replace(snippet, '…', ' ')'''), 'piece', 'pos')} x",
        "worded": f"""SELECT s.qid, s.doc_id, s.pos, s.sentence, f.title, f.terms, f.ids, f.defs, f.judgment, {e.words(d, 's.sentence')} AS w, {e.bare_words(d, 's.sentence')} AS bare, {e.words(d, 'f.title')} AS title_words
            FROM sentences s JOIN floored f ON s.qid = f.qid AND s.doc_id = f.doc_id WHERE length(s.sentence) >= 20""",
        "based": f"""SELECT *, {e.support_base(d, 'terms', 'ids', 'title_words', 'w')} AS base, {e.defines(d, 'defs', 'bare', 'sentence')} AS defines,
            {e.token_coverage(d, 'defs', "concat(title, ' ', sentence)")} >= 0.75e0 AND {d.like('lower(sentence)', DEFINES_WITH_TITLE)} AS defines_with_title FROM worded""",
        "supported": f"""SELECT qid, doc_id, pos, sentence, terms, defines, defines_with_title, judgment, length(sentence) AS chars, {e.support(d, 'base', 'terms', 'defs', 'defines', 'judgment', 'w')} AS support FROM based""",
        "supporting": "SELECT * FROM supported WHERE chars >= 35 AND support >= CASE WHEN judgment THEN 0.34e0 ELSE 0.30e0 END",
        "backed": "SELECT * FROM relevant r WHERE EXISTS (SELECT 1 FROM supporting s WHERE s.qid = r.qid AND s.doc_id = r.doc_id)",
        "survivors": f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS citation FROM backed r
            WHERE {d.size('defs')} = 0 OR EXISTS (SELECT 1 FROM supported s WHERE s.qid = r.qid AND s.doc_id = r.doc_id AND (s.defines OR s.defines_with_title))""",
        "best_sentence": """SELECT * FROM (SELECT s.*, r.citation, row_number() OVER (PARTITION BY s.qid, s.doc_id ORDER BY s.support DESC, s.pos) AS nth
            FROM supporting s JOIN survivors r ON s.qid = r.qid AND s.doc_id = r.doc_id) x WHERE nth = 1""",
        "claims": f"SELECT qid, doc_id, citation, {e.claim_tokens(d, 'terms', 'sentence')} AS tokens, {e.polarity(d, 'terms', 'sentence')} AS polarity FROM best_sentence",
        "claim_pairs": f"""SELECT a.qid, a.citation AS i, b.citation AS j, a.polarity <> b.polarity AS conflict
            FROM claims a JOIN claims b ON a.qid = b.qid AND a.citation < b.citation WHERE {e.comparable(d, 'a.tokens', 'b.tokens')}""",
        "pair_counts": "SELECT qid, count(*) AS pairs, sum(CASE WHEN conflict THEN 1 ELSE 0 END) AS conflicts FROM claim_pairs GROUP BY qid",
        "pair_ends": "SELECT qid, i AS node, conflict FROM claim_pairs UNION ALL SELECT qid, j, conflict FROM claim_pairs",
        "nodes": "SELECT qid, count(DISTINCT CASE WHEN conflict THEN node END) AS conflicting, count(DISTINCT CASE WHEN NOT conflict THEN node END) AS aligned FROM pair_ends GROUP BY qid",
        "claim_counts": "SELECT qid, count(*) AS claims FROM claims GROUP BY qid",
        "result_counts": "SELECT qid, count(*) AS results, avg(relevance) AS relevance, avg(topic_authority) AS authority, count(DISTINCT nullif(host, '')) AS hosts, count(DISTINCT nullif(source, '')) AS sources FROM survivors GROUP BY qid",
        "agreed": """SELECT r.qid, CASE WHEN r.results = 1 THEN 'single_source' WHEN coalesce(c.claims, 0) < 2 THEN 'insufficient' WHEN coalesce(p.pairs, 0) = 0 THEN 'mixed' WHEN p.conflicts > 0 THEN 'mixed' ELSE 'agreement' END AS agreement,
            r.results > 1 AND coalesce(c.claims, 0) >= 2 AND coalesce(p.conflicts, 0) > 0 AS conflict,
            CASE WHEN r.results = 1 THEN 1 WHEN coalesce(c.claims, 0) < 2 OR coalesce(p.pairs, 0) = 0 THEN coalesce(c.claims, 0) WHEN p.conflicts > 0 THEN greatest(0, c.claims - n.conflicting) ELSE n.aligned END AS supporting_sources,
            CASE WHEN r.results > 1 AND coalesce(c.claims, 0) >= 2 AND coalesce(p.conflicts, 0) > 0 THEN n.conflicting ELSE 0 END AS conflicting_sources
            FROM result_counts r LEFT JOIN claim_counts c ON r.qid = c.qid LEFT JOIN pair_counts p ON r.qid = p.qid LEFT JOIN nodes n ON r.qid = n.qid""",
        "term_rows": f"SELECT qid, term, title, snippet FROM {d.lists('survivors', 'qid, title, snippet', 'terms', 'term')} x",
        "covered": "SELECT qid, count(DISTINCT CASE WHEN contains(lower(concat(title, ' ', snippet)), term) THEN term END) AS covered, count(DISTINCT term) AS asked_terms FROM term_rows GROUP BY qid",
        "stage_counts": """SELECT a.qid, coalesce(f.n, 0) AS candidates, coalesce(r.n, 0) AS relevant_results, coalesce(b.n, 0) AS backed_results FROM asked a
            LEFT JOIN (SELECT qid, count(*) AS n FROM found GROUP BY qid) f ON a.qid = f.qid LEFT JOIN (SELECT qid, count(*) AS n FROM relevant GROUP BY qid) r ON a.qid = r.qid
            LEFT JOIN (SELECT qid, count(*) AS n FROM backed GROUP BY qid) b ON a.qid = b.qid""",
        "facts": f"""SELECT a.qid, a.query, a.judgment, a.underspecified, {d.size('a.defs')} > 0 AS definition, s.candidates, s.relevant_results, s.backed_results, coalesce(r.results, 0) AS results,
            CASE WHEN r.results IS NULL THEN 0e0 ELSE coalesce({d.divide('v.covered', 'v.asked_terms')}, 1e0) END AS coverage, coalesce(r.relevance, 0e0) AS relevance, coalesce(r.authority, 0e0) AS authority,
            coalesce(CASE WHEN r.hosts > 0 THEN r.hosts ELSE r.sources END, 0) AS independent, coalesce(g.agreement, 'insufficient') AS agreement, coalesce(g.conflict, false) AS conflict,
            coalesce(g.supporting_sources, 0) AS supporting_sources, coalesce(g.conflicting_sources, 0) AS conflicting_sources
            FROM asked a JOIN stage_counts s ON a.qid = s.qid LEFT JOIN result_counts r ON a.qid = r.qid LEFT JOIN covered v ON a.qid = v.qid LEFT JOIN agreed g ON a.qid = g.qid""",
        "weighed": """SELECT *, CASE WHEN results = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 0.38e0 * coverage + 0.27e0 * relevance + 0.2e0 * authority + 0.1e0 * least(independent, 3) / 3e0 + 0.05e0 * least(results, 3) / 3e0)) END AS confidence,
            NOT judgment AND results = 1 AND coverage >= 0.85e0 AND relevance >= 0.8e0 AND authority >= 0.9e0 AS strong FROM facts""",
        "decided": """SELECT *, CASE WHEN results = 0 OR underspecified OR coverage < 0.3e0 OR relevance < 0.22e0 OR confidence < 0.48e0 OR (relevance < 0.35e0 AND authority < 0.6e0) THEN 'abstain'
            WHEN conflict THEN 'answer_with_caveat' WHEN strong THEN 'answer' WHEN confidence < 0.76e0 OR coverage < 0.7e0 OR relevance < 0.45e0 OR independent < 2 THEN 'answer_with_caveat' ELSE 'answer' END AS decision FROM weighed""",
    }
    reasons = d.compact([
        f"CASE WHEN coverage < 0.5e0 THEN '{LOW_COVERAGE}' END",
        f"CASE WHEN relevance < 0.35e0 THEN '{LOW_RELEVANCE}' END",
        f"CASE WHEN authority < 0.6e0 THEN '{LOW_AUTHORITY}' END",
        f"CASE WHEN relevance < 0.35e0 AND authority < 0.6e0 THEN '{LOW_BOTH}' END",
        f"CASE WHEN independent < 2 AND NOT strong THEN '{FEW_SOURCES}' END",
        f"CASE WHEN conflict THEN '{CONFLICT}' WHEN agreement = 'agreement' THEN '{CONSISTENT}' WHEN agreement = 'mixed' THEN '{DIFFERENT}' END",
        "CASE WHEN candidates > results THEN concat('Discarded ', cast(candidates - results AS string), ' weak or lower-ranked retrieval candidates.') END",
        f"CASE WHEN underspecified THEN '{UNDERSPECIFIED}' END",
    ])
    out["reasoned"] = f"""SELECT *, CASE WHEN results = 0 THEN CASE WHEN definition AND backed_results > 0 THEN '{NO_DEFINITION}' WHEN relevant_results > 0 THEN '{NO_CLAIM}' ELSE '{NO_RESULT}' END
        ELSE coalesce(nullif({d.join(reasons, ' ')}, ''), '{SUFFICIENT}') END AS reasons FROM decided"""
    key = d.replace("lower(sentence)", d.space + "+", " ")
    out["unrepeated"] = f"""SELECT * FROM (SELECT s.qid, s.sentence, s.support, r.citation, s.pos, row_number() OVER (PARTITION BY s.qid, substring({key.replace('sentence', 's.sentence')}, 1, 140) ORDER BY s.support DESC, r.citation, s.pos) AS again
        FROM supporting s JOIN survivors r ON s.qid = r.qid AND s.doc_id = r.doc_id) x WHERE again = 1"""
    out["quoted"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY support DESC, citation, pos) AS nth FROM unrepeated) x WHERE nth <= 3"
    line = "concat(sentence, ' [', cast(citation AS string), ']')"
    parts = ", ".join(f"max(CASE WHEN nth = {i} THEN {line} END) AS l{i}" for i in (1, 2, 3))
    out["extract"] = f"SELECT qid, concat_ws(' ', l1, l2, l3) AS extract FROM (SELECT qid, {parts} FROM quoted GROUP BY qid) x"
    out["answers"] = f"""SELECT r.qid, r.decision, CASE WHEN r.decision = 'abstain' THEN CASE WHEN r.underspecified AND r.relevant_results > 0 THEN '{ABSTAIN_UNDERSPECIFIED}' ELSE '{ABSTAIN}' END
        ELSE concat(CASE WHEN r.decision = 'answer' THEN '' WHEN r.conflict THEN '{CAVEAT_CONFLICT}' ELSE '{CAVEAT_PARTIAL}' END, coalesce(x.extract, '{FALLBACK}')) END AS answer,
        CASE WHEN r.decision = 'abstain' THEN 'evidence-gate' ELSE 'extractive-grounded' END AS model FROM reasoned r LEFT JOIN extract x ON r.qid = x.qid"""
    # Where each candidate drops out; the check of definitions here knows the sentence alone.
    out["traced"] = f"""SELECT f.qid, f.doc_id, f.rank, round(f.relevance, 6) AS relevance, round(f.floor, 6) AS floor, round(f.topic_authority, 6) AS authority,
        CASE WHEN f.relevance < {MIN_RELEVANCE}e0 THEN 'pruned_minimum_relevance' WHEN f.relevance < f.floor THEN 'pruned_relative_relevance' WHEN NOT f.has_ids THEN 'pruned_identifier_grounding'
        WHEN NOT EXISTS (SELECT 1 FROM supporting s WHERE s.qid = f.qid AND s.doc_id = f.doc_id) THEN 'pruned_sentence_support'
        WHEN {d.size('f.defs')} > 0 AND NOT EXISTS (SELECT 1 FROM supported s WHERE s.qid = f.qid AND s.doc_id = f.doc_id AND s.defines) THEN 'pruned_definition_answerability' ELSE 'survives_local_evidence_pruning' END AS stage FROM floored f"""
    return out


#: Steps with several readers; a run writes them once to the shared folder.
SHARED = ("asked", "floored", "supported", "relevant", "survivors", "claims")


def chain(d: Spark, last: str, select: str = "*", have: tuple[str, ...] = ()) -> str:
    """One statement of the steps that ``last`` needs; those in ``have`` are tables already."""
    import re

    all_steps, need, todo = steps(d), set(), [last]
    while todo:
        name = todo.pop()
        if name in need or name in have:
            continue
        need.add(name)
        todo += [n for n in all_steps if n != name and re.search(rf"\b{n}\b", all_steps[name])]
    ordered = [n for n in all_steps if n in need]
    return ("WITH " + ",\n".join(f"{n} AS ({all_steps[n]})" for n in ordered) if ordered else "") + f"\nSELECT {select} FROM {last}"


def needed(d: Spark, last: str) -> list[str]:
    """The shared steps that ``last`` needs, itself left out."""
    text = chain(d, last)
    return [n for n in SHARED if n != last and f"{n} AS (" in text]


def evaluate(spark, candidates, queries, last: str, select: str = "*"):
    """A step over DataFrames of candidates and queries; shared steps are written once."""
    from corpusloom.functions.dialect import SPARK
    from corpusloom.runtime import materialise

    frames, have = {"candidates": candidates, "queries": queries}, []
    for name in [*needed(SPARK, last), None]:
        for k, df in frames.items():
            df.createOrReplaceTempView(k)
        if name is None:
            return spark.sql(chain(SPARK, last, select, tuple(have)))
        frames = {name: materialise(spark.sql(chain(SPARK, name, "*", tuple(have))), name)}
        have.append(name)
