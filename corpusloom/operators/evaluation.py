"""Retrieval quality over labelled cases: reciprocal rank, recall, nDCG, pass rates, diagnosis and funnel.

Steps over ``eval_cases``, ``results`` (qid, rank, url) and ``gate`` (qid, decision, citations, cited
array of urls joined by blanks).  Cases without gold domains have null metrics; a null ``must_cite``
is no rule; a null list is empty.
"""

from __future__ import annotations

from corpusloom.functions import text
from corpusloom.functions.dialect import Spark

K = 5


def _dcg(gain: str) -> str:
    return f"{gain} / ln(rank + 1) * ln(2)"


def steps(d: Spark, k: int = K, search_k: int = 20) -> dict[str, str]:
    empty = "cast(array() AS array<string>)" if d.name == "spark" else "[]::VARCHAR[]"
    pref, acc = f"coalesce(preferred_domains, {empty})", f"coalesce(acceptable_domains, {empty})"
    ideal = " + ".join(f"(CASE WHEN {i} <= n_pref THEN 2e0 WHEN {i} <= n_pref + n_acc THEN 1e0 ELSE 0e0 END) / ln({i + 1}) * ln(2)" for i in range(1, k + 1))
    return {
        "lists": f"SELECT id AS qid, category, must_cite, coalesce(expected_decision, {empty}) AS expected, {d.distinct(pref)} AS pref, {d.minus(acc, pref)} AS acc FROM eval_cases",
        "gold": f"SELECT *, {d.size('pref')} AS n_pref, {d.size('acc')} AS n_acc, {d.size('pref')} + {d.size('acc')} > 0 AS judged FROM lists",
        "domains": f"SELECT qid, rank, coalesce({text.domain_of(d, 'url')}, '') AS domain FROM results",
        "gains": f"""SELECT r.qid, r.rank, r.domain, CASE WHEN {d.has('g.pref', 'r.domain')} THEN 2 WHEN {d.has('g.acc', 'r.domain')} THEN 1 ELSE 0 END AS gain,
            row_number() OVER (PARTITION BY r.qid, r.domain ORDER BY r.rank) AS seen FROM domains r JOIN gold g ON r.qid = g.qid""",
        "ranks": f"""SELECT qid, min(CASE WHEN gain > 0 THEN rank END) AS first_rank, count(DISTINCT CASE WHEN gain > 0 AND rank <= {k} THEN domain END) AS found,
            sum(CASE WHEN rank <= {k} AND seen = 1 THEN {_dcg('gain')} ELSE 0e0 END) AS dcg, sum(CASE WHEN gain > 0 AND rank <= {search_k} THEN 1 ELSE 0 END) AS gold_results FROM gains GROUP BY qid""",
        "metrics": f"""SELECT g.qid, g.category, g.judged, r.first_rank, CASE WHEN g.judged THEN coalesce(1e0 / r.first_rank, 0e0) END AS rr,
            CASE WHEN g.judged THEN coalesce(r.found, 0) / cast(g.n_pref + g.n_acc AS double) END AS recall_at_k,
            CASE WHEN g.judged THEN coalesce(r.dcg, 0e0) / ({ideal}) END AS ndcg_at_k, coalesce(r.gold_results, 0) AS gold_results FROM gold g LEFT JOIN ranks r ON g.qid = r.qid""",
        "cited": f"SELECT c.qid, count(*) AS citations, sum(CASE WHEN {d.has('g.pref', 'c.domain')} OR {d.has('g.acc', 'c.domain')} THEN 1 ELSE 0 END) AS gold_citations FROM (SELECT qid, coalesce({text.domain_of(d, 'url')}, '') AS domain FROM citations) c JOIN gold g ON c.qid = g.qid GROUP BY c.qid",
        "policy": f"""SELECT m.*, a.decision, coalesce(c.citations, 0) AS citations, coalesce(c.gold_citations, 0) AS gold_citations, {d.has('g.expected', 'a.decision')} AS decision_ok,
            CASE WHEN g.must_cite IS NULL THEN true WHEN g.must_cite THEN coalesce(c.citations, 0) > 0 ELSE coalesce(c.citations, 0) = 0 END AS citation_rule_ok
            FROM metrics m JOIN gold g ON m.qid = g.qid JOIN gate a ON m.qid = a.qid LEFT JOIN cited c ON m.qid = c.qid""",
        "diagnosed": f"""SELECT qid, category, first_rank, judged, CASE WHEN NOT judged THEN CASE WHEN decision = 'abstain' THEN 'behavior_only_abstain' ELSE 'behavior_only_answered' END
            WHEN gold_results = 0 THEN 'candidate_coverage_miss_top_{search_k}' WHEN gold_citations = 0 THEN CASE WHEN decision = 'abstain' THEN 'retrieved_then_filtered_or_answerability_abstain' ELSE 'retrieved_but_not_selected_for_citation' END
            WHEN decision = 'abstain' THEN 'citation_present_but_abstained' ELSE 'authoritative_evidence_reached_answer' END AS diagnosis FROM policy""",
    }


def chain(d: Spark, last: str, select: str = "*", k: int = K) -> str:
    s = steps(d, k)
    return "WITH " + ",\n".join(f"{n} AS ({x})" for n, x in s.items()) + f"\nSELECT {select} FROM {last}"
