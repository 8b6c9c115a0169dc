"""Quality evaluation of the evidence gate on the labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.dialect import DUCK
from corpusloom.operators import answers, evaluation
from corpusloom.plans import search
from corpusloom.plans.sql import run
from corpusloom.runtime import materialise


def responses(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Results, decisions and citations of all cases."""
    found, asked = search.retrieved(spark, d), search.cases(spark, d)
    gate = materialise(answers.evaluate(spark, found, asked, "reasoned", "qid, decision"), "gate")
    cited = materialise(answers.evaluate(spark, found, asked, "survivors", "qid, doc_id, url"), "cited")
    return {"results": found.select("qid", "rank", "url", "doc_id"), "gate": gate, "citations": cited.select("qid", "url")}


_PASS = "sum(CASE WHEN decision_ok AND citation_rule_ok THEN 1 ELSE 0 END)"
_ROLLUP = f"""coalesce(category, 'all') AS category, count(*) AS cases, round(1e2 * {_PASS} / count(*), 2) AS pass_rate, round(coalesce(avg(rr), 0e0), 4) AS mrr,
    round(coalesce(avg(recall_at_k), 0e0), 4) AS recall_at_k, round(coalesce(avg(ndcg_at_k), 0e0), 4) AS ndcg_at_k"""
_STATEMENTS = {
    "mrr": ("metrics", "qid, round(rr, 6) AS rr", ""),
    "recall_at_k": ("metrics", "qid, round(recall_at_k, 6) AS recall_at_k", ""),
    "ndcg_at_k": ("metrics", "qid, round(ndcg_at_k, 6) AS ndcg_at_k", ""),
    "first_judged_rank": ("metrics", "qid, cast(first_rank AS int) AS first_rank", ""),
    "first_seen_domains": ("gains", "qid, cast(rank AS int) AS rank, domain, gain", "WHERE seen = 1"),
    "policy_checks": ("policy", "qid, decision, decision_ok, citation_rule_ok, cast(citations AS int) AS citations", ""),
    "category_rollup": ("policy", _ROLLUP, "GROUP BY GROUPING SETS ((category), ())"),
    "decision_counts": ("policy", "decision, count(*) AS cases", "GROUP BY decision"),
    "diagnosis": ("diagnosed", "qid, diagnosis", ""),
    "diagnosis_counts": ("diagnosed", "diagnosis, count(*) AS cases", "GROUP BY diagnosis"),
    "coverage_at_k": ("diagnosed", "count(*) AS judged_cases, round(avg(CASE WHEN first_rank IS NULL THEN 0e0 ELSE 1e0 END), 4) AS coverage, round(avg(first_rank), 3) AS mean_first_rank", "WHERE judged"),
    "gold_results": ("domains", "x.qid, cast(x.rank AS int) AS rank, x.domain", "x LEFT SEMI JOIN gold g ON x.qid = g.qid AND (array_contains(g.pref, x.domain) OR array_contains(g.acc, x.domain))"),
}
_DUCK_TAIL = {"gold_results": "x SEMI JOIN gold g ON x.qid = g.qid AND (list_contains(g.pref, x.domain) OR list_contains(g.acc, x.domain))"}


def _query(name: str):
    last, select, tail = _STATEMENTS[name]
    return lambda spark, d: run(spark, d, lambda dialect: evaluation.chain(dialect, last, select) + " " + tail, **responses(spark, d))


def _oracle(name: str) -> str:
    last, select, tail = _STATEMENTS[name]
    gate = answers.chain(DUCK, "reasoned", "qid, decision").removeprefix("WITH ")
    cut = gate.rindex("\nSELECT")
    survivors = answers.chain(DUCK, "survivors", "*").removeprefix("WITH ")
    return f"""WITH {search._CAND}, queries AS (SELECT id AS qid, query FROM eval_cases), {gate[:cut]}, results AS (SELECT qid, rank, url, doc_id FROM candidates),
        gate AS (SELECT qid, decision FROM reasoned), citations AS (SELECT qid, url FROM survivors), {evaluation.chain(DUCK, last, select).removeprefix('WITH ')} {_DUCK_TAIL.get(name, tail)}"""


def authoritative_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Stage counts of candidates from gold domains, and the stage of the first of them in each case."""
    traced = search.QUERIES["stage_trace"](spark, d)
    gold = QUERIES["gold_results"](spark, d)
    t = gold.join(traced.select("qid", "rank", "stage"), ["qid", "rank"])
    first = t.groupBy("qid").agg(F.min_by("stage", "rank").alias("stage")).groupBy("stage").agg(F.count("*").alias("first_in_cases"))
    return t.groupBy("stage").agg(F.count("*").alias("candidates")).join(first, "stage", "left").na.fill(0)


QUERIES = {n: _query(n) for n in _STATEMENTS}
ORACLE = {n: _oracle(n) for n in _STATEMENTS}
QUERIES["authoritative_funnel"] = authoritative_funnel
ORACLE["authoritative_funnel"] = f"""WITH marked AS (SELECT g.qid, g.rank, t.stage FROM ({ORACLE['gold_results']}) g JOIN ({search.ORACLE['stage_trace']}) t ON t.qid = g.qid AND t.rank = g.rank),
    firsts AS (SELECT stage, count(*) AS n FROM (SELECT qid, stage FROM marked QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1) GROUP BY stage)
    SELECT m.stage, count(*) AS candidates, coalesce(any_value(f.n), 0) AS first_in_cases FROM marked m LEFT JOIN firsts f USING (stage) GROUP BY m.stage"""
