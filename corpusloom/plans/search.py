"""Index, lexical and vector search, fusion and shard merge, and the evidence gate over their results.

The corpus is ``documents``; the query table is ``eval_cases``, and for vectors every row whose id is
divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import evidence, text
from corpusloom.functions.constants import BM25_B, BM25_K1, LSA_FEATURES, RRF_K
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import answers
from corpusloom.operators.fusion import assemble, candidates, hybrid, merge_shards, rrf
from corpusloom.operators.index import TextIndex, indexed_text
from corpusloom.operators.semantic import LatentSpace, nearest, normalised
from corpusloom.runtime import kept, materialise, table

K = 10


def cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").select(F.col("id").alias("qid"), "query")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "title", "text", "url", "source")


def shards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nexus_documents").select("shard_id", F.col("document_id").alias("doc_id"), "title", F.col("body").alias("text"), "url", "source")


def index(spark: SparkSession, d: str, persist: bool = False) -> TextIndex:
    """The index of the corpus; a written one serves all queries of the session."""
    if not persist:
        return TextIndex.build(corpus(spark, d), persist=False)
    return kept(spark, ("index", d), lambda: TextIndex.build(corpus(spark, d)), lambda i: [i.rows, i.stats, i.df])


def shard_index(spark: SparkSession, d: str) -> TextIndex:
    return kept(spark, ("shards", d), lambda: TextIndex.build(shards(spark, d), scope=["shard_id"]), lambda i: [i.rows, i.stats, i.df])


def bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return index(spark, d, persist=True).search(cases(spark, d), k)


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the evidence gate: the best 20 lexical results with snippets, written once a session."""

    def found() -> DataFrame:
        out = assemble(bm25(spark, d, candidates(5)), cases(spark, d), corpus(spark, d))
        return materialise(out.select("qid", "query", "doc_id", "rank", "score", "title", "url", "source", "snippet"), "candidates")

    return kept(spark, ("candidates", d), found, lambda t: [t])


def evidence_query(last: str, select: str):
    return lambda spark, d: answers.evaluate(spark, retrieved(spark, d), cases(spark, d), last, select)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), normalised(F.col("embedding")).alias("vector"))


def cosine(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    v = vectors(spark, d)
    return nearest(v, v.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), "vector"), k)


def titled(spark: SparkSession, d: str) -> DataFrame:
    """Query table of documents whose id is divisible by 100: their titles."""
    return corpus(spark, d).where("doc_id % 100 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("qid"), F.col("title").alias("query"))


def hybrid_embeddings(spark: SparkSession, d: str) -> DataFrame:
    lexical = index(spark, d, persist=True).search(titled(spark, d), candidates(K))
    return hybrid(lexical, cosine(spark, d, candidates(K)), K)


def hybrid_search(spark: SparkSession, d: str, mode: str = "hybrid") -> DataFrame:
    """The flagship: lexical and latent semantic lists fused, with titles, urls and snippets."""
    ix = index(spark, d, persist=True)
    space = LatentSpace.fit(spark, ix)
    ranked = hybrid(ix.search(cases(spark, d), candidates(K)), space.search(cases(spark, d), candidates(K)), K, mode)
    return assemble(ranked, cases(spark, d), corpus(spark, d))


def lsa(spark: SparkSession, d: str) -> DataFrame:
    return LatentSpace.fit(spark, index(spark, d, persist=True)).search(cases(spark, d), K)


def shard_lists(spark: SparkSession, d: str) -> DataFrame:
    return shard_index(spark, d).search(cases(spark, d), candidates(K))


def merged(spark: SparkSession, d: str) -> DataFrame:
    lists = shard_lists(spark, d).join(cases(spark, d), "qid").join(shards(spark, d).select("shard_id", "doc_id", "title", "url"), ["shard_id", "doc_id"])
    lists = lists.select("shard_id", "qid", "query", "doc_id", "title", "url", "rank", F.col("score").alias("bm25_score"), F.lit(0.0).alias("semantic_score"))
    return merge_shards(lists, K).select("qid", "doc_id", "rank", "score", "title_overlap", "bm25_score")


_REASONED = "qid, decision, round(confidence, 3) AS confidence, round(coverage, 3) AS coverage, round(authority, 3) AS authority, round(relevance, 3) AS relevance, cast(independent AS int) AS independent_sources, cast(results AS int) AS relevant_evidence_count, cast(candidates - results AS int) AS discarded_results, agreement, conflict, cast(supporting_sources AS int) AS supporting_sources, cast(conflicting_sources AS int) AS conflicting_sources, reasons"
_EVIDENCE = {
    "query_facts": ("asked", "qid, {j}, judgment, underspecified"),
    "result_relevance": ("floored", "qid, doc_id, round(relevance, 6) AS relevance, round(floor, 6) AS floor, has_ids"),
    "authority_join": ("floored", "qid, doc_id, host, authority, round(topic_authority, 6) AS topic_authority"),
    "relevance_prune": ("relevant", "qid, doc_id, cast(place AS int) AS place"),
    "sentences": ("sentences", "qid, doc_id, cast(pos AS int) AS pos, sentence"),
    "sentence_support": ("supported", "qid, doc_id, cast(pos AS int) AS pos, round(support, 6) AS support"),
    "supporting_sentences": ("supporting", "qid, doc_id, cast(pos AS int) AS pos, sentence"),
    "support_prune": ("backed", "qid, doc_id"),
    "definition_gate": ("supported", "qid, doc_id, cast(pos AS int) AS pos, defines, defines_with_title"),
    "definition_prune": ("survivors", "qid, doc_id"),
    "citations": ("survivors", "qid, cast(citation AS int) AS citation, title, url, doc_id"),
    "claims": ("claims", "qid, doc_id, polarity, {t}"),
    "claim_pairs": ("claim_pairs", "qid, cast(i AS int) AS i, cast(j AS int) AS j, conflict"),
    "agreement_summary": ("agreed", "qid, agreement, conflict, cast(supporting_sources AS int) AS supporting_sources, cast(conflicting_sources AS int) AS conflicting_sources"),
    "coverage_union": ("covered", "qid, cast(covered AS int) AS covered, cast(asked_terms AS int) AS asked_terms"),
    "evidence_summary": ("reasoned", _REASONED),
    "top_sentences": ("quoted", "qid, cast(nth AS int) AS nth, sentence, cast(citation AS int) AS citation"),
    "extractive_answer": ("answers", "qid, decision, answer, model"),
    "stage_trace": ("traced", "*"),
    "stage_funnel": ("traced", "qid, stage"),
}


def _select(d, s: str) -> str:
    j = ", ".join(f"{d.join(d.sort(c), ' ')} AS {c}" for c in ("terms", "ids", "defs"))
    return s.replace("{j}", j).replace("{t}", f"{d.join(d.sort('tokens'), ' ')} AS tokens")


def _run_evidence(name: str):
    last, select = _EVIDENCE[name]
    return evidence_query(last, _select(SPARK, select))


def _funnel(spark, d):
    f = _run_evidence("stage_funnel")(spark, d)
    return f.groupBy("stage").agg(F.count("*").alias("candidates"), F.countDistinct("qid").alias("queries"))


def _marks(spark, d):
    """Every candidate, marked as cited or not."""
    found = retrieved(spark, d)
    cited = answers.evaluate(spark, found, cases(spark, d), "survivors", "qid, doc_id, true AS cited")
    return found.select("qid", "doc_id", "rank").join(cited, ["qid", "doc_id"], "left").na.fill(False, ["cited"])


QUERIES = {
    "doc_stats": lambda spark, d: corpus(spark, d).select("doc_id", F.expr(f"size({text.tokens(SPARK, indexed_text())})").alias("dl")),
    "corpus_stats": lambda spark, d: index(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl")),
    "postings": lambda spark, d: index(spark, d).postings,
    "document_frequency": lambda spark, d: index(spark, d).document_frequency(),
    "idf": lambda spark, d: index(spark, d, persist=True).idf().select("term", "df", F.round("idf", 9).alias("idf")),
    "vocabulary_size": lambda spark, d: index(spark, d).postings.agg(F.countDistinct("term").alias("terms")),
    "topk_vocab": lambda spark, d: index(spark, d).document_frequency().orderBy(F.desc("df"), F.asc("term")).limit(LSA_FEATURES),
    "bm25_batch": bm25,
    "bm25_topk": lambda spark, d: bm25(spark, d, 3),
    "bm25_results": lambda spark, d: retrieved(spark, d),
    "compact_results": lambda spark, d: retrieved(spark, d).select("qid", "rank", "title", "url", F.expr(text.domain_of(SPARK, "url")).alias("domain"), "score"),
    "cosine_topk": cosine,
    "l2_normalise": lambda spark, d: vectors(spark, d).select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector")),
    "rrf_fusion": lambda spark, d: rrf([index(spark, d, persist=True).search(titled(spark, d), candidates(K)), cosine(spark, d, candidates(K))], ["qid"]),
    "rrf_hybrid": hybrid_embeddings,
    "hybrid_search": hybrid_search,
    "lsa_topk": lsa,
    "shard_local_bm25": shard_lists,
    "cluster_merge": merged,
    "partial_merge": lambda spark, d: shard_lists(spark, d).where("shard_id <> 'shard-1'").groupBy("qid").agg(F.count("*").alias("results"), F.countDistinct("shard_id").alias("healthy")),
    "title_overlap": lambda spark, d: retrieved(spark, d).select("qid", "doc_id", F.round(F.expr(evidence.title_overlap(SPARK, text.tokens(SPARK, "query"), text.tokens(SPARK, "coalesce(title, '')"))), 6).alias("overlap")),
    "cluster_vocabulary": lambda spark, d: TextIndex.build(shards(spark, d), scope=["shard_id"], persist=False).postings.select("shard_id", "term").distinct().groupBy("shard_id").agg(F.count("*").alias("terms")).agg(F.sum("terms").alias("summed_terms"), F.count("*").alias("shards")),
    "candidate_marks": _marks,
} | {n: _run_evidence(n) for n in _EVIDENCE if n != "stage_funnel"} | {"stage_funnel": _funnel}

# ---- the same in SQL


def _index_sql(docs: str, scope: str = "", queries: str = "SELECT id AS qid, query FROM eval_cases") -> str:
    s = f"{scope}, " if scope else ""
    on = f"AND p.{scope} = f.{scope}" if scope else ""
    on_stats = f"JOIN stats USING ({scope})" if scope else "CROSS JOIN stats"
    return f"""docs AS ({docs}), toks AS (SELECT {s}doc_id, {text.tokens(DUCK, indexed_text())} AS a FROM docs),
  p AS (SELECT {s}doc_id, dl, term, count(*)::INT AS tf FROM (SELECT {s}doc_id, len(a)::INT AS dl, unnest(a) AS term FROM toks) GROUP BY ALL),
  stats AS (SELECT {s}count(*) AS n, avg(len(a)) AS avgdl FROM toks {f'GROUP BY {scope}' if scope else ''}),
  f AS (SELECT {s}term, count(*) AS df FROM p GROUP BY {s}term),
  asked_terms0 AS (SELECT qid, unnest({text.tokens(DUCK, 'query')}) AS term FROM ({queries})), asked AS (SELECT qid, term, count(*) AS times FROM asked_terms0 GROUP BY ALL),
  bm AS (SELECT {f'p.{scope}, ' if scope else ''}qid, doc_id, round(sum(times * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * {BM25_K1 + 1}e0 / (tf + {BM25_K1}e0 * ({1 - BM25_B}e0 + {BM25_B}e0 * dl / greatest(avgdl, 1e-9)))), 6) AS score
     FROM p JOIN asked ON p.term = asked.term JOIN f ON p.term = f.term {on} {on_stats.replace(f'({scope})', f'({scope})') if not scope else f'JOIN stats ON stats.{scope} = p.{scope}'} GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {s}qid ORDER BY score DESC, doc_id)::INT AS rank FROM bm)"""


_DOCS = "SELECT doc_id, title, text, url, source FROM documents"
_SHARDS = "SELECT shard_id, document_id AS doc_id, title, body AS text, url, source FROM nexus_documents"
_TITLED = "SELECT doc_id AS qid, title AS query FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL"
_IX = _index_sql(_DOCS)
_CAND = f"""{_IX.replace('asked', 'bm_asked')}, candidates AS (SELECT r.qid, e.query, r.doc_id, r.rank, r.score, d.title, d.url, d.source, {text.snippet(DUCK, "coalesce(d.text, '')", "e.query")} AS snippet
    FROM ranked r JOIN eval_cases e ON e.id = r.qid JOIN docs d ON d.doc_id = r.doc_id WHERE rank <= {candidates(5)})"""
_COS = f"""vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) END) AS v FROM embeddings),
  sim AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v), 6) AS score FROM vec q CROSS JOIN vec d WHERE q.vec_id % 100 = 0),
  cos AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM sim)"""
_HYB = f"{_index_sql(_DOCS, queries=_TITLED)}, {_COS}"
_LISTS = f"SELECT qid, doc_id, rank, score AS b, NULL::DOUBLE AS s FROM ranked WHERE rank <= {candidates(K)} UNION ALL SELECT qid, doc_id, rank, NULL, score FROM cos WHERE rank <= {candidates(K)}"
_MERGE = f"""{_index_sql(_SHARDS, 'shard_id')}, l AS (SELECT * FROM ranked WHERE rank <= {candidates(K)}),
  fu AS (SELECT qid, doc_id, round(sum(1e0 / ({RRF_K} + rank)), 6) AS score, max(shard_id) AS shard_id FROM l GROUP BY qid, doc_id),
  j AS (SELECT fu.qid, fu.doc_id, fu.score, l.score AS bm25_score, {evidence.title_overlap(DUCK, text.tokens(DUCK, 'e.query'), text.tokens(DUCK, "coalesce(d.title, '')"))} AS title_overlap
    FROM fu JOIN l USING (qid, doc_id, shard_id) JOIN eval_cases e ON e.id = fu.qid JOIN docs d ON d.shard_id = fu.shard_id AND d.doc_id = fu.doc_id),
  m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, title_overlap DESC, bm25_score DESC, doc_id DESC)::INT AS rank FROM j)"""


def _evidence_sql(name: str) -> str:
    last, select = _EVIDENCE[name]
    inner = answers.chain(DUCK, last, _select(DUCK, select)).removeprefix("WITH ")
    return f"WITH {_CAND}, queries AS (SELECT id AS qid, query FROM eval_cases), {inner}"


ORACLE = {
    "doc_stats": f"SELECT doc_id, len({text.tokens(DUCK, indexed_text())})::INT AS dl FROM documents",
    "corpus_stats": f"WITH {_IX} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "postings": f"WITH {_IX} SELECT * FROM p",
    "document_frequency": f"WITH {_IX} SELECT * FROM f",
    "idf": f"WITH {_IX} SELECT term, df, round(ln(1 + (n - df + 5e-1) / (df + 5e-1)), 9) AS idf FROM f CROSS JOIN stats",
    "vocabulary_size": f"WITH {_IX} SELECT count(*) AS terms FROM f",
    "topk_vocab": f"WITH {_IX} SELECT term, df FROM f ORDER BY df DESC, term LIMIT {LSA_FEATURES}",
    "bm25_batch": f"WITH {_IX} SELECT * FROM ranked WHERE rank <= {K}",
    "bm25_topk": f"WITH {_IX} SELECT * FROM ranked WHERE rank <= 3",
    "bm25_results": f"WITH {_CAND} SELECT * FROM candidates",
    "compact_results": f"WITH {_CAND} SELECT qid, rank, title, url, {text.domain_of(DUCK, 'url')} AS domain, score FROM candidates",
    "cosine_topk": f"WITH {_COS} SELECT * FROM cos WHERE rank <= {K}",
    "l2_normalise": f"WITH {_COS} SELECT vec_id AS doc_id, list_transform(v, lambda x: round(x, 6)) AS vector FROM vec",
    "rrf_fusion": f"WITH {_HYB} SELECT qid, doc_id, round(sum(1e0 / ({RRF_K} + rank)), 9) AS rrf FROM ({_LISTS}) GROUP BY qid, doc_id",
    "rrf_hybrid": f"""WITH {_HYB}, u AS (SELECT qid, doc_id, round(sum(1e0 / ({RRF_K} + rank)), 6) AS score, coalesce(max(b), 0e0) AS bm25_score, coalesce(max(s), 0e0) AS semantic_score FROM ({_LISTS}) GROUP BY qid, doc_id),
        w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM u) SELECT * FROM w WHERE rank <= {K}""",
    "shard_local_bm25": f"WITH {_index_sql(_SHARDS, 'shard_id')} SELECT * FROM ranked WHERE rank <= {candidates(K)}",
    "cluster_merge": f"WITH {_MERGE} SELECT qid, doc_id, rank, score, title_overlap, bm25_score FROM m WHERE rank <= {K}",
    "partial_merge": f"WITH {_index_sql(_SHARDS, 'shard_id')} SELECT qid, count(*) AS results, count(DISTINCT shard_id) AS healthy FROM ranked WHERE rank <= {candidates(K)} AND shard_id <> 'shard-1' GROUP BY qid",
    "title_overlap": f"WITH {_CAND} SELECT qid, doc_id, round({evidence.title_overlap(DUCK, text.tokens(DUCK, 'query'), text.tokens(DUCK, "coalesce(title, '')"))}, 6) AS overlap FROM candidates",
    "cluster_vocabulary": f"WITH {_index_sql(_SHARDS, 'shard_id')} SELECT count(*) AS summed_terms, count(DISTINCT shard_id) AS shards FROM f",
    "candidate_marks": f"WITH {_CAND}, queries AS (SELECT id AS qid, query FROM eval_cases), m AS ({answers.chain(DUCK, 'survivors', 'qid, doc_id')}) SELECT c.qid, c.doc_id, c.rank, m.qid IS NOT NULL AS cited FROM candidates c LEFT JOIN m ON c.qid = m.qid AND c.doc_id = m.doc_id",
} | {n: _evidence_sql(n) for n in _EVIDENCE if n != "stage_funnel"} | {
    "stage_funnel": f"SELECT stage, count(*) AS candidates, count(DISTINCT qid) AS queries FROM ({_evidence_sql('stage_funnel')}) GROUP BY stage",
}
