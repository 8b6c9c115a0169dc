"""Fusing ranked lists: reciprocal ranks, hybrid search and the merge of independently ranked shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import evidence, text
from corpusloom.functions.constants import RRF_K
from corpusloom.functions.dialect import SPARK
from corpusloom.operators.index import TextIndex, rank


def rrf(lists: list[DataFrame], by: list[str], k: int = RRF_K) -> DataFrame:
    """``by``, doc_id and the sum of 1 / (k + rank) over the lists (by, doc_id, rank): a union and a sum, no outer join."""
    out = lists[0].select(*by, "doc_id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select(*by, "doc_id", "rank"))
    return out.groupBy(*by, "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("rrf"))


def candidates(k: int) -> int:
    return max(3 * k, 20)


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int, mode: str = "hybrid", scope: list[str] | None = None) -> DataFrame:
    """Ranked results with both component scores, from lists of ``candidates(k)`` rows.

    A component score is 0 for a document outside its list.  In the modes ``lexical`` and
    ``semantic`` the score is that list's own.
    """
    by = [*(scope or []), "qid"]
    both = (
        lexical.select(*by, "doc_id", "rank", F.col("score").alias("b"), F.lit(None).cast("double").alias("s"), F.lit(True).alias("lex"))
        .unionByName(semantic.select(*by, "doc_id", "rank", F.lit(None).cast("double").alias("b"), F.col("score").alias("s"), F.lit(False).alias("lex")))
        .groupBy(*by, "doc_id")
        .agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 6).alias("rrf"), F.max("b").alias("b"), F.max("s").alias("s"), F.min(F.when(F.col("lex"), F.col("rank"))).alias("lr"), F.min(F.when(~F.col("lex"), F.col("rank"))).alias("sr"))
    )
    if mode == "lexical":
        both, score, order = both.where("lr IS NOT NULL"), F.col("b"), [F.asc("lr")]
    elif mode == "semantic":
        both, score, order = both.where("sr IS NOT NULL"), F.col("s"), [F.asc("sr")]
    else:
        score, order = F.col("rrf"), [F.desc("rrf"), F.asc("doc_id")]
    out = both.withColumn("rank", rank(by, order)).where(F.col("rank") <= k)
    return out.select(*by, "doc_id", "rank", F.round(score, 6).alias("score"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("bm25_score"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("semantic_score"))


def assemble(ranked: DataFrame, queries: DataFrame, docs: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """Titles, urls and snippets for ranked rows, joined after the cut to k."""
    d = docs.select("doc_id", "title", "url", "text", "source")
    return ranked.join(queries.select(F.col(qid).alias("qid"), F.col(query).alias("query")), "qid").join(d, "doc_id").select(*ranked.columns, "query", "title", "url", "source", F.expr(text.snippet(SPARK, "coalesce(text, '')", "query")).alias("snippet"))


def merge_shards(results: DataFrame, k: int, shard: str = "shard_id") -> DataFrame:
    """One list per query of the lists of several shards.

    Rows have qid, query, title, doc_id, rank, bm25_score and semantic_score.  A document of two
    shards is fused, the last shard's row stands for it.  Order: reciprocal ranks, share of the query
    in the title, lexical score, semantic score, document id, all descending; the score becomes the
    fused one in every mode.
    """
    row = F.struct(shard, *[c for c in results.columns if c not in (shard, "qid", "doc_id")])
    fused = results.groupBy("qid", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 6).alias("rrf"), F.max_by(row, F.col(shard)).alias("r"))
    over = F.expr(evidence.title_overlap(SPARK, text.tokens(SPARK, "r.query"), text.tokens(SPARK, "coalesce(r.title, '')")))
    flat = fused.select("qid", "doc_id", "rrf", over.alias("title_overlap"), "r.*").drop("rank", "score")
    order = [F.desc(c) for c in ("rrf", "title_overlap", "bm25_score", "semantic_score", "doc_id")]
    return flat.withColumn("rank", rank(["qid"], order)).where(F.col("rank") <= k).withColumnRenamed("rrf", "score")


def shard_search(docs: DataFrame, queries: DataFrame, k: int, shard: str = "shard_id") -> DataFrame:
    """Lexical search of every shard with its own statistics: the best k of each shard and query."""
    return TextIndex.build(docs, scope=[shard]).search(queries, k)
