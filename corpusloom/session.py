"""Facade: one object that stores documents, keeps the index tables and answers tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.constants import TOP_K
from corpusloom.functions.dialect import SPARK
from corpusloom.operators import answers, planner
from corpusloom.operators.fusion import assemble, candidates, hybrid
from corpusloom.operators.index import TextIndex
from corpusloom.operators.semantic import LatentSpace
from corpusloom.operators.store import VersionedStore, new_rows, replace_urls, store_rows
from corpusloom.runtime import Owner, materialise


class SearchSession:
    """Documents in a versioned store under ``path``; queries are DataFrames of qid and query.

    The index is built once per store version and kept in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str, shards: list[str] | None = None):
        self.spark, self.shards = spark, shards or ["shard-0"]
        self.store = VersionedStore(spark, path)
        self.store.create()
        self._built: tuple | None = None
        self._owned: Owner | None = None

    def _rows(self, documents: DataFrame) -> DataFrame:
        d = documents
        for c, v in (("input_id", F.monotonically_increasing_id()), ("received_at", F.current_timestamp()), ("url", F.lit(None).cast("string")), ("source", F.lit(None).cast("string"))):
            if c not in d.columns:
                d = d.withColumn(c, v)
        return materialise(store_rows(d, self.shards), "incoming")

    def add(self, documents: DataFrame) -> dict:
        """Adds texts that the owner shard hasn't (title, text, url?, source?); counts of added and skipped."""
        rows = self._rows(documents)
        fresh = materialise(new_rows(rows, self.store.read()).drop("copies"), "fresh")
        total, added = rows.count(), fresh.count()
        if added:
            self.store.append(fresh)
        return {"added": added, "skipped": total - added}

    def refresh(self, documents: DataFrame) -> dict:
        """Replaces the stored texts of every url that comes; unchanged urls are left alone, a failed write keeps the last version."""
        rows = self._rows(documents)
        if not rows.where("url IS NULL OR url = ''").isEmpty():
            raise ValueError("a refresh needs a url on every document")
        changes = materialise(replace_urls(self.store.read(), rows), "changes")
        changed = rows.join(changes.where("NOT unchanged").select("url"), "url", "left_semi")
        if not changed.isEmpty():
            self.store.replace(changed)
        total = changes.agg(F.sum("added"), F.sum("skipped"), F.sum("removed"), F.count_if(~F.col("unchanged")), F.count_if("unchanged")).first()
        return dict(zip(("added", "skipped", "removed", "refreshed", "unchanged"), (x or 0 for x in total)))

    def documents(self) -> DataFrame:
        return self.store.read().select(F.concat_ws("/", "shard_id", "document_id").alias("doc_id"), "title", F.col("body").alias("text"), "url", "source")

    def _index(self) -> tuple[TextIndex, LatentSpace]:
        version = tuple(self.store._current())
        if self._built is None or self._built[0] != version:
            if self._owned is not None:
                self._owned.free()  # the tables of the last version's index
            with Owner() as self._owned:
                index = TextIndex.build(self.documents())
                self._built = (version, index, LatentSpace.fit(self.spark, index))
        return self._built[1:]

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 10) -> DataFrame:
        """Ranked results of each query with scores and snippets; modes ``lexical``, ``semantic`` and ``hybrid``."""
        if mode not in ("lexical", "semantic", "hybrid"):
            raise ValueError(f"unknown mode {mode}")
        if not 1 <= k <= TOP_K["search"]:
            raise ValueError(f"k must be from 1 to {TOP_K['search']}")
        queries = queries.where(F.length("query").between(2, 500))
        index, space = self._index()
        ranked = hybrid(index.search(queries, candidates(k)), space.search(queries, candidates(k)), k, mode)
        return assemble(ranked, queries, self.documents())

    def ask(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """``qid, decision, answer, model`` by the evidence gate over up to 25 candidates."""
        if not 1 <= k <= TOP_K["ask"]:
            raise ValueError(f"k must be from 1 to {TOP_K['ask']}")
        found = materialise(self.search(queries, "hybrid", min(25, max(20, 4 * k))), "asked").select("qid", "query", "doc_id", "rank", "score", "title", "url", "source", "snippet")
        return answers.evaluate(self.spark, found, queries.select("qid", "query"), "answers")

    def plan(self, requests: DataFrame) -> DataFrame:
        """Plans for rows of id, query, state, requested, inflight, capacity, healthy, total, unavailable, p95_ms."""
        requests.createOrReplaceTempView("plan_requests")
        return self.spark.sql(planner.plan(SPARK, "plan_requests"))

    def stats(self) -> DataFrame:
        """Documents and terms of each shard; the terms of a cluster add up, shared ones again."""
        d = self.store.read().select("shard_id", F.col("document_id").alias("doc_id"), "title", F.col("body").alias("text"))
        index = TextIndex.build(d, scope=["shard_id"])
        terms = index.postings.select("shard_id", "term").distinct().groupBy("shard_id").agg(F.count("*").alias("terms"))
        return index.stats.select("shard_id", F.col("n").alias("documents"), F.round("avgdl", 3).alias("mean_terms")).join(terms, "shard_id", "left").na.fill(0, ["terms"])
