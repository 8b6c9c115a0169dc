"""Inverted index: postings with document lengths, corpus statistics and batch BM25 over a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as rules
from corpusloom.functions.constants import BM25_B, BM25_K1
from corpusloom.functions.dialect import SPARK
from corpusloom.runtime import materialise, small_side, spread


def tokens(text: str) -> Column:
    return F.expr(rules.tokens(SPARK, text))


def indexed_text(title: str = "title", text: str = "text") -> str:
    return f"concat(coalesce({title}, ''), chr(10), coalesce({text}, ''))"


def rank(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


#: Queries that are scored by one matrix, and that one scan of the documents serves; their weights are broadcast, at most 250 terms each.
QUERY_BLOCK, SCAN_QUERIES = 512, 8192
#: Parts of the inverted table, by hash of the term.
BUCKETS = 64
#: Cells of the term-by-document matrix that a task scores at once.
CELLS = 4_000_000


def best_of(score: np.ndarray, docs: np.ndarray, old_score: np.ndarray, old_docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of two score matrices with their documents, ties by document."""
    rows = np.arange(len(score))[:, None]
    if score.shape[1] > k:  # all that tie with the k-th stay until the documents decide
        least = -np.partition(-score, k - 1, 1)[:, k - 1 : k]
        width = max(1, int(((score >= least) & (score > -np.inf)).sum(1).max()))
        top = np.argpartition(-score, width - 1, 1)[:, :width]
        score, docs = score[rows, top], docs[rows, top]
    score, docs = np.concatenate((old_score, score), 1), np.concatenate((old_docs, docs.astype(object)), 1)
    place = np.unique(docs.astype(np.int64) if isinstance(docs.flat[0], (int, np.integer)) else docs.astype(str), return_inverse=True)[1].reshape(docs.shape) if docs.size else docs
    top = np.lexsort((place, -score), axis=1)[:, :k]
    return score[rows, top], docs[rows, top]


@dataclass
class TextIndex:
    """``rows``: scope columns, doc_id, dl, terms, tfs; ``postings``: the same by term; ``stats``: scope, n, avgdl;
    ``df``: scope, term, df.

    ``scope`` are the columns within which statistics are taken: none for the whole corpus, the
    shard for shard-local search.
    """

    rows: DataFrame
    stats: DataFrame
    scope: list[str]
    df: DataFrame | None = None
    inverted: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.rows.select(*self.scope, "doc_id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).toDF(*self.scope, "doc_id", "dl", "term", "tf")

    @classmethod
    def build(cls, docs: DataFrame, id: str = "doc_id", scope: list[str] | None = None, text: str | None = None, persist: bool = True) -> "TextIndex":
        """Tokenise once.  Documents without a term have no posting but count in n and avgdl; a null text is empty.

        A row holds a whole document, so a term of every document costs no skew and a document's score
        is complete in one task.  The tables are written to the shared folder unless ``persist`` is off.
        ``id`` must tell documents (of a scope) apart.
        """
        scope = list(scope or [])
        # A row is a document, so its terms are counted, and later scored, where it is read.
        whole = spread(docs).select(*scope, F.col(id).alias("doc_id"), F.expr(text or indexed_text()).alias("body"))
        kept = whole.select(*scope, "doc_id", tokens("body").alias("terms"))
        schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in (*scope, "doc_id")) + ", dl int, terms array<string>, tfs array<int>"
        rows = kept.mapInArrow(counter([*scope, "doc_id"]), schema)
        if persist:
            rows = materialise(rows, "index")
        stats = rows.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        if not persist:
            return cls(rows, stats, scope)
        index = cls(rows, materialise(stats, "stats"), scope)
        index.df = materialise(index.document_frequency(), "df")
        return index

    def document_frequency(self) -> DataFrame:
        return self.df if self.df is not None else self.postings.groupBy(*self.scope, "term").agg(F.count("*").alias("df"))

    def _with_stats(self, df: DataFrame) -> DataFrame:
        """``n`` and ``avgdl`` beside each row: constants for the whole corpus, one row a shard otherwise."""
        if self.scope:
            return df.join(F.broadcast(self.stats), self.scope)
        s = self.stats.first()
        return df.withColumns({"n": F.lit(s["n"]), "avgdl": F.lit(float(s["avgdl"] or 0.0))})

    def idf(self) -> DataFrame:
        joined = self._with_stats(self.document_frequency())
        n, d = F.col("n"), F.col("df")
        return joined.select(*self.scope, "term", "df", F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5)).alias("idf"))

    def _weights(self, queries: DataFrame, qid: str, query: str) -> DataFrame:
        """Scope, qid, term, weight (times, idf and the constant factor) and avgdl of every query term the index knows."""
        asked = queries.select(F.col(qid).alias("qid"), F.explode(tokens(query)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        known = self._with_stats(self.document_frequency())
        n, d = F.col("n"), F.col("df")
        weight = F.col("times") * F.log(F.lit(1.0) + (n - d + 0.5) / (d + 0.5)) * (BM25_K1 + 1)
        return known.join(asked, "term").select(*self.scope, "qid", "term", "df", weight.alias("weight"), F.greatest("avgdl", F.lit(1e-9)).alias("avgdl"))

    def scores(self, queries: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
        """BM25 of every (query, document) with a common term; a repeated query term counts again."""
        weighed, tf = materialise(self._weights(queries, qid, query), "weighed"), F.col("tf")
        hits = self.postings.join(small_side(weighed, weighed.count(), 96), [*self.scope, "term"])
        part = F.col("weight") * tf / (tf + BM25_K1 * (1 - BM25_B) + BM25_K1 * BM25_B * F.col("dl") / F.col("avgdl"))
        return hits.groupBy(*self.scope, "qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

    def by_term(self) -> DataFrame:
        """The postings in ``BUCKETS`` folders by hash of the term, sorted by it: a query reads the folders and row groups of its terms. Written once, when first asked for."""
        if self.inverted is None:
            bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
            p = self.postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term")
            self.inverted = materialise(p, "postings", ("bucket",))
        return self.inverted

    def search(self, queries: DataFrame, k: int, qid: str = "qid", query: str = "query") -> DataFrame:
        """The k best documents of each query (and scope); ties by document id.

        The document frequencies tell how many postings the queries' terms have.  Where these are few
        against the postings of the whole index, they are read by term (``by_term``) and summed; else the
        documents are scanned once per ``SCAN_QUERIES`` queries, a task multiplies the queries' weights
        with its documents' saturated term counts and keeps its k best of each, so tasks x queries x k
        rows are shuffled and not a row for each query and matching document.  Both are exact.
        """
        weighed = materialise(self._weights(queries, qid, query), "weighed")
        r = rank([*self.scope, "qid"], [F.desc("score"), F.asc("doc_id")])
        out = self._selective(weighed) if self._is_selective(weighed) else self._scanned(queries.select(F.col(qid).alias("qid")), weighed, k)
        return out.withColumn("rank", r).where(F.col("rank") <= k)

    def _is_selective(self, weighed: DataFrame, share: float = 0.02, least: int = 50_000_000) -> bool:
        """Whether the queries' terms have under ``share`` of all postings, in an index of at least ``least``; smaller ones are scanned as fast."""
        total = self.document_frequency().agg(F.sum("df")).first()[0] or 0
        if total < least:
            return False
        return (weighed.agg(F.sum("df")).first()[0] or 0) < share * total

    def _selective(self, weighed: DataFrame) -> DataFrame:
        n = weighed.count()
        parts = [r[0] for r in weighed.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most BUCKETS
        tf = F.col("tf")
        hits = self.by_term().where(F.col("bucket").isin(parts)).join(small_side(weighed.drop("df"), n, 96), [*self.scope, "term"])
        part = F.col("weight") * tf / (tf + BM25_K1 * (1 - BM25_B) + BM25_K1 * BM25_B * F.col("dl") / F.col("avgdl"))
        return hits.groupBy(*self.scope, "qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

    def _scanned(self, queries: DataFrame, weighed: DataFrame, k: int) -> DataFrame:
        spark, scope = self.rows.sparkSession, self.scope
        scans = -(-queries.count() // SCAN_QUERIES)
        kinds = {c: (queries.schema[c] if c == "qid" else self.rows.schema[c]).dataType for c in (*scope, "qid", "doc_id")}
        schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items()) + ", score double"
        out = spark.createDataFrame([], schema)
        for scan in range(scans):
            part = weighed.where(F.pmod(F.xxhash64("qid"), F.lit(scans)) == scan) if scans > 1 else weighed
            sent = spark.sparkContext.broadcast(_Weights(part.select(*scope, "qid", "term", "weight", "avgdl").toArrow(), scope))
            out = out.unionByName(self.rows.mapInArrow(_scorer(sent, scope, k), schema))
        return out


def counter(keys: list[str]):
    """Term counts of whole documents by batch: one sort of (document, term code) pairs, no row per token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("terms")
            sizes = np.diff(col.offsets.to_numpy())
            coded = col.flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(b.num_rows), sizes) * many + coded.indices.to_numpy(), return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(pairs // many, minlength=b.num_rows)))).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(pairs % many)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(sizes.astype(np.int32)), terms, pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))], [*keys, "dl", "terms", "tfs"])

    return run


class _Weights:
    """Weights of a scan's queries by scope: avgdl, the terms, and blocks of queries with their place, term and weight of each entry."""

    def __init__(self, t: pa.Table, scope: list[str]):
        keys = list(zip(*(t.column(c).to_pylist() for c in scope))) if scope else [()] * t.num_rows
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(key, []).append(i)
        self.by = {}
        for key, at in groups.items():
            g = t.take(pa.array(at))
            ids, terms = (g.column(c).combine_chunks().dictionary_encode() for c in ("qid", "term"))
            ids, terms = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, terms))
            q, term, weight = ids.indices.to_numpy(), terms.indices.to_numpy(), g.column("weight").to_numpy()
            names, blocks = ids.dictionary.to_pylist(), []
            for lo in range(0, len(names), QUERY_BLOCK):
                on = (q >= lo) & (q < lo + QUERY_BLOCK)
                own, local = np.unique(term[on], return_inverse=True)
                blocks.append((names[lo : lo + QUERY_BLOCK], own, q[on] - lo, local, weight[on]))
            self.by[key] = g.column("avgdl")[0].as_py(), terms.dictionary, blocks


def _scorer(sent, scope: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, best, dense = sent.value.by, {}, {}
        kinds = None
        for b in batches:
            kinds = {c: b.column(c).type for c in (*scope, "doc_id")}
            if scope:
                keys = list(zip(*(b.column(c).to_pylist() for c in scope)))
                parts = [(s, b.take(pa.array([i for i, x in enumerate(keys) if x == s]))) for s in dict.fromkeys(keys)]
            else:
                parts = [((), b)]
            for key, p in parts:
                if key not in by:
                    continue
                avgdl, terms, blocks = by[key]
                step = max(1, CELLS // QUERY_BLOCK)
                for lo in range(0, p.num_rows, step):
                    docs, at, x = _saturated(p.slice(lo, step), terms, avgdl)
                    for j, (ids, own, row, col, weight) in enumerate(blocks):
                        w = dense.get((key, j))
                        if w is None:
                            w = np.zeros((len(ids), len(own)))
                            w[row, col] = weight
                            if len(dense) < 32:
                                dense[key, j] = w
                        place = np.full(len(terms), -1)
                        place[own] = np.arange(len(own))
                        local = place[at[0]]
                        on = local >= 0
                        m = np.zeros((len(own), len(docs)))
                        m[local[on], at[1][on]] = x[on]
                        s = w @ m
                        score = np.where(s > 0, np.round(s, 6), -np.inf)
                        best[key, j] = best_of(score, np.broadcast_to(docs, s.shape), *best.get((key, j), (np.empty((len(ids), 0)), np.empty((len(ids), 0), object))), k)
        for (key, j), (score, docs) in best.items():
            at, place = np.nonzero(score > -np.inf)
            if not len(at):
                continue
            ids = by[key][2][j][0]
            cols = [pa.array([v] * len(at), kinds[c]) for c, v in zip(scope, key)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([ids[i] for i in at]), pa.array(docs[at, place].tolist(), kinds["doc_id"]), pa.array(score[at, place])], [*scope, "qid", "doc_id", "score"])

    return run


def _saturated(p: pa.RecordBatch, terms: pa.Array, avgdl: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The documents; term and document of each known posting, and its saturated count."""
    col, tf = p.column("terms"), p.column("tfs").flatten().to_numpy()
    doc = np.repeat(np.arange(p.num_rows), np.diff(col.offsets.to_numpy()))
    term = pc.fill_null(pc.index_in(col.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    known = term >= 0
    tf, doc, term = tf[known].astype(np.float64), doc[known], term[known]
    dl = p.column("dl").to_numpy(zero_copy_only=False)[doc]
    return p.column("doc_id").to_numpy(zero_copy_only=False), (term, doc), tf / (tf + BM25_K1 * (1 - BM25_B) + BM25_K1 * BM25_B * dl / avgdl)
