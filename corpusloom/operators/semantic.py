"""Vector search: latent semantic space fitted on a bounded sample, and given embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.constants import LSA_DIMENSIONS, LSA_FEATURES, NEURAL_SETTINGS
from corpusloom.operators.index import TextIndex, best_of, counter, rank, tokens
from corpusloom.runtime import materialise

#: Queries scored by one matrix, and blocks of them that one scan serves: all that is broadcast.
QUERY_BLOCK, SCAN_BLOCKS = 2048, 8
#: Documents that the basis is fitted on, by hash of the id: all of a smaller corpus. Terms, weights and vectors cover every document.
FIT_ROWS = 200_000
#: Tasks that add up Gram matrices.
GRAM_TASKS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


@dataclass
class LatentSpace:
    """``vocabulary``: term, col, idf (at most ``features`` rows); ``components``: k x features; ``vectors``: doc_id, vector."""

    vocabulary: pd.DataFrame
    components: np.ndarray
    vectors: DataFrame

    @classmethod
    def fit(cls, spark: SparkSession, index: TextIndex, dimensions: int = LSA_DIMENSIONS, features: int = LSA_FEATURES) -> "LatentSpace":
        """Vocabulary by document frequency over all documents (ties by term); the basis from the Gram matrix.

        The basis comes from at most about ``FIT_ROWS`` documents; up to ``GRAM_TASKS`` tasks add up the Gram
        matrix of theirs, the sums are added row by row and the eigenvectors taken by the driver.  Where
        they can't be taken, the space is that of the first terms.  Documents outside the vocabulary get
        no vector; an empty corpus gives an empty space.
        """
        stats = index.stats.first()
        top = index.document_frequency().orderBy(F.desc("df"), F.asc("term")).limit(features).toPandas()
        top["col"] = np.arange(len(top), dtype=np.int32)
        n = stats["n"] if stats else 0
        top["idf"] = np.log((1 + n) / (1 + top["df"].astype(float))) + 1
        vocabulary = top[["term", "col", "idf"]]
        rows = cls._weights(index.rows, vocabulary, "doc_id")
        m = len(vocabulary)

        def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros((m, m))
            for b in batches:
                x = _dense(b.column("cols"), b.column("vals"), m)
                g += x.T @ x
            for i in range(m):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([g[i]], pa.list_(pa.float64()))], ["i", "row"])

        if not m:
            return cls(vocabulary, np.zeros((0, 0)), spark.createDataFrame([], f"doc_id {index.rows.schema['doc_id'].dataType.simpleString()}, vector array<float>"))
        drawn = rows if n <= FIT_ROWS else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(FIT_ROWS / n * (1 << 30)))
        part = drawn.coalesce(GRAM_TASKS).mapInArrow(gram, "i int, row array<double>")
        total = _sum_rows(part)
        g = np.zeros((m, m))
        for r in total.collect():  # features x features numbers, whatever the corpus
            g[r["i"]] = np.frombuffer(r["row"])
        k = min(dimensions, max(1, min(n, m) - 1))
        try:
            values, basis = np.linalg.eigh(g)
            v = basis[:, np.argsort(values)[::-1][:k]]
        except np.linalg.LinAlgError:
            v = np.eye(m)[:, :k]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)  # fixed signs
        space = cls(vocabulary, np.ascontiguousarray(v.T), rows)
        space.vectors = materialise(space._project(spark, rows, "doc_id"), "lsa-vectors")
        return space

    @staticmethod
    def _weights(rows: DataFrame, vocabulary: pd.DataFrame, key: str) -> DataFrame:
        """Sparse tf-idf of rows (key, dl, terms, tfs): term frequency is relative to all terms of the text, known or not."""
        sent = rows.sparkSession.sparkContext.broadcast((list(vocabulary["term"]), vocabulary["idf"].to_numpy(float)))  # at most ``features`` terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, idf = sent.value
            known_terms = pa.array(terms, pa.string())
            for b in batches:
                at = pc.fill_null(pc.index_in(b.column("terms").flatten(), value_set=known_terms), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("terms").offsets.to_numpy()))
                tf, dl = b.column("tfs").flatten().to_numpy(), b.column("dl").to_numpy()
                known = at >= 0
                n = np.bincount(doc[known], minlength=b.num_rows)
                some = np.flatnonzero(n)
                ends = pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32))
                vals = tf[known] / dl[doc[known]] * idf[at[known]] if len(idf) else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(at[known].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(vals))], [key, "cols", "vals"])

        return rows.select(key, "dl", "terms", "tfs").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, cols array<int>, vals array<double>")

    def _project(self, spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
        basis, m = spark.sparkContext.broadcast(self.components), len(self.vocabulary)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = _dense(b.column("cols"), b.column("vals"), m) @ basis.value.T
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                y = (y / np.where(norm == 0, 1, norm)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(key), _lists(y)], [key, "vector"])

        return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<float>")

    def fold_in(self, queries: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
        """Vectors of queries; none for a query without known terms."""
        t = queries.select(F.col(qid).alias("qid"), tokens(query).alias("terms")).where("terms IS NOT NULL")
        rows = t.mapInArrow(counter(["qid"]), f"qid {t.schema['qid'].dataType.simpleString()}, dl int, terms array<string>, tfs array<int>")
        return self._project(queries.sparkSession, self._weights(rows, self.vocabulary, "qid"), "qid")

    def search(self, queries: DataFrame, k: int, qid: str = "qid", query: str = "query") -> DataFrame:
        """The k nearest documents of each query; those without positive cosine are left out after the cut."""
        return nearest(self.vectors, self.fold_in(queries, qid, query), k).where(F.col("score") > 0)


def _sum_rows(part: DataFrame) -> DataFrame:
    """Sum of the Gram rows of all tasks, row by row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), b.column("row")):
                v = row.values.to_numpy()
                sums[i] = sums[i] + v if i in sums else v.copy()
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["i", "row"])

    return part.repartition(16, "i").mapInArrow(add, "i int, row binary")


def _dense(cols: pa.ListArray, vals: pa.ListArray, m: int) -> np.ndarray:
    n = np.diff(cols.offsets.to_numpy())
    x = np.zeros((len(n), m))
    x[np.repeat(np.arange(len(n)), n), cols.flatten().to_numpy()] = vals.flatten().to_numpy()
    return x


def _lists(y: np.ndarray) -> pa.Array:
    offsets = np.arange(0, y.size + 1, y.shape[1] or 1, dtype=np.int32)[: len(y) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, doc_id, score, rank``: the k greatest dot products of each query (ties by doc_id).

    Queries are broadcast in ``SCAN_BLOCKS`` blocks of ``QUERY_BLOCK`` rows a scan (a fixed size); every task keeps
    its k best per query before the ranks are taken, so what is shuffled is tasks x queries x k at most.
    """
    spark, kind = vectors.sparkSession, queries.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    small = queries.count() <= QUERY_BLOCK * SCAN_BLOCKS
    asked = queries.select("qid", "vector")
    for blocks in [list(_slices(asked.toArrow().to_pylist()))] if small else _scans(asked):
        if not blocks:
            continue
        sent = spark.sparkContext.broadcast(blocks)

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [(np.empty((len(ids), 0)), np.empty((len(ids), 0), object)) for ids, _ in sent.value]
            kind = None
            for b in batches:
                col, kind = b.column("vector"), b.column("doc_id").type
                x = col.flatten().to_numpy().reshape(len(col), -1).astype(np.float64)
                doc = b.column("doc_id").to_numpy(zero_copy_only=False)
                for i, (ids, m) in enumerate(sent.value):
                    held[i] = best_of(np.round(m @ x.T, 6), np.broadcast_to(doc, (len(ids), len(doc))), *held[i], k)
            for (ids, _), (score, docs) in zip(sent.value, held):
                n = score.shape[1]
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(n)]), pa.array(docs.ravel().tolist(), kind), pa.array(score.ravel())], ["qid", "doc_id", "score"])

        out = out.unionByName(vectors.select("doc_id", "vector").mapInArrow(best, schema))
    return out.withColumn("rank", rank(["qid"], [F.desc("score"), F.asc("doc_id")])).where(F.col("rank") <= k)


def _slices(rows: list[dict]) -> Iterator[tuple[list, np.ndarray]]:
    for lo in range(0, len(rows), QUERY_BLOCK):
        part = rows[lo : lo + QUERY_BLOCK]
        yield [r["qid"] for r in part], np.array([r["vector"] for r in part], np.float64)


def _scans(queries: DataFrame) -> Iterator[list[tuple[list, np.ndarray]]]:
    """Blocks of queries, as many as a scan serves."""
    held = []
    for row in queries.toLocalIterator():
        held.append({"qid": row["qid"], "vector": row["vector"]})
        if len(held) == QUERY_BLOCK * SCAN_BLOCKS:
            yield list(_slices(held))
            held = []
    if held:
        yield list(_slices(held))


def wants_neural(setting: str, key: str | None) -> bool:
    """Whether embeddings of a service are wanted: the setting allows it and there is a key."""
    return setting in NEURAL_SETTINGS and bool(key)


class SemanticSearch:
    """Vectors of an embedding provider with the latent space as its fallback.

    The latent space is always fitted.  Where a provider is wanted, all documents are embedded and written
    once; any error leaves the latent space in charge, and so does an error while queries are embedded.
    """

    def __init__(self, space: LatentSpace, vectors: DataFrame | None, provider):
        self.space, self.vectors, self.provider = space, vectors, provider

    @classmethod
    def fit(cls, spark: SparkSession, index: TextIndex, docs: DataFrame, provider=None, setting: str = "auto", key: str | None = None, id: str = "doc_id", text: str = "text") -> "SemanticSearch":
        from corpusloom.sources.web import embedded

        space, vectors = LatentSpace.fit(spark, index), None
        if provider is not None and wants_neural(setting, key):
            try:
                vectors = materialise(embedded(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", provider), "neural-vectors")
            except Exception:  # noqa: BLE001 - an outage of the provider must not stop search
                vectors = None
        return cls(space, vectors, provider)

    def search(self, queries: DataFrame, k: int, qid: str = "qid", query: str = "query") -> DataFrame:
        if self.vectors is not None:
            from corpusloom.sources.web import embedded

            try:
                asked = materialise(embedded(queries.select(F.col(qid).alias("qid"), F.col(query).alias("query")), "qid", "query", self.provider), "neural-queries")
                return nearest(self.vectors, asked, k)
            except Exception:  # noqa: BLE001
                pass
        return self.space.search(queries, k, qid, query)
