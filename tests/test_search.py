import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.functions import constants as C
from corpusloom.operators.fusion import hybrid, merge_shards, rrf
from corpusloom.operators.index import TextIndex
from corpusloom.operators import semantic
from corpusloom.operators.semantic import LatentSpace, SemanticSearch, nearest

DOCS = [(1, "Queues", "a broker keeps ordered messages in a partition log", "https://q.example/1", "s"), (2, "Caches", "a cache keeps hot keys in memory with a ttl", None, "s"),
        (3, "Traces", "a trace follows a request across services", "", "s"), (4, "Caches", "cache invalidation of keys and cache misses", None, None), (5, None, None, None, None), (6, "", "", None, "s")]
SCHEMA = "doc_id long, title string, text string, url string, source string"


def toks(t):
    return [x.lower() for x in re.findall(C.TERM, t) if x.lower() not in C.STOPWORDS]


def bm25(docs, query):
    bags = {d[0]: toks(f"{d[1] or ''}\n{d[2] or ''}") for d in docs}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    out = Counter()
    for term in toks(query):
        df = sum(term in b for b in bags.values())
        for i, b in bags.items():
            if tf := b.count(term):
                out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(b) / max(avg, 1e-9)))
    return {k: round(v, 6) for k, v in out.items()}


@pytest.fixture(scope="module")
def index(spark):
    return TextIndex.build(spark.createDataFrame(DOCS, SCHEMA))


def queries(spark):
    return spark.createDataFrame([("q1", "cache keys"), ("q2", "cache cache ttl"), ("q3", "the of"), ("q4", None), ("q5", "broker")], "qid string, query string")


def test_bm25_counts_repeated_terms(spark, index):
    got = {(r.qid, r.doc_id): r.score for r in index.search(queries(spark), 10).collect()}
    want = {(q, d): s for q, t in (("q1", "cache keys"), ("q2", "cache cache ttl"), ("q5", "broker")) for d, s in bm25(DOCS, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_shard_statistics_are_local(spark):
    docs = spark.createDataFrame([("a", *d) if d[0] % 2 else ("b", *d) for d in DOCS], "shard_id string, " + SCHEMA)
    got = {(r.shard_id, r.doc_id): r.score for r in TextIndex.build(docs, scope=["shard_id"]).search(queries(spark).where("qid = 'q1'"), 5).collect()}
    even = bm25([d for d in DOCS if d[0] % 2 == 0], "cache keys")
    assert {k[1]: v for k, v in got.items() if k[0] == "b"} == pytest.approx(even)


def test_latent_space_matches_svd(spark, index):
    space = LatentSpace.fit(spark, index)
    terms = list(space.vocabulary["term"])
    bags = {d[0]: toks(f"{d[1] or ''}\n{d[2] or ''}") for d in DOCS}
    a = np.array([[b.count(t) / max(1, len(b)) * i for t, i in zip(terms, space.vocabulary["idf"])] for b in bags.values()])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k = len(space.components)
    y = u[:, :k] * s[:k]
    y = y / np.where(np.linalg.norm(y, axis=1, keepdims=True) < 1e-12, 1, np.linalg.norm(y, axis=1, keepdims=True))
    got = {r.doc_id: np.array(r.vector) for r in space.vectors.collect()}
    ids = list(bags)
    for i in got:
        for j in got:
            assert got[i] @ got[j] == pytest.approx(y[ids.index(i)] @ y[ids.index(j)], abs=1e-4)
    assert [r.doc_id for r in space.search(queries(spark).where("qid = 'q1'"), 2).collect()]


def test_empty_corpus(spark):
    e = spark.createDataFrame([], SCHEMA)
    ix = TextIndex.build(e)
    assert ix.search(queries(spark), 3).collect() == []
    assert LatentSpace.fit(spark, ix).search(queries(spark), 3).collect() == []


def test_rrf_is_blind_to_the_order_of_lists(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, doc_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "qid string, doc_id long, rank int")
    x, y = (sorted(map(tuple, rrf(p, ["qid"]).collect())) for p in ([a, b], [b, a]))
    assert x == y and dict((r[1], r[2]) for r in x)[2] == pytest.approx(1 / 61 + 1 / 62)


def test_hybrid_modes_and_missing_components(spark):
    lex = spark.createDataFrame([("q", 1, 3.0, 1), ("q", 2, 2.0, 2)], "qid string, doc_id long, score double, rank int")
    sem = spark.createDataFrame([("q", 2, 0.9, 1), ("q", 3, 0.5, 2)], "qid string, doc_id long, score double, rank int")
    h = {r.doc_id: r for r in hybrid(lex, sem, 10).collect()}
    assert h[2].rank == 1 and h[3].bm25_score == 0 and h[1].semantic_score == 0
    assert [r.doc_id for r in hybrid(lex, sem, 1, "lexical").collect()] == [1]
    assert [r.score for r in hybrid(lex, sem, 1, "semantic").collect()] == [0.9]


def test_merge_breaks_ties_by_title_then_id_downwards(spark):
    rows = [("s0", "q", "redis cache", "a", "Other", None, 1, 1.0, 0.0), ("s1", "q", "redis cache", "b", "Redis cache", None, 1, 1.0, 0.0), ("s2", "q", "redis cache", "c", "Other", None, 1, 1.0, 0.0), ("s2", "q", "redis cache", "a", "Newer", None, 2, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "shard_id string, qid string, query string, doc_id string, title string, url string, rank int, bm25_score double, semantic_score double")
    got = {r.rank: r for r in merge_shards(df, 10).collect()}
    assert [got[i].doc_id for i in (1, 2, 3)] == ["a", "b", "c"] and got[1].title == "Newer"


def test_nearest_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2)], "doc_id long, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vector array<float>")
    assert [(r.doc_id, r.rank) for r in nearest(v, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_nearest_over_many_batches(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 4)), 1)
    df = spark.createDataFrame([(f"d{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)], "doc_id string, vector array<double>").repartition(3)
    q = spark.createDataFrame([(j, [float(v) for v in x[j]]) for j in range(5)], "qid long, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {(r.qid, r.rank): (r.doc_id, r.score) for r in nearest(df, q, 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for j in range(5):
        s = np.round(x @ x[j], 6)
        want = sorted(range(500), key=lambda i: (-s[i], i))[:7]
        assert [got[j, n + 1][0] for n in range(7)] == [f"d{i:03d}" for i in want]


def test_selective_queries_read_postings_by_term(spark, index, monkeypatch):
    want = sorted(map(tuple, index.search(queries(spark), 10).select("qid", "doc_id", "score", "rank").collect()))
    monkeypatch.setattr(TextIndex, "_is_selective", lambda self, weighed: True)
    assert sorted(map(tuple, index.search(queries(spark), 10).select("qid", "doc_id", "score", "rank").collect())) == want


def test_many_blocks_in_a_scan(spark, index, monkeypatch):
    from corpusloom.operators import index as module

    want = sorted(map(tuple, index.search(queries(spark), 2).collect()))
    for block, scan in ((1, 8192), (2, 2)):
        monkeypatch.setattr(module, "QUERY_BLOCK", block)
        monkeypatch.setattr(module, "SCAN_QUERIES", scan)
        assert sorted(map(tuple, index.search(queries(spark), 2).collect())) == want


def test_factorisation_failure_leaves_the_first_terms(spark, index, monkeypatch):
    def fail(_):
        raise np.linalg.LinAlgError("no")

    monkeypatch.setattr(semantic.np.linalg, "eigh", fail)
    space = LatentSpace.fit(spark, index)
    assert (space.components == np.eye(len(space.vocabulary))[: len(space.components)]).all()


def test_provider_and_its_outages(spark, index):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    q = queries(spark).where("qid = 'q1'")

    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    def broken(texts):
        raise OSError("down")

    def no_queries(texts):
        if "cache keys" in texts:
            raise OSError("down")
        return lengths(texts)

    assert not semantic.wants_neural("lsa", "k") and not semantic.wants_neural("auto", None) and semantic.wants_neural("auto", "k")
    local = sorted(map(tuple, LatentSpace.fit(spark, index).search(q, 3).collect()))
    assert SemanticSearch.fit(spark, index, docs, lengths, "auto", "k").search(q, 3).count() == 3
    for provider, key in ((broken, "k"), (no_queries, "k"), (lengths, None)):
        assert sorted(map(tuple, SemanticSearch.fit(spark, index, docs, provider, "auto", key).search(q, 3).collect())) == local


def test_kept_tables_are_made_again_when_gone(spark):
    from corpusloom.runtime import kept, materialise, remove

    made = []

    def make():
        made.append(1)
        return materialise(spark.range(4), "kept")

    get = lambda: kept(spark, ("test",), make, lambda t: [t])
    assert get().count() == get().count() == 4 and len(made) == 1
    remove(spark, get()._corpusloom_path)
    assert get().count() == 4 and len(made) == 2
