import numpy as np
import pytest

from corpusloom.llm.mixture import mix, permuted, short_sources

T = "source string, target_share double, max_repeats int"
D = "doc_id long, text string, source string, uses int, name string"


def docs(spark, n=900):
    src = ["big", " Big", "BIG　", "small", None, "other"]
    return spark.createDataFrame([(i, None if i % 50 == 0 else "token " * (5 + i % 40), src[i % 6], 3, "x") for i in range(n)], D)


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        got = permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got) == list(range(n))
    assert permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != list(range(1000))


def test_shares_and_caps(spark):
    t = spark.createDataFrame([("big", 0.6, 3), ("Small ", 0.3, 3), ("none", 0.05, 9), ("other", 0.05, 1)], T)
    m = mix(docs(spark), t, block_tokens=100, shard_blocks=16)
    uses, shares = m.uses.collect(), {r.source: r for r in m.shares.collect()}
    total = sum(5 + i % 40 for i in range(900) if i % 50) 
    by = {}
    for r in uses:
        by[r.source] = by.get(r.source, 0) + r.used_tokens
        assert r.uses <= (1 if r.source == "other" else 3)
    assert by["big"] / total == pytest.approx(0.6, abs=0.03) and by["small"] / total == pytest.approx(0.3, abs=0.03) and by["other"] / total == pytest.approx(0.05, abs=0.03)
    assert {s for s, r in shares.items() if r.unreachable} == {"none"} and len(shares) == 4
    assert shares["big"].actual_share == pytest.approx(by["big"] / shares["big"].used_tokens * shares["big"].actual_share)
    assert [tuple(r) for r in m.uses.orderBy("doc_id").collect()] == sorted(map(tuple, uses))  # the same again


def test_unreachable_source_is_used_to_its_cap(spark):
    t = spark.createDataFrame([("small", 0.9, 2), ("big", None, None)], T)
    m = mix(docs(spark, 300), t, block_tokens=50)
    r = {x.source: x for x in m.shares.collect()}
    assert r["small"].unreachable and r["small"].used_tokens == 2 * r["small"].source_tokens and not r["big"].unreachable and r["big"].used_tokens == 0


def test_blocks_have_a_fixed_length(spark):
    t = spark.createDataFrame([("long", 1.0, 2)], T)
    rows = [(i, "token " * n, "long", 0, "x") for i, n in enumerate((1000, 3, 0, 250, 1))]
    m = mix(spark.createDataFrame(rows, D), t, block_tokens=64)
    uses = {r.doc_id: r for r in m.uses.collect()}
    n = sum(r.n_tokens for r in uses.values())
    assert abs(sum(r.used_tokens for r in uses.values()) - n) <= 64 and all(r.used_tokens <= r.n_tokens * r.uses for r in uses.values()) and uses[2].uses == 0


def test_short_sources_come_from_the_mix(spark):
    t = spark.createDataFrame([("small", 0.9, 2), ("SMALL", 0.01, 1), ("big", 0.1, 3), ("none", 0.1, 4)], T)
    found = short_sources(mix(docs(spark, 300), t, block_tokens=50))
    assert {r.source for r in found.collect()} == {"small", "none"}
    assert "block_at" in found._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], T)
    m = mix(docs(spark, 0), t)
    assert m.uses.collect() == [] and [x.unreachable for x in m.shares.collect()] == [False]
    assert mix(docs(spark, 10), spark.createDataFrame([], T)).shares.collect() == []
