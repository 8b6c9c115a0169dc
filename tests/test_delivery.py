import random
from datetime import datetime, timedelta

from corpusloom.operators.delivery import DeliveryIndex, exactly_once, redundant_deliveries
from corpusloom.runtime import scratch

SCHEMA = "delivery_id long, batch_no long, event_id string, attempt int, created_at timestamp, key string, lost int"
T0 = datetime(2025, 1, 1)


def rows(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        e = r.choice([None, "hot", " HOT ", " hot　", f"id{r.randint(0, 80)}", f"ID{r.randint(0, 80)}"])
        out.append((i, r.choice([None, i // 50]), e, r.choice([None, 0, 0, 1]), r.choice([None, T0 + timedelta(seconds=r.randint(0, 3))]), "x", 1))
    return out


def brute(data):
    last = (1 << 62)
    best, drop = {}, set()
    for d, _, e, a, c, *_ in data:
        if e is None:
            continue
        k = e.strip().lower()
        rank = (last if a is None else a, datetime.max if c is None else c, d)
        if k in best:
            lose = max(best[k], rank)
            drop.add(lose[2])
            best[k] = min(best[k], rank)
        else:
            best[k] = rank
    return drop


def test_against_brute_force(spark):
    data = rows()
    got = [r[0] for r in redundant_deliveries(spark.createDataFrame(data, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_repeated_rounds_merge_runs_and_displace_winners(spark):
    index = DeliveryIndex(spark, scratch(spark, "t"), prefix_bits=2, fanout=2)
    mk = lambda *x: spark.createDataFrame([(*y, "x", 1) for y in x], SCHEMA)
    assert index.ingest(mk((1, 1, "a", 2, T0), (2, 1, "b", 0, T0))).collect() == []
    assert {r[0] for r in index.ingest(mk((3, 2, "A ", 1, T0), (4, 2, "c", 0, T0))).collect()} == {1}
    assert {r[0] for r in index.ingest(mk((5, 3, "a", 5, T0), (6, 3, "C", 0, T0), (7, 3, None, 0, T0))).collect()} == {5, 6}
    assert index.runs == [(1, 0, 1), (0, 2, 2)]
    again = DeliveryIndex(spark, index.path, prefix_bits=2, fanout=2)  # a restart finds the same runs
    assert again.runs == index.runs
    assert {r[0] for r in again.ingest(mk((8, 4, "b", 0, T0), (9, 4, "d", 0, T0))).collect()} == {8}
    assert again.ingest(mk((10, 5, "e", 0, T0))).collect() == [] and again.runs == [(2, 0, 3), (0, 4, 4)]


def test_empty_and_exactly_once(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert redundant_deliveries(empty).collect() == []
    data = rows(100, 2)
    kept = exactly_once(spark.createDataFrame(data, SCHEMA))
    assert kept.count() == 100 - len(brute(data)) and set(kept.columns) == {"delivery_id", "batch_no", "event_id", "attempt", "created_at", "key", "lost"}
