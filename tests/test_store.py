import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import events, store
from corpusloom.runtime import Owner, materialise, numbered, scratch
from corpusloom.session import SearchSession

T0 = datetime(2025, 1, 1)
IN = "input_id long, title string, text string, url string, source string, received_at timestamp, copies int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, *r, T0, 7) for i, r in enumerate(rows)], IN)


def test_first_wins_and_nulls(spark):
    r = store.store_rows(docs(spark, ("A ", "Some  text", "u", None), ("B", "some TEXT", "u", "x"), (None, None, None, None), (None, "", "", None)), ["s"])
    got = {x.content_hash: x for x in store.first_wins(r).collect()}
    assert len(got) == 2 and {x.copies for x in got.values()} == {2}
    a = next(x for x in got.values() if x.title == "A")
    assert a.body == "Some text" and a.source == "manual" and a.document_id == a.content_hash[:16]


def test_upsert_is_idempotent_and_last_wins(spark):
    empty = spark.createDataFrame([], store.STORE)
    rows = store.store_rows(docs(spark, ("A", "one text", "u", "s"), ("B", "One Text", "u", "s")), ["s"])
    once = store.upsert(empty, rows)
    assert [r.title for r in once.collect()] == ["B"]
    assert store.upsert(once, rows).collect() == once.collect()
    assert store.new_rows(rows, once).collect() == []


def test_replace_urls(spark):
    base = store.upsert(spark.createDataFrame([], store.STORE), store.store_rows(docs(spark, ("A", "one", "u", "s"), ("B", "two", "u", "s"), ("C", "three", "v", "s")), ["s"]))
    same = store.store_rows(docs(spark, ("A", "one", "u", "s"), ("B", "two", "u", "s")), ["s"])
    r = store.replace_urls(base, same).first()
    assert r.unchanged and (r.added, r.skipped, r.removed) == (0, 2, 0)
    new = store.store_rows(docs(spark, ("A", "one", "u", "s"), ("D", "three", "u", "s"), ("E", None, None, None)), ["s"])
    r = store.replace_urls(base, new).collect()
    assert len(r) == 1 and (r[0].added, r[0].skipped, r[0].removed, r[0].unchanged) == (1, 1, 2, False)
    left = store.replace_slices(base, new.where("url = 'u'"))
    assert sorted(x.title for x in left.collect()) == ["A", "D"]


def test_micro_batches(spark):
    rows = store.store_rows(docs(spark, *[(str(i), f"text {i}", "u", "s") for i in range(8)]), ["s"])
    got = sorted((r.input_id, r.batch) for r in store.micro_batches(rows, 3).collect())
    assert got == [(i, i // 3) for i in range(8)]


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) as g")
    for r in numbered(df, ["g"], ["id"]).collect():
        assert r.n == r.id // 3
    assert numbered(spark.range(0).selectExpr("id", "'a' as g"), ["g"], ["id"]).collect() == []


def test_versions_and_rollback(spark):
    s = store.VersionedStore(spark, scratch(spark, "store"))
    s.create()
    s.upsert(store.store_rows(docs(spark, ("A", "one", "u", "s")), ["x"]))
    assert [r.title for r in s.restore("x").collect()] == ["A"] and s.restore("y").collect() == []
    s.replace(store.store_rows(docs(spark, ("B", "two", "u", "s")), ["x"]))
    assert [r.title for r in s.read().collect()] == ["B"]
    s.rollback()
    assert [r.title for r in s.read().collect()] == ["A"]


def test_events_split_and_retry(spark):
    raw = spark.createDataFrame([('{"event_id":"e","document":{"text":"t"},"attempt":0}',), ("broken",), ('{"event_id":"e","attempt":1}',), (None,)], "value string")
    ok, dead = events.split(events.parsed(raw))
    assert ok.count() == 1 and dead.count() == 3
    e = spark.createDataFrame([(1, 0), (2, 0), (3, 4)], "delivery_id long, attempt int")
    got = {r.delivery_id: (r.attempt, r.outcome) for r in events.retried(e, "e.delivery_id <> 2 AND e.attempt < 3 OR e.delivery_id = 3", 3).collect()}
    assert got == {1: (3, "indexed"), 2: (0, "indexed"), 3: (5, "dead_letter")}


def test_session(spark):
    s = SearchSession(spark, scratch(spark, "session"), ["a", "b"])
    d = [("Kafka log", "A partition is an ordered log of messages kept by a broker.", "https://k.example/1", "manual"), ("Redis ttl", "A redis ttl is the time to live of a key in the cache.", "https://redis.io/ttl", "manual")]
    df = spark.createDataFrame(d, "title string, text string, url string, source string")
    assert s.add(df) == {"added": 2, "skipped": 0} and s.add(df) == {"added": 0, "skipped": 2}
    q = spark.createDataFrame([("1", "redis ttl"), ("2", "x")], "qid string, query string")
    for mode in ("lexical", "hybrid"):
        assert s.search(q, mode, 1).first().title == "Redis ttl"
    with pytest.raises(ValueError):
        s.search(q, "other")
    assert {r.qid for r in s.ask(q).collect()} == {"1", "2"}
    assert s.refresh(df)["unchanged"] == 2
    assert s.refresh(spark.createDataFrame([("Redis ttl", "A new text about the time to live of a redis key.", "https://redis.io/ttl", "manual")], df.schema)) == {"added": 1, "skipped": 0, "removed": 1, "refreshed": 1, "unchanged": 0}
    assert s.stats().agg({"documents": "sum"}).first()[0] == 2


def test_hashes_agree_whatever_their_case(spark):
    rows = store.store_rows(docs(spark, ("A", "one text", "u", "s")), ["s"])
    upper = rows.withColumn("content_hash", F.upper("content_hash")).select(*store.ROW)
    assert store.new_rows(rows, upper).collect() == []
    assert [r.title for r in store.upsert(upper, rows.withColumn("title", F.lit("B"))).collect()] == ["B"]


def test_a_crash_while_committing_keeps_the_last_version(spark, monkeypatch):
    path = scratch(spark, "store")
    s = store.VersionedStore(spark, path)
    s.create()
    s.upsert(store.store_rows(docs(spark, ("A", "one", "u", "s")), ["x"]))

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(store.VersionedStore, "_point", crash)  # the run is written, its version isn't
    with pytest.raises(OSError):
        s.upsert(store.store_rows(docs(spark, ("B", "two", "u", "s")), ["x"]))
    monkeypatch.undo()
    again = store.VersionedStore(spark, path)
    again.create()
    assert [r.title for r in again.read().collect()] == ["A"] and len(again.versions()) == 2


def test_two_writers_do_not_lose_each_other(spark):
    s = store.VersionedStore(spark, scratch(spark, "store"))
    s.create()
    with pytest.raises(store.ConcurrentWrite):
        s._point(["late"], after=0)
    assert s.read().collect() == []


def test_failed_batches_count_as_skipped(spark):
    rows = store.store_rows(docs(spark, *[(str(i), f"text {i % 6}", "u", "s") for i in range(8)]), ["s"])
    out = store.ingest_outcome(store.micro_batches(rows, 3), "CASE batch WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END").first()
    assert (out.batches, out.failed, out.attempts, out.added, out.skipped) == (3, 1, 3 + 3 + 1, 5, 3)


def test_stream_reads_its_retries_when_due(spark):
    from corpusloom.streaming.index_stream import IndexStream, file_source

    base = scratch(spark, "stream")
    lines = [json.dumps({"event_id": f"e{i}", "document": {"title": "t", "text": f"text {i}", "url": f"u{i}"}, "attempt": 0}) for i in range(4)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{base}/log")
    worker = lambda refuses: IndexStream(spark, f"{base}/store", f"{base}/dead", f"{base}/retry", ["s"], refuses)
    run = lambda w: w.start(file_source(spark, f"{base}/log"), f"{base}/checkpoint").awaitTermination()
    w = worker("event_id = 'e1' OR event_id = 'e2' AND attempt < 1")
    run(w)
    assert w.store.read().count() == 2
    for _ in range(12):
        run(w)
        if w.store.read().count() == 3:
            break
        time.sleep(0.5)
    assert sorted(r.url for r in w.store.read().collect()) == ["u0", "u2", "u3"]
    w = worker(None)
    for _ in range(12):
        run(w)
        if w.store.read().count() == 4:
            break
        time.sleep(1)
    assert w.store.read().count() == 4


def test_trace_headers_are_read(spark):
    e = spark.createDataFrame([(1, "e", 0)], "delivery_id long, event_id string, attempt int").selectExpr("*", "named_struct('title', 't', 'text', 'x', 'url', 'u', 'source', 's') AS document", "current_timestamp() AS created_at", "cast(null as string) AS last_error")
    ok, _ = events.split(events.parsed(events.messages(e, {"traceparent": "00-abc-01"})))
    assert ok.first().traceparent == "00-abc-01"


def test_owned_tables_are_freed(spark):
    with Owner() as o:
        df = materialise(spark.range(3), "owned")
    assert df.count() == 3 and len(o.paths) == 1
    path = o.paths[0][1]
    o.free()
    assert not os.path.exists(path.removeprefix("file://"))
