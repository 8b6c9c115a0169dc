import json

from corpusloom.functions.register import register
from corpusloom.operators import guards, pages, planner
from corpusloom.functions.dialect import SPARK
from corpusloom.runtime import scratch
from corpusloom.sources import registry
from corpusloom.sources.web import answered, embedded
from corpusloom.streaming.index_stream import IndexStream, file_source

LONG = " ".join(f"This is sentence number {i} of a rather long text." for i in range(120))


def test_chunks():
    assert pages.chunks(None) == [] and pages.chunks("short") == [] and pages.chunks("x" * 200) == ["x" * 200]
    got = pages.chunks(LONG, 500, 80)
    assert len(got) > 5 and all(120 <= len(c) <= 620 for c in got)
    for a, b in zip(got, got[1:]):
        assert a.endswith(b.split(".")[0][:20]) or b[:20] in a
    assert len(pages.chunks(LONG * 20, 200, 20)) == 24 and len(pages.chunks(LONG * 2, 200, 20, cap=None)) > 24


HTML = f"""<html><head><title>Guide</title><script>x</script></head><body><nav><a href="/other?utm_source=x">n</a><p>{'menu ' * 50}</p></nav>
<main><h1>Start</h1><p>{'alpha ' * 40}</p><aside><p>{'side ' * 60}</p></aside><h2>Feedback</h2><p>{'beta ' * 40}</p><h2>More</h2><ul><li>{'gamma ' * 40}</li></ul></main><footer><p>{'foot ' * 60}</p></footer></body></html>"""


def test_extraction():
    got = pages.page_documents(HTML, "https://a.example/g", "fallback")
    assert [d["title"] for d in got] == ["Guide — Start", "Guide — More"] and got[0]["source"] == "trusted-docs:a.example"
    assert not any(w in d["text"] for d in got for w in ("menu", "side", "foot", "beta"))
    assert pages.page_documents("", "https://a.example/g", "t") == []


def test_links_robots_crawl(spark):
    rows = [("https://a.example/g", HTML, 200, "text/html"), ("https://a.example/other", '<a href="https://b.example/x">b</a><a href="/g">g</a>', 200, "text/html"), ("https://a.example/none", None, 404, None)]
    p = spark.createDataFrame(rows, "url string, html string, status int, content_type string")
    assert [(r.url, r.link) for r in pages.links(p).where("url like '%/g'").collect()] == [("https://a.example/g", "https://a.example/other")]
    seen, counts = pages.crawl(spark, p, ["https://a.example/g#x", "https://a.example/none"], 10, 2)
    assert {(r.url, r.depth) for r in seen.collect()} == {("https://a.example/g", 0), ("https://a.example/none", 0), ("https://a.example/other", 1)}
    assert counts["html_pages"] == 2 and counts["skipped"] == 1
    assert pages.crawl(spark, p, ["https://a.example/g", "https://a.example/none"], 1, 2)[1]["seen"] == 1
    rules = spark.createDataFrame([("https://a.example", "User-agent: *\nDisallow: /g")], "origin string, rules string")
    assert {r.url: r.allowed for r in pages.allowed(p.select("url"), rules).collect()} == {"https://a.example/g": False, "https://a.example/other": True, "https://a.example/none": True}


def test_public_address():
    assert not any(map(pages.public_address, ["localhost", "127.0.0.1", "10.1.2.3", "169.254.0.1", "224.0.0.1", "[::1]", ""])) and pages.public_address("8.8.8.8")


def test_circuit():
    c = guards.Circuit(3, 15)
    for t in range(3):
        assert c.allow(t)
        c.result(t, False)
    assert c.name(3) == "open" and not c.allow(10)
    assert c.allow(17) and not c.allow(17.5)  # one probe
    c.result(18, True)
    assert c.name(18) == "closed" and c.allow(19)


def test_bucket_and_gate(spark):
    b = guards.Bucket(2, 0.5)
    assert [b.take(0)[0], b.take(0)[0], b.take(0)] == [True, True, (False, 3)] and b.take(2)[0]
    calls = spark.createDataFrame([(i, "c", 0, 0.0, 10.0) for i in range(5)] + [(9, "d", 0, 20.0, 1.0)], "call_id long, client string, node int, at double, seconds double")
    assert sum(r.admitted for r in guards.capacity_gate(calls.select("call_id", "node", "at", "seconds"), 2).collect()) == 3
    assert sum(r.allowed for r in guards.token_buckets(calls.select("call_id", "client", "at"), 3, 0.1).collect()) == 4
    ok = calls.selectExpr("call_id", "node AS shard", "at", "false AS ok")
    assert [r.allowed for r in guards.circuit_states(ok).orderBy("call_id").collect()] == [True, True, True, False, False, True]


def test_plan_tiers(spark):
    rows = [("a", "what is a broken cache", 0, "auto", 1, 10, 3, 3, 0, 10.0), ("b", "what is a broken cache", 1, "auto", 9, 10, 3, 3, 0, 10.0), ("c", "a.b", 2, "auto", 1, 10, 2, 3, 0, 10.0), ("d", "x", 3, "semantic", 1, 10, 1, 3, 0, 10.0)]
    spark.createDataFrame(rows, "id string, query string, state int, requested string, inflight int, capacity int, healthy int, total int, unavailable int, p95_ms double").createOrReplaceTempView("asked_plans")
    got = {r.id: (r.tier, r.selected_mode, r.generation_allowed) for r in spark.sql(planner.plan(SPARK, "asked_plans")).collect()}
    assert got == {"a": ("quality", "hybrid", True), "b": ("survival", "lexical", False), "c": ("survival", "lexical", False), "d": ("manual", "semantic", True)}


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT tokenize('The Redis cache') AS t, canonicalize_url('https://A.example/x?utm_source=1') AS u, query_profile('a.b') AS p").first()
    assert r.t == ["redis", "cache"] and r.u == "https://a.example/x" and r.p == "exact"
    spark.createDataFrame([(LONG,)], "t string").createOrReplaceTempView("long_texts")
    assert spark.sql("SELECT c.* FROM long_texts, LATERAL chunk_text(t) c").count() == len(pages.chunks(LONG))


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"title": "T", "text": "x" * 30}, {"title": "", "text": "x" * 30}, {"title": "T", "text": "short"}]))
    ok, bad = registry.documents(spark, str(tmp_path / "d.json"))
    assert ok.first().source == "manual" and bad.count() == 2 and registry.documents(spark, str(tmp_path / "none.json"))[0].count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"name": "A docs", "seed": "s", "tier": " Core", "max_pages": 500}, {"name": "B", "seed": "s", "tier": "x"}]))
    r = registry.registry(spark, str(tmp_path / "r.json"), tier="core").collect()
    assert len(r) == 1 and r[0].max_pages == 100 and r[0].seeds == ["s"]
    (tmp_path / "c.jsonl").write_text('{"id":"1","must_cite":null}\n\n{"id":"2","must_cite":true}\n')
    assert [x.must_cite for x in registry.cases(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == [None, True]
    registry.report(ok, ok.select("title"), str(tmp_path / "out"), "Report")
    assert "| title |" in spark.read.text(str(tmp_path / "out/report"), wholetext=True).first()[0]
    m = spark.createDataFrame([("n", {"a": "b"}, 1.0)], "name string, labels map<string,string>, value double")
    assert registry.exposition(m) == 'n{a="b"} 1.0\n'
    pool = spark.createDataFrame([(1, "t", "x"), (2, "u", "y")], "doc_id long, title string, text string")
    assert registry.generated(pool, 9).count() == 9


def test_providers(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: list(r.vector) for r in embedded(df, "doc_id", "text", lambda ts: [[len(t), 0] for t in ts]).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    p = spark.createDataFrame([("q", "p", "extract")], "qid string, prompt string, answer string")
    assert answered(p, None).first().model == "extractive-grounded"
    assert answered(p, lambda x: 1 / 0).first().answer == "extract" and answered(p, lambda x: x + "!").first().answer == "p!"


def test_stream_replay_changes_nothing(spark):
    base = scratch(spark, "st")
    e = ['{"event_id":"a","document":{"title":"T","text":"one text"},"attempt":0}', "broken", '{"event_id":"b","document":{"title":"T","text":"ONE text"},"attempt":5}', '{"event_id":"c","document":{"title":"T","text":"two"},"attempt":0}']
    spark.createDataFrame([(x,) for x in e], "value string").coalesce(1).write.text(f"{base}/log")
    w = IndexStream(spark, f"{base}/store", f"{base}/dead", f"{base}/retry", ["s"], refuses="event_id = 'c' OR event_id = 'b'")
    w.start(file_source(spark, f"{base}/log"), f"{base}/cp").awaitTermination()
    assert w.store.read().count() == 1 and spark.read.text(f"{base}/dead/batch=0").count() == 1
    assert "last_error" in spark.read.text(f"{base}/retry/batch-0").first()[0] and spark.read.text(f"{base}/dead/exhausted-0").count() == 1
    before = w.store.read().collect()
    w.batch(spark.read.text(f"{base}/log"), 0)
    assert w.store.read().collect() == before
