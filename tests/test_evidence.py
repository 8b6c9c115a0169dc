from pyspark.sql import functions as F

from corpusloom.functions import evidence as e
from corpusloom.functions.dialect import SPARK
from corpusloom.operators import answers

SCHEMA = "qid string, query string, doc_id long, rank int, score double, title string, url string, source string, snippet string"


def gate(spark, query, results, step="reasoned", select="*", qid="q"):
    rows = [(qid, query, i, i, 1.0 / i, *r) for i, r in enumerate(results, 1)]
    queries = spark.createDataFrame([(qid, query)], "qid string, query string")
    return answers.evaluate(spark, spark.createDataFrame(rows, SCHEMA), queries, step, select).collect()


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(F.expr(expr)).first()[0]


def terms(spark, q):
    return set(value(spark, e.query_terms(SPARK, "q"), q=q))


def test_query_terms_and_identifiers(spark):
    assert terms(spark, "What is the HTTP 503 status?") == {"http", "503", "status"}
    assert terms(spark, "Use node.js. now.") == {"node.js.", "now."}
    assert set(value(spark, e.identifiers(SPARK, "q"), q="Does PERMASTORE support exactly-once or v2?")) == {"permastore", "exactly-once", "v2"}


def test_definition_terms(spark):
    f = lambda q: set(value(spark, e.definition_terms(SPARK, "q"), q=q))
    assert f("What is idempotency in distributed systems?") == {"idempotency"}
    assert f("what does cold start mean?") == {"cold", "start"}
    assert f("Define service mesh.") == {"service", "mesh"}
    assert f("How is a cache warmed?") == set()


def test_underspecified(spark):
    def f(q):
        return value(spark, f"{e.is_underspecified(SPARK, 'q', e.query_terms(SPARK, 'q'), e.identifiers(SPARK, 'q'), e.definition_terms(SPARK, 'q'))}", q=q)

    assert not f("how do caches work")
    assert f("Should I retry") and not f("Should I retry HTTP-503 calls") and not f("What is retry")


def test_plural_terms_match(spark):
    f = lambda term, token: value(spark, e.term_in(SPARK, "t", "array(k)"), t=term, k=token)
    assert f("cache", "caches") and f("query", "queries") and f("class", "classes")
    assert not f("key", "keys") and not f("v2xyz", "v2xyzs")


def test_polarity_looks_three_words_back(spark):
    f = lambda s: value(spark, e.polarity(SPARK, "array('required')", "s"), s=s)
    assert f("Locks are not always required here.") == -1
    assert f("Required when duplicates cannot be tolerated") == 1
    assert f("not one two three required") == 1


def test_authority(spark):
    f = lambda h, s: value(spark, e.authority(SPARK, "h", "s"), h=h, s=s)
    assert f("redis.io", "x") == 1.0 and f("docs.redis.io", "x") == 1.0 and f("cheatsheetseries.owasp.org", "x") == 0.98
    assert f("other.example", "trusted-docs:other.example") == 0.85 and f("", "manual") == 0.6


DEFINES = ("Idempotency", "https://a.example/1", "trusted-docs:a.example", "Idempotency is a property of an operation that gives the same result when it is repeated.")
MENTIONS = ("Payments", "https://b.example/1", "trusted-docs:b.example", "Every payment request of this service requires idempotency and a valid account number.")


def test_definition_query_needs_a_definition(spark):
    assert [r.doc_id for r in gate(spark, "What is idempotency?", [MENTIONS, DEFINES], "survivors")] == [2]
    r = gate(spark, "What is idempotency?", [MENTIONS])[0]
    assert r.decision == "abstain" and r.reasons in (answers.NO_DEFINITION, answers.NO_CLAIM)


def test_identifier_must_be_there(spark):
    near = ("Commands", "https://a.example/2", "manual", "The store offers many commands to expire keys and to persist keys for a long time.")
    assert gate(spark, "How does PERMASTORE persist keys", [near], "relevant") == []
    assert gate(spark, "How does PERMASTORE persist keys", [near])[0].decision == "abstain"


def test_judgment_needs_tradeoffs(spark):
    plain = ("Retries", "https://a.example/3", "manual", "Clients can send a request again after a failed call to the payment gateway today.")
    weighs = ("Retries", "https://b.example/3", "manual", "Whether clients should retry a payment depends on the cost of duplicates and on latency.")
    got = {(r.doc_id) for r in gate(spark, "Should clients retry a payment gateway request?", [plain, weighs], "supporting")}
    assert 2 in got


def test_agreement_and_conflict(spark):
    a = ("Locks", "https://a.example/4", "manual", "Advisory locks protect shared counters during concurrent writes to the ledger table.")
    b = ("Locks", "https://b.example/4", "manual", "Advisory locks protect shared counters when concurrent writes reach the ledger table.")
    c = ("Locks", "https://c.example/4", "manual", "You should never use advisory locks for shared counters, concurrent writes reach the ledger table anyway.")
    assert gate(spark, "advisory locks", [a, b], "agreed")[0].agreement == "agreement"
    r = gate(spark, "advisory locks", [a, c], "agreed")[0]
    assert r.agreement == "mixed" and r.conflict and r.conflicting_sources == 2 and r.supporting_sources == 0
    assert gate(spark, "advisory locks", [a], "agreed")[0].agreement == "single_source"
    assert gate(spark, "advisory locks", [a, c], "answers")[0].answer.startswith(answers.CAVEAT_CONFLICT)


def test_strong_single_source_answers(spark):
    one = ("What redis ttl is", "https://redis.io/ttl", "manual", "A redis ttl is the time to live of a redis key, given in seconds.")
    r = gate(spark, "What is redis ttl?", [one])[0]
    assert r.decision == "answer" and r.strong
    got = gate(spark, "What is redis ttl?", [one], "answers")[0]
    assert got.answer.endswith("[1]") and got.model == "extractive-grounded"


def test_nothing_found_and_null_fields(spark):
    r = gate(spark, "advisory locks", [])[0]
    assert (r.decision, r.confidence, r.reasons) == ("abstain", 0.0, answers.NO_RESULT)
    assert gate(spark, "advisory locks", [(None, None, None, None)])[0].decision == "abstain"
    assert gate(spark, None, [DEFINES])[0].decision in ("abstain", "answer_with_caveat", "answer")


def test_weak_tail_is_cut(spark):
    strong = ("Advisory locks guide", "https://a.example/5", "manual", "Advisory locks guide for writers of the ledger.")
    weak = ("Other", "https://b.example/5", "manual", "A page that has locks in one place of its text.")
    assert [r.doc_id for r in gate(spark, "advisory locks guide", [weak, strong], "relevant")] == [2]
    stages = {r.doc_id: r.stage for r in gate(spark, "advisory locks guide", [weak, strong], "traced")}
    assert stages[1] in ("pruned_relative_relevance", "pruned_minimum_relevance")
