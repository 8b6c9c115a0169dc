import hashlib
import re
from urllib.parse import parse_qsl, urldefrag, urlencode, urlparse, urlunparse

from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions import text as t
from corpusloom.functions.dialect import SPARK

TEXTS = ["The Quick-brown fox_2 is at C++ and node.js.", "", None, "naïve café is über ok", "a b cd ef\tgh", "K8s K x.y. not", "of the and"]
URLS = ["https://A.Example/x//y/?utm_source=a&b=1&ref=z&c=#frag", "http://h.example", "ftp://h/x", "https://h/a.PDF", "https://h/a?x=1&y=", None, "", "https://h/en/x;p?q=2", "mailto:x@y", "https://h/de/a", "https://h:8080/EN-us/a", "https://h/pt-br", "https://h/docs/a"]


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", F.expr(expr).alias("o")).orderBy("i").select("o").collect()]


def test_tokens(spark):
    want = [[x.lower() for x in re.findall(C.TERM, v or "") if x.lower() not in C.STOPWORDS] for v in TEXTS]
    assert col(spark, TEXTS, t.tokens(SPARK, "coalesce(v, '')")) == want


def test_hash_collapses_unicode_blanks(spark):
    want = [hashlib.sha256(" ".join((v or "").lower().split()).encode()).hexdigest() for v in TEXTS]
    assert col(spark, TEXTS, t.content_hash(SPARK, "coalesce(v, '')")) == want


def canonical(u):
    u, _ = urldefrag(u)
    p = urlparse(u)
    if p.scheme not in ("http", "https") or any(p.path.lower().endswith("." + e) for e in C.SKIP_EXTENSIONS):
        return ""
    q = [(k, v) for k, v in parse_qsl(p.query) if not k.lower().startswith("utm_") and k.lower() not in C.TRACKING_PARAMS]
    return urlunparse((p.scheme, p.netloc.lower(), re.sub("/{2,}", "/", p.path or "/"), "", urlencode(q), ""))


def test_canonical_url(spark):
    assert col(spark, URLS, t.canonical_url(SPARK, "v")) == [None if u is None else canonical(u) for u in URLS]


def test_localized(spark):
    got = dict(zip(URLS, col(spark, URLS, t.localized(SPARK, "v"))))
    assert got["https://h/de/a"] and got["https://h/pt-br"] and not got["https://h:8080/EN-us/a"] and not got["https://h/docs/a"] and not got["http://h.example"]


def test_domain_and_source_host(spark):
    assert col(spark, ["https://WWW.a.example:99/x", "x", None], t.domain_of(SPARK, "v")) == ["a.example", "", None]
    assert col(spark, ["", None], t.source_host(SPARK, "v", "'trusted-docs:A.example'")) == ["a.example", "a.example"]
    assert col(spark, ["nohost"], t.source_host(SPARK, "v", "'trusted-docs:a'")) == [""]


def snippet(text, q):
    low, terms = text.lower(), [x for x in q.lower().split() if len(x) > 2]
    hits = [low.find(x) for x in terms if x in low]
    s = max(0, (min(hits) if hits else 0) - 70)
    return ("…" if s else "") + text[s : s + 260].strip() + ("…" if s + 260 < len(text) else "")


def test_snippet(spark):
    texts = ["", "short", "x " * 200 + "needle here " + "y " * 200, "needle", " " + "z" * 400]
    assert col(spark, texts, t.snippet(SPARK, "v", "'the Needle of'")) == [snippet(x, "the Needle of") for x in texts]


def test_query_profile(spark):
    qs = ["what is a cache", "redis ttl", "find 'exact words' please now", 'say "this thing" to me', "see node.js docs for it", "it's a long question about caches"]
    want = ["natural_language", "exact", "exact", "exact", "exact", "natural_language"]
    assert col(spark, qs, t.query_profile(SPARK, "v")) == want


def test_rendezvous_moves_only_what_it_must(spark):
    keys = [f"k{i}" for i in range(300)]

    def pick(k, nodes):
        return max(nodes, key=lambda n: hashlib.sha256(f"{k}|{n}".encode()).hexdigest()[:16])

    three, four = ["a", "b", "c"], ["a", "b", "c", "d"]
    x, y = col(spark, keys, t.rendezvous(SPARK, "v", three)), col(spark, keys, t.rendezvous(SPARK, "v", four))
    assert x == [pick(k, three) for k in keys] and all(b in (a, "d") for a, b in zip(x, y))


def test_low_value(spark):
    assert col(spark, ["a | b | c | d", "Plain text", "x" * 300 + "|||", None], t.low_value(SPARK, "'Section'", "v")) == [True, False, False, False]
    assert col(spark, ["x"], t.low_value(SPARK, "' Table of   Contents ¶'", "v")) == [True]
