import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.llm.repeated_lines import repeated_lines, site_of, without_repeated_lines

SCHEMA = "shard_id string, document_id string, body string, url string, source string, site int, lines int, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, d, e, 1, 2, "x") for a, b, c, d, e in rows], SCHEMA)


def identifier(line):
    return "".join(c for c in line if not c.isspace() and c not in "0123456789").lower()


def brute(rows, least):
    count = defaultdict(set)
    for i, (_, _, body, _, site) in enumerate(rows):
        for line in (body or "").split("\n"):
            if identifier(line) and site:
                count[site, identifier(line)].add(i)
    return {(a, b, n) for a, b, body, _, site in rows for n, line in enumerate((body or "").split("\n"), 1) if identifier(line) and site and len(count[site, identifier(line)]) >= least}


def test_against_brute_force(spark):
    r = random.Random(3)
    lines = ["Share  this", "share THIS 12", "\t©　2020", "a", "b", "", " ", "own text 1", "7", "own text x\r"]
    rows = [("s", f"d{i}", None if i % 17 == 0 else "\n".join(r.choices(lines + [f"unique {chr(97 + i % 26)}{'z' * (i // 26)}"], k=r.randint(0, 6))), None, r.choice(["hot", "hot", "b", None])) for i in range(90)]
    got = set(map(tuple, repeated_lines(frame(spark, rows), ["shard_id", "document_id"], min_rows=8).collect()))
    assert got == brute(rows, 8) and got


def test_site(spark):
    rows = [("https://WWW.A.example:8080/x", "s", "a.example"), ("http://u@b.example", "s", "b.example"), ("", "Trusted-Docs:www.C.example", "c.example"), (None, "Manual", "manual"), (None, None, None)]
    df = spark.createDataFrame(rows, "url string, source string, want string")
    assert all(r.got == r.want for r in df.select("want", site_of(F.col("url"), F.col("source")).alias("got")).collect())


def brute_sequences(rows, single, least, length):
    """All sequences by enumeration."""
    import itertools

    def ids(body):
        return [(n, identifier(x)) for n, x in enumerate((body or "").split("\n"), 1) if identifier(x)]

    support = Counter()
    for _, _, body, _, _ in rows:
        seq = [x for _, x in ids(body)]
        support.update({p for size in range(length, len(seq) + 1) for p in itertools.combinations(seq, size)})
    out = brute(rows, single)
    for a, b, body, _, _ in rows:
        seq = ids(body)
        for size in range(length, len(seq) + 1):
            for c in itertools.combinations(seq, size):
                if support[tuple(x for _, x in c)] >= least:
                    out |= {(a, b, n) for n, _ in c}
    return out


def test_sequences_against_enumeration(spark):
    r = random.Random(11)
    rows = [("s", str(i), "\n".join(r.choices("abcdef", k=r.randint(0, 6))), None, "w") for i in range(40)]
    for least, length in ((6, 2), (3, 3)):
        got = set(map(tuple, repeated_lines(frame(spark, rows), ["shard_id", "document_id"], min_rows=30, sequence_rows=least, length=length).collect()))
        assert got == brute_sequences(rows, 30, least, length) and got


def test_sequences_grow_at_the_threshold_of_lines(spark, monkeypatch):
    import itertools

    from corpusloom.llm import repeated_lines as module

    tables, plain = {}, module.materialise

    def materialise(df, name, *args):
        tables[name] = out = plain(df, name, *args)
        return out

    monkeypatch.setattr(module, "materialise", materialise)
    r = random.Random(12)
    rows = [("s", str(i), "\n".join(r.choices("abcdef", k=r.randint(0, 7))), None, r.choice("vw")) for i in range(60)]
    got = set(map(tuple, repeated_lines(frame(spark, rows), ["shard_id", "document_id"], min_rows=8).collect()))
    assert got == brute(rows, 8) and got
    support = Counter()
    for _, _, body, _, site in rows:
        support.update({(site, p) for p in itertools.combinations(body.split("\n"), 2) if all(p)})
    often = tables["patterns-2"].groupBy("site").count().collect()
    assert {x.site: x["count"] for x in often} == Counter(site for (site, _), n in support.items() if n >= 8) and often
    assert tables["sequences"].agg(F.sum("weight")).first()[0] == len({(a, b) for a, b, _ in got})


def test_long_rows_grow_where_they_can_add(spark, monkeypatch):
    from corpusloom.llm import repeated_lines as module

    monkeypatch.setattr(module, "LONG", 1)
    r = random.Random(13)
    rows = [("s", str(i), "\n".join(r.choices("aaaabcde", k=r.randint(0, 6))), None, "w") for i in range(40)]
    got = set(map(tuple, repeated_lines(frame(spark, rows), ["shard_id", "document_id"], min_rows=20, sequence_rows=5).collect()))
    assert got == brute_sequences(rows, 20, 5, 2) and got > brute(rows, 20) > set()


def test_sequences_can_have_a_lower_support(spark):
    rows = [("s", str(i), "head\ntail" if i < 4 else "head\nother\ntail" if i < 5 else "tail", None, "w") for i in range(8)]
    f = lambda **kw: Counter(r.line_no for r in repeated_lines(frame(spark, rows), ["document_id"], min_rows=7, **kw).collect())
    assert f() == Counter({1: 3, 2: 4, 3: 1})
    assert f(sequence_rows=4) == Counter({1: 8, 2: 4, 3: 1})  # head, then tail, goes as a sequence


def test_clean_keeps_the_rest_in_order(spark):
    rows = [("s", str(i), f"menu\n\nown {chr(97 + i)}\nmenu 2", None, "w") for i in range(9)] + [("s", "n", None, None, "w"), ("s", "e", "", None, "w")]
    got = {r.document_id: r.body for r in without_repeated_lines(frame(spark, rows), ["document_id"]).collect()}
    assert got["0"] == "\nown a" and got["n"] is None and got["e"] == ""


def test_empty(spark):
    assert repeated_lines(frame(spark, []), ["document_id"]).collect() == []
    assert without_repeated_lines(frame(spark, []), ["document_id"]).collect() == []
