import random

from corpusloom.llm import shared_spans as s

SCHEMA = "doc_id long, text string, k long, place long"


def brute(rows, span):
    owner, multi = {}, set()
    for i, t in rows:
        if i is None or t is None:
            continue
        for a in range(len(t) - span + 1):
            w = t[a : a + span]
            if owner.setdefault(w, i) != i:
                multi.add(w)
    out = set()
    for i, t in rows:
        if i is None or t is None:
            continue
        cur = None
        for a in range(len(t) - span + 1):
            if t[a : a + span] in multi:
                if cur and a <= cur[1]:
                    cur[1] = a + span
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [a, a + span]
        if cur:
            out.add((i, *cur))
    return out


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdefgh ñ語😀"
    mk = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [mk(r.randint(150, 700)) for _ in range(8)] + ["=" * 400, "ab" * 300]
    rows = []
    for i in range(60):
        t = mk(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            x = r.choice(shared)
            a = r.randint(0, 60)
            t += x[a : len(x) - r.randint(0, 60)] + mk(r.randint(0, 120))
        rows.append((i, t))
    return rows + [(100, None), (101, ""), (102, "x" * 199), (None, shared[0]), (103, shared[8] * 2)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(a, b, 1, 1) for a, b in rows], SCHEMA)
        assert set(map(tuple, s.shared_spans(df).collect())) == brute(rows, 200)


def test_other_spans_and_many_parts(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame([(a, b, 1, 1) for a, b in rows], SCHEMA).repartition(7)
    assert set(map(tuple, s.shared_spans(df, span=120).collect())) == brute(rows, 120)


def test_a_long_text_in_chunks(monkeypatch):
    r = random.Random(9)
    t = "".join(r.choice("abc ") for _ in range(5000))
    monkeypatch.setattr(s, "CHUNK", 700)
    seen = set()
    for codes, doc, ids, starts, offsets in s._text_chunks([1, 2], [t, t[1000:3000]], 200):
        h = s._Hashes(codes)
        p, lo, hi = s.super_windows(codes, doc, h, 200)
        for a, x, y in zip(p, lo, hi):
            d = doc[x]
            seen |= {(ids[d], w - offsets[d] + starts[d]) for w in range(x, y + 1)}
            assert x <= a <= y + 180 and a - y >= 0
    assert seen == {(1, w) for w in range(4801)} | {(2, w) for w in range(1801)}


def test_repeats_within_one_document_do_not_count(spark):
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, t + t, 1, 1), (1, t, 1, 1), (2, "z" * 500, 1, 1)], SCHEMA)
    assert s.shared_spans(df).collect() == []
    assert s.shared_spans(df.limit(0)).collect() == []
