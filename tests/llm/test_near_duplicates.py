import random
import re

from corpusloom.llm.near_duplicates import NearDuplicates, components

SCHEMA = "shard string, id string, body string, sig int, n int, h string"


def shingles(t, k):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = r.choices(vocab, k=r.randint(30, 120))
        out.append(base)
        for _ in range(r.randint(0, 3)):
            e = list(base)
            for _ in range(r.randint(0, 8)):
                j = r.randrange(len(e))
                e[j : j + r.randint(0, 1)] = r.choices(vocab, k=r.randint(0, 2))
            if r.random() < 0.2:
                m = len(e) // 2
                e = e[m:] + e[:m]
            out.append(e)
    menu = "home about contact search login privacy terms share print follow " * 2
    return [("s", f"d{i}", menu + " ".join(e) + ("" if i % 3 else "!"), 1, 1, "x") for i, e in enumerate(out)]


def brute(rows, k, t):
    sets = [(r[1], shingles(r[2], k)) for r in rows]
    return {tuple(sorted((a, b))) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a != b and x and y and len(x & y) >= t * len(x | y)}


def test_against_brute_force(spark):
    rows = corpus()
    rows += [("t", rows[0][1], rows[0][2], 1, 1, "x"), ("s", "copy", rows[1][2].upper(), 1, 1, "x"), ("s", "null", None, 1, 1, "x"), ("s", "empty", "", 1, 1, "x"), ("s", "tiny", "one two", 1, 1, "x"), ("s", "e3", "one two three", 1, 1, "x"), ("s", "e4", "One, two; three", 1, 1, "x")]
    for k, t in ((3, 0.6), (5, 0.8)):
        nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body", k=k, threshold=t)
        want = brute(rows, k, t)
        assert set(map(tuple, nd.pairs("id").collect())) == want and ("e3", "e4") in want or k == 5
        groups = {r.id: r for r in nd.groups("id").collect()}
        assert all(groups[a].group_id == groups[b].group_id for a, b in want)
        assert "null" not in groups and "tiny" not in groups


def test_order_of_sections_plays_no_part(spark):
    r, rows = random.Random(4), []
    for i in range(12):
        parts = [" ".join(f"w{r.randrange(10_000)}" for _ in range(12)) for _ in range(25)]
        rows += [("s", f"{i}a", " ".join(parts), 1, 1, "x"), ("s", f"{i}b", " ".join(parts[::-1]), 1, 1, "x")]
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body", k=3, threshold=0.6)
    assert set(map(tuple, nd.pairs("id").collect())) == brute(rows, 3, 0.6) == {(f"{i}a", f"{i}b") for i in range(12)}


def test_repeats_of_a_passage_play_no_part(spark):
    r, rows = random.Random(5), []
    for i in range(12):
        passage = " ".join(f"w{r.randrange(10_000)}" for _ in range(200))
        rows += [("s", f"{i}a", passage, 1, 1, "x"), ("s", f"{i}b", " ".join([passage] * 10), 1, 1, "x")]
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body", k=3, threshold=0.6)
    assert set(map(tuple, nd.pairs("id").collect())) == brute(rows, 3, 0.6) == {(f"{i}a", f"{i}b") for i in range(12)}


def test_crowded_buckets_are_split(spark, monkeypatch):
    from corpusloom.llm import near_duplicates

    rows = corpus(3, 80)
    want = brute(rows, 3, 0.6)
    monkeypatch.setattr(near_duplicates, "CROWD", 2)
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body", k=3, threshold=0.6)
    assert set(map(tuple, nd.pairs("id").collect())) == want


def test_texts_move_only_for_pairs_in_reach(spark, monkeypatch):
    from corpusloom import runtime
    from corpusloom.llm import near_duplicates

    r, rows = random.Random(6), []
    shared = [f"s{i}" for i in range(140)]
    for i in range(40):  # all pairs share 0.4 of their runs, so their sketches agree; pairs of a and b are alike
        own = [f"o{i}x{j}" for j in range(100)]
        rows += [("s", f"{i}a", " ".join(shared + own), 1, 1, "x"), ("s", f"{i}b", " ".join(shared + own[:-4]), 1, 1, "x")]
    want, compared, plain = brute(rows, 3, 0.6), [], near_duplicates.verified

    def verified(pairs, *args):
        compared.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(near_duplicates, "verified", verified)
    for room in (runtime.BROADCAST_BYTES, 64):  # in 64 bytes nothing is broadcast, and the bitmap of keys has 512 bits
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", room)
        nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body", k=3, threshold=0.6, common=1.0)
        assert set(map(tuple, nd.pairs("id").collect())) == want == {(f"{i}a", f"{i}b") for i in range(40)}
    assert max(compared) < 100  # of 3,160 pairs


def test_edits(spark):
    r, rows = random.Random(8), []
    for i in range(15):
        words = [f"w{r.randrange(10_000)}" for _ in range(120)]
        edited = list(words)
        for _ in range(4):
            j = r.randrange(len(edited))
            edited[j : j + r.randint(0, 2)] = [f"v{r.randrange(10_000)}" for _ in range(r.randint(0, 2))]
        rows += [("s", f"{i}a", " ".join(words), 1, 1, "x"), ("s", f"{i}b", " ".join(edited), 1, 1, "x"), ("s", f"{i}c", " ".join(words[60:] + words[:60]), 1, 1, "x"), ("s", f"{i}d", " ".join(words * 3), 1, 1, "x")]
    nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body", k=3, threshold=0.6, ordered=True)
    got = set(map(tuple, nd.pairs("id").collect()))
    assert got == {(f"{i}a", f"{i}b") for i in range(15)}  # sections in another order and repeats are many edits


def test_empty_and_alone(spark):
    for rows in ([], [("s", "a", "one two three four five six", 1, 1, "x")]):
        nd = NearDuplicates(spark.createDataFrame(rows, SCHEMA), ["shard", "id"], "body")
        assert nd.pairs("id").collect() == [] and nd.groups("id").count() == len(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.sig: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 230)} == {200}
