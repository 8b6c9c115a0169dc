import random

from corpusloom.llm import splitting as s

TEXTS = [None, "", " ", "a", "x" * 5000, "One. Two! " * 900, "あ。い、" * 1500, " \t\r\n" * 1000, "word " * 3000 + "\n\n" + "tail", "emoji 😀 " * 700, "a　b c" * 300]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id long, t string, piece_no int")


def check(text, pieces, limit=1800, overlap=220):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, e, p in pieces:
        assert text[a:e] == p and len(p) <= limit
    for (a, e, _), (a2, e2, _) in zip(pieces, pieces[1:]):
        assert a < a2 <= e and e - a2 <= overlap and e2 > e


def test_pieces(spark):
    got = {}
    for r in s.split_pieces(rows(spark, TEXTS), ["id"], "t").collect():
        got.setdefault(r.id, []).append((r.piece_no, r.start_char, r.end_char, r.piece))
    assert 0 not in got and 1 not in got
    for i, t in enumerate(TEXTS[2:], 2):
        pieces = sorted(got[i])
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        check(t, [p[1:] for p in pieces])


def test_ends_are_natural():
    text = ("A sentence of some length stands here. " * 30 + "\n\n") * 5
    for _, e, p in s.split_text(text.encode())[:-1]:
        assert text[:e].endswith("\n\n") or text[:e].rstrip().endswith(".")


def mixed(n, seed=2):
    r = random.Random(seed)
    return "".join(r.choice(["Wort ", "größer. ", "文字。", "\n", "\n\n", "x" * 50 + " ", *(["y" * r.randint(100, 4000)] if i % 50 == 0 else [])]) for i in range(n))


def test_pieces_whatever_the_ranges(spark):
    texts = [mixed(3000), "y" * 9000, "ü" * 5000 + mixed(300, 3), *TEXTS]
    df = rows(spark, texts)
    want = {}
    for size in (1 << 20, 1 << 12, 900):
        got = sorted((x.id, x.piece_no, x.start_char, x.end_char, x.piece) for x in s.split_pieces(df, ["id"], "t", range_bytes=size).collect())
        want = want or got
        assert got == want
    for i in range(3):
        check(texts[i], [g[2:] for g in want if g[0] == i])


def test_tables_stitch_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 3)
    df = rows(spark, [mixed(4000, 7)])
    pieces = lambda size: sorted((x.piece_no, x.start_char, x.end_char, x.piece) for x in s.split_pieces(df, ["id"], "t", range_bytes=size).collect())
    assert pieces(2000) == pieces(1 << 20)


def test_files(spark, tmp_path):
    text = "Line of a file with ümlauts. " * 20_000
    (tmp_path / "a.txt").write_text(text)
    got = sorted((x.piece_no, x.start_char, x.end_char, x.piece) for x in s.split_files(spark, [f"file://{tmp_path}/a.txt"], range_bytes=1 << 17).collect())
    check(text, [g[1:] for g in got])
    assert [g[1:3] for g in got] == [p[:2] for p in s.split_text(text.encode())]


def test_lengths_whatever_the_ranges(spark):
    for size in (7, 64, 1 << 20):
        got = {r.id: r.n_chars for r in s.collapsed_lengths(rows(spark, TEXTS), ["id"], "t", range_bytes=size).collect()}
        assert got == {i: len(" ".join((t or "").split())) for i, t in enumerate(TEXTS)}
    assert s.collapsed_lengths(rows(spark, []), ["id"], "t").collect() == [] == s.split_pieces(rows(spark, []), ["id"], "t").collect()


def test_registered_queries_agree(spark):
    from corpusloom.llm.queries import QUERIES

    pieces, ranged = (QUERIES[q](spark, "/root/testdata/sf0.001") for q in ("p3_pieces", "p3_ranged"))
    assert pieces.exceptAll(ranged).isEmpty() and ranged.exceptAll(pieces).isEmpty() and pieces.where("length(piece) > 1800").isEmpty()
