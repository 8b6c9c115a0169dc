import itertools
import random

from corpusloom.llm import boilerplate as b

PROSE = "The scheduler moves the oldest entry to the next worker, and a second worker confirms it before the lease ends. "
NAMES = "queue lease shard worker entry broker ledger cursor replica digest window token".split()


def cost(scores, edges, side):
    return sum(-s if s < 0 and x else s if s > 0 and not x else 0 for s, x in zip(scores, side)) + sum(w for a, c, w in edges if side[a] != side[c])


def test_min_cut_is_minimal():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 8)
        scores = [r.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) * r.random() for _ in range(n)]
        edges = [(a, c, r.random() * 2) for a, c in itertools.combinations(range(n), 2) if r.random() < 0.5]
        best = min(cost(scores, edges, s) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(scores, edges, b.min_cut(scores, edges)) - best) < 1e-6


def page(i, words=("More on", "We use cookies to improve", "All rights reserved", "Home")):
    """A page and the numbers of its furniture lines; ``words`` are the wordings of its site."""
    r = random.Random(i)
    tell = lambda: "The " + " ".join(r.choices("scheduler worker lease entry queue shard broker keeps moves confirms renews before after while every single old new".split(), k=18)) + "."
    title = lambda: r.choice(["How a {} {} drains", "Tuning the {} of a {}", "Why operators move the {} to a {}"]).format(r.choice(NAMES), r.choice(NAMES))
    own = [title(), tell() + " " + tell(), "- " + tell(), f"| {tell()[:20]} | b | c |", f"if x > {i}: run_{r.choice('abcdefgh')}{r.choice('abcdefgh')}()", title(), "The session cookie set by the gateway carries a signed lease, and " + tell()]
    junk = [f"{words[3]} | Products | Docs | Blog | Login", f"{words[1]} the {r.choice(NAMES)} pages. Accept all", f"{words[0]} {r.choice(NAMES)} and {r.choice(NAMES)}", *[title() for _ in range(3)], f"© 2024 Example {r.choice(NAMES)}. {words[2]}"]
    middle = i % 2 == 0  # the list of related pages stands between two paragraphs, or at the end
    lines = [junk[0], junk[1], own[0], "", *own[1:5], *(junk[2:6] if middle else []), "", *own[5:], *([] if middle else junk[2:6]), junk[6]]
    want = {1, 2, len(lines), *range(9, 13)} if middle else {1, 2, *range(len(lines) - 4, len(lines) + 1)}
    return "\n".join(lines), want


def accuracy(model, pages):
    right = cut = total = 0
    for text, want in pages:
        lines = b.read_page(text)
        z, _ = model.terminals(lines)
        got = set(b.furniture(model, text))
        for n, s in zip(lines, z):
            total += 1
            right += (s > 0) == (n.no in want)
            cut += (n.no in got) == (n.no in want)
    return right / total, cut / total


def test_cut_beats_threshold_on_held_out_pages():
    model = b.fit_model([page(i)[0] for i in range(300)], [f"s{i % 6}" for i in range(300)], [{1}] * 300)
    threshold, cut = accuracy(model, [page(i) for i in range(400, 460)])
    assert cut > threshold and cut > 0.98
    assert b.furniture(model, None) == b.furniture(model, "") == b.furniture(model, " \n\t\n") == []


def test_wordings_outside_the_seeds_are_learnt_from_repetition():
    new = ("Handpicked for the", "Biscuits help our team run", "Kept by the guild", "Lobby")
    pages = [page(i, new) for i in range(300)]
    menus = [{1, *(n for n in want if "Biscuits" in text.split("\n")[n - 1])} for text, want in pages]
    assert not any(b._seed(f"{w} x") for w in new)
    fitted = b.fit_model([t for t, _ in pages], [f"s{i % 6}" for i in range(300)], menus)
    unlabelled = b.fit_model([t for t, _ in pages], [f"s{i % 6}" for i in range(300)], [set()] * 300)
    asked = [page(i, new) for i in range(401, 461)]
    found = lambda m: sum(2 in b.furniture(m, t) for t, _ in asked)
    assert found(fitted) == 60 > found(unlabelled)


def test_unfitted_model_keeps_all():
    assert b.furniture(b.fit_model([], [], []), "Skip to main content\n" + PROSE) == []


def test_long_menus_are_menus():
    assert b.read_page(" | ".join(["Docs", "Blog", "Jobs"] * 60))[0].kind == "menu"
    assert b.read_page("x" * 900)[0].kind == "text"


def test_operator(spark):
    rows = [(i, page(i)[0], f"s{i % 5}", 1) for i in range(300)] + [(1000, None, None, 1), (1001, "", "s0", 1), (1002, PROSE * 2000, "s1", 1), (0, page(0)[0], "s0", 1)]
    df = spark.createDataFrame(rows, "id long, text string, site string, line_no int")
    got = {}
    for r in b.furniture_lines(df, ["id"], "text", "site").collect():
        got.setdefault(r.id, []).append(r.line_no)
    assert sum(set(got[i]) == page(i)[1] for i in range(1, 300)) > 285 and not {1000, 1001, 1002} & set(got)
    clean = {r.id: r.text for r in b.main_content(df, ["id"], "text", "site").collect()}
    assert "We use cookies" not in clean[4] and "session cookie" in clean[4] and clean[1000] is None and clean[1001] == ""
    assert b.furniture_lines(df.limit(0), ["id"], "text", "site").collect() == []


def test_repetition_is_counted_over_all_rows(spark):
    rows = [(i, f"Lobby {i}\nown {'abcdefghijkl'[i]}", "s" if i else None) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, site string").repartition(3)
    assert b._repeated(df, "text", "site", [("lob by\nown b", "s"), ("Lobby", "t"), ("Lobby", None)], 11) == [{1}, set(), set()]
    assert b._repeated(df, "text", "site", [("Lobby", "s")], 12) == [set()]
