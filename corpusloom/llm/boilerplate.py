"""Main content of page texts by minimum cut.

A page's non-blank lines are the nodes of a graph.  A classifier of words and shapes gives each line the
cost of either label, which become the capacities to source and sink; smoothness edges join what stands
together in the page: neighbouring lines, lines of one list, a list with its heading, a heading with the
text under it.  The maximum flow separates content from furniture.

Terminal and edge weights are learnt from a bounded sample of rows with weak labels: lines that their
site repeats (counted over all rows), seed wordings, and the place in the page.  Seeds and repetition are
no features, so a line is judged by what it has in common with labelled lines, and by its neighbours.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that is fitted on: rows, by hash of the key, and bytes of a row that may be drawn.
SAMPLE_ROWS, SAMPLE_ROW_BYTES = 3000, 32 << 10
#: Rows of its site that a line must stand in to count as repeated.
MIN_ROWS = 8
HASHED = 1 << 16
RARE = 20  # a word or pair of words that the sample has less often has no weight
SURE = 2.0  # log odds from which a line is taken for furniture while edges are laid
OPEN = 3.0  # log odds up to which a line may be the heading of the text under it

# Seeds of the weak labels, by kind: wordings matched without letter case at the start of a line
# whose bullet is left out, its runs of white space made one blank.  They label the sample and nothing else.
SEEDS = {
    "skip": r"(?:skip|jump) to\b|back to top|menu close menu|loading\b.{0,60}\bwidgets|javascript is (?:off|disabled)|type / to search|text size\b|version:? \d+(?:\.\d+)* ?\(|(?:search|suche|buscar|rechercher) [^.]{0,60}…|zum inhalt|aller au contenu|ir al contenido|english \| deutsch",
    "consent": r"this (?:web)?site uses cookies|we use cookies|before you continue, .{0,60}cookies|by browsing .{0,60}cookies|your privacy matters|cookies on .{0,80}pages\b|our .{0,60}need your consent for cookies|.{0,60}and its \d+ partners|en .{0,40}usamos cookies|wir (?:von .{0,40})?verwenden cookies|.{0,40}utilise des cookies|nous utilisons des cookies|сайт .{0,40}использует файлы cookie|.{0,40}使用 cookie|.{0,60}(?:では|は).{0,60}cookie",
    "byline": r"by [^.]{3,60}, \d{4}-\d|author: |written by |posted (?:on )?\d|last edited|last updated|updated (?:on )?\d|published (?:on )?\d|filed under|reading time|page \d+ of \d+|.{3,60} \| .{3,40} staff \||zuletzt geändert|mis à jour|última edición|последнее изменение|最終更新|最后(?:编辑|更新)|обновлено|von .{3,60}, \d{4}-\d|par .{3,60}, \d{4}-\d|por .{3,60}, \d{4}-\d",
    "related": r"popular in |related to |readers of .{2,80} also |you may also |more (?:on|about) [^.]*$|on this page:|see also:?$|mehr zum thema|más sobre |à lire aussi|читайте также|関連(?:記事|項目)|相关(?:阅读|文章)|[^.]{0,60}の関連|recommended for you|most read|also opened",
    "neighbour": r"previous: .{1,200}next: |next: |[←‹«] .{1,200}[→›»|]|.{1,200} [→›»]$",
    "tags": r"(?:#\w+[^#.]{0,40}){2,}|tags?: |.{1,40} › .{1,80} › |schlagwörter|étiquettes|etiquetas",
    "share": r"share this|share on|like this .{0,80}page|save for later|print \||follow .{2,80} on |send to |teilen: |partager |compartir |поделиться|シェア|共有|分享|.{0,40}をシェア|open the .{2,60} app\b",
    "rating": r"was this .{0,80}helpful|did this answer|rate this |was something unclear|report a problem|\d+ comments? ·|war diese seite|cette page .{0,40}utile|¿.{0,60}útil|was ist unklar|была ли .{0,60}полезна|この.{0,20}役に立ち|本页.{0,20}(?:有用|帮助)",
    "signup": r"join \d+ readers|get .{2,80} news in your inbox|subscribe to the .{2,80}(?:newsletter|digest|letter|mailing)\b|sign in to|log in to|try .{2,80} free for|jetzt den .{2,80}bestellen|recevez la lettre|suscríbete al|подпишитесь|подписаться|.{0,40}(?:ニュースレター|メルマガ)|.{0,60}(?:订阅|訂閱).{0,60}(?:通讯|通訊)|.{0,80}を購読",
    "advert": r"advertisement|story continues|continue reading|read more|article continues|\[ ?sponsored ?\]|sponsored\b|anzeige\b|publicité|publicidad|реклама|広告|广告",
    "legal": r"©|\(c\) \d{4}|copyright (?:©|\(c\)|\d{4})|nothing on .{2,60} is advice|the .{2,120} (?:are|is a) (?:marks?|trademarks?) of|all .{2,80}content on this site|impressum\b|.{0,80}(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|все права защищены|無断転載|版权所有)|privacy policy|terms of (?:use|service)|legal notice",
    "crumbs": r"you are here|home »|home >|home /|docs > |startseite\b|inicio\b ?[|·»>/]|accueil\b ?[|·»>/]|главная\b|ホーム|首页|sie sind hier|vous êtes ici|estás en|вы здесь",
}
KINDS = list(SEEDS)
SEED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SEEDS.items()), re.I)
TOKEN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+|[^\W\d_]+|\d+|[^\w\s]")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
NUMBER = re.compile(r"\d+")
BULLET = re.compile(r"(?:[-*•»›·▪–—+]|\d{1,3}\))\s+")
PART = re.compile(r"\s*[|•·/>»›–]\s*|\t+|\s{2,}")
STOP = re.compile(r"[.!?:;。！？…।॥؟۔։።\"”»)]$")
CODE = re.compile(r"[{}=;]|\w\(|^(?:def|return|for|if|while|class|import|let|var|const)\b|--\w|^\s{4}|_\w+:")
NOT_ID = re.compile(r"[\s\x1c-\x1f0-9]+")

SHAPES = ["one", "bullet", "title", "item", "text", "bullet_text", "menu", "many_parts", "code", "table", "long", "middle", "short", "upper", "head", "tail", "top", "bottom", "gap_before", "gap_after"]
SHAPE = {k: i for i, k in enumerate(SHAPES)}
WORDS = len(SHAPES)
EDGES = ["near", "gap", "heads", "own", "under", "list", "lists", "inner", "last", "head_item", "run_inner", "run_last", "run_item", "skip"]
EDGE = {k: i for i, k in enumerate(EDGES)}
OWN = (EDGE["heads"], EDGE["own"])
BODY = ("text", "code", "table")


def _menu(line: str) -> int:
    """Number of parts that separators or wide blanks divide, if nearly all are short and of one or two words; else 0."""
    parts = [p for p in PART.split(line.strip()) if p]
    if len(parts) < 3 or sum(len(p) <= 40 for p in parts) < 0.9 * len(parts):
        return 0
    return len(parts) if sum(len(p.split(" ")) <= 2 for p in parts) >= 0.8 * len(parts) else 0


def _cells(line: str) -> bool:
    """A row of a table: three or more cells between tabs, of which some have several words."""
    cells = [c for c in line.strip().split("\t") if c.strip()]
    return len(cells) > 2 and sum(" " in c.strip() or "_" in c for c in cells) * 2 >= len(cells)


def tokens(line: str) -> list[str]:
    """Words, signs and numbers (all as 0); scripts without blanks by pairs of characters."""
    found = TOKEN.findall(NUMBER.sub("0", line.lower()))
    if line.isascii() or not WIDE.search(line):
        return found
    out = []
    for w in found:
        if len(w) > 2 and WIDE.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


class Line:
    __slots__ = ("bullet", "gap", "kind", "no", "shapes", "tokens")

    def __init__(self, no: int, gap: bool):
        self.no, self.gap, self.shapes, self.bullet, self.kind, self.tokens = no, gap, [SHAPE["one"]], "", "", []


def read_page(text: str | None) -> list[Line]:
    """The non-blank lines of a page: kind, words and shapes of each by itself, and its place in the page."""
    out: list[Line] = []
    gap = False
    for no, raw in enumerate((text or "").split("\n"), 1):
        line = " ".join(raw.split())
        if not line:
            gap = True
            if out and out[-1].shapes[-1] != SHAPE["gap_after"]:
                out[-1].shapes.append(SHAPE["gap_after"])
            continue
        n = Line(no, gap)
        m = BULLET.match(line)
        body = line[m.end() :] if m else line
        shapes = ["gap_before"] if gap else []
        gap = False
        if m:
            n.bullet = m[0].strip()[-1]
            shapes.append("bullet")
        parts = 0 if line[-1] in ".。" else _menu(raw)
        if line[0] == "|" and line.count("|") > 2 or _cells(raw):
            n.kind = "table"
        elif parts:
            n.kind = "menu"
            if parts >= 5:
                shapes.append("many_parts")
        elif len(line) < 200 and CODE.search(raw):
            n.kind = "code"
        elif STOP.search(body) or len(body) > 160:
            n.kind = "text"
        else:
            n.kind = "item" if m else "title"
        shapes += ["bullet_text" if m and n.kind == "text" else n.kind, "long" if len(body) > 120 else "short" if len(body) < 25 else "middle"]
        if line.isupper():
            shapes.append("upper")
        n.shapes += [SHAPE[s] for s in shapes]
        n.tokens = tokens(body)
        out.append(n)
    own = [i for i, n in enumerate(out) if n.kind in BODY]
    first, last = (own[0], own[-1]) if own else (len(out), -1)
    for i, n in enumerate(out):
        n.shapes += [SHAPE[s] for s, x in (("head", i < first), ("tail", i > last), ("top", i < 2), ("bottom", i >= len(out) - 3)) if x]
    return out


def _marks(t: list[str]) -> list[str]:
    """How a line begins and ends."""
    return ["^" + t[0], "^" + " ".join(t[:2]), "^" + " ".join(t[:3]), t[-1] + "$"] if t else []


def _slot(word: str) -> int:
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return WORDS + h % HASHED


class _Weights(dict):
    """Weights of words or pairs of words, looked up once while there are not too many."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, w: str | tuple[str, str]) -> float:
        if len(self) > 500_000:
            self.clear()
        self[w] = v = float(self.weights[_slot(w if isinstance(w, str) else " ".join(w))])
        return v


@dataclass
class Model:
    """Weights of shapes and hashed words, scale and offset of their sum, and capacities of the edges by kind."""

    weights: np.ndarray
    scale: float
    offset: float
    edges: np.ndarray

    def __post_init__(self):
        self._shapes, self._words = self.weights[:WORDS].tolist(), _Weights(self.weights)

    def score(self, n: Line) -> float:
        """Log odds of furniture by the line itself; words and pairs share their weight by the root of their number."""
        t, of = n.tokens, self._words.__getitem__
        z = sum(map(self._shapes.__getitem__, n.shapes)) + sum(map(of, _marks(t)))
        if t:
            z += (sum(map(of, t)) + sum(map(of, zip(t, t[1:])))) / math.sqrt(2 * len(t) - 1)
        return z

    def terminals(self, lines: list[Line]) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Capacities of a page's graph: to source (above 0) or sink (below) of each line, and of the edges."""
        scores = [self.score(n) for n in lines]
        return [self.scale * z + self.offset for z in scores], [(a, b, float(self.edges[k])) for a, b, k in laid(lines, scores) if self.edges[k] > 0]


def laid(lines: list[Line], scores: list[float]) -> list[tuple[int, int, int]]:
    """Smoothness edges and their kinds.

    ``near``, ``gap``: next lines, a blank line between or not; ``list``, ``lists``: next items under one
    bullet, alike or not; ``skip``: items with one line between; ``inner``, ``last``: next titles, the later
    followed by text or not; ``head_item``: a title and an item; ``heads``: a title and the text below;
    ``own``: a title and the first text beyond furniture; ``under``: text and a title below; ``run_...``: a
    line sure to be furniture and the titles and items that follow it.  Such a line begins something new,
    so nothing joins it to a title before it.
    """
    out: list[tuple[int, int, int]] = []
    size, below, under, head = len(lines), None, [None] * len(lines), None
    for i in range(size - 1, -1, -1):
        under[i] = below
        if lines[i].kind in BODY and scores[i] < 0:
            below = i
    for i, n in enumerate(lines):
        sure = scores[i] > SURE and not n.bullet and n.kind in ("title", "text")
        before_text = i + 1 < size and lines[i + 1].kind in BODY
        if i + 1 < size:
            m = lines[i + 1]
            if n.bullet and n.bullet == m.bullet:
                k = "list" if n.kind == m.kind else "lists"
            elif n.kind == m.kind == "title":
                k = "" if scores[i + 1] > SURE else "last" if i + 2 < size and lines[i + 2].kind in BODY else "inner"
            elif n.kind == "title" and m.kind == "item":
                k = "head_item"
            elif n.kind == "title" and m.kind in BODY:
                k = "heads" if scores[i] < OPEN else ""
            elif n.kind in BODY and m.kind == "title":
                k = "under"
            else:
                k = "gap" if m.gap else "near"
            if k:
                out.append((i, i + 1, EDGE[k]))
        if i + 2 < size and n.kind == lines[i + 2].kind == "item" and n.bullet == lines[i + 2].bullet:
            out.append((i, i + 2, EDGE["skip"]))
        if n.kind == "title" and head is None and under[i] is not None and under[i] > i + 1:
            out.append((i, under[i], EDGE["own"]))
        if n.kind in ("title", "item") and head is not None and not sure:
            out.append((head, i, EDGE["run_item" if n.kind == "item" else "run_last" if before_text else "run_inner"]))
        if n.kind in BODY and scores[i] < 0:
            head = None
        elif sure:
            head = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the furniture side of a minimum cut.

    A node whose terminal capacity exceeds its edges' keeps its side in every minimum cut, so it is
    settled and folded into its neighbours first; the rest goes through shortest augmenting paths.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    t, side = list(scores), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(t[i]) >= sum(near[i].values()):
            side[i] = t[i] > 0
            for j, w in near[i].items():
                t[j] += w if side[i] else -w
                near[j].pop(i, None)
                if side[j] is None:
                    todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        s, e = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
        cap[s], cap[e] = {}, {}
        for i in left:
            if t[i] > 0:
                cap[s][i], cap[i][s] = t[i], 0.0
            else:
                cap[i][e], cap[e][i] = -t[i], 0.0
        while True:
            back = {s: s}
            queue = deque([s])
            while queue and e not in back:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-9 and v not in back:
                        back[v] = u
                        queue.append(v)
            if e not in back:
                break
            path, v = [], e
            while v != s:
                path.append((back[v], v))
                v = back[v]
            f = min(cap[a][b] for a, b in path)
            for a, b in path:
                cap[a][b] -= f
                cap[b][a] = cap[b].get(a, 0.0) + f
        for i in left:
            side[i] = i in back
    return side


def _seed(line: str) -> str | None:
    """Kind of the seed that a line begins with."""
    line = " ".join(line.split())
    m = BULLET.match(line)
    got = SEED.match(line[m.end() :] if m else line) or (SEED.match(line) if m else None)
    return got.lastgroup if got else None


def weak_labels(page: list[Line], text: str, repeated: set[int]) -> list[int | None]:
    """1: furniture, 0: content, None: unknown.

    Furniture are lines that the site repeats or a seed begins, what isn't text after all text of the
    page, and the titles listed after a seed of related pages.  Content are text, code and tables
    without either, the titles above them, and a page's first titles.  A repeated title above text may be
    a heading that many pages of the site have.
    """
    raw, out, listing = text.split("\n"), [], False
    for i, n in enumerate(page):
        seed = None if n.kind == "table" else _seed(raw[n.no - 1])
        body = n.kind in BODY
        above = n.kind == "title" and i + 1 < len(page) and page[i + 1].kind in BODY
        if seed or n.no in repeated and not above or not body and SHAPE["tail"] in n.shapes:
            out.append(1)
        elif n.no in repeated:
            out.append(None)
        elif body or above:
            out.append(0)
        elif listing:
            out.append(1)
        elif n.kind == "title" and SHAPE["head"] in n.shapes:
            out.append(0)
        else:
            out.append(None)
        if seed:
            listing = seed == "related" or listing and seed != "byline"
        elif n.kind not in ("item", "menu") and out[-1] != 1:
            listing = False
    return out


class _Design:
    """Lines of pages as rows of a sparse matrix of shapes and hashed words."""

    def __init__(self, pages: list[list[Line]]):
        at, rows, cols, vals = 0, [], [], []
        slots: dict[str, int] = {}
        for page in pages:
            for n in page:
                t = n.tokens
                words = [*t, *map(" ".join, zip(t, t[1:]))]
                for w in (*words, *_marks(t)):
                    if w not in slots:
                        slots[w] = _slot(w)
                many = len(n.shapes) + len(words) + (4 if t else 0)
                rows.append(np.full(many, at))
                cols += [*n.shapes, *(slots[w] for w in words), *(slots[w] for w in _marks(t))]
                vals.append(np.concatenate((np.ones(len(n.shapes)), np.full(len(words), 1 / math.sqrt(max(1, len(words)))), np.ones(4 if t else 0))))
                at += 1
        self.size = at
        self.rows, self.cols, self.vals = (np.concatenate(rows), np.array(cols, np.int64), np.concatenate(vals)) if at else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * w[self.cols], self.size)


def _adam(gradient, w: np.ndarray, steps: int, rate: float, floor: np.ndarray) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.maximum(floor, w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9))
    return w


def _logistic(x: _Design, y: np.ndarray, use: np.ndarray, edges: tuple | None = None, steps: int = 60, rate: float = 0.25, prior: float = 1e-5) -> np.ndarray:
    """Weights of words and shapes, then of the edges given as (row, kind, label of the other end), for the rows ``use``.

    Both labels count by the root of their number.  Edge weights are not negative.
    """
    base = WORDS + HASHED
    keep = use[x.rows]
    r, c, v = x.rows[keep], x.cols[keep], x.vals[keep]
    often = (np.bincount(c, minlength=base)[c] >= RARE) | (c < WORDS)
    r, c, v = r[often], c[often], v[often]
    if edges is not None:
        on = use[edges[0]]
        r, c, v = np.concatenate((r, edges[0][on])), np.concatenate((c, base + edges[1][on])), np.concatenate((v, edges[2][on]))
    cells = np.flatnonzero(np.bincount(c))
    place = np.zeros(base + len(EDGES), np.int64)
    place[cells] = np.arange(len(cells))
    at, t = place[c], np.where(use, y, 0.0)
    ones, all_ = max(1.0, t.sum()), max(1, int(use.sum()))
    weight = np.where(t > 0, math.sqrt(all_ / ones), math.sqrt(all_ / max(1.0, all_ - ones))) * use
    weight /= max(1e-9, weight.sum())

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.clip(np.bincount(r, v * w[at], x.size), -30, 30)
        return np.bincount(at, v * ((1 / (1 + np.exp(-z)) - t) * weight)[r], len(cells)) + prior * w

    out = np.zeros(base + len(EDGES))
    out[cells] = _adam(gradient, np.zeros(len(cells)), steps, rate, np.where(cells < base, -np.inf, 0.0))
    return out


def fit_model(texts: list[str | None], sites: list[str | None], repeated: list[set[int]]) -> Model:
    """Model of a sample with weak labels.

    Terminal weights are fitted together with the edges between titles and their text.  Scale, offset and
    the other edges follow by pseudo-likelihood of each label given its neighbours', with scores of
    models that were fitted on the other half of the sites.  Without labels of both kinds nothing is furniture.
    """
    pages = [read_page(t) for t in texts]
    label = [x for p, t, r in zip(pages, texts, repeated) for x in weak_labels(p, t or "", r)]
    known = np.array([x is not None for x in label], bool)
    y = np.array([x or 0 for x in label], float)
    base = WORDS + HASHED
    if not (y[known] > 0).any() or not (y[known] == 0).any():
        return Model(np.zeros(base), 1.0, -1.0, np.zeros(len(EDGES)))
    x = _Design(pages)
    sizes = np.array([len(p) for p in pages])
    starts = np.cumsum(sizes) - sizes
    half = np.repeat(np.array([xxhash.xxh3_64_intdigest((s or "").encode("utf-8", "surrogatepass")) & 1 for s in sites]), sizes)

    def edges(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both directions of every edge as (row, kind, label of the other end, by its score where unknown); own edges from titles only."""
        soft = np.where(known, 2 * y - 1, np.tanh(z / 2))
        a, b, k = [], [], []
        for page, lo in zip(pages, starts.tolist()):
            for i, j, kind in laid(page, z[lo : lo + len(page)].tolist()):
                a.append(lo + i), b.append(lo + j), k.append(kind)
                if kind not in OWN:
                    a.append(lo + j), b.append(lo + i), k.append(kind)
        return np.array(a, np.int64), np.array(k, np.int64), soft[np.array(b, np.int64)]

    def held_out(e: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each row by the model of the other half; the model's edges of titles."""
        z, own = np.zeros(x.size), np.zeros(len(EDGES))
        for h in (0, 1):
            w = _logistic(x, y, known & (half == h), e)
            z = np.where(half != h, x.scores(w), z)
            own += w[base:] / 2
        return z, own

    def own_of(e: tuple) -> tuple:
        on = np.isin(e[1], OWN)
        return tuple(part[on] for part in e)

    if not all((known & (half == h) & (y == v)).any() for h in (0, 1) for v in (0, 1)):  # one site alone: halves by page
        half = np.repeat(np.arange(len(pages)) & 1, sizes)
    z, _ = held_out(None)
    first = own_of(edges(z))
    z, own = held_out(first)
    w = _logistic(x, y, known, first)

    rows, kinds, ends = edges(z)
    mine = np.isin(kinds, OWN)
    z = z + np.bincount(rows[mine], own[kinds[mine]] * ends[mine], x.size)
    on = known[rows] & ~mine
    rows, kinds, ends, n = rows[on], kinds[on], ends[on], known.sum()

    def gradient(v: np.ndarray) -> np.ndarray:
        q = np.clip(v[-2] * z + v[-1] + np.bincount(rows, v[kinds] * ends, x.size), -30, 30)
        e = np.where(known, 1 / (1 + np.exp(-q)) - y, 0.0) / n
        return np.concatenate((np.bincount(kinds, ends * e[rows], len(EDGES)), [e @ z, e.sum()]))

    v = _adam(gradient, np.array([*np.full(len(EDGES), 0.3), 0.5, 0.0]), 250, 0.05, np.array([*np.zeros(len(EDGES)), 0.05, -np.inf]))
    capacity = v[: len(EDGES)].copy()
    capacity[list(OWN)] = v[-2] * w[base:][list(OWN)]
    return Model(w[:base], float(v[-2]), float(v[-1]), capacity)


def furniture(model: Model, text: str | None) -> list[int]:
    """Line numbers of a page's furniture."""
    lines = read_page(text)
    return [n.no for n, x in zip(lines, min_cut(*model.terminals(lines))) if x] if lines else []


def _line_ids(text: str | None, site: str | None) -> list[int | None]:
    """Identifier of each line within its site, without white space, digits and letter case; None without a site or when nothing is left."""
    if site is None:
        return []
    return [xxhash.xxh3_64_intdigest(f"{site}\n{k}".encode("utf-8", "surrogatepass")) if (k := NOT_ID.sub("", x).lower()) else None for x in (text or "").split("\n")]


def _repeated(df: DataFrame, text: str, site: str, sample: list[tuple[str | None, str | None]], min_rows: int) -> list[set[int]]:
    """Of each sampled row, the numbers of the lines that stand in ``min_rows`` rows of its site, counted over all rows.

    The sample's identifiers, bounded as it is, go to the tasks; each sends one count per identifier.
    """
    ids = [_line_ids(t, s) for t, s in sample]
    sent = df.sparkSession.sparkContext.broadcast(frozenset(i for x in ids for i in x if i is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, count = sent.value, {}
        for batch in batches:
            for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in wanted.intersection(_line_ids(t, s)):
                    count[i] = count.get(i, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(count, np.uint64, len(count)).view(np.int64)), pa.array(count.values(), pa.int64())], ["id", "n"])

    counts = df.select(F.col(text), F.col(site)).where(F.col(site).isNotNull()).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)
    often = {r["id"] & (1 << 64) - 1 for r in counts.select("id").collect()}  # no more than the sample's lines
    return [{no for no, i in enumerate(x, 1) if i in often} for x in ids]


def fitted(df: DataFrame, keys: list[str], text: str, site: str, sample_rows: int = SAMPLE_ROWS, sample_row_bytes: int = SAMPLE_ROW_BYTES, min_rows: int = MIN_ROWS) -> Model:
    """Model of at most ``sample_rows`` rows of at most ``sample_row_bytes``, drawn by the hash of their keys."""
    # A threshold on the hash, so that tasks send the sampled rows alone.
    share = min(1.0, 0.9 * sample_rows / max(1, df.count()))
    order = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    drawn = df.where((order < int(share * (1 << 30))) & (F.octet_length(text) <= sample_row_bytes))
    sample = drawn.select(F.col(text).alias("t"), F.col(site).alias("s"), order.alias("o")).limit(sample_rows).collect()
    sample.sort(key=lambda r: (r["o"], r["t"], r["s"] or ""))
    rows = [(r["t"], r["s"]) for r in sample]
    return fit_model([t for t, _ in rows], [s for _, s in rows], _repeated(df, text, site, rows, min_rows) if rows else [])


def furniture_lines(df: DataFrame, keys: list[str], text: str, site: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keys`` and ``line_no`` (from 1) of every non-blank line that isn't the page's own content.

    The model is fitted on a bounded sample (``fitted``); every row is labelled, with all its lines.
    Null and empty texts have no lines; a null site shares no lines with others; other columns are dropped.
    """
    model = fitted(df, keys, text, site, sample_rows)
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.scale, model.offset, model.edges))
    d = df.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            got = [furniture(model, t) for t in batch.column("__text").to_pylist()]
            row = np.repeat(np.arange(len(got)), [len(g) for g in got])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), pa.array([x for g in got for x in g], pa.int32())], [*keys, "line_no"])

    return d.mapInArrow(run, ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys) + ", line_no int")


def main_content(df: DataFrame, keys: list[str], text: str, site: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keys`` and the text without its furniture, blank lines kept."""
    gone = furniture_lines(df, keys, text, site, sample_rows).groupBy(*keys).agg(F.collect_list("line_no").alias("__gone"))
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", (i + 1).cast("int")))
    return df.select(*keys, text).join(gone, keys, "left").select(*keys, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))
