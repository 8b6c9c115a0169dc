"""Pages: chunking, section extraction from HTML, links and the breadth-first crawl over a table of pages."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib import robotparser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as rules
from corpusloom.functions.constants import (
    CHUNK_CAP,
    CHUNK_CHARS,
    CHUNK_MIN,
    CHUNK_OVERLAP,
    LINKS_PER_PAGE,
    LOW_VALUE_MARKERS,
    LOW_VALUE_SECTIONS,
)
from corpusloom.functions.dialect import SPARK
from corpusloom.runtime import materialise

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
DROPPED = {"script", "style", "noscript", "svg", "nav", "footer", "form", "button", "aside"}
HEADINGS, TEXTS = {"h1", "h2", "h3"}, {"p", "pre", "li"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def squeeze(t: str | None) -> str:
    return " ".join((t or "").split())


def chunks(t: str | None, limit: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, cap: int | None = CHUNK_CAP) -> list[str]:
    """Whole sentences packed up to ``limit`` characters; each chunk begins with the end of its predecessor.

    Texts under 120 characters have no chunk, texts up to the limit are one.  A sentence over the
    limit stays whole; chunks under 120 characters are left out, though their end is carried on.
    """
    clean = squeeze(t)
    if len(clean) <= limit:
        return [clean] if len(clean) >= CHUNK_MIN else []
    out, held, size = [], [], 0

    def close() -> str:
        piece = " ".join(held).strip()
        if len(piece) >= CHUNK_MIN:
            out.append(piece)
        return piece

    for sentence in filter(None, map(str.strip, SENTENCE_END.split(clean))):
        if held and size + len(sentence) + 1 > limit:
            tail = close()[-overlap:]
            _, blank, rest = tail.partition(" ")
            tail = rest if blank else tail
            held, size = ([tail] if tail else []), len(tail)
        held.append(sentence)
        size += len(sentence) + 1
    close()
    return out[:cap]


def chunked(df: DataFrame, keys: list[str], text: str, limit: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, cap: int | None = CHUNK_CAP) -> DataFrame:
    """``keys``, ``chunk_no`` and ``chunk`` of every text, at most ``cap`` of a text (None: all); null texts have none."""
    d = df.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [chunks(t, limit, overlap, cap) for t in b.column("__text").to_pylist()]
            rows = [(i, n, c) for i, g in enumerate(got) for n, c in enumerate(g)]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [*keys, "chunk_no", "chunk"])

    return d.mapInArrow(run, ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys) + ", chunk_no int, chunk string")


class _Node:
    __slots__ = ("children", "tag")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.texts()

    def walk(self) -> Iterator["_Node"]:
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()

    def first(self, tag: str) -> "_Node | None":
        return next((n for n in self.walk() if n.tag == tag), None)


class _Tree(HTMLParser):
    """A plain tree; a close tag ends the nearest open element of its name, dropped elements vanish."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append(href)
        node = _Node(tag)
        if tag not in DROPPED:
            self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> _Tree:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t


def low_value(section: str, t: str) -> bool:
    name, body = squeeze(section).lower().strip("¶ "), squeeze(t).lower()
    return name in LOW_VALUE_SECTIONS or any(m in body for m in LOW_VALUE_MARKERS) or (len(body) < 260 and t.count("|") >= 3)


def sections(html: str | None, default_title: str) -> tuple[str, list[tuple[str, str]]]:
    """Title and (heading, text) blocks of 120 and more characters; the whole text where there is no block.

    An element inside another counts with both, as a paragraph in a list item does.
    """
    tree = parse(html).root
    root = tree.first("main") or tree.first("article") or tree.first("body") or tree
    t = tree.first("title")
    title = (" ".join(t.texts()).strip()[:300] if t else "") or default_title
    blocks, heading, held = [], title, []

    def flush():
        body = " ".join(held).strip()
        if len(body) >= CHUNK_MIN:
            blocks.append((heading, body))
        held.clear()

    for node in root.walk():
        if node.tag in HEADINGS:
            flush()
            heading = squeeze(" ".join(node.texts()))[:220] or heading
        elif node.tag in TEXTS and (body := squeeze(" ".join(node.texts()))):
            held.append(body)
    flush()
    return title, blocks or [(title, squeeze(" ".join(root.texts())))]


def page_documents(html: str | None, url: str, default_title: str) -> list[dict]:
    """Documents of a page: chunks of its sections without low-value and repeated ones."""
    title, blocks = sections(html, default_title)
    out, seen = [], set()
    for heading, body in blocks:
        if low_value(heading, body):
            continue
        for chunk in chunks(body):
            if low_value(heading, chunk) or (key := squeeze(chunk).lower()) in seen:
                continue
            seen.add(key)
            out.append({"title": (title if heading == title else f"{title} — {heading}")[:300], "text": chunk, "url": url, "source": f"trusted-docs:{urlsplit(url).netloc}"})
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """Documents (url, n, title, text, source) of pages (url, html); null HTML has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                path = urlsplit(url or "").path.strip("/") or urlsplit(url or "").netloc
                rows += [{"url": url, "n": n, "title": p["title"], "text": p["text"], "source": p["source"]} for n, p in enumerate(page_documents(html, url or "", path))] if html else []
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("url", pa.string()), ("n", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("source", pa.string())]))

    return pages.select("url", "html").mapInArrow(run, "url string, n int, title string, text string, source string")


def links(pages: DataFrame, limit: int = LINKS_PER_PAGE) -> DataFrame:
    """``url, link, place``: canonical links of each page in order, at most ``limit`` that are web pages and not localised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                for n, href in enumerate(parse(html).links if html else []):
                    try:
                        rows.append({"url": url, "raw": urljoin(url or "", href), "n": n})
                    except ValueError:
                        continue
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("url", pa.string()), ("raw", pa.string()), ("n", pa.int32())]))

    raw = pages.select("url", "html").mapInArrow(run, "url string, raw string, n int")
    link = raw.select("url", "n", F.expr(rules.canonical_url(SPARK, "raw")).alias("link")).where((F.col("link") != "") & ~F.expr(rules.localized(SPARK, "link")))
    place = F.row_number().over(Window.partitionBy("url").orderBy("n"))
    return link.select("url", "link", place.alias("place")).where(F.col("place") <= limit)


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Urls with ``allowed`` by their origin's rules (origin, rules): no or unreadable rules allow everything.

    Rules are one row per origin and joined, so a crawl of many origins needs no broadcast.
    """
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)

    @F.pandas_udf("boolean")
    def can(url, rules_text):
        cache, out = {}, []
        for u, r in zip(url, rules_text):
            if r not in cache:
                p = robotparser.RobotFileParser()
                p.parse((r or "").splitlines())
                cache[r] = p
            out.append(cache[r].can_fetch(agent, u))
        import pandas as pd

        return pd.Series(out)

    joined = urls.withColumn("origin", origin).join(robots, "origin", "left")
    return joined.withColumn("allowed", can("url", F.coalesce("rules", F.lit("")))).drop("rules", "origin")


def public_address(host: str) -> bool:
    """False for local names and literal addresses that aren't public; other names are for a resolver to judge."""
    if host in ("", "localhost", "localhost.localdomain"):
        return False
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return True
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast)


def crawl(spark: SparkSession, pages: DataFrame, seeds: list[str], max_pages: int = 100, max_depth: int = 2, same_domain: bool = True) -> tuple[DataFrame, dict]:
    """Breadth-first visit of ``pages`` (url, html, status, content_type) from ``seeds``: visited urls with depth, and counters.

    One join per level (three at most); the frontier keeps first-in first-out order by the parent's
    place and the link's place.  ``max_pages`` (100 at most) bounds the urls seen, skipped ones too.
    """
    max_pages, max_depth = max(1, min(100, max_pages)), max(0, min(3, max_depth))
    start = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "raw string, place long").select(F.expr(rules.canonical_url(SPARK, "raw")).alias("url"), F.struct(F.col("place").alias("a"), F.lit(0).alias("b")).alias("place"))
    hosts = {urlsplit(s).netloc.lower() for s in seeds}
    in_domain = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).isin(*hosts) if same_domain else F.lit(True)
    seen, frontier, counts = None, start.where("url <> ''"), {"seen": 0, "fetched": 0, "html_pages": 0, "skipped": 0}
    for depth in range(max_depth + 1):
        level = frontier.groupBy("url").agg(F.min("place").alias("place"))
        if seen is not None:
            level = level.join(seen.select("url"), "url", "left_anti")
        level = level.orderBy("place").limit(max_pages - counts["seen"]).withColumn("n", F.row_number().over(Window.orderBy("place")))  # at most 100 rows
        level = level.withColumn("ok", in_domain & ~F.expr(rules.localized(SPARK, "url")))
        level = materialise(level.join(pages.select("url", "html", "status", "content_type"), "url", "left").withColumn("depth", F.lit(depth)), f"crawl-{depth}")
        c = level.agg(F.count("*"), F.count_if(F.col("ok") & F.col("status").isNotNull()), F.count_if(F.col("ok") & (F.col("status") < 400) & F.contains(F.lower("content_type"), F.lit("text/html")))).first()
        counts["seen"] += c[0]
        counts["fetched"] += c[1]
        counts["html_pages"] += c[2]
        counts["skipped"] += c[0] - c[2]
        html = level.where(F.col("ok") & (F.col("status") < 400) & F.contains(F.lower("content_type"), F.lit("text/html")))
        visited = level.select("url", "depth", "n", "ok", "status")
        seen = visited if seen is None else seen.unionByName(visited)
        if counts["seen"] >= max_pages or not c[0] or depth == max_depth:
            break
        frontier = links(html).join(html.select("url", "n"), "url").select(F.col("link").alias("url"), F.struct(F.col("n").cast("long").alias("a"), F.col("place").alias("b")).alias("place")).where(in_domain)
    return seen, counts
