"""Near-duplicate records by Order MinHash, for edits or for sets of k-mers.

A record's k-mers are its runs of ``k`` words.  Each of ``sketches`` random orders keeps the two least k-mers.
``ordered``: k-mers are labelled with their occurrence, the two are kept in the order of the text, and a banded
alignment of the labelled k-mers decides: records are alike when few edits lead from one to the other.  Else
k-mers count once and the two are kept as a set, wherever they stand: the sketch agrees with probability near the
squared share of common k-mers however the sections are arranged, and that exact share decides.

K-mers standing in more than ``common`` of all records (site furniture, found by lossy counting over every
record, at most mean length / ``common`` of them) are set aside before sketching, so that furniture doesn't make
candidates of all pairs of a site; records with more than ``1 - WHOLE`` of furniture are sketched with all their
k-mers too, of which ``PART`` sketches do for those with at most ``1 - MOSTLY``, whose pairs meet by the others as well.

Candidates pass sizes and bitmaps of their k-mers before any text moves: what one bitmap has and the other lacks
are k-mers that aren't common, so a pair is dropped only where the threshold is out of reach.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared_spans import _mix
from corpusloom.runtime import Owner, materialise, sifted, small_side

WORD = re.compile(r"[^\W_]+")
CHUNK = 1_500_000  # characters handled at once
STOP_SIZE = 2_000_000  # set-aside k-mers are at most this many: those above that share of all k-mers
CONTENT, MOSTLY, WHOLE = 0.4, 0.7, 0.92  # from the first share of k-mers left on, a record is sketched with these; below the last with all
PART = 24  # sketches of all k-mers between MOSTLY and WHOLE
CROWD = 64  # classes of a bucket from which it is split by a second sketch
BITS = 16  # words of 64 bits of a record's bitmap
_U = np.uint64
_M = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Hashes()


def _shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words of every text, and the text it belongs to, in text order."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.array([len(f) for f in found], np.int64)
    h = np.fromiter((_words[w] for f in found for w in f), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - k + 1
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = _mix(out * _M[1] + h[i : i + m] * _M[0] + _U(i + 1))
    inside = doc[:m] == doc[k - 1 :]
    return out[inside], doc[:m][inside]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _order(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by text and k-mer together, and which rows of it begin a new one."""
    both = _mix(g + doc.astype(np.uint64) * _M[1])
    order = np.argsort(both, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    return order, new


def _firsts(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the first occurrence of each k-mer in its text."""
    order, new = _order(g, doc)
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def _labelled(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """K-mers that are told apart by how often they have occurred in their text before."""
    order, new = _order(g, doc)
    if not len(order):
        return g
    begins = np.flatnonzero(new)
    label = np.empty(len(order), np.int64)
    label[order] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return np.where(label > 0, _mix(g + label.astype(np.uint64) * _M[2]), g)


def common_shingles(df: DataFrame, text: str, k: int, common: float) -> np.ndarray:
    """Sorted k-mers that occur about ``common`` times the number of records: counts of every batch, those under half the share left out.

    No more than ``STOP_SIZE`` k-mers can each have that share of all k-mers, which bounds the result whatever the lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = batch.column(0).to_pylist(), []
            for lo, hi in _chunks(texts):
                parts.append(_shingles(texts[lo:hi], k)[0])
            g, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = n >= max(8, common / 2 * len(texts))
            yield pa.RecordBatch.from_arrays([pa.array([None, *g[often].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64())], ["g", "n"])

    counts = materialise(df.select(text).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "common-runs")
    rows = df.count()
    total = counts.where("g IS NULL").first()
    least = max(8.0, common * rows, (total[1] if total else 0) / STOP_SIZE)
    return np.sort(np.array([r[0] for r in counts.where(F.col("g").isNotNull() & (F.col("n") >= least)).select("g").collect()], np.int64).view(np.uint64))


def _sketch(g: np.ndarray, doc: np.ndarray, docs: int, sketches: int, salt: int, ordered: bool) -> np.ndarray:
    """Matrix of sketches of each text's k-mers, texts and k-mers as they stand.  Rows without k-mers are 0."""
    out = np.zeros((docs, sketches), np.uint64)
    have = np.unique(doc)
    if not len(g):
        return out
    if len(g) >= 1 << 24:  # one giant text: the two least hashes by a full search
        for d in have:
            x = g[doc == d]
            for j in range(sketches):
                key = x * (_mix(np.array([j * 7919 + salt + 1], np.uint64))[0] | _U(1)) >> _U(24)
                one = int(key.argmin())
                key[one] = np.iinfo(np.uint64).max
                two = int(key.argmin()) if len(x) > 1 else one
                if ordered:
                    one, two = min(one, two), max(one, two)
                out[d, j] = _mix(x[[one]] * _M[0] + x[[two]] * _M[2] + _U(j * 2 + salt))[0]
        return out
    begins = np.searchsorted(doc, have)
    at = np.arange(len(g), dtype=np.uint64)
    top = _U(np.iinfo(np.uint64).max)
    low = _U((1 << 24) - 1)
    for j in range(sketches):
        key = g * (_mix(np.array([j * 7919 + salt + 1], np.uint64))[0] | _U(1)) & ~low | at  # k-mers are hashes already
        one = (np.minimum.reduceat(key, begins) & low).astype(np.int64)
        key[one] = top
        least = np.minimum.reduceat(key, begins)
        two = np.where(least == top, one, (least & low).astype(np.int64))
        if ordered:
            one, two = np.minimum(one, two), np.maximum(one, two)
        out[have, j] = _mix(g[one] * _M[0] + g[two] * _M[2] + _U(j * 2 + salt))
    return out


def _bitmaps(g: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Bitmap of each text's k-mers, ``BITS`` words a row."""
    bit = g >> _U(32)
    out = np.zeros((docs, BITS), np.uint64)
    np.bitwise_or.at(out.reshape(-1), doc * BITS + (bit % _U(64 * BITS) // _U(64)).astype(np.int64), _U(1) << bit % _U(64))
    return out


def sketch_records(df: DataFrame, keys: list[str], text: str, *, k: int, sketches: int, common: float, ordered: bool = False) -> DataFrame:
    """``keys``, ``sig`` (class of records with one set, or one sequence, of k-mers), ``n`` (its size), ``sketch`` and ``bits`` of every record with a k-mer."""
    stop = df.sparkSession.sparkContext.broadcast(common_shingles(df, text, k, common))
    d = df.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside = stop.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for lo, hi in _chunks(texts):
                m = hi - lo
                g, doc = _shingles(texts[lo:hi], k)
                plain = g
                if ordered:
                    g = _labelled(g, doc)
                else:
                    first = _firsts(g, doc)
                    plain = g = g[first]
                    doc = doc[first]
                n = np.bincount(doc, minlength=m)
                sig = np.zeros(m, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    begins = np.searchsorted(doc, some)
                    at = (np.arange(len(g)) - np.repeat(begins, n[some])).astype(np.uint64) if ordered else _U(0)
                    sig[some] = np.add.reduceat(_mix(g + _M[0] + at * _M[2]), begins)
                sig = _mix(sig + n.astype(np.uint64) * _M[1]).view(np.int64)
                rare = np.ones(len(g), bool)
                if len(aside) and len(g):
                    pos = np.minimum(np.searchsorted(aside, plain), len(aside) - 1)
                    rare = aside[pos] != plain
                share = np.bincount(doc[rare], minlength=m) / np.maximum(n, 1)
                content = rare & (share >= CONTENT)[doc]
                whole = (share < WHOLE)[doc]
                a = _sketch(g[content], doc[content], m, sketches, 0, ordered)
                b = _sketch(g[whole], doc[whole], m, sketches, 1_000_003, ordered)
                b[share >= MOSTLY, PART:] = 0
                rows = np.concatenate((a, b), 1)
                size = (rows != 0).sum(1)
                flat = rows[rows != 0].view(np.int64)
                keep = np.flatnonzero(n)
                bits = _bitmaps(g, doc, m)[keep].view(np.int64).reshape(-1)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * BITS), pa.array(bits))
                col = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))
                part = batch.slice(lo, m)
                take = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in keys), pa.array(sig[keep]), pa.array(n[keep].astype(np.int32)), col.take(take), bits], [*keys, "sig", "n", "sketch", "bits"])

    return d.mapInArrow(run, ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keys) + ", sig long, n int, sketch array<long>, bits array<long>")


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common chain of k-mers within ``band`` of the commonest diagonal (sparse banded alignment)."""
    where = {g: i for i, g in enumerate(b.tolist())}
    hits = [(i, j) for i, g in enumerate(a.tolist()) if (j := where.get(g)) is not None]
    if not hits:
        return 0
    d = np.array([j - i for i, j in hits])
    near = np.abs(d - int(np.median(d))) <= band
    tails: list[int] = []
    for (_, j), ok in zip(hits, near):
        if ok:
            at = bisect_left(tails, j)
            tails[at : at + 1] = [j]
    return len(tails)


def verified(pairs: DataFrame, k: int, threshold: float, band: int, ordered: bool = False) -> DataFrame:
    """Pairs (sig_a, sig_b, text_a, text_b) at the threshold: of the aligned share of the longer text if ``ordered``, else of the common share of both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = {c: batch.column(f"sig_{c}").to_pylist() for c in "ab"}
            where = {s: (c, i) for c in "ab" for i, s in enumerate(sig[c])}
            cols, order = {c: batch.column(f"text_{c}") for c in "ab"}, list(where)
            raw = [cols[where[s][0]][where[s][1]].as_py() for s in order]
            runs = {}
            for lo, hi in _chunks(raw):
                g, doc = _shingles(raw[lo:hi], k)
                if ordered:
                    g = _labelled(g, doc)
                else:
                    by = np.lexsort((g, doc))
                    g, doc = g[by], doc[by]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
                    g, doc = g[new], doc[new]
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i, s in enumerate(order[lo:hi]):
                    runs[s] = g[at[i] : at[i + 1]]
            out = ([], [], [])
            for a, b in zip(sig["a"], sig["b"]):
                x, y = runs[a], runs[b]
                if not len(x) or not len(y):
                    continue
                if ordered:
                    share = _aligned(x, y, band) / max(len(x), len(y))
                else:
                    both = int((y[np.minimum(y.searchsorted(x), len(y) - 1)] == x).sum())
                    share = both / (len(x) + len(y) - both)
                if share >= threshold:
                    for o, v in zip(out, (a, b, share)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["sig_a", "sig_b", "similarity"])

    return pairs.mapInArrow(run, "sig_a long, sig_b long, similarity double")


def candidates(classes: DataFrame, agreeing: int) -> DataFrame:
    """Pairs (a, b) of classes (sig, sketch) that agree in ``agreeing`` sketches.

    Most sketches stand alone and are left out first.  A bucket of up to ``CROWD`` classes gives its pairs.
    A larger one is split by every other sketch of its members that doesn't stand alone, so that unrelated
    classes which meet in it make no pairs; the pair's number of agreements is then that of the parts it
    shares, and one.
    """
    each = classes.select("sig", F.explode("sketch").alias("h"))
    buckets = materialise(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    members = materialise(each.join(small_side(buckets, buckets.count(), 24), "h"), "members")

    def met(rows: DataFrame, by: list[str]) -> DataFrame:
        a, b = (rows.select(*by, F.col("sig").alias(x)) for x in "ab")
        return a.join(b, by).where("a < b")

    agreed = met(members.where(F.col("c") <= CROWD), ["h"]).groupBy("a", "b").agg(F.count("*").alias("agree"))
    crowd = members.where(F.col("c") > CROWD).select("h", "sig")
    if not crowd.isEmpty():
        parts = crowd.join(members.select("sig", F.col("h").alias("g")), "sig").where("g <> h")
        shared = parts.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").select("h", "g")
        split = met(materialise(parts.join(shared, ["h", "g"]), "split"), ["h", "g"]).groupBy("h", "a", "b").agg((F.count("*") + 1).alias("agree"))
        agreed = agreed.unionByName(split.select("a", "b", "agree")).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    return agreed.where(F.col("agree") >= agreeing).select("a", "b")


def _reachable(threshold: float, ordered: bool) -> Column:
    """Whether sizes and bitmaps of ``a`` and ``b`` leave room for the threshold, by the quotient that decides."""
    n = {x: F.col(f"n_{x}") - sum((F.bit_count(F.col(f"bits_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[i]))) for i in range(BITS)), F.lit(0)) for x, y in ("ab", "ba")}
    both = F.least(n["a"], n["b"]).cast("double")
    return both / (F.greatest("n_a", "n_b") if ordered else F.col("n_a") + F.col("n_b") - both) >= threshold


class NearDuplicates:
    """``members``: keys and class of each record; ``links``: pairs of different classes at the threshold.

    Records of one class have the same set of k-mers (``ordered``: the same k-mers in a row).  Records with fewer
    than ``k`` words, null and empty texts have no k-mer and are in no class.  ``keys`` must tell rows apart.

    Pairs are candidates when at least ``agreeing`` of the ``sketches`` agree.  By the law of the sketches, a
    pair of sets at similarity 0.6 is missed with probability 2.4e-6 at most, whatever the order of its sections
    and however much of it is set aside.  A record with a single k-mer has the same sketches as its equals,
    which are of its class anyway.
    """

    def __init__(self, df: DataFrame, keys: list[str], text: str, *, k: int = 5, threshold: float = 0.8, ordered: bool = False, sketches: int = 48, agreeing: int = 3, common: float = 0.005, band: int = 256):
        sketched = materialise(sketch_records(df, keys, text, k=k, sketches=sketches, common=common, ordered=ordered), "sketches")
        self.members = sketched.select(*keys, "sig", "n")
        with Owner() as between:
            pairs, wanted = self._pairs(sketched, keys, agreeing, threshold, ordered)
            texts = sifted(df.select(*keys, F.col(text).alias("text")), wanted, keys, wanted.count()).select("sig", "text")
        both = pairs.select(F.col("a").alias("sig_a"), F.col("b").alias("sig_b")).join(texts.select(F.col("sig").alias("sig_a"), F.col("text").alias("text_a")), "sig_a").join(texts.select(F.col("sig").alias("sig_b"), F.col("text").alias("text_b")), "sig_b")
        self.links = materialise(verified(both, k, threshold, band, ordered), "links")
        between.free()

    @staticmethod
    def _pairs(sketched: DataFrame, keys: list[str], agreeing: int, threshold: float, ordered: bool) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of classes whose texts must be compared, and ``sig`` and ``keys`` of a record of each of these."""
        several = sketched.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct(*keys)).alias("first")).where("c > 1").select("sig", "first")
        several = materialise(several, "several")
        # One record stands for a class; most are alone in theirs, so no sketch is shuffled for it.
        classes = sketched.join(small_side(several, several.count(), 100), "sig", "left").where(F.col("first").isNull() | F.struct(*keys).eqNullSafe(F.col("first")))
        met = materialise(candidates(classes.select("sig", "sketch"), agreeing), "candidates")

        def ends(pairs: DataFrame) -> DataFrame:
            return pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()

        some = materialise(ends(met), "ends")
        many = some.count()
        known = materialise(classes.join(small_side(some, many, 16), "sig", "left_semi").select("sig", *keys, "n", "bits"), "ends-known")
        for x in "ab":
            met = met.join(small_side(known.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), many, 32 + 8 * BITS), x)
        pairs = materialise(met.where(_reachable(threshold, ordered)).select("a", "b"), "pairs")
        some = ends(pairs)
        return pairs, materialise(known.select("sig", *keys).join(some, "sig", "left_semi"), "wanted")

    def pairs(self, key: str) -> DataFrame:
        """Every pair of different values of ``key`` whose records are alike, the smaller first."""
        who = self.members.select("sig", key).distinct()
        a, b = (who.select(F.col("sig").alias(f"sig_{x}"), F.col(key).alias(f"{key}_{x}")) for x in "ab")
        far = self.links.select("sig_a", "sig_b").join(a, "sig_a").join(b, "sig_b")
        same = a.join(b, F.col("sig_a") == F.col("sig_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
        out = far.select(f"{key}_a", f"{key}_b").where(F.col(f"{key}_a") != F.col(f"{key}_b"))
        out = out.select(F.least(f"{key}_a", f"{key}_b").alias(f"{key}_a"), F.greatest(f"{key}_a", f"{key}_b").alias(f"{key}_b"))
        return out.unionByName(same.select(f"{key}_a", f"{key}_b")).distinct()

    def groups(self, key: str) -> DataFrame:
        """``key``, ``group_id`` and ``links`` (records of other classes it is alike to) of every record with a k-mer."""
        degree = self.links.select(F.col("sig_a").alias("sig")).unionAll(self.links.select(F.col("sig_b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("links"))
        label = components(self.links.select("sig_a", "sig_b"))
        return self.members.join(label, "sig", "left").join(degree, "sig", "left").groupBy(key).agg(F.min(F.coalesce("label", "sig")).alias("group_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))


def components(links: DataFrame) -> DataFrame:
    """``sig`` and ``label`` (least sig of its connected component), by alternating large and small stars.

    Every round is written to the shared folder; hub nodes only ever meet partial aggregates.
    """
    edges = links.toDF("u", "v").where("u <> v").distinct()
    last = None
    while True:
        sym = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    label = edges.groupBy("u").agg(F.min("v").alias("label"))
    roots = label.select(F.col("label").alias("u"), "label").distinct()
    return label.unionByName(roots).distinct().withColumnRenamed("u", "sig")
