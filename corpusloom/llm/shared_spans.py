"""Long exact spans shared between records, by prefix-partitioned suffix groups.

Every window of ``span`` characters is assigned to the suffix that begins at its minimizer: the
leftmost k-gram of least hash in it, a choice that depends on the window's text alone.  Consecutive
windows with one minimizer form a super-window, about one per 90 characters.  Suffixes are partitioned
by prefixes of variable length: first by the 110 characters that all windows of a half of a
super-window have in common, and where more than one document has those, by the 189 characters that
twelve neighbouring windows have in common.  Within such a group the subtree's nodes of string depth
``span`` are told apart by the hashes of the edge labels that lead to them, and a node with suffixes of
two documents is a repeat.  The repeats of a document are joined to maximal stretches.

Groups whose rows repeat within an Arrow batch are settled there and send two rows of different
documents, so a passage that stands in a third of all documents reaches no task in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

GRAM = 20  # characters of the k-gram that anchors a suffix
FINE = 12  # neighbouring windows that share a group of the second partition
CHUNK = 1_000_000  # characters handled at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


class _Hashes:
    """Hashes of all substrings of a text, from prefix sums modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.inv = _powers(_INV, n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + _U(1)) * _powers(_BASE, n), dtype=np.uint64)))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.inv[lo]


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power_cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, np.uint64)
        step, done = _U(base), 1
        while done < size:  # doubling
            more = min(done, size - done)
            out[done : done + more] = out[:more] * step
            done += more
            with np.errstate(over="ignore"):
                step = step * step
        _power_cache[base] = have = out
    return have[:n]


def _windows_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values, by block prefix and suffix minima."""
    n = len(key)
    pad = (-n) % w
    b = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(b, 1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def super_windows(codes: np.ndarray, doc: np.ndarray, h: _Hashes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each super-window; ``doc`` is the document of each character."""
    n = len(codes)
    if n < span:
        e = np.empty(0, np.int64)
        return e, e, e
    at = np.arange(n - GRAM + 1)
    key = _mix(h.of(at, at + GRAM))
    key = key >> _U(21) << _U(21) | at.astype(np.uint64)  # ties: the leftmost; a chunk has fewer than 2**21 characters
    best = (_windows_min(key, span - GRAM + 1) & _U((1 << 21) - 1)).astype(np.int64)
    inside = doc[: n - span + 1] == doc[span - 1 :]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = new | ~inside
    ends = np.append(np.flatnonzero(stop), len(best))
    last = ends[np.searchsorted(ends, first, "right")] - 1
    return best[first], first, last


def _text_chunks(ids: list, texts: list[str | None], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole texts, or of parts of a long one overlapping by ``span`` - 1: codes, index, id and start of the texts."""
    group, size = [], 0

    def out(group):
        codes = np.frombuffer("".join(g[1] for g in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(g[1]) for g in group])
        return codes, np.repeat(np.arange(len(group)), n), np.array([g[0] for g in group], np.int64), np.array([g[2] for g in group], np.int64), np.cumsum(n) - n

    for i, t in zip(ids, texts):
        if i is None or t is None or len(t) < span:
            continue
        for lo in range(0, max(1, len(t) - span + 1), CHUNK):
            part = t[lo : lo + CHUNK + span - 1]
            if size + len(part) > CHUNK and group:
                yield out(group)
                group, size = [], 0
            group.append((i, part, lo))
            size += len(part)
    if group:
        yield out(group)


def _two_documents(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a key that two documents have; two rows of different documents for each such key."""
    shared, rep = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if not len(key):
        return shared, rep
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    begins = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    ends = np.append(begins[1:], len(k)) - 1
    many = d[begins] != d[ends]
    shared[order] = np.repeat(many, ends - begins + 1)
    rep[order[begins[many]]] = rep[order[ends[many]]] = True
    return shared, rep


def _groups(batches: Iterator[pa.RecordBatch], two: bool) -> Iterator[tuple]:
    """Rows sorted by ``k`` in parts that hold whole groups: k, doc, place, known, done, around.

    A group goes on into the next batch; it is held back until it ends.  With ``two``, as soon as it has two
    documents its rows are given out and two of them, of different documents, stay for the rest as ``done``.
    """
    held: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k, doc, place, known = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "doc", "place", "known"))
        around = np.array(b.column("around").to_pylist(), object) if not two else np.empty(n, object)
        now = (k, doc, place, known, np.zeros(n, bool), around)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        k, doc, done = now[0], now[1], now[4]
        tail = k == k[-1]
        other = tail & ~now[3] & (doc != doc[tail & ~now[3]][0]) if (tail & ~now[3]).any() else np.zeros(len(k), bool)
        if two and other.any():
            keep = np.array([np.flatnonzero(tail & ~now[3])[0], np.flatnonzero(other)[0]])
            yield now
            held = tuple(x[keep] for x in now)
            held = (*held[:4], np.ones(2, bool), held[5])
        else:
            held = tuple(x[tail] for x in now)
            if not tail.all():
                yield tuple(x[~tail] for x in now)
    if held is not None:
        yield held


def _depth_nodes(k: np.ndarray, doc: np.ndarray, place: np.ndarray, known: np.ndarray, around: np.ndarray, span: int) -> pa.RecordBatch:
    """The stretches of the suffixes that pass a node of depth ``span`` with two documents, of whole groups of the second partition."""
    p, n0, n1 = place >> 16, place >> 8 & 255, place & 255
    first, last = n0.copy(), n1.copy()
    todo = np.flatnonzero(~known)
    first[todo], last[todo] = 256, -1
    text = np.frombuffer(b"".join(around[todo]), np.uint32).reshape(len(todo), 2 * (FINE - 1)).astype(np.uint64)
    base = n0[todo] // FINE * FINE
    low, high = n0[todo] - base, n1[todo] - base
    left, right = [k[todo].view(np.uint64)], [np.zeros(len(todo), np.uint64)]
    for j in range(FINE - 1):  # labels of the edges, away from the common part
        left.append(_mix(left[-1] * _U(_BASE) + text[:, j] + _U(1)))
        right.append(_mix(right[-1] * _U(_BASE) + text[:, FINE - 1 + j] + _U(1)))
    for i in range(FINE):
        at = np.flatnonzero((low <= i) & (i <= high))
        node = _mix(left[i][at] + right[FINE - 1 - i][at] * _U(3))
        hit = at[_two_documents(node, doc[todo][at])[0]]
        rows, a = todo[hit], base[hit] + i
        first[rows] = np.minimum(first[rows], a)
        last[rows] = np.maximum(last[rows], a)
    ok = last >= 0
    return pa.RecordBatch.from_arrays([pa.array(doc[ok]), pa.array((p - last)[ok]), pa.array((p - first)[ok] + span)], ["doc", "s", "e"])


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200) -> DataFrame:
    """``key``, ``start_char``, ``end_char``: the maximal stretches that windows of ``span`` characters cover which another ``key`` has too.

    Offsets count code points.  Null, empty and short texts have no stretch; rows with a null key
    are left out; repeated rows of one key are one document; other columns are dropped.
    """
    if not GRAM + 4 * FINE <= span <= 255:
        raise ValueError("span must be from 68 to 255 characters")
    reach = span - GRAM  # largest offset of the anchor in a window
    half = reach // 2 + 1
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= span))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, doc, ids, starts, offsets in _text_chunks(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), span):
                h = _Hashes(codes)
                p, lo, hi = super_windows(codes, doc, h, span)
                a0, a1, who = p - hi, p - lo, doc[p]
                right, left = np.flatnonzero(a0 < half), np.flatnonzero(a1 >= half)
                k = np.concatenate((_mix(h.of(p[right], p[right] + span - half + 1)), _mix(h.of(p[left] - half, p[left] + GRAM) + _U(1))))
                sel = np.concatenate((right, left))
                n0 = np.concatenate((a0[right], np.maximum(a0[left], half)))
                n1 = np.concatenate((np.minimum(a1[right], half - 1), a1[left]))
                w = who[sel]
                place = (p[sel] - offsets[w] + starts[w]) << 16 | n0 << 8 | n1
                known, rep = _two_documents(k, ids[w])
                k = k.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(known & ~rep, _mix(place.view(np.uint64)).view(np.int64), k)), pa.array(ids[w]), pa.array(place), pa.array(known & ~rep)], ["k", "doc", "place", "known"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, doc, place, known, done, _ in _groups(batches, two=True):
            keep = known.copy()
            keep[~known] = _two_documents(k[~known], doc[~known])[0]
            keep &= ~done
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep])], ["doc", "place"])

    found = docs.mapInArrow(anchors, "k long, doc long, place long, known boolean").repartition("k").sortWithinPartitions("k").mapInArrow(candidates, "doc long, place long")
    found = materialise(found, "span-candidates").groupBy("doc").agg(F.collect_list("place").alias("places"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = (batch.column(c).to_pylist() for c in ("doc", "text", "places"))
            for lo, hi in _slices(texts):
                yield from _suffix_rows(ids[lo:hi], texts[lo:hi], places[lo:hi], span)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, two=False):
            yield _depth_nodes(*group[:4], group[5], span)

    around = docs.join(found, "doc").mapInArrow(suffixes, "k long, doc long, place long, known boolean, around binary").repartition("k").sortWithinPartitions("k").mapInArrow(repeats, "doc long, s long, e long")
    by = Window.partitionBy("doc").orderBy("s", "e")
    edge = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = around.select("doc", "s", "e", (edge.isNull() | (F.col("s") > edge)).cast("int").alias("new")).select("doc", "s", "e", F.sum("new").over(by).alias("run"))
    return runs.groupBy("doc", "run").agg(F.min("s").alias("start_char"), F.max("e").alias("end_char")).select(F.col("doc").alias(key), "start_char", "end_char")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _suffix_rows(ids: list, texts: list[str], places: list[list[int]], span: int) -> Iterator[pa.RecordBatch]:
    """One row for each group of the second partition that a candidate is in, with the characters round the common part."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts])
    offset, h = np.cumsum(size) - size, _Hashes(codes)
    n = np.array([len(p) for p in places])
    who = np.repeat(np.arange(len(ids)), n)
    place = np.array([x for p in places for x in p], np.int64)
    p, a0, a1 = (place >> 16) + offset[who], place >> 8 & 255, place & 255
    parts = a1 // FINE - a0 // FINE + 1
    row = np.repeat(np.arange(len(p)), parts)
    j = a0[row] // FINE + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    p, who, n0, n1 = p[row], who[row], np.maximum(a0[row], j * FINE), np.minimum(a1[row], j * FINE + FINE - 1)
    lo = p - j * FINE
    hi = lo + span - FINE + 1
    k = _mix(h.of(lo, hi) + j.astype(np.uint64) * _U(0x2545F4914F6CDD1D))
    steps = np.arange(FINE - 1)
    left, right = lo[:, None] - 1 - steps, hi[:, None] + steps
    padded = np.concatenate((codes, np.zeros(1, np.uint32)))
    around = np.concatenate((np.where(steps < (n1 - j * FINE)[:, None], padded[np.clip(left, 0, len(codes))], 0), np.where(steps < (FINE - 1 - (n0 - j * FINE))[:, None], padded[np.clip(right, 0, len(codes))], 0)), 1).astype(np.uint32)
    doc = np.array(ids, np.int64)[who]
    place = (p - offset[who]) << 16 | n0 << 8 | n1
    whole = k + n0.astype(np.uint64) * _U(0x632BE59BD9B4E019) + n1.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    for c in range(around.shape[1]):
        whole = _mix(whole * _U(_BASE) + around[:, c].astype(np.uint64) + _U(1))
    known, rep = _two_documents(whole, doc)
    for at, settled in ((np.flatnonzero(known), True), (np.flatnonzero(~known | rep), False)):
        if len(at):
            width = 0 if settled else around.shape[1] * 4
            raw = b"" if settled else np.ascontiguousarray(around[at]).tobytes()
            binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, width * (len(at) + 1), max(1, width), dtype=np.int32)[: len(at) + 1].tobytes() if width else np.zeros(len(at) + 1, np.int32).tobytes()), pa.py_buffer(raw)])
            route = _mix(place[at].view(np.uint64)).view(np.int64) if settled else k[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc[at]), pa.array(place[at]), pa.array(np.full(len(at), settled)), binary], ["k", "doc", "place", "known", "around"])
