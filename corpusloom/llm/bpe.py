"""Byte-level BPE of a whole corpus with length-bucketed numpy matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces not met before by the worker are laid
out as padded matrices, one per length bucket.  In each round every row merges its leftmost pair of
minimum rank, found through a hashed pair table, and finished rows are compacted away.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

INF = np.int32(2**31 - 1)
LONG = 1024  # bytes; longer pieces go through a heap, whose cost isn't quadratic
CACHE = 400_000  # distinct pieces kept by a worker before it starts afresh
CHUNK = 4_000_000  # characters handled at once
MULT = np.uint64(0x9E3779B97F4A7C15)

_coders: dict[int, "NumpyBpe"] = {}


class NumpyBpe:
    def __init__(self, ranks_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines() if b"\n" in ranks_file else [ranks_file])}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, vals = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    vals.append(rank)
        self.pairs = dict(zip(keys, vals))
        self.bits = max(12, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_val = np.full(1 << self.bits, INF, np.int32)
        key, val = np.array(keys, np.int64), np.array(vals, np.int32)
        at, self.reach = self._hash(key), 0
        todo = np.arange(len(key))
        while len(todo):  # linear probing, all keys at once
            self.reach += 1
            free = self.slot_key[at[todo]] == -1
            cand = todo[free]
            slots, firsts = np.unique(at[cand], return_index=True)
            self.slot_key[slots], self.slot_val[slots] = key[cand[firsts]], val[cand[firsts]]
            done = np.zeros(len(key), bool)
            done[cand[firsts]] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.pattern = regex.compile(PATTERN)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * MULT >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, INF where it doesn't merge or a side is padding (-1)."""
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -2
        shape, key = key.shape, key.ravel()
        at = self._hash(key)
        out = np.full(len(key), INF, np.int32)
        found = self.slot_key[at]
        hit = found == key
        out[hit] = self.slot_val[at[hit]]
        todo = np.flatnonzero(~hit & (found != -1) & (key >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_val[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(shape)

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces as a padded matrix, and the number of ids in each row."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        tok = np.full((n, width), -1, np.int32)
        tok[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        done, left = np.full((n, width), -1, np.int32), size.copy()
        rows, cols = np.arange(n), np.arange(width)
        rank = self.lookup(tok[:, :-1], tok[:, 1:])
        while len(rows):
            at = rank.argmin(1)
            r = np.arange(len(rows))
            best = rank[r, at]
            over = best == INF
            if over.any():
                done[rows[over], : tok.shape[1]] = tok[over]
                rows, tok, rank, at, best = rows[~over], tok[~over], rank[~over], at[~over], best[~over]
                r = np.arange(len(rows))
                if not len(rows):
                    break
            tok[r, at] = best
            w = tok.shape[1]
            shift = np.minimum(cols[: w - 1] + (cols[: w - 1] > at[:, None]), w - 1)
            tok = np.take_along_axis(tok, shift, 1)
            left[rows] -= 1
            if w == 2:
                done[rows, :1] = tok
                break
            rank = np.take_along_axis(rank, np.minimum(cols[: w - 2] + (cols[: w - 2] >= at[:, None]), w - 2), 1)
            inner = at < w - 2
            rank[r[inner], at[inner]] = self.lookup(tok[r[inner], at[inner]], tok[r[inner], at[inner] + 1])
            before = at > 0
            rank[r[before], at[before] - 1] = self.lookup(tok[r[before], at[before] - 1], tok[r[before], at[before]])
        return done, left

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap of pairs."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else len(ids)
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = i
                if (q := get(r << 20 | ids[nxt[j]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[nxt[j]]))
            if prv[i] >= 0 and (q := get(ids[prv[i]] << 20 | r)) is not None:
                heapq.heappush(heap, (q, prv[i], ids[prv[i]], r))
        return [x for x, y in zip(ids, alive) if y]

    def learn(self, words: list[str]) -> None:
        """Encode distinct new pieces and remember them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        bucket = np.where(size > LONG, 0, np.maximum(2, np.where(size <= 16, size, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))))
        flats, order, lens = [self.flat], [], []
        for width in np.unique(bucket):
            at = np.flatnonzero(bucket == width)
            if width == 0:
                for i in at:
                    ids = self._heap(raw[i])
                    flats.append(np.array(ids, np.int32))
                    order.append(np.array([i]))
                    lens.append(np.array([len(ids)]))
                continue
            step = max(1, 4_000_000 // int(width))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                tok, n = self._matrix([raw[i] for i in part], int(width))
                flats.append(tok[np.arange(tok.shape[1]) < n[:, None]])
                order.append(part)
                lens.append(n)
        at, n, base = np.concatenate(order), np.concatenate(lens), len(self.known)
        first = len(self.flat) + np.concatenate(([0], np.cumsum(n)[:-1]))
        start, length = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        start[at], length[at] = first, n
        self.flat = np.concatenate(flats)
        self.start, self.length = np.concatenate((self.start, start)), np.concatenate((self.length, length))
        self.known.update(zip(words, range(base, base + len(words))))

    def _indices(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        counts = np.empty(len(texts), np.int64)
        find = self.pattern.findall
        for i, t in enumerate(texts):
            got = find(t) if t else ()
            counts[i] = len(got)
            words += got
        if len(self.known) > CACHE:
            self.reset()
        new = list(set(words) - self.known.keys())
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        at, counts = self._indices(texts)
        n = self.length[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, self._per_text(n, counts)

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, counts = self._indices(texts)
        return self._per_text(self.length[at], counts)

    @staticmethod
    def _per_text(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


def coder(ranks_file: bytes) -> NumpyBpe:
    """The worker's coder, built once a process."""
    key = hash(ranks_file)
    if key not in _coders:
        _coders.clear()
        _coders[key] = NumpyBpe(ranks_file)
    return _coders[key]


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        texts, lo, size = b.column(text).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > CHUNK:
                yield b.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, size = i + 1, 0
        if lo < len(texts):
            yield b.slice(lo), texts[lo:]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every row, without special tokens.

    A null or an empty text gives an empty list; the string of a special token is ordinary text.
    Repeated rows and null keys are kept; other columns are dropped.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value)
        for b, texts in _chunks(batches, text):
            ids, n = bpe.encode(texts)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns and the number of tokens of ``text`` (0 for a null or an empty text)."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    d = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value)
        for b, texts in _chunks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(bpe.count(texts), pa.int64())], [*keep, out])

    return d.mapInArrow(run, ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` long")
