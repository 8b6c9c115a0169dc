"""Splitting oversized texts at natural boundaries, by byte ranges.

Texts (or whole files) are seen as byte ranges with halos.  Each range finds the boundaries in its bytes
and follows the cuts from every place where a first piece of it may begin, which gives a table: from the
first start in this range to the first start in the next, and the pieces between.  The tables are stitched
along the text, prefix sums of their lengths and pieces place each range, and each range emits its pieces
by offset.  A table holds all that may come from the left, so the pieces are those of the whole text,
however long the ranges are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import materialise

LIMIT, OVERLAP = 1800, 220
RANGE_BYTES = 1 << 20
LEFT_BYTES = 1 << 10  # bytes before a range that tell what its first boundaries come after; a longer run of blanks counts as this much
BLOCK = 512  # tables that are stitched together before their blocks are
PIECES = "piece_no int, start_char long, end_char long, piece string"
TABLE = "range_no int, chars long, solid long, gaps long, exits array<int>, counts array<int>"
RANGE = "range_no int, left int, size int, first boolean, last boolean, reaches boolean, data binary"
#: The white space of Unicode as UTF-8, by length in bytes.
_WHITE1 = np.zeros(256, bool)
_WHITE1[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WHITE3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: Ends of sentences that need no white space after them, as UTF-8.
_STOP3 = np.array([0xE38082, 0xEFBC81, 0xEFBC9F])
_STOP1 = np.zeros(256, bool)
_STOP1[[ord(c) for c in ".!?;:"]] = True


def characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the characters, and which of them are white space, and which end a sentence (1: before white space, 2: anyway)."""
    at = np.flatnonzero((b & 0xC0) != 0x80)
    p = np.concatenate((b, np.zeros(3, np.uint8)))
    first = p[at]
    white, stop = _WHITE1[first], _STOP1[first].astype(np.int8)
    wide = first >= 0xC0
    if wide.any():
        w = at[wide]
        one, two = p[w + 1].astype(np.int64), p[w + 2].astype(np.int64)
        lead = first[wide].astype(np.int64)
        code3 = lead << 16 | one << 8 | two
        white[wide] = ((lead == 0xC2) & ((one == 0x85) | (one == 0xA0))) | np.isin(code3, _WHITE3)
        stop[wide] = 2 * np.isin(code3, _STOP3)
    return at, white, stop


def boundaries(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the characters; character index and strength of each boundary.

    Strength 4: after a blank line, 3: after a line, 2: after a sentence, 1: after white space.
    """
    at, white, stop = characters(b)
    n = len(at)
    if n < 2:
        return at, np.empty(0, np.int64), np.empty(0, np.int8)
    solid = np.maximum.accumulate(np.where(white, -1, np.arange(n)))
    after = np.flatnonzero((~white[1:] & white[:-1]) | ((stop[:-1] == 2) & ~white[1:])) + 1
    lines = np.cumsum(b[at] == 10)
    last = solid[after - 1]
    breaks = lines[after - 1] - np.where(last >= 0, lines[np.maximum(last, 0)], 0)
    ends = (last >= 0) & (stop[np.maximum(last, 0)] > 0)
    return at, after, np.where(breaks > 1, 4, np.where(breaks == 1, 3, np.where(ends, 2, 1))).astype(np.int8)


def next_piece(start: int, end: int, pos: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> tuple[int, int]:
    """End of the piece that begins at ``start``, and where the next one begins; -1 after the piece that ends the text at ``end``."""
    if end - start <= limit:
        return end, -1
    a, z = np.searchsorted(pos, (start + limit // 2, start + limit + 1))
    if z > a:
        s = strength[a:z]
        cut = int(pos[a + len(s) - 1 - int(np.argmax(s[::-1]))])
    else:
        a = np.searchsorted(pos, start + overlap + 1)
        cut = int(pos[z - 1]) if z > a else start + limit
    a, z = np.searchsorted(pos, (max(cut - overlap, start + 1), cut))
    return cut, int(pos[a]) if z > a else cut


class Section:
    """The characters of one range: ``data`` has ``left`` bytes of halo before its ``size`` bytes and a halo behind."""

    def __init__(self, data: bytes, left: int, size: int, reaches: bool, limit: int, overlap: int):
        self.data, self.limit, self.overlap = data, limit, overlap
        self.at, self.pos, self.strength = boundaries(np.frombuffer(data, np.uint8))
        self.edge = np.append(self.at, len(data))
        self.lo, self.hi = (int(x) for x in np.searchsorted(self.at, (left, left + size)))
        self.end = len(self.at) if reaches else len(self.at) + limit  # the text goes on beyond the halo
        self._next: dict[int, tuple[int, int]] = {}

    def step(self, start: int) -> tuple[int, int]:
        got = self._next.get(start)
        if got is None:
            got = self._next[start] = next_piece(start, self.end, self.pos, self.strength, self.limit, self.overlap)
        return got

    def entries(self) -> list[int]:
        """Where the first piece of a range that isn't the text's first may begin: at a boundary, or where all before it lacks one."""
        lo, stop, bare = self.lo, self.lo + self.limit, self.limit - self.overlap
        a, z = np.searchsorted(self.pos, (lo, stop))
        out = self.pos[a:z].tolist()
        # A piece cut at the limit has no boundary in its last ``bare`` characters, and none where its successor begins.
        edges = [int(self.pos[a - 1]) if a else lo - bare, *out, stop]
        for before, after in zip(edges, edges[1:]):
            out += range(max(lo, before + bare), after)
        return out

    def table(self, first: bool) -> tuple[list[int], list[int]]:
        """Of each place where the first piece may begin: where the next range's first one does (-1: nowhere), and the pieces between; -2 elsewhere."""
        memo: dict[int, tuple[int, int]] = {}
        entries = [self.lo] if first else self.entries()
        exits, counts = [-2] * (1 if first else self.limit), [0] * (1 if first else self.limit)
        for entry in entries:
            chain, at = [], entry
            while at not in memo and 0 <= at < self.hi:
                chain.append(at)
                at = self.step(at)[1]
            exit_, n = memo[at] if at in memo else (at if at < 0 else at - self.hi, 0)
            memo.setdefault(at, (exit_, n))
            for x in reversed(chain):
                n += 1
                memo[x] = exit_, n
            exits[entry - self.lo], counts[entry - self.lo] = memo[entry]
        return exits, counts

    def pieces(self, entry: int) -> list[tuple[int, int, bytes]]:
        """Pieces (start, end, bytes) that begin in the range; offsets count its characters."""
        out, at = [], self.lo + entry if entry >= 0 else -1
        while 0 <= at < self.hi:
            end, following = self.step(at)
            out.append((at - self.lo, end - self.lo, self.data[self.edge[at] : self.edge[end]]))
            at = following
        return out

    def lengths(self, first: bool, last: bool) -> tuple[int, int, int]:
        """Characters, those that aren't white space, and runs of white space that begin here, without those at the text's ends."""
        _, white, _ = characters(np.frombuffer(self.data, np.uint8))
        lo, hi = self.lo, self.hi
        if hi <= lo:
            return 0, 0, -int(last and hi > 0 and bool(white[hi - 1]))
        own = white[lo:hi]
        begins = own & ~np.concatenate(([lo > 0 and bool(white[lo - 1])], own[:-1]))
        return hi - lo, int((~own).sum()), int(begins.sum()) - int(first and bool(own[0])) - int(last and bool(own[-1]))


def split_text(text: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bytes]]:
    """Pieces (start, end, bytes) of one text, seen as one range; offsets count characters."""
    return Section(text, 0, len(text), True, limit, overlap).pieces(0)


def _right_bytes(limit: int) -> int:
    return 4 * (limit + 2)


def _keys(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _ranges(raw: bytes, range_bytes: int, limit: int) -> Iterator[tuple[int, int, int, bool, bool, bool, bytes]]:
    """``RANGE`` rows of one text."""
    for no, lo in enumerate(range(0, len(raw), range_bytes)):
        hi, left, stop = min(lo + range_bytes, len(raw)), min(lo, LEFT_BYTES), lo + range_bytes + _right_bytes(limit)
        yield no, left, hi - lo, lo == 0, hi == len(raw), stop >= len(raw), _aligned(raw[lo - left : stop], lo > left, stop < len(raw))


def _table_row(r: tuple, limit: int, overlap: int) -> tuple:
    no, left, size, first, last, reaches, data = r
    s = Section(data, left, size, reaches, limit, overlap)
    return no, *s.lengths(first, last), *s.table(first)


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]


_TABLE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_TABLE_NAMES = ["range_no", "chars", "solid", "gaps", "exits", "counts"]
_RANGE_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
_RANGE_NAMES = ["range_no", "left", "size", "first", "last", "reaches", "data"]


def section_tables(df: DataFrame, keys: list[str], text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``keys`` and the table of every range of every text: its lengths, and its exits and counts of pieces by entry."""
    d = df.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                got = [_table_row(r, limit, overlap) for r in _ranges((t or "").encode("utf-8", "surrogatepass"), range_bytes, limit)] or [(0, 0, 0, 0, [-1], [0])]
                row += [i] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in keys), *_columns(out, _TABLE_TYPES)], [*keys, *_TABLE_NAMES])

    return d.mapInArrow(run, f"{_keys(d, keys)}, {TABLE}")


def collapsed_lengths(df: DataFrame, keys: list[str], text: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``keys`` and ``n_chars``: characters left after each run of white space becomes one blank and the ends are trimmed.

    The lengths are sums over the section tables, exact whatever the ranges.  Null and empty texts have 0.
    """
    sums = section_tables(df, keys, text, range_bytes=range_bytes).groupBy(*keys).agg(F.sum("solid").alias("solid"), F.sum("gaps").alias("gaps"))
    return sums.select(*keys, F.when(F.col("solid") > 0, F.col("solid") + F.col("gaps")).otherwise(F.lit(0)).alias("n_chars"))


def _follow(t: pd.DataFrame, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exits and pieces of tables in a row, by entry."""
    at, n = entry.copy(), np.zeros(len(entry), np.int64)
    for exits, counts in zip(t["exits"], t["counts"]):
        on = at >= 0
        n[on] += np.asarray(counts)[at[on]]
        at[on] = np.asarray(exits)[at[on]]
    return at, n


def stitched(tables: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``keys``, ``range_no``, ``entry``, ``base`` (characters before) and ``before`` (pieces before) of every range.

    Blocks of ``BLOCK`` tables are put together first, then the blocks of a text are followed, then each
    block's ranges, so no task holds the tables of a whole file.
    """
    kinds = _keys(tables, keys)
    by = [*keys, "block"]
    tables = tables.withColumn("block", F.floor(F.col("range_no") / BLOCK).cast("int"))

    def together(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("range_no")
        at, n = _follow(t, np.arange(1 if t["range_no"].iloc[0] == 0 else limit))
        return pd.DataFrame([{**{k: t[k].iloc[0] for k in by}, "chars": int(t["chars"].sum()), "exits": at.astype(np.int32), "counts": n.astype(np.int32)}])

    def along(t: pd.DataFrame, no: str) -> pd.DataFrame:
        t = t.sort_values(no)
        at, base, before, out = int(t["entry"].iloc[0]), int(t["base"].iloc[0]), int(t["before"].iloc[0]), []
        for exits, counts, chars in zip(t["exits"], t["counts"], t["chars"]):
            out.append((at, base, before))
            base += int(chars)
            if at >= 0:
                before += int(counts[at])
                at = int(exits[at])
        e, b, f = zip(*out)
        return t[[*keys, no]].assign(entry=e, base=b, before=f)

    start = [F.lit(0).alias("entry"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("before")]
    blocks = tables.select(*by, "range_no", "chars", "exits", "counts").groupBy(*by).applyInPandas(together, f"{kinds}, block int, chars long, exits array<int>, counts array<int>")
    placed = blocks.select("*", *start).groupBy(*keys).applyInPandas(lambda t: along(t, "block"), f"{kinds}, block int, entry int, base long, before long")
    return tables.join(placed, by).groupBy(*by).applyInPandas(lambda t: along(t, "range_no"), f"{kinds}, range_no int, entry int, base long, before long")


def _pieces_of(ranges: DataFrame, keys: list[str], limit: int, overlap: int) -> DataFrame:
    """Pieces of ``RANGE`` rows: tables, stitched entries, then every range once more from its entry."""
    kinds = _keys(ranges, keys)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_table_row(tuple(r.values()), limit, overlap) for r in batch.select(_RANGE_NAMES).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *_columns(rows, _TABLE_TYPES)], [*keys, *_TABLE_NAMES])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, r in enumerate(batch.select([*_RANGE_NAMES, "entry", "base", "before"]).to_pylist()):
                got = Section(r["data"], r["left"], r["size"], r["reaches"], limit, overlap).pieces(r["entry"])
                row += [i] * len(got)
                out += [(r["before"] + j, r["base"] + s, r["base"] + e, p.decode("utf-8", "replace")) for j, (s, e, p) in enumerate(got)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in keys), *_columns(out, [pa.int32(), pa.int64(), pa.int64(), pa.string()])], [*keys, "piece_no", "start_char", "end_char", "piece"])

    tables = materialise(ranges.mapInArrow(table, f"{kinds}, {TABLE}"), "range-tables")
    placed = stitched(tables, keys, limit)
    return ranges.join(placed, [*keys, "range_no"]).select(*keys, *_RANGE_NAMES, "entry", "base", "before").mapInArrow(emit, f"{kinds}, {PIECES}")


def split_pieces(df: DataFrame, keys: list[str], text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``keys``, ``piece_no`` (from 0), ``start_char``, ``end_char`` and ``piece`` of every text.

    A piece has at most ``limit`` characters and ends at the strongest boundary in the second half of
    its room (blank line, line, sentence, white space), else at the last one before, else at the
    limit; the next begins at a boundary at most ``overlap`` characters earlier.  The pieces without
    their overlaps are the text.  Null and empty texts have no pieces.  ``keys`` must tell rows apart.
    The pieces don't depend on ``range_bytes``: a text of one range begins at entry 0 and needs no
    stitching, the ranges of a longer one are spread over the tasks.
    """
    d = df.select(*keys, F.col(text).alias("__text")).where(F.octet_length("__text") > 0)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                got = split_text(t.encode("utf-8", "surrogatepass"), limit, overlap)
                row += [i] * len(got)
                out += [(j, s, e, p.decode("utf-8", "replace")) for j, (s, e, p) in enumerate(got)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in keys), *_columns(out, [pa.int32(), pa.int64(), pa.int64(), pa.string()])], [*keys, "piece_no", "start_char", "end_char", "piece"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("__text").to_pylist()):
                for r in _ranges(t.encode("utf-8", "surrogatepass"), range_bytes, limit):
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in keys), *_columns([r], _RANGE_TYPES)], [*keys, *_RANGE_NAMES])

    kinds = _keys(d, keys)
    single = d.where(F.octet_length("__text") <= range_bytes).mapInArrow(one, f"{kinds}, {PIECES}")
    several = d.where(F.octet_length("__text") > range_bytes).mapInArrow(ranged, f"{kinds}, {RANGE}").repartition(*keys, "range_no")
    return single.unionByName(_pieces_of(several, keys, limit, overlap))


def _aligned(data: bytes, cut_left: bool, cut_right: bool) -> bytes:
    """The bytes of a range and its halos, parts of characters at its ends blanked out."""
    b = bytearray(data)
    if cut_left:
        for i in range(min(3, len(b))):
            if b[i] & 0xC0 != 0x80:
                break
            b[i] = 32
    if cut_right:
        for i in range(1, min(4, len(b)) + 1):
            if b[-i] < 0x80:
                break
            lead = b[-i] >= 0xC0
            b[-i] = 32
            if lead:
                break
    return bytes(b)


def split_files(spark: SparkSession, files: list[str], *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path`` and the pieces of each UTF-8 file; every task opens its file and reads one range with its halos."""
    from pyarrow import fs

    def ranges() -> Iterator[tuple]:
        for f in files:
            system, path = fs.FileSystem.from_uri(f)
            size = system.get_file_info(path).size
            for no, lo in enumerate(range(0, size, range_bytes)):
                yield f, no, lo, min(range_bytes, size - lo), size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(r["path"])
                lo, left = r["lo"], min(r["lo"], LEFT_BYTES)
                stop = lo + range_bytes + _right_bytes(limit)
                with system.open_input_file(path) as f:
                    f.seek(lo - left)
                    data = f.read(min(stop, r["whole"]) - lo + left)
                row = (r["range_no"], left, r["size"], lo == 0, lo + r["size"] == r["whole"], stop >= r["whole"], _aligned(data, lo > left, stop < r["whole"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), *_columns([row], _RANGE_TYPES)], ["path", *_RANGE_NAMES])

    listed = spark.createDataFrame(list(ranges()), "path string, range_no int, lo long, size int, whole long")
    listed = listed.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "range_no")
    return _pieces_of(listed.mapInArrow(read, f"path string, {RANGE}"), ["path"], limit, overlap)
