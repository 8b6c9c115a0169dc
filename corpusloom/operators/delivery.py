"""Exactly-once view of an at-least-once delivery log.

An index of sorted 128-bit identifiers is kept as immutable runs in the shared folder, split by hash
prefix.  Each incoming batch is deduplicated locally per Arrow batch (so a hot identifier reaches the
shuffle once per batch of rows), moved to its prefix, deduplicated there, and binary-searched in the
runs of that prefix only; a task holds one prefix at a time.  The loser of every meeting, incoming or
displaced, is emitted once.  Runs are merged by tiers: ``fanout`` runs of a tier become one of the next,
so an identifier is rewritten as often as there are tiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import scratch

ROW = "prefix int, key binary, attempt long, created long, delivery_id long, lost boolean"
RUN = "key binary, attempt long, created long, delivery_id long, prefix int, kind int, part int"
#: Folders of a run: prefixes beyond this number share one and are told apart by the row groups' bounds.
FOLDERS = 256
LAST = np.iinfo(np.int64).max


def message_key(event_id: Column) -> Column:
    """Identifier without surrounding white space and letter case."""
    return F.lower(F.regexp_replace(event_id, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def _columns(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    col = batch.column("key")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    key = np.array(col.to_pylist(), dtype="S16") if len(col) else np.empty(0, "S16")
    return (key, *(np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy(), dtype=np.int64) for c in ("attempt", "created", "delivery_id")))


def _firsts(key, attempt, created, delivery):
    """Sort order, and a mask over it of the winning row of each key."""
    order = np.lexsort((delivery, created, attempt, key))
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    return order, first


def _bytes(key: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(key).tobytes()
    offsets = np.arange(0, 16 * len(key) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _prefix(key: np.ndarray, bits: int) -> np.ndarray:
    head = np.frombuffer(np.ascontiguousarray(key).tobytes(), np.uint8).reshape(-1, 16)[:, :4]
    return (np.ascontiguousarray(head).view(">u4").ravel() >> (32 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)


def _part(prefix: np.ndarray | int, bits: int):
    """Folder of a prefix."""
    return prefix >> max(0, bits - FOLDERS.bit_length() + 1)


def _read_runs(runs: list[str], prefix: int, bits: int):
    """Sorted identifiers of a prefix in each run, from the row groups that may have it."""
    from pyarrow import compute as pc
    from pyarrow import fs
    from pyarrow import parquet as pq

    for run in runs:
        system, path = fs.FileSystem.from_uri(run)
        for info in system.get_file_info(fs.FileSelector(f"{path}/kind=1/part={_part(prefix, bits)}", allow_not_found=True)):
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                at = file.schema_arrow.get_field_index("prefix")
                bounds = [file.metadata.row_group(g).column(at).statistics for g in range(file.num_row_groups)]
                groups = [g for g, b in enumerate(bounds) if b is None or not b.has_min_max or b.min <= prefix <= b.max]
                t = file.read_row_groups(groups, ["key", "attempt", "created", "delivery_id", "prefix"])
                yield _columns(t.filter(pc.equal(t.column("prefix"), prefix)))


def _by_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by prefix, one prefix at a time."""
    held, now = [], None
    for b in batches:
        p = b.column("prefix").to_numpy()
        cuts = np.flatnonzero(np.diff(p)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(p)]):
            if hi == lo:
                continue
            if held and p[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(p[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


class DeliveryIndex:
    """Persistent identifier index; ``ingest`` returns the delivery ids that a batch makes redundant.

    Nulls: a null identifier is never a copy and is not indexed; a null attempt or time sorts last.
    Rows that tie in all three order columns are told apart by ``delivery_id``.  Empty batches are
    allowed.  Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, prefix_bits: int = 6, fanout: int = 3):
        """Opens the index in ``path``, with the runs that are complete there; a new one where there is none."""
        self.spark, self.bits, self.fanout = spark, prefix_bits, max(2, fanout)
        self.path = path or scratch(spark, "delivery-index")
        # A run is named by its tier and the batches it covers; one that a merge has taken in lies within the merged one.
        self.runs: list[tuple[int, int, int]] = []
        for tier, first, last in sorted(self._complete(), key=lambda r: (r[1], -r[2], -r[0])):
            if not self.runs or last > self.runs[-1][2]:
                self.runs.append((tier, first, last))

    def _complete(self) -> Iterator[tuple[int, int, int]]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        for f in fs.listStatus(root) if fs.exists(root) else []:
            name = f.getPath().getName()
            if name.startswith("run-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                yield tuple(int(x) for x in name.split("-")[1:])

    def _run(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]:09d}-{run[2]:09d}"

    @staticmethod
    def bits_for(rows: int, per_prefix: int = 2_000_000) -> int:
        """Prefix bits so that one prefix holds about ``per_prefix`` identifiers (at least 16 prefixes)."""
        return min(20, max(4, int(np.ceil(np.log2(max(1, rows) / per_prefix)))))

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Indexes a batch and returns the delivery ids that it makes redundant."""
        self._merge()
        bits, runs = self.bits, [self._run(r) for r in self.runs]
        rows = batch.where(F.col("event_id").isNotNull()).select(
            F.unhex(F.substring(F.sha2(message_key(F.col("event_id")), 256), 1, 32)).alias("key"),
            F.coalesce(F.col("attempt").cast("long"), F.lit(int(LAST))).alias("attempt"),
            F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(int(LAST))).alias("created"),
            F.col("delivery_id").cast("long").alias("delivery_id"),
        )

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, att, cre, did = _columns(b)
                if not len(key):
                    continue
                order, first = _firsts(key, att, cre, did)
                prefix = np.where(first, _prefix(key[order], bits), (did[order] & ((1 << bits) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(prefix, pa.int32()), _bytes(key[order]), pa.array(att[order]), pa.array(cre[order]), pa.array(did[order]), pa.array(~first)], ["prefix", "key", "attempt", "created", "delivery_id", "lost"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p, t in _by_prefix(batches):
                lost = t.column("lost").to_numpy()
                key, att, cre, did = _columns(t)
                keep = ~lost
                yield _out(key[lost], att[lost], cre[lost], did[lost], 0, p, bits)
                key, att, cre, did = key[keep], att[keep], cre[keep], did[keep]
                order, first = _firsts(key, att, cre, did)
                key, att, cre, did = key[order], att[order], cre[order], did[order]
                again = ~first
                yield _out(key[again], att[again], cre[again], did[again], 0, p, bits)
                k, best = key[first], [x[first] for x in (att, cre, did)]
                old = [np.full(len(k), LAST) for _ in range(3)]
                seen = np.zeros(len(k), bool)
                for rk, *rv in _read_runs(runs, p, bits):
                    if not len(rk):
                        continue
                    pos = np.minimum(np.searchsorted(rk, k), len(rk) - 1)
                    hit = rk[pos] == k
                    got = [np.where(hit, v[pos], LAST) for v in rv]
                    better = hit & (~seen | _less(got, old))
                    old = [np.where(better, g, o) for g, o in zip(got, old)]
                    seen |= hit
                wins = ~seen | _less(best, old)
                beaten, displaced = ~wins, wins & seen
                yield _out(k[beaten], best[0][beaten], best[1][beaten], best[2][beaten], 0, p, bits)
                yield _out(k[displaced], old[0][displaced], old[1][displaced], old[2][displaced], 0, p, bits)
                yield _out(k[wins], best[0][wins], best[1][wins], best[2][wins], 1, p, bits)

        spread = max(1, min(1 << bits, max(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * self.spark.sparkContext.defaultParallelism)))
        number = self.runs[-1][2] + 1 if self.runs else 0
        run = (0, number, number)
        self._write(rows.mapInArrow(local, ROW).repartition(spread, "prefix").sortWithinPartitions("prefix").mapInArrow(search, RUN), run)
        self.runs.append(run)
        return self._dropped(self._run(run))

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        rows.sortWithinPartitions("kind", "part", "prefix", "key").write.mode("overwrite").option("parquet.block.size", 16 << 20).partitionBy("kind", "part").parquet(self._run(run))

    def _merge(self) -> None:
        """Merges the newest ``fanout`` runs of one tier into one of the next, as long as there are so many."""
        while len(self.runs) >= self.fanout and len({r[0] for r in self.runs[-self.fanout :]}) == 1:
            taken, bits = self.runs[-self.fanout :], self.bits
            paths = [self._run(r) for r in taken]

            def merge(batches: Iterator[pa.RecordBatch], paths=paths, bits=bits) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for p in b.column(0).to_pylist():
                        parts = list(_read_runs(paths, p, bits))
                        if parts:
                            key, att, cre, did = (np.concatenate(c) for c in zip(*parts))
                            order, first = _firsts(key, att, cre, did)
                            o = order[first]
                            yield _out(key[o], att[o], cre[o], did[o], 1, p, bits)

            n, run = 1 << bits, (taken[0][0] + 1, taken[0][1], taken[-1][2])
            self._write(self.spark.range(0, n, 1, min(n, 4 * self.spark.sparkContext.defaultParallelism)).mapInArrow(merge, RUN), run)
            self.runs = [*self.runs[: -self.fanout], run]

    def _dropped(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path).where("kind = 0").select("delivery_id")


def _less(a, b) -> np.ndarray:
    out = a[2] < b[2]
    for x, y in ((a[1], b[1]), (a[0], b[0])):
        out = (x < y) | ((x == y) & out)
    return out


def _out(key, att, cre, did, kind: int, prefix: int, bits: int) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays([_bytes(key), pa.array(att, pa.int64()), pa.array(cre, pa.int64()), pa.array(did, pa.int64()), *(pa.array(np.full(n, x, np.int32)) for x in (prefix, kind, _part(prefix, bits)))], ["key", "attempt", "created", "delivery_id", "prefix", "kind", "part"])


def redundant_deliveries(events: DataFrame, rounds: int = 4) -> DataFrame:
    """Delivery ids of every row but the best of its message, ingesting the log in ``rounds`` ranges of ``batch_no``."""
    spark = events.sparkSession
    lo, hi, n = events.agg(F.min("batch_no"), F.max("batch_no"), F.count("*")).first()
    index = DeliveryIndex(spark, prefix_bits=DeliveryIndex.bits_for(n))
    lo, hi = lo or 0, hi or 0
    step = max(1, -(-(hi - lo + 1) // rounds))
    out = None
    for i, a in enumerate(range(lo, hi + 1, step)):
        part = events.where((F.col("batch_no") >= a) & (F.col("batch_no") < a + step) | (F.col("batch_no").isNull() if i == 0 else F.lit(False)))
        dropped = index.ingest(part)
        out = dropped if out is None else out.unionByName(dropped)
    return out


def exactly_once(events: DataFrame, rounds: int = 4) -> DataFrame:
    """The rows of ``events`` that stay: one of each message, and all rows without an identifier."""
    return events.join(redundant_deliveries(events, rounds), "delivery_id", "left_anti")
