"""Durable document store: identities, first-wins dedup, keyed upsert, page replacement and versions.

A store row is shard_id, document_id, title, body, url, source, content_hash, indexed_at.  Conflicts
are settled on (shard_id, content_hash).  All operators return new DataFrames; nothing is changed in
place, and ``VersionedStore`` swaps a pointer after a complete write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text
from corpusloom.functions.dialect import SPARK
from corpusloom.runtime import numbered

STORE = T.StructType([T.StructField(c, T.TimestampType() if c == "indexed_at" else T.StringType()) for c in ("shard_id", "document_id", "title", "body", "url", "source", "content_hash", "indexed_at")])
ROW = [f.name for f in STORE]
KEY = ["shard_id", "content_hash"]


def store_rows(incoming: DataFrame, shards: list[str]) -> DataFrame:
    """Incoming documents (input_id, title, text, url, source, received_at) as store rows with their owner shard.

    A null text counts as empty, a null source as ``manual``; the title is trimmed, the text's white
    space collapsed and its case kept.
    """
    t = "coalesce(text, '')"
    h = incoming.withColumn("content_hash", F.expr(text.content_hash(SPARK, t)))
    key = F.expr("CASE WHEN length(url) > 0 THEN url ELSE content_hash END")
    return h.withColumn("k", key).select(
        "input_id",
        F.expr(text.rendezvous(SPARK, "k", shards)).alias("shard_id"),
        F.substring("content_hash", 1, 16).alias("document_id"),
        F.expr(SPARK.strip("title")).alias("title"),
        F.expr(SPARK.collapse(t)).alias("body"),
        "url",
        F.coalesce("source", F.lit("manual")).alias("source"),
        "content_hash",
        F.col("received_at").alias("indexed_at"),
    )


def first_wins(rows: DataFrame, order: str = "input_id") -> DataFrame:
    """One row per (shard_id, content_hash), the first by ``order``: an aggregate, so a text that a third of the rows share costs no skew."""
    rest = [c for c in rows.columns if c not in (*KEY, order)]
    best = rows.groupBy(*KEY).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("r"), F.count("*").alias("copies"))
    return best.select(*KEY, "r.*", "copies")


def new_rows(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose (shard_id, content_hash) the store hasn't, whatever the letter case of its hashes: a left anti join on the hash, which spreads evenly."""
    return first_wins(rows).join(_folded(store).select(*KEY).distinct(), KEY, "left_anti")


def _folded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content_hash", F.lower("content_hash"))


def upsert(store: DataFrame, rows: DataFrame, order: str = "input_id") -> DataFrame:
    """The store after writing ``rows`` in order: the last row of a key replaces all other columns."""
    rest = [c for c in ROW if c not in KEY]
    last = _folded(rows).groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*KEY, "r.*")
    gone = last.select(F.col("shard_id").alias("__s"), F.col("content_hash").alias("__h"))
    kept = store.join(gone, (F.col("shard_id") == F.col("__s")) & (F.lower("content_hash") == F.col("__h")), "left_anti")
    return kept.select(*ROW).unionByName(last.select(*ROW))


def replace_slices(store: DataFrame, rows: DataFrame, order: str = "input_id") -> DataFrame:
    """The store after deleting every (shard_id, url) that ``rows`` has and writing ``rows``; a null url deletes nothing."""
    slices = rows.where("url IS NOT NULL").select("shard_id", "url").distinct()
    return upsert(store.join(slices, ["shard_id", "url"], "left_anti"), rows, order)


def replace_urls(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """``url, added, skipped, removed, unchanged`` of replacing each incoming url, each on its own.

    A url is unchanged when the sets of (hash, title, source) agree.  Otherwise its old rows go, and
    an incoming text is added once unless another url has it.  Rows without a url are rejected.
    """
    inc = incoming.where(F.length("url") > 0).select("url", "content_hash", "title", "source")
    old = store.where(F.length("url") > 0).select("url", F.lower("content_hash").alias("content_hash"), F.expr(SPARK.strip("title")).alias("title"), "source")
    sig = ["url", "content_hash", "title", "source"]
    a, b = inc.select(*sig).distinct(), old.select(*sig).distinct()
    same = a.withColumn("i", F.lit(1)).withColumn("o", F.lit(0)).unionByName(b.withColumn("i", F.lit(0)).withColumn("o", F.lit(1)))
    same = same.groupBy(*sig).agg(F.max("i").alias("i"), F.max("o").alias("o")).groupBy("url").agg((F.min("i") == 1).alias("all_in"), (F.min("o") == 1).alias("all_old"), F.sum("i").alias("n_in"))
    owners = store.select(F.lower("content_hash").alias("content_hash"), F.coalesce("url", F.lit("")).alias("u")).distinct().groupBy("content_hash").agg(F.count("*").alias("owners"), F.min("u").alias("owner"))
    fresh = inc.select("url", "content_hash").distinct().join(owners, "content_hash", "left").groupBy("url").agg(F.sum(F.when(F.col("owners").isNull() | ((F.col("owners") == 1) & (F.col("owner") == F.col("url"))), 1).otherwise(0)).alias("fresh"))
    items = inc.groupBy("url").agg(F.count("*").alias("items"))
    gone = old.groupBy("url").agg(F.count("*").alias("old_rows"))
    j = items.join(same, "url").join(fresh, "url").join(gone, "url", "left").withColumn("unchanged", F.col("all_in") & F.col("all_old") & (F.coalesce("old_rows", F.lit(0)) == F.col("n_in")))
    return j.select("url", F.when(F.col("unchanged"), 0).otherwise(F.col("fresh")).cast("long").alias("added"), F.when(F.col("unchanged"), F.col("items")).otherwise(F.col("items") - F.col("fresh")).cast("long").alias("skipped"), F.when(F.col("unchanged"), 0).otherwise(F.coalesce("old_rows", F.lit(0))).cast("long").alias("removed"), "unchanged")


def micro_batches(rows: DataFrame, size: int = 25, order: str = "input_id") -> DataFrame:
    """``batch`` of each row: slices of ``size`` rows of a shard in order."""
    return numbered(rows, ["shard_id"], [order], "n").withColumn("batch", F.floor(F.col("n") / size).cast("long"))


def ingest_outcome(batched: DataFrame, failures: str, retries: int = 2, order: str = "input_id") -> DataFrame:
    """``shard_id, batches, failed, attempts, added, skipped`` of writing micro-batches to shards that refuse now and then.

    ``failures`` tells how often the write of a batch (``shard_id``, ``batch``) fails; it is tried ``retries`` times
    more.  A batch that fails to the end is left out, and all its documents count as skipped; of the others a
    text is added once, by its first row, and skipped from then on.
    """
    f = batched.withColumn("__failures", F.greatest(F.expr(failures).cast("int"), F.lit(0)))
    lost = F.col("__failures") > retries
    each = f.groupBy("shard_id", "batch").agg(F.first("__failures").alias("__failures"), F.count("*").alias("n"))
    batches = each.groupBy("shard_id").agg(F.count("*").alias("batches"), F.count_if(lost).alias("failed"), F.sum(F.least(F.col("__failures") + 1, F.lit(retries + 1))).alias("attempts"), F.sum("n").alias("n"))
    added = f.where(~lost).groupBy(*KEY).agg(F.count("*").alias("copies")).groupBy("shard_id").agg(F.count("*").alias("added"))
    out = batches.join(added, "shard_id", "left").na.fill(0, ["added"])
    return out.select("shard_id", "batches", "failed", "attempts", "added", (F.col("n") - F.col("added")).alias("skipped"))


class ConcurrentWrite(RuntimeError):
    """Another writer has made the next version; read again and repeat."""


class VersionedStore:
    """A store in a folder: a version is a numbered file that lists immutable runs.

    A commit writes its file beside and renames it to the next number, which fails when another writer has
    it; nothing is deleted before, so a crash leaves the last version as it was.  ``append`` writes only the
    rows that are new; ``commit`` writes a complete run and is what an upsert, a replacement and a compaction
    do.  Rollback removes the newest file.  Runs are partitioned by shard_id, so a restore of one shard reads
    its files alone.
    """

    def __init__(self, spark: SparkSession, path: str, max_runs: int = 32):
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        """Numbers of the versions, the newest last."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("versions"))]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))

    def _runs(self, number: int) -> list[str]:
        return json.loads(self.spark.read.text(f"{self.path}/versions/v-{number:09d}.json", wholetext=True).first()[0])

    def versions(self) -> list[list[str]]:
        """The runs of each version, the newest last."""
        return [self._runs(n) for n in self._numbers()]

    def _current(self) -> list[str]:
        n = self._numbers()
        return self._runs(n[-1]) if n else []

    def _point(self, runs: list[str], after: int | None = None) -> None:
        """Makes ``runs`` the version that follows number ``after`` (default: the newest)."""
        last = (self._numbers() or [0])[-1] if after is None else after
        tmp, to = self._path(f"versions/.{uuid.uuid4().hex}.tmp"), self._path(f"versions/v-{last + 1:09d}.json")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(runs), "utf-8"))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(tmp, to):
            self.fs.delete(tmp, False)
            raise ConcurrentWrite(f"{self.path}: version {last + 1} is there")

    def create(self) -> None:
        """An empty store where there is none."""
        if not self._numbers():
            self._point([])

    def read(self, shard_id: str | None = None) -> DataFrame:
        runs = self._current()
        df = self.spark.read.schema(STORE).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{r}" for r in runs)).select(*ROW) if runs else self.spark.createDataFrame([], STORE)
        return df if shard_id is None else df.where(F.col("shard_id") == shard_id)

    def restore(self, shard_id: str) -> DataFrame:
        return self.read(shard_id).orderBy("indexed_at", "document_id")

    def _write(self, df: DataFrame) -> str:
        run = f"run={uuid.uuid4().hex}"
        df.select(*ROW).write.partitionBy("shard_id").parquet(f"{self.path}/data/{run}")
        return run

    def commit(self, df: DataFrame) -> None:
        last = (self._numbers() or [0])[-1]
        self._point([self._write(df)], last)

    def append(self, rows: DataFrame) -> None:
        """Adds rows whose keys the store hasn't (``new_rows``)."""
        last, runs = (self._numbers() or [0])[-1], self._current()
        self._point([*runs, self._write(rows)], last)
        if len(runs) >= self.max_runs:
            self.commit(self.read())

    def rollback(self) -> None:
        n = self._numbers()
        if len(n) > 1:
            self.fs.delete(self._path(f"versions/v-{n[-1]:09d}.json"), False)

    def upsert(self, rows: DataFrame, order: str = "input_id") -> None:
        self.commit(upsert(self.read(), rows, order))

    def replace(self, rows: DataFrame, order: str = "input_id") -> None:
        self.commit(replace_slices(self.read(), rows, order))
