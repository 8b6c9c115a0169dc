"""Session helpers: shared folder, materialised intermediates, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times this width stay under BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []
_owners: list["Owner"] = []


class Owner:
    """Owns the tables that are materialised inside its ``with`` block; ``free`` removes them once nothing reads them any more."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> "Owner":
        _owners.append(self)
        return self

    def __exit__(self, *exc) -> None:
        _owners.remove(self)

    def free(self) -> None:
        for spark, path in self.paths:
            remove(spark, path)
            if (spark, path) in _made:
                _made.remove((spark, path))
        self.paths = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a private one only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made.append((spark, base))
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    if _owners:
        _owners[-1].paths.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in reversed(_made):
        try:
            if path.startswith("file://"):
                import shutil

                shutil.rmtree(path[7:], ignore_errors=True)
            else:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, key: tuple, make: Callable[[], object], tables: Callable[[object], list[DataFrame]]):
    """What ``make`` has made for ``key`` in this application, as long as the ``tables`` it materialised are there."""
    full = (spark.sparkContext.applicationId, *key)
    if full in _kept:
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        paths = [jvm.org.apache.hadoop.fs.Path(f"{t._corpusloom_path}/_SUCCESS") for t in tables(_kept[full])]
        if all(p.getFileSystem(conf).exists(p) for p in paths):
            return _kept[full]
    _kept[full] = make()
    return _kept[full]


def small_side(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Broadcast hint behind a size check; larger sides are left to the shuffle join that AQE splits on skew."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def sifted(df: DataFrame, wanted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` joined with ``wanted``, a table of ``rows`` distinct ``keys``, without a shuffle of all of ``df``.

    Where ``wanted`` is too large for a broadcast, a bitmap of its keys' hashes (16 bits a row, ``BROADCAST_BYTES`` at
    most) keeps nearly all other rows out of the join.
    """
    if rows * 100 <= BROADCAST_BYTES:
        return df.join(F.broadcast(wanted), keys)
    size = min(1 << (16 * rows).bit_length(), 8 * BROADCAST_BYTES)
    place = F.pmod(F.xxhash64(*keys), F.lit(size))
    bits = np.zeros(size // 8 + 1, np.uint8)
    for batch in wanted.select(place.alias("at")).distinct().toArrow().to_batches():
        at = batch.column(0).to_numpy()
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def kept(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series(shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1 == 1)

    return df.where(kept(place)).join(wanted, keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A source that has fewer files than there are cores, dealt out to all cores; any other as it is read.

    What moves is less than a file split for each core, so a large source is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * (128 << 20) or len(df.inputFiles()) >= cores else df.repartition(cores)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``name``: place of each row from 0 within ``by`` in the order of ``order``, without one task per group.

    Rows are range-partitioned, numbered within their partition, and shifted by the prefix sums of
    the partitions' counts, a table of partitions x groups.
    """
    from pyspark.sql import Window

    keys = [*by, *order]
    parts = materialise(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    w = Window.partitionBy("__part", *by)
    local = parts.withColumn("__local", F.row_number().over(w.orderBy(*order)) - 1)
    sizes = parts.groupBy("__part", *by).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", *by, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before")).withColumnsRenamed({c: f"__{c}" for c in by})
    on = (F.col("p.__part") == F.col("o.__part")) & (F.lit(True) if not by else _all_equal(by))
    out = local.alias("p").join(F.broadcast(offsets.alias("o")) if offsets.count() <= 100_000 else offsets.alias("o"), on)
    return out.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("__local") + F.col("__before")).alias(name))


def _all_equal(by: list[str]):
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"p.{c}").eqNullSafe(F.col(f"o.__{c}"))
    return cond
