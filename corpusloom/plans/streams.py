"""Streaming operators run to the end of what there is, over files made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.functions import text as t
from corpusloom.functions.dialect import DUCK
from corpusloom.plans import control
from corpusloom.plans.control import calls
from corpusloom.plans.ingest import raw_events
from corpusloom.plans.text_rules import SHARDS
from corpusloom.runtime import scratch
from corpusloom.streaming import guards
from corpusloom.streaming.index_stream import IndexStream, file_source


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """The whole event log as files of JSON lines, through the index worker; what the store holds then."""
    base = scratch(spark, "stream")
    raw_events(spark, d).select("value").where("value IS NOT NULL").write.text(f"{base}/log")
    worker = IndexStream(spark, f"{base}/store", f"{base}/dead", f"{base}/retry", SHARDS)
    worker.start(file_source(spark, f"{base}/log"), f"{base}/checkpoint").awaitTermination()
    return worker.store.read().select("shard_id", "document_id")


def _stateful(name: str, columns: list[str], build):
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = scratch(spark, name)
        c = calls(spark, d).select(*columns)
        c.write.parquet(f"{base}/in")
        out = build(spark.readStream.schema(c.schema).parquet(f"{base}/in"))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/out")

    return run


def windowed(spark: SparkSession, d: str) -> DataFrame:
    """Errors and successes by ten minutes of event time, with a watermark, to a table."""
    from corpusloom.streaming.index_stream import windowed_counts

    base = scratch(spark, "windows")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"))
    e.write.parquet(f"{base}/in")
    out = windowed_counts(spark.readStream.schema(e.schema).parquet(f"{base}/in"), "ts")
    flat = out.select(F.unix_micros("window.start").alias("start_us"), "outcome", "n")

    def keep(batch: DataFrame, number: int) -> None:  # what a batch has changed, once however often it is run
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    flat.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.schema(StructType([*flat.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out")
    return changed.groupBy("start_us", "outcome").agg(F.max_by("n", "batch").alias("n"))


QUERIES = {
    "stream_index": stream_index,
    "stream_circuits": _stateful("circuits", ["call_id", "shard", "at", "ok"], lambda s: guards.circuits(s, idle_ms=None)),
    "stream_buckets": _stateful("buckets", ["call_id", "client", "at"], lambda s: guards.buckets(s, capacity=3, per_second=0.0005, idle_ms=None)),
    "stream_windows": windowed,
}
_KEY = f"CASE WHEN length(document.url) > 0 THEN document.url ELSE {t.content_hash(DUCK, 'document.text')} END"
ORACLE = {
    "stream_circuits": control.ORACLE["circuit_states"],
    "stream_buckets": control.ORACLE["token_bucket"],
    "stream_index": f"""SELECT DISTINCT {t.rendezvous(DUCK, 'k', SHARDS)} AS shard_id, substring(h, 1, 16) AS document_id FROM
        (SELECT {t.content_hash(DUCK, "coalesce(document.text, '')")} AS h, {_KEY} AS k FROM index_events WHERE event_id IS NOT NULL AND document IS NOT NULL)""",
    "stream_windows": "SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts)) AS start_us, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n FROM events GROUP BY ALL",
}
