"""Index events as a stream: parse, dead-letter, dedup, route, upsert; with Kafka or files as the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.constants import RETRY_MAX
from corpusloom.operators import events
from corpusloom.operators.store import VersionedStore, new_rows, store_rows
from corpusloom.runtime import materialise


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages from the beginning; progress is kept by the query's checkpoint, committed after each batch."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select("value", "headers")


def kafka_sink(batch: DataFrame, servers: str, topic: str) -> None:
    """Messages with key, value and headers, acknowledged by all replicas, without duplicates of the producer's own making."""
    batch.select("key", "value", "headers").write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("topic", topic).save()


def file_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("text").load(path)


class IndexStream:
    """``foreachBatch`` worker over a stream of raw messages (column ``value``, and ``headers`` where the log has them).

    A batch is split into valid events and dead letters; valid ones that ``refuses`` (a condition over
    delivery columns, for tests and partial outages) are written to the retry folder with their attempt,
    the error and the time they are due, or to the dead letters beyond the limit; the rest is deduplicated
    against the store without a time limit and appended under its owner shard.  The retry folder is part of
    the stream's source: a message that isn't due yet is put back as it is.  A batch that is run again
    after a crash finds its rows in the store and changes nothing.
    """

    def __init__(self, spark: SparkSession, store: str, dead: str, retry: str, shards: list[str], refuses: str | None = None):
        self.spark, self.store, self.dead, self.retry, self.shards, self.refuses = spark, VersionedStore(spark, store), dead, retry, shards, refuses
        self.store.create()
        self.store.fs.mkdirs(self.store.jvm.org.apache.hadoop.fs.Path(retry))

    @staticmethod
    def _messages(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(F.to_json(F.struct("event_id", "document", "attempt", "created_at", "last_error", "traceparent", *columns)).alias("value"))

    def batch(self, raw: DataFrame, batch_id: int) -> None:
        raw = raw.persist()
        try:
            ok, dead = events.split(events.parsed(raw))
            dead.select("value").write.mode("overwrite").text(f"{self.dead}/batch={batch_id}")
            early = F.coalesce(F.col("not_before") > F.current_timestamp(), F.lit(False))
            again, ok = self._messages(ok.where(early), "not_before"), ok.where(~early)
            if self.refuses:
                refused = F.coalesce(F.expr(self.refuses), F.lit(False))
                failed = ok.where(refused).withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1).withColumn("last_error", F.substring(F.lit(f"refused: {self.refuses}"), 1, 500))
                ok = ok.where(~refused)
                due = F.expr(f"timestampadd(MILLISECOND, cast(1000 * {events.retry_delay('attempt')} AS int), current_timestamp())")
                again = again.unionByName(self._messages(failed.where(F.col("attempt") <= RETRY_MAX).withColumn("not_before", due), "not_before"))
                self._messages(failed.where(F.col("attempt") > RETRY_MAX)).write.mode("overwrite").text(f"{self.dead}/exhausted-{batch_id}")
            again.write.mode("overwrite").text(f"{self.retry}/batch-{batch_id}")
            docs = ok.select("document.*", F.col("created_at").alias("received_at"), F.xxhash64("event_id").alias("input_id"))
            rows = materialise(new_rows(store_rows(docs, self.shards), self.store.read()), "batch")
            if not rows.isEmpty():
                self.store.append(rows)
        finally:
            raw.unpersist()

    def start(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs to the end of the log and of the retries that are there; run it again, or on a timer, for those that fall due later."""
        retries = self.spark.readStream.format("text").option("recursiveFileLookup", "true").load(self.retry)
        both = source.unionByName(retries.select("value"), allowMissingColumns=True)
        return both.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within_watermark(stream: DataFrame, event_time: str = "created_at", lateness: str = "1 hour") -> DataFrame:
    """Drops copies that arrive close together; only to spare work, the store's dedup has no time limit."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(stream: DataFrame, event_time: str, size: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, size), "outcome").agg(F.count("*").alias("n"))
