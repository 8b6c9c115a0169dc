"""Index events: ids, wire format, parsing with dead letters, and bounded retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.constants import RETRY_BASE, RETRY_CAP, RETRY_MAX
from corpusloom.functions.dialect import SPARK

EVENT = "event_id string, document struct<title: string, text: string, url: string, source: string>, attempt int, created_at timestamp, last_error string, not_before timestamp, traceparent string, _corrupt string"


def event_ids(events: DataFrame) -> DataFrame:
    """The id an event should have: the content hash of its text, whatever its title and url."""
    return events.where("document IS NOT NULL").select("delivery_id", F.expr(text.content_hash(SPARK, "coalesce(document.text, '')")).alias("event_id"))


def messages(events: DataFrame, trace: dict[str, str] | None = None) -> DataFrame:
    """Key, JSON value and headers, as a Kafka sink takes them; trace headers travel with each message."""
    headers = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in (trace or {"traceparent": "00"}).items()))
    return events.select(F.col("event_id").alias("key"), F.to_json(F.struct("event_id", "document", "attempt", "created_at", "last_error")).alias("value"), headers.alias("headers"))


def parsed(raw: DataFrame, value: str = "value") -> DataFrame:
    """Fields of each message and ``valid``; broken JSON, a missing id or document and a negative attempt are invalid, their raw value kept."""
    raw = traced(raw)
    e = raw.withColumn("e", F.from_json(F.col(value).cast("string"), EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.col("e._corrupt").isNull() & F.col("e.event_id").isNotNull() & F.col("e.document").isNotNull() & (F.coalesce("e.attempt", F.lit(0)) >= 0)
    return e.withColumn("valid", F.coalesce(ok, F.lit(False)))


def traced(raw: DataFrame) -> DataFrame:
    """``trace`` beside each message: the header ``traceparent``, where messages have headers."""
    if "headers" not in raw.columns:
        return raw.withColumn("trace", F.lit(None).cast("string"))
    return raw.withColumn("trace", F.try_element_at(F.transform(F.filter("headers", lambda h: h["key"] == "traceparent"), lambda h: h["value"].cast("string")), F.lit(1)))


def split(parsed_events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events with their fields, and dead letters as they came."""
    valid = parsed_events.where("valid").select("*", "e.*").drop("e", "_corrupt")
    return valid.withColumn("traceparent", F.coalesce("trace", "traceparent")).drop("trace"), parsed_events.where("NOT valid").drop("e")


def retry_delay(attempt: str) -> str:
    return f"least({RETRY_CAP}D, {RETRY_BASE}D * pow(2D, least(30, greatest(0, {attempt} - 1))))"


def retried(events: DataFrame, failing: str, limit: int = RETRY_MAX) -> DataFrame:
    """Outcome of every event when those for which ``failing`` (over alias ``e``) holds are published again.

    One round per attempt, ``limit`` + 1 at most: a failure adds one to the attempt, and goes to the
    dead letters beyond ``limit``.
    """
    done, open_ = [], events
    for _ in range(limit + 1):
        e = open_.alias("e")
        bad = F.expr(failing)
        done.append(e.where(~bad).select("delivery_id", "attempt", F.lit("indexed").alias("outcome")))
        failed = e.where(bad).select("delivery_id", (F.col("attempt") + 1).cast("int").alias("attempt"))
        done.append(failed.where(F.col("attempt") > limit).select("delivery_id", "attempt", F.lit("dead_letter").alias("outcome")))
        open_ = failed.where(F.col("attempt") <= limit)
    return reduce(DataFrame.unionByName, done)
