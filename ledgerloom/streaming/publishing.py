"""Outbox publisher: bounded batches that are sent first and marked then, safe to replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .events import TOPICS, outbox_messages


def headers(event: DataFrame) -> Column:
    """Message headers: event, tenant, correlation and schema version, in the form the Kafka sink takes."""
    correlation = F.col("correlation_id") if "correlation_id" in event.columns else F.col("id")
    values = (("x-event-id", F.col("id")), ("x-tenant-id", F.col("tenant_id")), ("x-correlation-id", correlation), ("x-schema-version", F.lit(1)))
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in values])


def outgoing(outbox: DataFrame, include_failed: bool = False) -> DataFrame:
    """Messages of the pending (optionally failed) events with headers. An event whose topic is not in the catalogue
    cannot be delivered: it goes to the dead-letter topic of that name with the reason and a header that says so."""
    known = F.col("topic").isin(*TOPICS)
    body = outbox_messages(outbox, include_failed).select("event_id", "key", "value", "topic")
    marked = outbox.select(F.col("id").alias("event_id"), headers(outbox).alias("headers"))
    joined = body.join(marked, "event_id")
    reason = F.when(~known, F.concat(F.lit("DLQ:"), F.col("topic"), F.lit(".dlq:UNKNOWN_TOPIC")))
    dead = F.array(F.struct(F.lit("x-dead-letter").alias("key"), F.lit("true").cast("binary").alias("value")))
    return joined.select(
        "event_id", F.when(known, F.col("topic")).otherwise(F.concat("topic", F.lit(".dlq"))).alias("topic"), "key", "value",
        F.when(known, F.col("headers")).otherwise(F.concat("headers", dead)).alias("headers"), reason.alias("failure_reason"))


def marks(outbox: DataFrame, path: str) -> DataFrame | None:
    """All marks written so far; null before the first batch."""
    try:
        return outbox.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish_batch(batch: DataFrame, batch_id: int, send: Callable[[DataFrame, int], None], marks_path: str, include_failed: bool = False) -> None:
    """``foreachBatch`` body: send what is pending, then mark it.

    An event that another batch has marked is not sent again. The marks of a batch are one folder that a replay
    writes anew: a crash between sending and marking repeats the same messages under the same batch id, which a
    sink that is keyed by it (or by event id) takes once. An event twice in one batch is sent once."""
    done = marks(batch, marks_path)
    fresh = batch.dropDuplicates(["id"])
    if done is not None:
        others = done.where(F.col("batch_id") != batch_id).select(F.col("event_id").alias("id"))
        fresh = fresh.join(others, "id", "left_anti")
    messages = outgoing(fresh, include_failed).persist()
    send(messages, batch_id)
    state = messages.select("event_id", F.when(F.col("failure_reason").isNull(), F.current_timestamp()).alias("published_at"), "failure_reason")
    state.write.mode("overwrite").parquet(f"{marks_path}/batch_id={batch_id}")
    messages.unpersist()


def file_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Messages as files, a folder a batch."""
    return lambda messages, batch_id: messages.drop("failure_reason").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def kafka_sink(servers: str) -> Callable[[DataFrame, int], None]:
    """Messages to a broker, headers included; consumers drop repeats by the event id header."""
    def send(messages: DataFrame, batch_id: int) -> None:
        rows = messages.select("topic", F.col("key").cast("string").alias("key"), "value", "headers")
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()

    return send


def publish_stream(outbox_stream: DataFrame, send: Callable[[DataFrame, int], None], marks_path: str, checkpoint: str, include_failed: bool = False):
    """Publisher query over everything available; the source bounds its batches (``maxFilesPerTrigger``)."""
    writer = outbox_stream.writeStream.foreachBatch(lambda b, k: publish_batch(b, k, send, marks_path, include_failed))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outbox_after(outbox: DataFrame, published: DataFrame) -> DataFrame:
    """The outbox with the publisher's marks: a mark's time and reason stand where it has one."""
    own = published.groupBy(F.col("event_id").alias("id")).agg(F.max("published_at").alias("at__"), F.max("failure_reason").alias("reason__"))
    joined = outbox.join(own, "id", "left")
    return joined.withColumns({
        "published_at": F.coalesce(F.col("at__").cast(outbox.schema["published_at"].dataType), "published_at"),
        "failure_reason": F.when(F.col("at__").isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce("reason__", "failure_reason")),
    }).drop("at__", "reason__")
