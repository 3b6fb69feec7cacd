"""Event stream jobs. Every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import groups

# The event catalogue.
TOPICS = (
    "document.uploaded", "ocr.job.created", "ocr.preprocessing.completed", "ocr.tesseract.completed",
    "ocr.custom_model.completed", "ocr.ensemble.completed", "extraction.completed", "extraction.needs_review",
    "expense.created", "expense.updated", "expense.approved", "expense.rejected", "model.training.started",
    "model.training.completed", "model.evaluation.completed", "annotation.created", "audit.event.created",
    "report.generated", "webhook.delivery.requested",
)
ENVELOPE = (
    "id string, topic string, tenantId string, aggregateId string, schemaVersion int, correlationId string, "
    "payload string, _corrupt_record string"
)


def kafka_source(spark: SparkSession, servers: str, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return stream.option("subscribe", ",".join(topics)).load().select(F.col("value").cast("string").alias("value"))


def parse_envelopes(messages: DataFrame) -> DataFrame:
    """Envelope fields with an ``error_code``; null marks a good message."""
    parsed = messages.withColumn(
        "e", F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    required = ("id", "topic", "tenantId", "aggregateId", "correlationId")
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | (F.coalesce(F.col(f"e.{name}"), F.lit("")) == "")
    version = F.coalesce("e.schemaVersion", F.lit(1))
    code = (
        F.when(F.coalesce("value", F.lit("")) == "", "EVENT_CONSUMER_EMPTY_MESSAGE")
        .when(F.col("e").isNull() | F.col("e._corrupt_record").isNotNull(), "EVENT_CONSUMER_INVALID_JSON")
        .when(lacking | (version < 1), "EVENT_ENVELOPE_INVALID")
        .when(~F.col("e.topic").isin(*TOPICS), "UNKNOWN_TOPIC")
    )
    return parsed.select(
        *[c for c in messages.columns if c != "value"], "value", F.col("e.id").alias("event_id"), F.col("e.topic").alias("topic"),
        F.col("e.tenantId").alias("tenant_id"), F.col("e.aggregateId").alias("aggregate_id"),
        version.alias("schema_version"), F.col("e.correlationId").alias("correlation_id"),
        F.coalesce("e.payload", F.lit("{}")).alias("payload"), code.alias("error_code"),
    )


def split_good_bad(batch: DataFrame, good_path: str, bad_path: str, batch_id: int = 0) -> None:
    """``foreachBatch`` body: accepted events and quarantined messages. Each batch owns
    a folder, which a replay writes anew, so nothing is doubled."""
    batch.persist()
    batch.where(F.col("error_code").isNull()).write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
    batch.where(F.col("error_code").isNotNull()).write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")
    batch.unpersist()


def dedupe_within(stream: DataFrame, delay: str) -> DataFrame:
    """Bounded-state dedupe: repeats within the watermark delay are dropped."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["consumer_name", "event_id"])


def inbox_record(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Exact inbox: the first record of each (consumer, event) wins, repeats and
    ids already stored are flagged. Records received at once are ordered by their
    ``record_offset``, or by a hash of the row where there is none. Winners come from
    an aggregate and a join, so an id repeated a billion times is not sorted anywhere."""
    keys = ["consumer_name", "event_id"]
    order = F.struct("received_at", F.col("record_offset") if "record_offset" in incoming.columns else F.xxhash64(*incoming.columns).alias("record_offset"))
    flagged = groups.attach(incoming, keys, F.min(order).alias("first_at"))
    duplicate = order > F.col("first_at")
    if stored is not None:
        known = stored.select(*keys).distinct().withColumn("known", F.lit(True))
        flagged = flagged.join(known, keys, "left")
        duplicate = duplicate | F.coalesce("known", F.lit(False))
    return flagged.withColumn("duplicate", duplicate).drop("first_at", "known")


def append_new(batch: DataFrame, inbox_path: str, buckets: int = 256) -> None:
    """``foreachBatch`` body for the exact inbox table. A replayed batch adds nothing.

    The inbox is partitioned by a hash bucket of its key. A batch reads the buckets it
    has keys of and keeps the stored rows of those keys only."""
    spark, keys = batch.sparkSession, ["consumer_name", "event_id"]
    keyed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    stored = None
    try:
        inbox = spark.read.parquet(inbox_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # the first batch finds no table
            raise
    else:
        hit = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        stored = inbox.where(F.col("bucket").isin(hit)).join(batch.select(*keys).distinct(), keys, "left_semi")
    fresh = inbox_record(keyed, stored).where(~F.col("duplicate")).drop("duplicate")
    fresh.dropDuplicates(keys).write.mode("append").partitionBy("bucket").parquet(inbox_path)


def outbox_messages(outbox: DataFrame, include_failed: bool = False) -> DataFrame:
    """Kafka rows of the pending (optionally failed) events, keyed by aggregate."""
    failed = F.coalesce("failure_reason", F.lit("")) != ""
    pending = F.col("published_at").isNull() & ~failed
    occurred = [F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("occurredAt")] if "created_at" in outbox.columns else []
    body = F.to_json(F.struct(
        F.col("id").cast("string").alias("id"), "topic", F.col("tenant_id").cast("string").alias("tenantId"),
        F.col("aggregate_id").alias("aggregateId"), F.lit(1).alias("schemaVersion"), *occurred,
        (F.col("correlation_id") if "correlation_id" in outbox.columns else F.col("id")).cast("string").alias("correlationId"),
        (F.col("payload") if "payload" in outbox.columns else F.lit("{}")).alias("payload")))
    return outbox.where(pending | failed if include_failed else pending).select(
        "topic", F.col("aggregate_id").alias("key"), body.alias("value"), F.col("id").alias("event_id"))


def dead_letter_route(outbox: DataFrame) -> DataFrame:
    """Failed events as messages on the dead-letter topic of their topic."""
    failed = outbox.where(F.coalesce("failure_reason", F.lit("")) != "")
    return failed.select(
        F.col("id").alias("event_id"), F.concat("topic", F.lit(".dlq")).alias("topic"),
        F.col("topic").alias("original_topic"), "aggregate_id", "failure_reason",
    )


def live_counts(outbox: DataFrame) -> DataFrame:
    """Running counts per (topic, state), for update-mode streams."""
    failed = F.coalesce("failure_reason", F.lit("")) != ""
    state = F.when(failed, "failed").when(F.col("published_at").isNotNull(), "published").otherwise("pending")
    return outbox.groupBy("topic", state.alias("state")).agg(F.count(F.lit(1)).alias("count"))


def rolling_errors(request: DataFrame, watermark: str | None = None) -> DataFrame:
    """Requests and server errors in sliding five-minute windows."""
    rows = request.withWatermark("ts", watermark) if watermark else request
    return rows.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "route").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors")
    ).select("route", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "errors")


def held_alerts(windows: DataFrame, hold_minutes: int = 5) -> DataFrame:
    """Runs of consecutive error windows that lasted at least the hold time."""
    minute = F.floor(F.unix_micros(F.col("window_start").cast("timestamp")) / F.lit(60_000_000)).cast("long")
    firing = windows.where(F.col("errors") > 0).withColumn("__m", minute)
    numbered = groups.positions(firing, ["route"], [F.asc("__m")])
    runs = numbered.groupBy("route", (F.col("__m") - F.col("position")).alias("run")).agg(
        F.min("window_start").alias("started_at"), F.max("window_start").alias("last_at"),
        F.count(F.lit(1)).alias("windows"), F.max("errors").alias("peak_errors"))
    return runs.where(F.col("windows") > hold_minutes).drop("run")


def event_projection(event: DataFrame) -> DataFrame:
    """Current state of each aggregate from its latest lifecycle event."""
    # Topic to status.
    status = (
        F.when(F.col("topic") == "expense.created", "DRAFT").when(F.col("topic") == "expense.approved", "APPROVED")
        .when(F.col("topic") == "expense.rejected", "REJECTED").when(F.col("topic") == "expense.updated", "UPDATED")
    )
    rows = event.withColumn("status", status).where(F.col("status").isNotNull())
    newest = F.max_by(F.struct("status", "created_at", "id"), F.struct("created_at", "id")).alias("e")
    return rows.groupBy("aggregate_id").agg(newest, F.count(F.lit(1)).alias("events")).select(
        "aggregate_id", F.col("e.status").alias("status"), F.col("e.created_at").alias("occurred_at"),
        F.col("e.id").alias("event_id"), "events")
