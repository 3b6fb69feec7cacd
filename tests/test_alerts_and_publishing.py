"""Alert streams equal their batch form with late rows and a restart; the publisher sends and marks once."""

from datetime import datetime, timedelta

import pytest

from ledgerloom.streaming import alerts, events, publishing

START = datetime(2024, 1, 1)
CHANGE = "rule string, series string, ts timestamp, delta long, above int"


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def key(df):
    return sorted((r["rule"], r["started_at"], r["state"], r["moment"]) for r in df.collect())


def test_held_stream_with_late_rows_and_restart_equals_batch(rocks, tmp_path):
    spark = rocks
    level = lambda rule, m, d: (rule, "", at(m), d, None)
    lag = lambda series, m, above: ("consumer_lag", series, at(m), None, above)
    first = [level("http_5xx", 0, 1), level("http_5xx", 7, -1), level("failed_jobs", 3, 1), lag("a", 1, 1), lag("b", 9, 1)]
    second = [level("http_5xx", 4, 1), level("http_5xx", 9, -1), level("failed_jobs", 12, -1), lag("a", 10, 0), level("failed_events", 2, 2), level("http_5xx", 8, 1), level("http_5xx", 9, -1)]
    third = [lag("b", 40, 0), level("http_5xx", 30, 1), level("http_5xx", 35, -1), level("failed_events", 31, -2), level("failed_jobs", 25, 1), level("failed_jobs", 36, -1), level("http_5xx", 38, 1)]
    closing = [level(rule, 500, 0) for rule in alerts.HOLD_SECONDS]
    source, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))

    def run(rows):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGE).parquet(source)
        query = alerts.held_stream(stream, "30 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for rows in (first, second, third, closing):  # every call is a restart from the checkpoint
        run(rows)
    run([level("http_5xx", 5, 9)])  # later than the delay: dropped
    changes = spark.createDataFrame(first + second + third + closing, CHANGE)
    want = key(alerts.held_conditions(changes, "2024-01-01 07:50:00"))
    assert key(spark.read.schema(alerts.ALERT).parquet(out)) == want
    assert {(rule, state) for rule, _, state, _ in want} == {("http_5xx", "firing"), ("http_5xx", "resolved"), ("failed_events", "firing"), ("failed_events", "resolved"), ("failed_jobs", "firing"), ("failed_jobs", "resolved"), ("consumer_lag", "firing"), ("consumer_lag", "resolved")}


def test_conditions_need_their_whole_time(spark):
    rows = [("failed_jobs", "", at(0), 1, None), ("failed_jobs", "", at(10), -1, None), ("failed_events", "", at(0), 1, None), ("failed_events", "", at(10), 0, None), ("http_5xx", "", at(0), 1, None), ("http_5xx", "", at(4), -1, None)]
    got = key(alerts.held_conditions(spark.createDataFrame(rows, CHANGE)))
    # ended at the very moment: no alert; still open at that moment: fires; too short: none
    assert got == [("failed_events", at(0), "firing", at(10))]
    request = spark.createDataFrame([(at(0), 500), (at(4), 503), (at(5), 200)], "ts timestamp, status_code int")
    assert key(alerts.held_conditions(alerts.error_changes(request))) == [("http_5xx", at(0), "firing", at(5)), ("http_5xx", at(0), "resolved", at(9))]


OUTBOX = "id long, tenant_id long, topic string, aggregate_id string, created_at timestamp, published_at timestamp, failure_reason string"


def outbox_rows(ids, topic=events.TOPICS[8]):
    return [(i, i % 3, "gone.topic" if i % 10 == 9 else topic, f"a{i}", at(i), None, None) for i in ids]


def test_publisher_marks_what_it_sent_and_a_replay_doubles_nothing(spark, tmp_path):
    source, sent, marks, mark = (str(tmp_path / p) for p in ("outbox", "sent", "marks", "mark"))
    send = publishing.file_sink(sent)

    def run(rows):
        spark.createDataFrame(rows, OUTBOX).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).parquet(source)
        publishing.publish_stream(stream, send, marks, mark).awaitTermination()

    run(outbox_rows(range(20)))
    run(outbox_rows(range(15, 30)))  # five come again
    messages = spark.read.parquet(sent)
    assert sorted(r["event_id"] for r in messages.collect()) == list(range(30))
    # a crash between sending and marking: the batch runs again under its number
    batch = spark.createDataFrame(outbox_rows(range(100, 104)), OUTBOX)
    calls = []

    def broken(rows, batch_id):
        send(rows, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publishing.publish_batch(batch, 99, broken, marks)
    for _ in range(2):
        publishing.publish_batch(batch, 99, broken, marks)
    publishing.publish_batch(batch, 100, broken, marks)  # another batch: all marked already
    found = [r for r in spark.read.parquet(sent).collect() if r["event_id"] >= 100]
    assert sorted(r["event_id"] for r in found) == [100, 101, 102, 103]
    headers = {h["key"]: bytes(h["value"]).decode() for h in found[0]["headers"]}
    assert set(headers) == {"x-event-id", "x-tenant-id", "x-correlation-id", "x-schema-version"}
    state = {r["id"]: (r["published_at"] is not None, r["failure_reason"]) for r in publishing.outbox_after(spark.createDataFrame(outbox_rows(range(30)), OUTBOX), spark.read.parquet(marks)).collect()}
    assert state[8] == (True, None) and state[9] == (False, "DLQ:gone.topic.dlq:UNKNOWN_TOPIC")


def test_dead_letters_carry_their_header(spark):
    rows = {r["event_id"]: r for r in publishing.outgoing(spark.createDataFrame(outbox_rows(range(8, 10)), OUTBOX)).collect()}
    assert rows[8]["topic"] == events.TOPICS[8] and rows[8]["failure_reason"] is None
    assert rows[9]["topic"] == "gone.topic.dlq" and rows[9]["headers"][-1]["key"] == "x-dead-letter"
    assert publishing.outgoing(spark.createDataFrame([(1, 1, events.TOPICS[0], "a", at(0), None, "RETRY: slow")], OUTBOX)).count() == 0
    assert publishing.outgoing(spark.createDataFrame([(1, 1, events.TOPICS[0], "a", at(0), None, "RETRY: slow")], OUTBOX), include_failed=True).count() == 1
