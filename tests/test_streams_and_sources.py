"""Streams equal their batch form and survive a restart; files in and out."""

import json

from pyspark.sql import functions as F

from ledgerloom.plans.bindings import Tables
from ledgerloom.sources import imports, sinks
from ledgerloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_stream_restart_keeps_each_event_once(spark, tmp_path):
    source, inbox, mark = (str(tmp_path / p) for p in ("in", "inbox", "mark"))
    rows = Tables(spark, SF).inbox
    half = rows.where("event_id % 2 = 0")
    half.write.parquet(source)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        query = stream.writeStream.foreachBatch(lambda b, _: events.append_new(b, inbox)).option(
            "checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    first = spark.read.parquet(inbox).count()
    rows.write.mode("append").parquet(source)  # repeats everything once more
    run()
    stored = spark.read.parquet(inbox)
    distinct = rows.select("consumer_name", "event_id").distinct().count()
    assert first == half.select("consumer_name", "event_id").distinct().count()
    assert stored.count() == distinct == stored.select("consumer_name", "event_id").distinct().count()


def test_streaming_counts_equal_batch(spark, tmp_path):
    source = str(tmp_path / "outbox")
    outbox = Tables(spark, SF).outbox
    outbox.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(outbox.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = events.live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("live")) == key(events.live_counts(outbox))


def test_envelopes_are_quarantined(spark, tmp_path):
    good = {"id": "1", "topic": "expense.created", "tenantId": "t", "aggregateId": "a", "correlationId": "c", "payload": {"x": 1}}
    values = [json.dumps(good), "", "{", json.dumps({**good, "topic": "nope"}), json.dumps({**good, "id": ""}), json.dumps({**good, "schemaVersion": 0})]
    rows = events.parse_envelopes(spark.createDataFrame([(v,) for v in values], "value string"))
    assert [r.error_code for r in rows.collect()] == [
        None, "EVENT_CONSUMER_EMPTY_MESSAGE", "EVENT_CONSUMER_INVALID_JSON", "UNKNOWN_TOPIC", "EVENT_ENVELOPE_INVALID", "EVENT_ENVELOPE_INVALID"]
    events.split_good_bad(rows, str(tmp_path / "g"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1 and spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_csv_import_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TITLE,date,amount,reimbursable\nLunch,2024-01-02,\"12,5\",evet\n")
    (tmp_path / "b.csv").write_text("title,occurred_at,amount_minor,currency\nTaxi,2024-01-02,900,USD\n,oops,x,ABC\n")
    got = {}
    for name in ("a", "b"):
        rows = imports.validate_import(imports.read_import_csv(spark, str(tmp_path / f"{name}.csv")))
        got[name] = (imports.import_batches(rows).collect()[0], imports.import_errors(rows).collect(), imports.accepted_rows(rows).collect())
    assert got["a"][0].status == "SUCCEEDED" and int(got["a"][2][0].amount_minor) == 1250 and got["a"][2][0].reimbursable
    assert got["b"][0].status == "FAILED" and got["b"][2] == []
    assert {(e.row, e.code) for e in got["b"][1]} == {
        (3, "TITLE_REQUIRED"), (3, "VALID_DATE_REQUIRED"), (3, "INVALID_CURRENCY"), (3, "VALID_AMOUNT_REQUIRED")}


def test_corpora_and_jsonl(spark, tmp_path):
    quad = {f"{a}{i}": v for i, (x, y) in enumerate(((10, 10), (50, 10), (50, 30), (10, 30)), 1) for a, v in (("x", x), ("y", y))}
    (tmp_path / "n.json").write_text(json.dumps({"valid_line": [{"category": "menu", "words": [{"text": "Tea ", "quad": quad}, {"text": "x2", "quad": quad}]}]}))
    row = imports.read_nested_corpus(spark, str(tmp_path / "n.json")).collect()[0]
    assert (row.text, row.box, row.category) == ("Tea x2", [6, 6, 54, 34], "menu")
    (tmp_path / "b.txt").write_text("1,2,30,2,30,12,1,12,TOTAL, 5\nbad,line\n")
    row = imports.read_box_corpus(spark, str(tmp_path / "b.txt")).collect()[0]
    assert (row.text, row.box) == ("TOTAL, 5", [0, 0, 33, 15])
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n')
    good, bad = imports.read_jsonl(spark, str(tmp_path / "p.jsonl"), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 2


def test_export_writes_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "=sum", None), (2, "a,b", "x")], "id int, label string, note string")
    sinks.export(df, "ledger", str(tmp_path / "out"), str(tmp_path / "manifest"))
    text = "".join(p.read_text(newline="") for p in (tmp_path / "out").glob("*.csv"))
    assert "'=sum" in text and '"a,b"' in text and "\r\n" in text
    assert spark.read.parquet(str(tmp_path / "manifest")).collect()[0].rows == 2
    sinks.write_manifests(df.withColumns({"level": F.lit("line"), "split": F.lit("train")}), str(tmp_path / "m"))
    assert (tmp_path / "m" / "manifest=line_train").is_dir()


def test_published_events_pass_the_own_validation_and_a_replay_adds_nothing(spark, tmp_path):
    rows = [(i, events.TOPICS[0], "t", f"a{i}", None, None) for i in range(5)]
    outbox = spark.createDataFrame(rows, "id long, topic string, tenant_id string, aggregate_id string, published_at timestamp, failure_reason string")
    parsed = events.parse_envelopes(events.outbox_messages(outbox).select("value"))
    assert parsed.where("error_code is null").count() == 5
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for _ in range(2):
        events.split_good_bad(parsed, good, bad, batch_id=7)
    assert spark.read.parquet(good).count() == 5


def test_records_received_at_once_keep_one_first(spark):
    from pyspark.sql import functions as F

    incoming = spark.createDataFrame([("c", 1, 10), ("c", 1, 11), ("c", 2, 12)], "consumer_name string, event_id long, record_offset long").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    flagged = {r["record_offset"]: r["duplicate"] for r in events.inbox_record(incoming).collect()}
    assert flagged == {10: False, 11: True, 12: False}


def test_import_files_have_their_own_header_and_numbers(spark, tmp_path):
    folder = tmp_path / "imports"
    folder.mkdir()
    (folder / "a.csv").write_text("title,date,amount,currency\nA,2024-01-02,1.50,EUR\n\"B\nb\",2024-01-02,2.50,EUR\n")
    (folder / "b.csv").write_text("Title,currency,amount,date\nC,EUR,3.50,2024-01-02\nD,EUR\n")
    rows = imports.validate_import(imports.read_import_csv(spark, str(folder)))
    found = {(r["batch_id"][-5:], r["row_no"]): r for r in rows.collect()}
    assert sorted(found) == [("a.csv", 0), ("a.csv", 1), ("b.csv", 0), ("b.csv", 1)]
    good = [found["a.csv", 0], found["a.csv", 1], found["b.csv", 0]]
    assert [(r["title"], r["amount_minor"], r["currency"]) for r in good] == [("A", 150, "EUR"), ("B\nb", 250, "EUR"), ("C", 350, "EUR")]
    assert "CSV_PARSE_FAILED" in [e["code"] for e in found["b.csv", 1]["errors"]]
    status = {r["batch_id"][-5:]: r["status"] for r in imports.import_batches(rows).collect()}
    assert status["b.csv"] == "FAILED"


def test_inbox_replay_adds_nothing(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    batch = spark.sql("SELECT 'c' AS consumer_name, 'e' || CAST(id % 7 AS STRING) AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS received_at, id AS record_offset FROM range(20)")
    for _ in range(2):
        events.append_new(batch, inbox)
    stored = spark.read.parquet(inbox).collect()
    assert sorted((r["event_id"], r["record_offset"]) for r in stored) == [(f"e{i}", i) for i in range(7)]
