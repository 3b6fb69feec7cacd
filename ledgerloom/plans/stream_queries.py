"""Streams, sources and sinks as registered queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import scratch
from ..operators import spend
from ..sources import imports, sinks
from ..streaming import alerts, events as ev, publishing
from .bindings import with_bindings
from .registry import query


@query("envelope_validate", with_bindings(
    """SELECT offset_id, CASE WHEN k IN (1, 2, 3) THEN NULL ELSE 'e' || CAST(offset_id % 6000 AS VARCHAR) END AS event_id,
    CASE k WHEN 5 THEN 0 WHEN 6 THEN 3 ELSE 1 END AS schema_version, CASE k WHEN 1 THEN 'EVENT_CONSUMER_EMPTY_MESSAGE' WHEN 2 THEN 'EVENT_CONSUMER_INVALID_JSON'
      WHEN 3 THEN 'EVENT_ENVELOPE_INVALID' WHEN 5 THEN 'EVENT_ENVELOPE_INVALID' WHEN 4 THEN 'UNKNOWN_TOPIC' END AS error_code
    FROM message JOIN (SELECT event_id, k FROM keyed_event) ON event_id = offset_id"""))
def _(t):
    return ev.parse_envelopes(t.message).select("offset_id", "event_id", "schema_version", "error_code")


@query("idempotent_inbox", with_bindings(
    """SELECT consumer_name, event_id, received_at, record_offset,
       row_number() OVER (PARTITION BY consumer_name, event_id ORDER BY received_at, record_offset) > 1 AS duplicate FROM inbox"""))
def _(t):
    return ev.inbox_record(t.inbox).select("consumer_name", "event_id", "received_at", "record_offset", "duplicate")


@query("outbox_publish", with_bindings(
    """SELECT event_id, CASE WHEN bad THEN topic || '.dlq' ELSE topic END AS topic, key, value, 'x-event-id=' || event_id || ',x-tenant-id=' || tenant_id || ',x-correlation-id=' || event_id || ',x-schema-version=1'
      || CASE WHEN bad THEN ',x-dead-letter=true' ELSE '' END AS headers, CASE WHEN bad THEN 'DLQ:' || topic || '.dlq:UNKNOWN_TOPIC' END AS failure_reason
    FROM (SELECT id AS event_id, tenant_id, aggregate_id AS key, t AS topic, t = 'expense.vanished' AS bad, '{"id":"' || id || '","topic":"' || t || '","tenantId":"' || tenant_id || '","aggregateId":"' || aggregate_id
      || '","schemaVersion":1,"occurredAt":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(created_at) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z","correlationId":"' || id || '","payload":"{}"}' AS value
      FROM (SELECT *, CASE WHEN id % 50 = 3 THEN 'expense.vanished' ELSE topic END AS t FROM outbox WHERE published_at IS NULL AND failure_reason IS NULL))"""))
def _(t):
    outbox = t.outbox.withColumn("topic", F.when(F.col("id") % 50 == 3, "expense.vanished").otherwise(F.col("topic")))
    named = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ",")
    return publishing.outgoing(outbox).withColumn("headers", named)


@query("dead_letter_route", with_bindings(
    "SELECT id AS event_id, topic || '.dlq' AS topic, topic AS original_topic, aggregate_id, failure_reason FROM outbox WHERE failure_reason IS NOT NULL"))
def _(t):
    return ev.dead_letter_route(t.outbox)


@query("live_counts", with_bindings(
    """SELECT topic, CASE WHEN failure_reason IS NOT NULL THEN 'failed' WHEN published_at IS NOT NULL THEN 'published' ELSE 'pending' END AS state, count(*) AS count
    FROM outbox GROUP BY 1, 2"""))
def _(t):
    return ev.live_counts(t.outbox)


WINDOWS = """slid AS (SELECT route, w AS window_start, w + INTERVAL 5 MINUTE AS window_end, count(*) AS requests, count(*) FILTER (WHERE status_code >= 500) AS errors
    FROM (SELECT *, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 4 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS w FROM request) GROUP BY ALL)"""


@query("rolling_error_rate", with_bindings("SELECT * FROM slid", WINDOWS))
def _(t):
    return ev.rolling_errors(t.request)


@query("held_alerts", with_bindings(
    """SELECT route, min(window_start) AS started_at, max(window_start) AS last_at, count(*) AS windows, max(errors) AS peak_errors FROM (
      SELECT *, epoch_us(window_start) // 60000000 - row_number() OVER (PARTITION BY route ORDER BY window_start) AS run FROM slid WHERE errors > 0)
    GROUP BY route, run HAVING count(*) > 4""", WINDOWS))
def _(t):
    return ev.held_alerts(ev.rolling_errors(t.request), 4)


def alert_changes(t):
    """Changes of all four rules from requests, outbox, jobs and lag samples."""
    settled = t.outbox.select(F.when(F.col("failure_reason").isNotNull(), F.col("created_at")).alias("failed_at"),
                              F.when(F.col("id") % 3 != 0, F.col("created_at") + F.expr("INTERVAL 20 MINUTES")).alias("settled_at"))
    job = t.job.select(F.when(F.col("status") == "FAILED", F.col("created_at")).alias("failed_at"),
                       F.when(F.col("id") % 4 != 0, F.col("updated_at")).alias("settled_at"))
    lag = t.keyed_event.select((F.col("user_id") % 3).cast("string").alias("series"), "ts", (F.col("k") + 30).alias("lag"))
    changes = alerts.error_changes(t.request)
    for more in (alerts.failure_changes(settled, "failed_events", "failed_at", "settled_at"), alerts.failure_changes(job, "failed_jobs", "failed_at", "settled_at"), alerts.lag_changes(lag)):
        changes = changes.unionByName(more)
    return changes


MOVES = (
    """moved AS (
      SELECT 'http_5xx' AS rule, unnest([ts, ts + INTERVAL 5 MINUTE]) AS ts, unnest([1, -1]) AS delta FROM request WHERE status_code >= 500
      UNION ALL SELECT 'failed_events', created_at, 1 FROM outbox WHERE failure_reason IS NOT NULL
      UNION ALL SELECT 'failed_events', created_at + INTERVAL 20 MINUTE, -1 FROM outbox WHERE failure_reason IS NOT NULL AND id % 3 <> 0
      UNION ALL SELECT 'failed_jobs', created_at, 1 FROM job WHERE status = 'FAILED'
      UNION ALL SELECT 'failed_jobs', updated_at, -1 FROM job WHERE status = 'FAILED' AND id % 4 <> 0
      UNION ALL SELECT 'consumer_lag', ts, above - lag(above, 1, 0) OVER (PARTITION BY series ORDER BY ts) FROM (SELECT user_id % 3 AS series, ts, max(CAST(k + 30 > 100 AS INTEGER)) AS above FROM keyed_event GROUP BY 1, 2))""",
    "moments AS (SELECT rule, ts, sum(delta) AS delta FROM moved GROUP BY rule, ts)",
    "levels AS (SELECT *, sum(delta) OVER (PARTITION BY rule ORDER BY ts) AS level, max(ts) OVER (PARTITION BY rule) AS horizon FROM moments)",
    "edges AS (SELECT *, lead(ts) OVER (PARTITION BY rule ORDER BY ts) AS ended_at FROM levels WHERE (level > 0) <> (level - delta > 0))",
    """fired AS (SELECT rule, ts AS started_at, ended_at, ts + INTERVAL 1 SECOND * CASE rule WHEN 'http_5xx' THEN 300 WHEN 'consumer_lag' THEN 900 ELSE 600 END AS fires, horizon FROM edges WHERE level > 0)""",
)


@query("held_conditions", with_bindings(
    """SELECT rule, CAST(started_at AS TIMESTAMP) AS started_at, state, CAST(moment AS TIMESTAMP) AS moment FROM (SELECT rule, started_at, unnest(['firing', 'resolved']) AS state, unnest([fires, ended_at]) AS moment FROM fired
      WHERE fires < coalesce(ended_at, horizon) OR (ended_at IS NULL AND fires <= horizon)) WHERE moment IS NOT NULL""", *MOVES))
def _(t):
    return alerts.held_conditions(alert_changes(t)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "moment")})


@query("event_projection", with_bindings(
    """SELECT aggregate_id, CASE arg_max(topic, (created_at, id)) WHEN 'expense.created' THEN 'DRAFT' WHEN 'expense.approved' THEN 'APPROVED' WHEN 'expense.rejected' THEN 'REJECTED' ELSE 'UPDATED' END AS status,
    max(created_at) AS occurred_at, arg_max(id, (created_at, id)) AS event_id, count(*) AS events FROM outbox WHERE topic LIKE 'expense.%' GROUP BY aggregate_id"""))
def _(t):
    return ev.event_projection(t.outbox)


VALID = """typed AS (SELECT batch_id, row_no, nullif(trim(title), '') AS title, TRY_CAST(date AS TIMESTAMP) AS d, coalesce(currency, 'TRY') AS cur,
      CASE WHEN amount_minor IS NOT NULL THEN CAST(amount_minor AS BIGINT) WHEN regexp_matches(amount, '^-?[0-9]+([,.][0-9]{1,2})?$') THEN CAST(round(CAST(replace(amount, ',', '.') AS DOUBLE) * 100) AS BIGINT) END AS am,
      CASE WHEN tax IS NULL THEN 0 WHEN tax = '-1.50' THEN -150 END AS tx, CASE WHEN coalesce(reimbursable, '') IN ('', 'no') THEN FALSE WHEN reimbursable IN ('Evet', '1') THEN TRUE END AS rb FROM import_raw),
  errs AS (SELECT batch_id, row_no + 2 AS row, unnest(list_filter([CASE WHEN title IS NULL THEN 'title:TITLE_REQUIRED' END, CASE WHEN d IS NULL THEN 'occurred_at:VALID_DATE_REQUIRED' END,
      CASE WHEN cur = 'XXX' THEN 'currency:INVALID_CURRENCY' END, CASE WHEN am IS NULL THEN 'amount:VALID_AMOUNT_REQUIRED' END, CASE WHEN tx IS NULL THEN 'tax:INVALID_TAX_AMOUNT' END,
      CASE WHEN rb IS NULL THEN 'reimbursable:INVALID_BOOLEAN' END], lambda x: x IS NOT NULL)) AS e FROM typed)"""


@query("csv_import_errors", with_bindings("SELECT batch_id, row, split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS code FROM errs", VALID))
def _(t):
    return imports.import_errors(imports.validate_import(t.import_raw))


@query("csv_import_batches", with_bindings(
    """SELECT t.batch_id, count(*) AS total_rows, CAST(coalesce(any_value(n), 0) AS BIGINT) AS failed_rows, CASE WHEN any_value(n) IS NULL THEN count(*) ELSE 0 END AS imported_rows,
    CASE WHEN any_value(n) IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM typed t LEFT JOIN (SELECT batch_id, count(*) AS n FROM errs GROUP BY batch_id) e ON e.batch_id = t.batch_id GROUP BY t.batch_id""", VALID))
def _(t):
    return imports.import_batches(imports.validate_import(t.import_raw))


@query("csv_import_validated", with_bindings(
    """SELECT batch_id, row_no, title, d AS occurred_at, cur AS currency, am AS amount_minor, CAST(tx AS BIGINT) AS tax_minor, rb AS reimbursable, FALSE AS business_expense
    FROM typed WHERE batch_id NOT IN (SELECT batch_id FROM errs)""", VALID))
def _(t):
    return imports.accepted_rows(imports.validate_import(t.import_raw)).drop("merchant_name", "description")


@query("jsonl_scan", with_bindings("SELECT offset_id, json_extract_string(value, '$.topic') AS topic, json_extract_string(value, '$.id') AS id FROM message WHERE value NOT IN ('', '{\"id\": ')"))
def _(t):
    good, _bad = imports.parse_json_rows(t.message.select("offset_id", "value").where(F.trim("value") != ""), "topic string, id string")
    return good


@query("safe_csv_sink", with_bindings(
    """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN regexp_matches(label, '^[=+@-]') THEN '''' || label ELSE label END AS label, coalesce(category_id, '') AS category_id,
      CASE WHEN amount < 0 THEN '''' ELSE '' END || CAST(amount AS VARCHAR) AS amount, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.000Z') AS occurred_at, CAST(reimbursable AS VARCHAR) AS reimbursable
    FROM (SELECT *, CASE id % 3 WHEN 0 THEN '=x' WHEN 1 THEN '@' ELSE 'plain' END AS label, amount_minor - 20000000 AS amount FROM expense)"""))
def _(t):
    label = F.when(F.col("id") % 3 == 0, "=x").when(F.col("id") % 3 == 1, "@").otherwise("plain")
    return sinks.csv_cells(t.expense.select(
        "id", label.alias("label"), "category_id", (F.col("amount_minor") - 20000000).alias("amount"), "occurred_at", "reimbursable"))


@query("export_manifest")
def _(t):
    return sinks.manifest_row(spend.report_totals(t.expense, "merchant"), "merchant_spend_csv", "exports/merchant.csv")


@query("merge_upsert", with_bindings(
    """SELECT coalesce(u.budget_id, c.budget_id) AS budget_id, coalesce(u.starts_at, c.starts_at) AS starts_at, CASE WHEN u.budget_id IS NOT NULL THEN u.spent_minor ELSE c.spent_minor END AS spent_minor
    FROM (SELECT * FROM periods WHERE budget_id < 15) c FULL JOIN (SELECT budget_id, starts_at, CASE WHEN budget_id = 12 THEN NULL ELSE spent_minor * 2 END AS spent_minor FROM periods WHERE budget_id >= 10) u
      ON u.budget_id = c.budget_id AND u.starts_at = c.starts_at""",
    "periods AS (SELECT budget_id, CAST(date_trunc('month', updated_at) AS DATE) AS starts_at, CAST(sum(spent_minor) AS BIGINT) AS spent_minor FROM budget_period GROUP BY 1, 2)"))
def _(t):
    periods = t.budget_period.groupBy("budget_id", F.trunc("updated_at", "month").alias("starts_at")).agg(F.sum("spent_minor").alias("spent_minor"))
    updates = periods.where("budget_id >= 10").withColumn("spent_minor", F.when(F.col("budget_id") != 12, F.col("spent_minor") * 2))
    return sinks.merge_upsert(periods.where("budget_id < 15"), updates, ["budget_id", "starts_at"])


LEVEL = "CASE WHEN id % 7 = 3 THEN 'hardcase' WHEN id % 5 = 0 THEN CASE WHEN source = 'src3' THEN 'fixture' ELSE 'document' END WHEN id % 5 = 1 AND split = 'train' THEN 'character' WHEN id % 11 = 2 THEN 'page' ELSE 'line' END"


@query("partitioned_manifests", with_bindings(
    f"""SELECT name AS manifest, count(id) AS rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS letters, count(DISTINCT source) AS sources FROM (SELECT unnest({list(sinks.MANIFESTS)}) AS name)
    LEFT JOIN (SELECT *, CASE level WHEN 'document' THEN 'document_benchmark' WHEN 'fixture' THEN 'project_fixture_benchmark' WHEN 'page' THEN NULL ELSE level || '_' || CASE split WHEN 'train' THEN 'train' ELSE 'validation' END END AS m
      FROM (SELECT *, {LEVEL} AS level FROM manifest)) ON m = name GROUP BY name"""))
def _(t):
    """All eight manifests written and read back; one of them has no row."""
    path = scratch(t.spark, "manifests")
    sinks.write_manifests(t.manifest.select("id", "source", "split", "text", F.expr(LEVEL).alias("level")), path)
    return sinks.manifest_sizes(sinks.read_manifests(t.spark, path, "id long, source string, split string, text string, level string"))
