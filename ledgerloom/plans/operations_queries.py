"""Operational tables and reports: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as ops
from ..operators import reports, workload
from ..functions.text import reason_codes
from .bindings import AS_OF, EVENTS_AS_OF, with_bindings
from .registry import query

LIVE = "live AS (SELECT *, CAST(date_trunc('month', occurred_at) AS DATE) AS month FROM expense WHERE archived_at IS NULL)"
STATES = """stated AS (SELECT *, CASE WHEN failure_reason IS NOT NULL THEN 'failed' WHEN published_at IS NOT NULL THEN 'published'
    ELSE 'pending' END AS state FROM outbox)"""


@query("keyset_page", with_bindings(
    """SELECT id, kind, created_at FROM document_file WHERE deleted_at IS NULL AND kind = 'en' AND contains(lower(original_name), 'scan')
    AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-28 00:00:00'
    AND (created_at < TIMESTAMP '2024-01-20 00:00:00' OR (created_at = TIMESTAMP '2024-01-20 00:00:00' AND id < 900))
    ORDER BY created_at DESC, id DESC LIMIT 26"""))
def _(t):
    page = ops.keyset_page(t.document_file, 25, ("2024-01-20 00:00:00", 900), "en", "SCAN", "2024-01-05 00:00:00",
                           "2024-01-28 00:00:00")
    return page.select("id", "kind", "created_at")


@query("audit_filter", with_bindings(
    """SELECT id, action, actor_user_id, created_at FROM audit WHERE action = 'view.1' AND resource_type = 'Expense'
    ORDER BY created_at DESC, id DESC LIMIT 50"""))
def _(t):
    rows = ops.audit_filter(t.audit, 50, action="view.1", resource_type="Expense")
    return rows.select("id", "action", "actor_user_id", "created_at")


@query("retention_cut", with_bindings(
    f"""SELECT tenant_id, count(*) FILTER (WHERE created_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS matched,
    count(*) FILTER (WHERE created_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS kept FROM audit GROUP BY tenant_id"""))
def _(t):
    return ops.retention_cut(t.audit, EVENTS_AS_OF, 7)


@query("retention_sample", with_bindings(
    f"""SELECT tenant_id, id, created_at, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS rank FROM audit
    WHERE created_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY QUALIFY rank <= 50"""))
def _(t):
    return ops.retention_sample(t.audit, EVENTS_AS_OF, 7).select("tenant_id", "id", "created_at", "rank")


DLQ = """dlq AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rank FROM outbox
    WHERE starts_with(failure_reason, 'DLQ:') AND contains(lower(failure_reason), 'broker'))"""


@query("dead_letter_select", with_bindings("SELECT id, tenant_id, topic, failure_reason, rank FROM dlq WHERE rank <= 25", DLQ))
def _(t):
    return ops.dead_letters(t.outbox, 25, reason="BROKER").select("id", "tenant_id", "topic", "failure_reason", "rank")


@query("dead_letter_replay", with_bindings(
    """SELECT id, tenant_id, topic, aggregate_id, 'requeued' AS action, CAST(NULL AS VARCHAR) AS failure_reason FROM dlq WHERE rank <= 25""", DLQ))
def _(t):
    return ops.replay_plan(t.outbox, 25, dry_run=False, reason="broker")


@query("dead_letter_replay_preview", with_bindings(
    """SELECT id, tenant_id, topic, aggregate_id, 'would_requeue' AS action, failure_reason FROM dlq WHERE rank <= 25""", DLQ))
def _(t):
    return ops.replay_plan(t.outbox, 25, dry_run=True, reason="broker")


@query("unread_notifications", with_bindings(
    """SELECT user_id, id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM notification
    WHERE read_at IS NULL QUALIFY rank <= 50"""))
def _(t):
    return ops.unread_notifications(t.notification).select("user_id", "id", "created_at", "rank")


@query("promotable_models", with_bindings(
    """SELECT model_version_id, engine, block_code, block_code IS NULL AS promotable FROM (
      SELECT id AS model_version_id, engine, CASE WHEN engine <> 'CUSTOM_CRNN' THEN NULL
        WHEN artifact_bucket IS NULL OR artifact_key = '' THEN 'CUSTOM_OCR_PROMOTION_ARTIFACT_REQUIRED'
        WHEN NOT contains(metrics, 'profile') OR contains(metrics, 'smoke') THEN 'CUSTOM_OCR_PROMOTION_SMOKE_MODEL_BLOCKED'
        WHEN contains(metrics, '"failed"') OR contains(metrics, 'WrongCount":2') THEN 'CUSTOM_OCR_PROMOTION_REAL_FIXTURE_GATE_FAILED'
        WHEN NOT contains(metrics, 'Passed":true') THEN 'CUSTOM_OCR_PROMOTION_REQUIRES_REAL_FIXTURE_VALIDATION' END AS block_code
      FROM model_version)"""))
def _(t):
    return ops.promotable_models(t.model_version)


@query("ocr_quality_rows", with_bindings(
    """SELECT CAST(date_trunc('month', coalesce(j.completed_at, j.created_at)) AS DATE) AS month, d.workspace_id, d.id AS document_id, d.kind,
    d.safe_name, j.id AS job_id, j.status AS job_status, j.requested_engines, r.engine, r.status AS run_status, r.confidence, r.latency_ms,
    coalesce(json_extract_string(x, '$.selectedEngine'), '') AS selected_engine,
    CASE WHEN json_type(x, '$.averageConfidence') = 'DOUBLE' THEN format('{:.4f}', CAST(json_extract_string(x, '$.averageConfidence') AS DOUBLE)) ELSE '' END AS average_confidence,
    CASE WHEN json_type(x, '$.failureRate') = 'DOUBLE' THEN format('{:.4f}', CAST(json_extract_string(x, '$.failureRate') AS DOUBLE)) ELSE '' END AS failure_rate,
    CASE WHEN json_type(x, '$.characterErrorRate') = 'DOUBLE' THEN '0.1235' ELSE '' END AS character_error_rate,
    '' AS word_error_rate, CASE WHEN x IS NULL THEN '' ELSE 'date|total' END AS conflict_fields, coalesce(r.failure_reason, '') AS failure_reason
    FROM (SELECT *, CASE WHEN engine = 'ENSEMBLE' THEN normalized_json END AS x FROM ocr_run) r JOIN ocr_job j ON j.id = r.job_id
    JOIN document_file d ON d.id = j.document_id"""))
def _(t):
    return reports.ocr_quality_rows(t.document_file, t.ocr_job, t.ocr_run)


@query("model_evaluation_rows", with_bindings(
    """SELECT e.id AS evaluation_run_id, e.model_version_id, e.status AS evaluation_status, e.completed_at,
    format('{:.4f}', CAST(json_extract_string(metrics, '$.accuracy') AS DOUBLE)) AS accuracy, '' AS macro_f1, '' AS loss, '0.5000' AS cer,
    '' AS wer, '' AS field_accuracy, 'ok' AS accuracy_note, coalesce(m.name, '') AS model_name, coalesce(m.engine, '') AS engine,
    coalesce(m.status, '') AS model_status, tr.id AS training_run_id, coalesce(tr.status, '') AS training_status
    FROM evaluation_run e LEFT JOIN (SELECT id, name, engine, status FROM model_version) m ON m.id = e.model_version_id
    LEFT JOIN (SELECT * FROM training_run QUALIFY row_number() OVER (PARTITION BY model_version_id ORDER BY created_at DESC, id DESC) = 1) tr
      ON tr.model_version_id = e.model_version_id"""))
def _(t):
    return reports.model_evaluation_rows(t.model_version, t.training_run, t.evaluation_run)


@query("audit_pack", with_bindings(
    """SELECT workspace_id, month, 'expense' AS row_type, 'Expense' AS resource_type, CAST(id AS VARCHAR) AS resource_id,
      updated_at AS event_at, status AS action_or_status, amount_minor, currency FROM live
    UNION ALL SELECT workspace_id, month, 'audit_event', resource_type, coalesce(resource_id, ''), created_at, action, NULL, NULL FROM (
      SELECT l.workspace_id, l.month, a.* FROM audit a JOIN live l ON a.resource_type = 'Expense' AND a.resource_id = CAST(l.id AS VARCHAR)
      UNION SELECT CAST(json_extract_string(metadata, '$.workspaceId') AS INTEGER), CAST(date_trunc('month', created_at) AS DATE), * FROM audit
        WHERE json_extract_string(metadata, '$.workspaceId') IS NOT NULL)""", LIVE))
def _(t):
    return reports.audit_pack(t.expense, t.audit)


def labelled(t):
    child = t.annotation
    return reports.labelled_documents(
        t.document_file, child.where(F.col("role") == "user"), child.where(F.col("role") == "assistant"),
        child.where(F.col("role") == "system"),
    )


@query("labelled_documents", with_bindings(
    """SELECT d.id AS document_id, CAST(0 AS BIGINT) AS part, d.kind,
      (SELECT coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY turn), '') FROM annotation a WHERE a.document_id = d.id AND role = 'user') AS labels,
      (SELECT coalesce(string_agg(a.text, ',' ORDER BY turn), '') FROM annotation a WHERE a.document_id = d.id AND role = 'assistant') AS corrections,
      (SELECT count(*) FROM annotation a WHERE a.document_id = d.id AND role = 'system') AS suggestions
    FROM document_file d WHERE deleted_at IS NULL"""))
def _(t):
    def joined(name, field):
        return F.coalesce(F.array_join(F.transform(name, lambda x: x[field].cast("string")), ","), F.lit(""))
    return labelled(t).select(
        "document_id", "part", "kind", joined("labels", "id").alias("labels"), joined("corrections", "text").alias("corrections"),
        F.coalesce(F.size("suggestions"), F.lit(0)).cast("long").alias("suggestions"))


@query("nested_jsonl_sink")
def _(t):
    return reports.dataset_export(labelled(t))


@query("eligible_reviewers", with_bindings(
    """SELECT id, tenant_id, display_name FROM app_user WHERE NOT disabled AND id IN (SELECT user_id FROM user_role
    WHERE role IN ('OWNER', 'ADMIN', 'FINANCE_MANAGER', 'REVIEWER'))"""))
def _(t):
    return workload.eligible_reviewers(t.app_user, t.user_role)


def endpoints(t):
    return t.endpoint.withColumn("event_types", F.split("event_types", ","))


@query("event_subscriptions", with_bindings(
    """SELECT o.id AS event_id, e.id AS endpoint_id, o.tenant_id, o.topic FROM outbox o JOIN endpoint e ON e.tenant_id = o.tenant_id
    AND e.enabled AND list_contains(string_split(e.event_types, ','), o.topic)"""))
def _(t):
    return ops.event_subscriptions(t.outbox, endpoints(t))


@query("tenant_usage", with_bindings(
    """SELECT w.tenant_id, workspaces, coalesce(documents, 0) AS documents, CAST(coalesce(bytes, 0) AS BIGINT) AS used_bytes,
      CAST(1000000 - coalesce(bytes, 0) AS BIGINT) AS remaining_bytes, CAST((coalesce(bytes, 0) * 10000) // 1000000 AS DOUBLE) / 100 AS quota_percent,
      CASE WHEN coalesce(bytes, 0) >= 1000000 THEN 'exceeded' WHEN coalesce(bytes, 0) >= 800000 THEN 'warning' ELSE 'ok' END AS quota_status,
      coalesce(active, 0) AS active_expenses, coalesce(archived, 0) AS archived_expenses, coalesce(totals, '') AS currency_totals
    FROM (SELECT r_regionkey % 3 AS tenant_id, count(*) AS workspaces FROM region GROUP BY 1) w
    LEFT JOIN (SELECT tenant_id, count(*) AS documents, sum(size_bytes) AS bytes FROM document_file WHERE deleted_at IS NULL GROUP BY 1) d ON d.tenant_id = w.tenant_id
    LEFT JOIN (SELECT tenant_id, CAST(sum(a) AS BIGINT) AS active, CAST(sum(b) AS BIGINT) AS archived,
        string_agg(currency || '=' || CAST(m AS VARCHAR), '|' ORDER BY currency) AS totals
      FROM (SELECT workspace_id % 3 AS tenant_id, currency, count(*) FILTER (WHERE archived_at IS NULL) AS a,
        count(*) FILTER (WHERE archived_at IS NOT NULL) AS b, sum(amount_minor) FILTER (WHERE archived_at IS NULL) AS m FROM expense GROUP BY 1, 2)
      GROUP BY 1) e ON e.tenant_id = w.tenant_id"""))
def _(t):
    spaces = t.region.select((F.col("r_regionkey") % 3).alias("tenant_id"))
    expense = t.expense.withColumn("tenant_id", F.col("workspace_id") % 3)
    return ops.tenant_usage(spaces, t.document_file, expense, 1_000_000)


def two_level(table: str, key: str, state: str, values: tuple[str, ...], ctes: tuple[str, ...] = ()) -> str:
    zero = " UNION ALL ".join(f"SELECT '{v}' AS {state}" for v in values)
    return with_bindings(
        f"""SELECT 'detail' AS level, {key}, {state}, count(*) AS count FROM {table} GROUP BY {key}, {state}
        UNION ALL SELECT 'total', NULL, z.{state}, count(x.{key}) FROM ({zero}) z LEFT JOIN {table} x ON x.{state} = z.{state}
        GROUP BY z.{state}""", *ctes)


@query("outbox_counts", two_level("stated", "topic", "state", ops.OUTBOX_STATES, (STATES,)))
def _(t):
    return ops.outbox_counts(t.outbox)


@query("inbox_counts", two_level("inbox", "topic", "status", ops.INBOX_STATES))
def _(t):
    return ops.inbox_counts(t.inbox)


@query("job_counts", with_bindings(
    """SELECT 'status' AS level, NULL AS queue, z.status, NULL AS worker, count(j.id) AS count FROM (SELECT unnest(['QUEUED', 'RUNNING',
      'SUCCEEDED', 'FAILED', 'CANCELED']) AS status) z LEFT JOIN job j ON j.status = z.status GROUP BY z.status
    UNION ALL SELECT 'queue', queue, status, NULL, count(*) FROM job GROUP BY queue, status
    UNION ALL SELECT 'failed', queue, status, locked_by, count(*) FROM job WHERE status = 'FAILED' AND locked_by IS NOT NULL
      GROUP BY queue, status, locked_by"""))
def _(t):
    return ops.job_counts(t.job)


@query("engine_run_metrics", with_bindings(
    """SELECT engine, status, count(*) AS count, any_value(c) AS mean_confidence, any_value(l) AS mean_latency_ms FROM (SELECT *,
      round(avg(confidence) OVER (PARTITION BY engine), 6) AS c, round(avg(latency_ms) OVER (PARTITION BY engine), 6) AS l FROM ocr_run)
    GROUP BY engine, status"""))
def _(t):
    return ops.engine_run_metrics(t.ocr_run)


@query("review_metrics", with_bindings(
    """SELECT 'tasks_' || lower(z.status) AS metric, CAST(count(r.id) AS DOUBLE) AS value FROM (SELECT unnest(['QUEUED', 'RUNNING',
      'SUCCEEDED', 'FAILED', 'CANCELED']) AS status) z LEFT JOIN review_task r ON r.status = z.status GROUP BY z.status
    UNION ALL SELECT CASE role WHEN 'user' THEN 'annotations' WHEN 'assistant' THEN 'corrections' ELSE 'suggestions' END, CAST(count(*) AS DOUBLE)
      FROM annotation GROUP BY role
    UNION ALL SELECT 'correction_rate', round((SELECT count(*) FROM annotation WHERE role = 'assistant')
      / (SELECT count(*) FROM review_task WHERE status = 'SUCCEEDED'), 6)"""))
def _(t):
    role = lambda r: t.annotation.where(F.col("role") == r)
    return workload.review_metrics(t.review_task, role("assistant"), role("user"), role("system"))


@query("audit_top10", with_bindings(
    """SELECT tenant_id, 'total' AS kind, NULL AS label, count(*) AS count, 1 AS rank FROM audit GROUP BY tenant_id
    UNION ALL (SELECT tenant_id, 'action', action, count(*) AS n, row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, action) AS rn
      FROM audit GROUP BY tenant_id, action QUALIFY rn <= 10)
    UNION ALL (SELECT tenant_id, 'resource', resource_type, count(*) AS n, row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, resource_type) AS rn
      FROM audit GROUP BY tenant_id, resource_type QUALIFY rn <= 10)"""))
def _(t):
    return ops.audit_top(t.audit)


def minutes(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 60000000.0) AS BIGINT)"


NOW = f"TIMESTAMP '{AS_OF}'"
FACTS = f"""reviewer AS (SELECT * FROM app_user WHERE NOT disabled AND id IN (SELECT user_id FROM user_role
      WHERE role IN ('OWNER', 'ADMIN', 'FINANCE_MANAGER', 'REVIEWER'))),
  facts AS (SELECT *, status IN ('QUEUED', 'RUNNING') AS is_open, coalesce(due_at < {NOW}, FALSE) AS late,
      coalesce(due_at BETWEEN {NOW} AND {NOW} + INTERVAL 24 HOUR, FALSE) AS soon, greatest(0, {minutes(NOW, 'created_at')}) AS age,
      {minutes(NOW, 'due_at')} AS late_by, {minutes('due_at', NOW)} AS due_in FROM review_task),
  loaded AS (SELECT tenant_id, assigned_to, count(*) FILTER (WHERE status = 'QUEUED') AS queued, count(*) FILTER (WHERE status = 'RUNNING') AS running,
      count(*) FILTER (WHERE status = 'SUCCEEDED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS rejected,
      count(*) FILTER (WHERE is_open AND late) AS overdue, count(*) FILTER (WHERE is_open AND soon) AS due_soon,
      max(age) FILTER (WHERE is_open) AS oldest_open_minutes FROM facts GROUP BY tenant_id, assigned_to),
  work AS (SELECT r.tenant_id, 'reviewer' AS row_type, r.id AS reviewer_id, r.display_name, coalesce(queued, 0) AS queued, coalesce(running, 0) AS running,
      coalesce(completed, 0) AS completed, coalesce(rejected, 0) AS rejected, coalesce(overdue, 0) AS overdue, coalesce(due_soon, 0) AS due_soon,
      oldest_open_minutes FROM reviewer r LEFT JOIN loaded l ON l.tenant_id = r.tenant_id AND l.assigned_to = r.id
    UNION ALL SELECT tenant_id, 'unassigned', NULL, NULL, queued, running, 0, 0, overdue, due_soon, oldest_open_minutes FROM loaded WHERE assigned_to IS NULL)"""


@query("reviewer_workload", with_bindings(
    """SELECT *, queued + running + overdue * 2 + due_soon AS workload_score FROM (SELECT * FROM work
    UNION ALL SELECT tenant_id, 'total', NULL, NULL, CAST(sum(queued) AS BIGINT), CAST(sum(running) AS BIGINT), CAST(sum(completed) AS BIGINT),
      CAST(sum(rejected) AS BIGINT), CAST(sum(overdue) AS BIGINT), CAST(sum(due_soon) AS BIGINT), max(oldest_open_minutes) FROM work GROUP BY tenant_id)""",
    FACTS))
def _(t):
    return workload.reviewer_workload(workload.eligible_reviewers(t.app_user, t.user_role), t.review_task, AS_OF)


REBALANCE = """scored AS (SELECT tenant_id, reviewer_id AS id, queued + running + overdue * 2 + due_soon AS score,
      row_number() OVER (PARTITION BY tenant_id ORDER BY queued + running + overdue * 2 + due_soon, display_name, reviewer_id) AS rn
    FROM work WHERE row_type = 'reviewer'),
  moves AS (SELECT f.tenant_id, 'ASSIGN' AS action, CASE WHEN late THEN 'SLA_OVERDUE_UNASSIGNED' ELSE 'SLA_DUE_SOON_UNASSIGNED' END AS reason_code,
      CASE WHEN late THEN 1000 + late_by ELSE 700 - least(due_in, 700) END AS priority, f.id AS task_id, NULL AS current_assignee, s.id AS target_reviewer, age AS age_minutes
    FROM facts f JOIN scored s ON s.tenant_id = f.tenant_id AND s.rn = 1 WHERE is_open AND assigned_to IS NULL AND (late OR soon)
    UNION ALL SELECT s.tenant_id, 'REASSIGN', 'OVERLOADED_REVIEWER', 500 + s.score - g.score + p.pressure, p.id, s.id, g.id, p.age
    FROM scored s JOIN scored g ON g.tenant_id = s.tenant_id AND g.rn = CASE WHEN s.rn = 1 THEN 2 ELSE 1 END
    JOIN (SELECT *, CASE WHEN due_at IS NULL THEN age WHEN late THEN age + late_by + 1440 ELSE age + greatest(0, 1440 - due_in) END AS pressure
      FROM facts WHERE is_open AND assigned_to IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY tenant_id, assigned_to ORDER BY pressure DESC, id) = 1) p
      ON p.tenant_id = s.tenant_id AND p.assigned_to = s.id WHERE s.score - g.score >= 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY priority DESC, age_minutes DESC, task_id) AS rank FROM moves QUALIFY rank <= 8)"""


def suggestions(t):
    return workload.rebalance_suggestions(workload.eligible_reviewers(t.app_user, t.user_role), t.review_task, AS_OF)


@query("rebalance_suggestions", with_bindings("SELECT * FROM ranked", FACTS, REBALANCE))
def _(t):
    return suggestions(t)


@query("escalation_plan", with_bindings(
    """SELECT k.tenant_id, rank, task_id, target_reviewer, CASE WHEN r.reason_code = 'SLA_ESCALATED' THEN 'SLA_ESCALATED'
      ELSE r.reason_code || ',SLA_ESCALATED' END || ',' || k.reason_code AS reason_codes FROM ranked k JOIN review_task r ON r.id = k.task_id
    WHERE rank <= 5""", FACTS, REBALANCE))
def _(t):
    task = t.review_task.withColumn("reason_codes", F.array("reason_code"))
    plan = workload.escalation_plan(suggestions(t), task, 5)
    return plan.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("reason_code_normalise", with_bindings(
    """SELECT id, upper(reason_code) || CASE WHEN lower(status) <> lower(reason_code) THEN '|_' || status || '_' ELSE '' END AS reason_codes
    FROM review_task"""))
def _(t):
    raw = F.array(F.lower("reason_code"), F.lit("  "), F.concat(F.lit("-"), F.lower("status"), F.lit("!")), "reason_code")
    return t.review_task.select("id", F.array_join(reason_codes(raw), "|").alias("reason_codes"))


@query("latency_histogram", with_bindings(
    """SELECT method, route, status_code, le, count(*) FILTER (WHERE duration_seconds <= CASE le WHEN '+Inf' THEN 1e300 ELSE CAST(le AS DOUBLE) END) AS bucket_count,
    count(*) AS observations, round(sum(duration_seconds), 6) AS seconds FROM request JOIN (SELECT unnest(['0.005', '0.01', '0.025', '0.05', '0.1',
      '0.25', '0.5', '1', '2.5', '5', '10', '+Inf']) AS le) ON TRUE GROUP BY ALL"""))
def _(t):
    return ops.latency_histogram(t.request)


@query("table_fingerprint")
def _(t):
    return ops.table_fingerprint(t.expense, ["workspace_id"], ["id", "amount_minor", "status", "updated_at", "archived_at"])


@query("monthly_report_summary", with_bindings(
    """SELECT workspace_id, month, count(*) AS expense_count, string_agg(DISTINCT currency, ', ' ORDER BY currency) AS currencies,
    CAST(sum(amount_minor) AS BIGINT) AS total_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE business_expense), 0) AS BIGINT) AS business_minor,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE reimbursable), 0) AS BIGINT) AS reimbursable_minor FROM live GROUP BY 1, 2""", LIVE))
def _(t):
    return reports.monthly_report_summary(t.expense)


@query("claim_report_summary", with_bindings(
    """SELECT workspace_id, count(*) AS claim_count, count(*) FILTER (WHERE status = 'APPROVED') AS approved,
    count(*) FILTER (WHERE status = 'REIMBURSED') AS reimbursed, string_agg(DISTINCT currency, ', ') AS currencies,
    CAST(sum(total_minor) AS BIGINT) AS total_minor FROM claim WHERE status IN ('APPROVED', 'REIMBURSED') GROUP BY 1"""))
def _(t):
    return reports.claim_report_summary(t.claim)


@query("consumer_lag", with_bindings(
    """SELECT c.group_id, c.topic, c.partition_id, c.committed, coalesce(h.high, c.committed) AS high,
    greatest(0, coalesce(h.high, c.committed) - c.committed) AS lag FROM committed_offset c
    LEFT JOIN topic_offset h ON h.topic = c.topic AND h.partition_id = c.partition_id"""))
def _(t):
    return ops.consumer_lag(t.committed_offset, t.topic_offset)


@query("currency_totals", with_bindings(
    "SELECT workspace_id, currency, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM expense GROUP BY 1, 2"))
def _(t):
    return ops.currency_totals(t.expense)


@query("dataset_readiness", with_bindings(
    """SELECT "check", CAST(value AS BIGINT) AS value, value >= needed AS passed FROM (
      SELECT 'users' AS "check", count(*) AS value, 6 AS needed FROM app_user WHERE NOT disabled
      UNION ALL SELECT 'documents', count(*), 20 FROM document_file WHERE deleted_at IS NULL
      UNION ALL SELECT 'expenses', count(*), 25 FROM live UNION ALL SELECT 'expenseMonths', count(DISTINCT month), 3 FROM live
      UNION ALL SELECT 'expenseStates', count(DISTINCT status), 5 FROM expense WHERE status IN ('DRAFT', 'NEEDS_REVIEW', 'APPROVED', 'REJECTED', 'REIMBURSED')
      UNION ALL SELECT 'budgets', count(*), 3 FROM ratios UNION ALL SELECT 'budgetHealthy', count(*), 1 FROM ratios WHERE r > 0 AND r < 0.8
      UNION ALL SELECT 'budgetNearLimit', count(*), 1 FROM ratios WHERE r BETWEEN 0.8 AND 1 UNION ALL SELECT 'budgetExceeded', count(*), 1 FROM ratios WHERE r > 1
      UNION ALL SELECT 'approvalStates', count(DISTINCT state), 3 FROM workflow WHERE state IN ('PENDING', 'APPROVED', 'REJECTED')
      UNION ALL SELECT 'reports', count(DISTINCT type), 3 FROM export_job WHERE status = 'SUCCEEDED'
      UNION ALL SELECT 'ocrJobs', count(*), 1 FROM ocr_job UNION ALL SELECT 'extractions', count(*), 1 FROM extraction WHERE status = 'SUCCEEDED')""",
    LIVE, """ratios AS (SELECT CAST(coalesce(spent_minor, 0) AS DOUBLE) / greatest(1, amount_minor) AS r FROM budget b LEFT JOIN (SELECT * FROM budget_period
      QUALIFY row_number() OVER (PARTITION BY budget_id ORDER BY updated_at DESC, id DESC) = 1) p ON p.budget_id = b.id)"""))
def _(t):
    return ops.dataset_readiness(
        t.app_user, t.document_file, t.expense, t.budget, t.budget_period, t.workflow, t.export_job, t.ocr_job, t.extraction)


@query("stale_and_retryable", with_bindings(
    f"""SELECT queue, document_id, kind, arg_min(id, (created_at, id)) AS id, min(created_at) AS created_at, count(*) AS candidates
    FROM (SELECT *, CASE WHEN status = 'RUNNING' AND updated_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 15 MINUTE THEN 'stale'
      WHEN status = 'FAILED' THEN 'retryable' END AS kind FROM job WHERE attempts < max_attempts) WHERE kind IS NOT NULL
    GROUP BY queue, document_id, kind"""))
def _(t):
    return ops.stale_and_retryable(t.job, EVENTS_AS_OF, 15)


@query("top_merchants", with_bindings(
    """SELECT *, row_number() OVER (PARTITION BY workspace_id, month ORDER BY total_minor DESC, merchant, currency) AS rank FROM (
      SELECT workspace_id, month, coalesce(nullif(trim(coalesce(merchant_name, title)), ''), 'unknown') AS merchant, currency, count(*) AS expense_count,
      CAST(sum(amount_minor) AS BIGINT) AS total_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor FROM live GROUP BY 1, 2, 3, 4) QUALIFY rank <= 12""", LIVE))
def _(t):
    return reports.top_merchants(t.expense)


@query("ledger_head", with_bindings(
    """SELECT workspace_id, month, id, occurred_at, title, amount_minor,
    row_number() OVER (PARTITION BY workspace_id, month ORDER BY occurred_at DESC, id DESC) AS rank FROM live QUALIFY rank <= 24""", LIVE))
def _(t):
    return reports.ledger_head(t.expense)


@query("recent_items", with_bindings(
    """SELECT workspace_id, 'expense' AS kind, row_number() OVER (PARTITION BY workspace_id ORDER BY occurred_at DESC, id DESC) AS rank, id, occurred_at AS at
    FROM live QUALIFY rank <= 5 UNION ALL (SELECT workspace_id, 'document', row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) AS rn,
    id, created_at FROM document_file WHERE deleted_at IS NULL QUALIFY rn <= 5)""", LIVE))
def _(t):
    return reports.recent_items(t.expense, t.document_file)


SEARCHES = {"q1": "on the and", "q2": "token", "q3": "pour la"}


def search_fields(t):
    fields = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(column).alias("value"), F.lit(weight).alias("weight"))
        for label, column, weight in (("filename", "original_name", 2.5), ("safeName", "safe_name", 1.5), ("kind", "kind", 1.0),
                                      ("ocrSnippet", "text", 0.75))
    ])
    return t.document_file.select(F.col("id").alias("document_id"), "created_at", F.explode(fields).alias("f")).select(
        "document_id", "created_at", "f.*")


FOLD = "trim(regexp_replace(replace(lower(strip_accents({0})), 'ı', 'i'), '[^a-z0-9]+', ' ', 'g'))"


@query("lexical_search", with_bindings(
    f"""SELECT query, rank, document_id, score, terms_matched, sources FROM (
      SELECT query, document_id, created_at, round(sum(weight * len(hits)) + 10 * len(list_distinct(flatten(list(hits)))), 2) AS score,
        CAST(len(list_distinct(flatten(list(hits)))) AS INTEGER) AS terms_matched, string_agg(DISTINCT label, ',' ORDER BY label) AS sources,
        row_number() OVER (PARTITION BY query ORDER BY round(sum(weight * len(hits)) + 10 * len(list_distinct(flatten(list(hits)))), 2) DESC, created_at DESC, document_id) AS rank
      FROM (SELECT query, document_id, created_at, label, weight, list_filter(terms, lambda w: contains(folded, w)) AS hits
        FROM (SELECT id AS document_id, created_at, label, {FOLD.format('value')} AS folded, weight FROM (
          SELECT id, created_at, 'filename' AS label, original_name AS value, CAST(2.5 AS DOUBLE) AS weight FROM document_file
          UNION ALL SELECT id, created_at, 'safeName', safe_name, 1.5 FROM document_file
          UNION ALL SELECT id, created_at, 'kind', kind, 1.0 FROM document_file
          UNION ALL SELECT id, created_at, 'ocrSnippet', text, 0.75 FROM document_file)) f
        JOIN (SELECT * FROM (VALUES ('q1', ['on', 'the', 'and']), ('q2', ['token']), ('q3', ['pour', 'la'])) v(query, terms)) q ON TRUE)
      WHERE len(hits) > 0 GROUP BY query, document_id, created_at) WHERE rank <= 10"""))
def _(t):
    return ops.lexical_search(search_fields(t), SEARCHES)


@query("search_snippets")
def _(t):
    fields = search_fields(t)
    return ops.search_snippets(fields, ops.lexical_search(fields, SEARCHES), SEARCHES)
