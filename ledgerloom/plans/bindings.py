"""Logical tables over the star-schema test tables.

Each binding is plain SQL understood by Spark and by the checking engine, so
both sides start from the same rows. Only the operators differ."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Reference instant for every age and deadline in the checks.
AS_OF = "1998-08-02 12:00:30"
EVENTS_AS_OF = "2024-01-20 00:00:30"

BINDINGS: dict[str, str] = {
    "expense": """
        SELECT o_orderkey AS id, n_regionkey AS workspace_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS merchant_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  ' ELSE c_name END
                 AS merchant_name,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS category_id,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS payment_method_name,
               CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 3.0) AS BIGINT) END
                 AS document_id,
               CASE WHEN o_orderkey % 29 = 0 THEN 'ARCHIVED' WHEN o_orderkey % 37 = 0 THEN 'REJECTED'
                    WHEN o_orderstatus = 'O' THEN 'DRAFT' WHEN o_orderstatus = 'P' THEN 'APPROVED'
                    ELSE 'REIMBURSED' END AS status,
               CASE WHEN o_orderkey % 221 = 0 THEN '' ELSE ' Order ' || CAST(o_orderkey % 97 AS STRING) END AS title,
               'paid ' || lower(o_orderpriority) || ' by ' || lower(c_mktsegment) AS description,
               CASE o_custkey % 4 WHEN 0 THEN 'TRY' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS currency,
               CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
               CAST(round(o_totalprice * 18) AS BIGINT) AS tax_minor,
               o_orderdate AS occurred_at,
               o_orderkey % 3 = 0 AS reimbursable, o_orderkey % 2 = 0 AS business_expense,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'P' || CAST(o_orderkey % 7 AS STRING) END AS project_code,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'C' || CAST(o_orderkey % 9 AS STRING) END AS cost_center,
               o_custkey % 20 AS created_by,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 72 AS INT) AS created_at,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 96 AS INT) AS updated_at,
               CASE WHEN o_orderkey % 23 = 0 THEN o_orderdate + INTERVAL '40' DAY ELSE NULL END AS archived_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "budget": """
        SELECT n_nationkey AS id, n_regionkey AS workspace_id, n_name AS name,
               CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'BUILDING'
                 WHEN 3 THEN 'FURNITURE' WHEN 4 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS category_id,
               CASE n_nationkey % 4 WHEN 0 THEN 'TRY' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS currency,
               CAST((n_nationkey % 5) * 30000000 AS BIGINT) AS amount_minor, 80 AS alert_percent
        FROM nation WHERE n_regionkey < 4""",
    "small_ticket": """
        SELECT l_orderkey AS id, l_suppkey % 5 AS workspace_id, l_suppkey AS merchant_id,
               CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE ' Shop  ' || CAST(l_suppkey AS STRING) END AS merchant_name,
               'Ticket ' || CAST(l_suppkey AS STRING) AS title,
               CAST(round(l_quantity * 100) AS BIGINT) - CASE WHEN l_linenumber = 7 THEN 5000 ELSE 0 END
                 AS amount_minor,
               CASE l_suppkey % 2 WHEN 0 THEN 'TRY' ELSE 'EUR' END AS currency,
               l_shipdate AS occurred_at, l_linestatus = 'F' AS business_expense, l_returnflag = 'R' AS reimbursable
        FROM lineitem""",
    "merchant": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "payment": "SELECT DISTINCT o_orderpriority AS id, 'Pay ' || o_orderpriority AS name FROM orders",
    "expense_ids": """
        SELECT id, workspace_id, merchant_id, description AS note, payment_method_name AS payment_method_id, amount_minor
        FROM expense""",
    "workflow": """
        SELECT 'wf-' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS target_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS state,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 20 END AS approver_id,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' HOUR * CAST(48 + o_orderkey % 72 AS INT) END AS sla_due_at,
               CASE WHEN o_orderkey % 41 = 0 THEN o_orderdate + INTERVAL '50' HOUR ELSE NULL END AS sla_breached_at,
               CASE WHEN o_orderkey % 3 = 1 THEN 'MET_ON_TIME' ELSE 'ON_TRACK' END AS sla_status,
               CAST(48 AS INT) AS sla_hours,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 120 AS INT) END AS decided_at
        FROM orders WHERE o_orderkey % 4 <> 0""",
    "claim": """
        SELECT o_orderkey AS id, o_custkey % 7 AS workspace_id, o_custkey % 20 AS claimant_id,
               CASE floor(o_orderkey / 5.0) % 4 WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'APPROVED'
                    WHEN 2 THEN 'REIMBURSED' ELSE 'REJECTED' END AS status,
               CAST(round(o_totalprice * 100) AS BIGINT) AS total_minor, 'EUR' AS currency,
               o_orderdate AS created_at,
               CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderdate + INTERVAL '10' DAY END AS submitted_at,
               CASE WHEN floor(o_orderkey / 5.0) % 4 = 2 THEN o_orderdate + INTERVAL '30' DAY ELSE NULL END AS paid_at
        FROM orders WHERE o_orderkey % 5 = 0""",
    "claim_item": """
        SELECT CAST(floor(o_orderkey / 5.0) AS BIGINT) * 5 AS claim_id, o_orderkey AS expense_id,
               CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor
        FROM orders WHERE o_orderkey % 5 < 3
        UNION ALL
        SELECT CAST(floor(o_orderkey / 5.0) AS BIGINT) * 5 + 5 AS claim_id, o_orderkey AS expense_id,
               CAST(round(o_totalprice * 50) AS BIGINT) AS amount_minor
        FROM orders WHERE o_orderkey % 10 = 1""",
    "decision": """
        SELECT event_id, user_id * 5 AS claim_id, ts AS decided_at,
               CASE event_type WHEN 'click' THEN 'APPROVED' WHEN 'purchase' THEN 'REIMBURSED' ELSE 'REJECTED' END AS action
        FROM events WHERE event_type IN ('click', 'purchase') OR (event_type = 'error' AND event_id % 7 = 0)""",
    "policy": """
        SELECT n_nationkey AS id, n_regionkey AS workspace_id, n_name AS name, n_nationkey <> 24 AS active,
               CASE WHEN n_nationkey % 2 = 0 THEN 'block' ELSE 'warning' END AS severity,
               CASE floor(n_nationkey / 5.0) WHEN 0 THEN 'MAX_AMOUNT_BY_CATEGORY' WHEN 1 THEN 'RECEIPT_REQUIRED_ABOVE'
                    WHEN 2 THEN 'PROJECT_REQUIRED' WHEN 3 THEN 'ALLOWED_CATEGORIES'
                    ELSE 'DUPLICATE_RECEIPT_REJECTION' END AS rule_type,
               CASE WHEN n_nationkey = 0 THEN '{"maxAmountMinor":"40000000","categoryId":"BUILDING"}'
                    WHEN n_nationkey = 1 THEN '{"maxAmountMinor":"oops"}'
                    WHEN n_nationkey < 5 THEN '{"maxAmountMinor":"45000000"}'
                    WHEN n_nationkey < 10 THEN '{"thresholdMinor":"20000000"}'
                    WHEN n_nationkey = 10 THEN '{"onlyBusiness":false}'
                    WHEN n_nationkey < 15 THEN '{}'
                    WHEN n_nationkey = 15 THEN '{"categoryIds":[]}'
                    WHEN n_nationkey < 20 THEN '{"categoryIds":["BUILDING","MACHINERY"]}' ELSE '{}' END AS config
        FROM nation""",
    "recurring": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'M' || CAST(o_custkey AS STRING) END
                 AS merchant_name,
               CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, 'TRY' AS currency,
               CASE WHEN o_orderkey % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS cadence,
               o_orderdate + INTERVAL '3' HOUR AS next_due_at
        FROM orders""",
    "upload_session": """
        SELECT o_orderkey AS session_id, 5000000 AS chunk_size, CAST(7 AS INT) AS chunk_count,
               35000000 - o_orderkey % 4999999 AS size_bytes
        FROM orders""",
    "upload_chunk": "SELECT l_orderkey AS session_id, CAST(l_linenumber - 1 AS BIGINT) AS chunk_index FROM lineitem",
    "extraction": """
        SELECT o_orderkey AS id, CAST(floor(o_orderkey / 2.0) AS BIGINT) AS document_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 7 = 3 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
               CASE o_orderkey % 8 WHEN 0 THEN 'unknown_document' WHEN 1 THEN 'bank_transfer_receipt' WHEN 2 THEN 'invoice'
                    ELSE 'retail_receipt' END AS document_type,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'M' || CAST(o_custkey AS STRING) END AS merchant,
               CASE WHEN o_orderkey % 12 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
               CASE WHEN o_orderkey % 14 = 6 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS total_minor,
               (o_orderkey % 21) / 20.0E0 AS merchant_confidence, (o_orderkey % 17) / 16.0E0 AS date_confidence,
               (o_orderkey % 11) / 10.0E0 AS total_confidence, (o_orderkey % 6) / 5.0E0 AS document_type_confidence,
               CASE WHEN o_orderkey % 9 = 2 THEN 'critical' WHEN o_orderkey % 9 = 5 THEN 'warning' ELSE NULL END
                 AS issue_severity,
               CASE WHEN o_orderkey % 2 = 0 THEN 'TAX_MISMATCH' ELSE 'DATE_MISSING' END AS issue_code
        FROM orders""",
    "allocation": """
        SELECT o_orderkey AS expense_id, ' first ' AS title,
               CAST(floor(round(o_totalprice * 100) / 2) AS BIGINT) AS amount_minor,
               CAST(round(o_totalprice * 18) AS BIGINT) AS tax_minor, 'S1' AS project_code, TRUE AS business_expense
        FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL
        SELECT o_orderkey AS expense_id, 'second' AS title,
               CAST(round(o_totalprice * 100) - floor(round(o_totalprice * 100) / 2) AS BIGINT)
                 + CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS amount_minor,
               CASE WHEN o_orderkey % 15 = 0 THEN CAST(1 AS BIGINT) ELSE NULL END AS tax_minor,
               NULL AS project_code, NULL AS business_expense
        FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0""",
    "review_task": """
        SELECT o_orderkey AS id, (o_custkey % 20) % 3 AS tenant_id, o_orderkey AS document_id,
               CASE o_orderkey % 7 WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'SUCCEEDED' WHEN 5 THEN 'SUCCEEDED'
                    WHEN 6 THEN 'FAILED' ELSE 'QUEUED' END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 20 END AS assigned_to,
               CASE WHEN o_orderkey % 2 = 0 THEN 'LOW_CONFIDENCE' ELSE 'SLA_ESCALATED' END AS reason_code,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 60 AS INT)
                    END AS due_at,
               o_orderdate AS created_at
        FROM orders""",
    "app_user": """
        SELECT s_suppkey AS id, s_suppkey % 3 AS tenant_id, s_name AS display_name, s_suppkey % 17 = 0 AS disabled
        FROM supplier""",
    "user_role": """
        SELECT s_suppkey AS user_id, CASE s_suppkey % 6 WHEN 0 THEN 'REVIEWER' WHEN 1 THEN 'OWNER' WHEN 2 THEN 'EMPLOYEE'
               WHEN 3 THEN 'FINANCE_MANAGER' WHEN 4 THEN 'VIEWER' ELSE 'ADMIN' END AS role FROM supplier
        UNION ALL SELECT s_suppkey AS user_id, 'VIEWER' AS role FROM supplier WHERE s_suppkey % 4 = 0""",
    "keyed_event": """
        SELECT event_id, user_id, user_id % 10 AS tenant_id, ts, event_type, value,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
        FROM events""",
    "outbox": """
        SELECT event_id AS id, tenant_id,
               CASE event_type WHEN 'view' THEN 'document.uploaded' WHEN 'click' THEN 'expense.created'
                    WHEN 'purchase' THEN 'expense.approved' WHEN 'error' THEN 'expense.rejected'
                    ELSE 'expense.updated' END AS topic,
               'agg-' || CAST(user_id AS STRING) AS aggregate_id, ts AS created_at,
               CASE WHEN k % 3 = 1 THEN ts + INTERVAL '1' HOUR ELSE NULL END AS published_at,
               CASE WHEN k % 10 = 0 THEN 'DLQ: Broker timeout ' || CAST(k AS STRING) WHEN k % 10 = 5 THEN 'RETRY: slow'
                    WHEN k % 10 = 7 THEN 'DLQ: schema' ELSE NULL END AS failure_reason
        FROM keyed_event""",
    "inbox": """
        SELECT CASE WHEN k % 2 = 0 THEN 'ledger' ELSE 'search' END AS consumer_name, event_id % 4000 AS event_id, tenant_id,
               event_type AS topic, CASE WHEN k % 8 = 0 THEN 'failed' ELSE 'processed' END AS status,
               date_trunc('hour', ts) AS received_at, event_id AS record_offset
        FROM keyed_event""",
    "audit": """
        SELECT event_id AS id, tenant_id, user_id AS actor_user_id, event_type || '.' || CAST(k % 4 AS STRING) AS action,
               CASE event_type WHEN 'view' THEN 'Expense' WHEN 'click' THEN 'Budget' ELSE 'Document' END AS resource_type,
               CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS resource_id,
               CASE WHEN k % 2 = 0 THEN '{"workspaceId":"' || CAST(user_id % 7 AS STRING) || '"}' ELSE '{}' END AS metadata,
               ts AS created_at
        FROM keyed_event""",
    "job": """
        SELECT event_id AS id, tenant_id, event_type AS queue, user_id AS document_id,
               CASE WHEN k < 20 THEN 'QUEUED' WHEN k < 40 THEN 'RUNNING' WHEN k < 60 THEN 'FAILED' WHEN k < 95 THEN 'SUCCEEDED'
                    ELSE 'CANCELED' END AS status,
               k % 5 AS attempts, CAST(3 AS INT) AS max_attempts,
               CASE WHEN k % 4 = 0 THEN NULL ELSE 'worker-' || CAST(k % 4 AS STRING) END AS locked_by,
               ts AS created_at, ts + INTERVAL '1' MINUTE * k AS updated_at
        FROM keyed_event""",
    "request": """
        SELECT CASE WHEN k % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS route,
               CASE WHEN k % 20 = 0 THEN 500 WHEN k % 9 = 0 THEN 404 ELSE 200 END AS status_code,
               value / 50 AS duration_seconds, ts
        FROM keyed_event""",
    "notification": """
        SELECT event_id AS id, user_id, ts AS created_at, CASE WHEN k % 3 = 0 THEN ts ELSE NULL END AS read_at, event_type AS kind
        FROM keyed_event""",
    "endpoint": """
        SELECT s_suppkey AS id, s_suppkey % 10 AS tenant_id, s_suppkey % 5 <> 0 AS enabled,
               CASE s_suppkey % 3 WHEN 0 THEN 'expense.created,expense.approved' WHEN 1 THEN 'document.uploaded'
                    ELSE 'expense.created,document.uploaded,expense.rejected' END AS event_types
        FROM supplier""",
    "topic_offset": """
        SELECT event_type AS topic, event_id % 4 AS partition_id, max(event_id) AS high FROM keyed_event
        WHERE event_id % 4 < 3 GROUP BY event_type, event_id % 4""",
    "committed_offset": """
        SELECT user_id % 3 AS group_id, event_type AS topic, event_id % 4 AS partition_id, max(event_id) + 40 AS committed
        FROM keyed_event WHERE k < 50 GROUP BY user_id % 3, event_type, event_id % 4""",
    "document_file": """
        SELECT doc_id AS id, doc_id % 5 AS workspace_id, doc_id % 3 AS tenant_id, lang AS kind,
               'scan ' || source || '.pdf' AS original_name, 'scan-' || source AS safe_name, n_chars AS size_bytes,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 700 AS INT) AS created_at,
               CASE WHEN doc_id % 10 = 9 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE NULL END AS deleted_at, text
        FROM documents""",
    "ocr_job": """
        SELECT doc_id AS id, doc_id AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 700 AS INT) AS created_at,
               CASE WHEN doc_id % 6 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-05 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 700 AS INT) END AS completed_at,
               'TESSERACT|CUSTOM_CRNN' AS requested_engines
        FROM documents""",
    "ocr_run": """
        SELECT doc_id * 2 AS id, doc_id AS job_id, 'TESSERACT' AS engine,
               CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (n_chars % 100) / 100.0E0 END AS confidence,
               CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars END AS latency_ms,
               CASE WHEN doc_id % 9 = 0 THEN 'TIMEOUT' ELSE NULL END AS failure_reason, '{}' AS normalized_json
        FROM documents
        UNION ALL
        SELECT doc_id * 2 + 1 AS id, doc_id AS job_id, 'ENSEMBLE' AS engine, 'SUCCEEDED' AS status,
               (n_chars % 90) / 100.0E0 AS confidence, n_chars % 70 AS latency_ms, NULL AS failure_reason,
               '{"selectedEngine":"TESSERACT","averageConfidence":' || CAST(n_chars % 10 AS STRING) || '.5,"failureRate":' ||
                 CASE WHEN doc_id % 4 = 0 THEN '"bad"' ELSE '0.25' END || ',"characterErrorRate":' ||
                 CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '0.12345' END || ',"conflictFields":["date","total"]}' AS normalized_json
        FROM documents""",
    "model_version": """
        SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 10 = 0 THEN 'TESSERACT' ELSE 'CUSTOM_CRNN' END AS engine,
               'CANDIDATE' AS status, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'bucket' END AS artifact_bucket,
               CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'key-' || CAST(p_partkey AS STRING) END AS artifact_key,
               CASE p_partkey % 8
                 WHEN 0 THEN '{}'
                 WHEN 1 THEN '{"profile":"smoke-1"}'
                 WHEN 2 THEN '{"training_profile":"full","realFixtureBenchmarkStatus":"passed","qualityGatePassed":true}'
                 WHEN 3 THEN '{"training_profile":"full","realFixtureBenchmarkStatus":"failed","qualityGatePassed":true}'
                 WHEN 4 THEN '{"profile":"full","engines":{"CUSTOM_CRNN":{"qualityGateStatus":"passed","qualityGatePassed":true,"highConfidenceWrongCount":2}}}'
                 WHEN 5 THEN '{"profile":"full","engines":{"CUSTOM_CRNN":{"qualityGateStatus":"passed","qualityGatePassed":true,"highConfidenceWrongCount":0}}}'
                 WHEN 6 THEN '{"profile":"full","validated_on_real_fixtures":true,"qualityGatePassed":"yes"}'
                 ELSE '{"profile":"full","validatedOnRealFixtures":true,"qualityGatePassed":true}' END AS metrics
        FROM part""",
    "training_run": """
        SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS model_version_id, l_shipdate AS created_at,
               max(CASE WHEN l_linestatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END) AS status
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber, l_partkey, l_shipdate""",
    "evaluation_run": """
        SELECT l_orderkey AS id, CASE WHEN l_partkey % 25 = 0 THEN NULL ELSE l_partkey END AS model_version_id, 'SUCCEEDED' AS status,
               l_shipdate AS completed_at, '{"accuracy":' || CAST(l_linenumber AS STRING) || '.123456,"macro_f1":"n/a","cer":0.5,"accuracy_note":"ok"}'
                 AS metrics
        FROM lineitem WHERE l_returnflag = 'A'""",
    "annotation": "SELECT conv_id AS document_id, conv_id * 1000 + turn AS id, role, turn, text FROM conversations",
    "budget_period": """
        SELECT o_orderkey AS id, o_custkey % 25 AS budget_id, o_orderdate AS updated_at,
               CAST(round(o_totalprice * 200) AS BIGINT) AS spent_minor FROM orders""",
    "export_job": "SELECT event_id AS id, event_type AS type, CASE WHEN k < 50 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM keyed_event",
    # Receipt, invoice and bank texts written from the orders, with recognition noise.
    "receipt_parts": """
        SELECT o_orderkey AS k, o_orderkey % 12 AS v, c_mktsegment AS seg, o_custkey AS cust,
               CASE WHEN o_orderkey % 24 = 4 THEN '' ELSE
                 lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '/' ELSE '.' END ||
                 lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '/' ELSE '.' END ||
                 CAST(year(o_orderdate) AS STRING) END AS d,
               lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') AS clock,
               CAST(floor(round(o_totalprice * 100) * 0.6E0) AS BIGINT) % 900000 + 100 AS a,
               CAST(round(o_totalprice * 100) AS BIGINT) % 500000 + 100 AS b,
               CAST(round(o_totalprice * 3) AS BIGINT) % 70000 AS tax
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "receipt_money": """
        SELECT k, v, seg, cust, d, clock, a, b, tax,
               CAST(CAST(floor(a / 100.0) AS BIGINT) AS STRING) || ',' || lpad(CAST(a % 100 AS STRING), 2, '0') AS ma,
               CAST(CAST(floor(b / 100.0) AS BIGINT) AS STRING) || '.' || lpad(CAST(b % 100 AS STRING), 2, '0') AS mb,
               CAST(CAST(floor((a + b) / 100.0) AS BIGINT) AS STRING) || ',' || lpad(CAST((a + b) % 100 AS STRING), 2, '0') AS msub,
               CAST(CAST(floor(tax / 100.0) AS BIGINT) AS STRING) || ',' || lpad(CAST(tax % 100 AS STRING), 2, '0') AS mtax,
               CAST(CAST(floor((a + b + tax) / 100.0) AS BIGINT) AS STRING) || ',' ||
                 lpad(CAST((a + b + tax) % 100 AS STRING), 2, '0') AS mt
        FROM receipt_parts""",
    "receipt": """
        SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'CUSTOM_CRNN' ELSE 'TESSERACT' END AS engine,
               CASE WHEN k % 4 = 0 THEN CAST(0.0 AS DOUBLE) ELSE (k % 83) / 82.0E0 END AS confidence, v,
               CASE v
               WHEN 0 THEN seg || ' MARKET LTD' || chr(10) || 'TARIH: ' || d || ' SAAT: ' || clock || chr(10) || 'FIS NO: 00' || CAST(k AS STRING)
                 || chr(10) || 'SUT 2 %10 ' || ma || chr(10) || 'Ekmek 3 x 5,00 ' || mb || chr(10) || 'ARA TOPLAM ' || msub || chr(10)
                 || 'KDV ' || mtax || chr(10) || 'GENEL TOPLAM ' || mt || ' TL' || chr(10) || 'KREDI KARTI **** ' || lpad(CAST(cust % 10000 AS STRING), 4, '0')
               WHEN 1 THEN 'FATURA NO: INV-' || CAST(k AS STRING) || chr(10) || 'Satici: ' || seg || ' A.S.' || chr(10) || 'VKN 1234567890' || chr(10)
                 || 'Date ' || d || chr(10) || 'Hizmet bedeli ' || ma || ' TL' || chr(10) || 'Danismanlik 2 adet 10,00 ' || mb || chr(10)
                 || 'Matrah ' || msub || chr(10) || 'KDV %18 ' || mtax || chr(10) || 'Toplam tutari ' || mt || chr(10) || 'USD'
               WHEN 2 THEN 'ZIRAAT BANKASI' || chr(10) || 'HESAPTAN FAST' || chr(10) || 'ISLEM TARIHI ' || d || ' ' || clock || chr(10)
                 || 'ISLEM TUTARI: ' || ma || ' TL' || chr(10) || 'KOMISYON 1,00 TL' || chr(10) || 'IBAN TR' || CAST(k AS STRING)
               WHEN 3 THEN seg || ' MARKET' || chr(10) || 'FIS' || chr(10) || 'Tarih ' || d || chr(10) || 'Peynir 1O5,6O' || chr(10)
                 || 'GENEL T0PLAM ' || replace(replace(mt, '0', 'O'), '1', 'I') || chr(10) || 'K0V ' || mtax || chr(10) || 'NAKIT'
               WHEN 4 THEN 'Bakkal ' || seg || chr(10) || d || chr(10) || 'Fis' || chr(10) || 'Urun ' || ma || chr(10) || 'Indirim 1,00' || chr(10)
                 || 'Ara toplam ' || msub || chr(10) || 'KDV ' || mtax || chr(10) || 'TOPLAM ' || ma || chr(10) || 'Para ustu 3,00'
               WHEN 5 THEN 'E-ARSIV FATURA' || chr(10) || 'ETTN: abc-' || CAST(k AS STRING) || chr(10) || 'SENARYO: TEMEL' || chr(10) || d || chr(10)
                 || 'Kablo ' || ma || chr(10) || 'Toplam ' || ma || ' EUR'
               WHEN 6 THEN 'POS SLIP' || chr(10) || 'PROVIZYON: ' || CAST(k AS STRING) || chr(10) || d || ' ' || clock || chr(10) || 'TUTAR ' || ma || 'TL'
                 || chr(10) || 'XX' || lpad(CAST(cust % 10000 AS STRING), 4, '0')
               WHEN 7 THEN 'TAHSILAT MAKBUZU' || chr(10) || 'Odeme ' || d || chr(10) || 'Gonderilen tutar ' || mb || ' masraf 2,00' || chr(10) || 'Havale'
               WHEN 8 THEN seg || chr(10) || 'Toplam 12' || CAST(k % 1000 AS STRING) || chr(10) || 'referans 99' || chr(10) || 'Market fis' || chr(10) || 'kdv'
               WHEN 9 THEN 'aa11 bb ' || CAST(k AS STRING) || chr(10) || 'xx xx xx' || chr(10) || 'xx xx ' || ma || chr(10) || 'xx xx' || chr(10) || 'fis toplam'
                 || chr(10) || 'xx' || chr(10) || 'xx xx' || chr(10) || 'xx xx' || chr(10) || 'xx'
               WHEN 10 THEN '20240101.123456 islem ' || ma || chr(10) || 'Tutar islem no 123456' || chr(10) || 'Toplam referans 777' || chr(10) || d
               ELSE 'Market ' || seg || chr(10) || 'Fis no 77' || CAST(k AS STRING) || chr(10) || 'Tarih 13' || '/25/2024' || chr(10) || d || ' kasa' || chr(10)
                 || 'Elma  %08 ' || ma || chr(10) || chr(10) || chr(10) || chr(10) || 'KDV dahil toplam ' || ma || ' TRY' || chr(10) || 'sa4t ' || clock END AS text,
               seg, d, ma, mb, msub, mtax, mt
        FROM receipt_money""",
    "ocr_text": """
        SELECT doc_id, engine, confidence, text FROM receipt
        UNION ALL SELECT doc_id + 1000000000000 AS doc_id, 'TESSERACT' AS engine, (n_chars % 100) / 100.0E0 AS confidence, text FROM documents""",
    # What the receipts of the orders say, as truth beside their text; some truth is missing or blank.
    "scan": """
        SELECT doc_id, v, replace(replace(text, 'Urun', 'Ürün'), 'Satici', 'Satıcı') AS reference,
               CASE WHEN v IN (1, 5) THEN 'invoice' WHEN v IN (0, 3, 4, 11) THEN 'receipt' ELSE 'unknown' END AS document_type,
               CASE v WHEN 0 THEN seg || ' MARKET LTD' WHEN 1 THEN seg || ' A.S.' WHEN 3 THEN seg || ' MARKET' WHEN 8 THEN seg ELSE NULL END AS t_merchant,
               CASE WHEN d = '' OR doc_id % 7 = 3 THEN NULL ELSE substr(d, 7, 4) || '-' || substr(d, 4, 2) || '-' || substr(d, 1, 2) END AS t_date,
               CASE WHEN v IN (0, 1, 3) THEN mt WHEN v IN (4, 11) THEN ma ELSE NULL END AS t_total,
               CASE WHEN v IN (0, 1, 3, 4) THEN mtax WHEN v = 8 THEN ' ' ELSE NULL END AS t_tax,
               CASE WHEN v IN (0, 1, 4) THEN msub ELSE NULL END AS t_subtotal,
               CASE v WHEN 0 THEN 'KART' WHEN 3 THEN 'NAKIT' ELSE NULL END AS t_payment,
               CASE v WHEN 0 THEN 'SUT' WHEN 1 THEN 'Hizmet bedeli' WHEN 5 THEN 'Kablo' WHEN 11 THEN 'Elma' ELSE NULL END AS item1, ma AS amount1,
               CASE v WHEN 0 THEN 'Ekmek' WHEN 1 THEN 'Danismanlik' ELSE NULL END AS item2, mb AS amount2
        FROM receipt""",
    "scan_run": """
        SELECT doc_id AS sample_id, 'alpha' AS engine, v, document_type, t_merchant, t_date, t_total, t_tax, t_subtotal, t_payment, item1, amount1, item2, amount2, reference,
               CASE doc_id % 4 WHEN 0 THEN replace(reference, ',', '.') WHEN 1 THEN replace(replace(reference, 'TOPLAM', 'TOPL4M'), 'ı', 'i')
                 WHEN 2 THEN reference ELSE replace(replace(reference, '%', ''), ' x ', ' ') END AS prediction,
               (doc_id * 37 % 101) / 100.0E0 AS confidence, doc_id % 900 AS latency_ms, CASE WHEN doc_id % 50 = 0 THEN 'TIMEOUT' ELSE NULL END AS error_code,
               CASE WHEN doc_id % 6 = 0 THEN 'LOW_CONFIDENCE' WHEN doc_id % 10 = 1 THEN 'LOW_CONFIDENCE,NO_TOTAL' ELSE '' END AS warnings
        FROM scan
        UNION ALL
        SELECT doc_id AS sample_id, 'beta' AS engine, v, document_type, t_merchant, t_date, t_total, t_tax, t_subtotal, t_payment, item1, amount1, item2, amount2, reference,
               CASE WHEN doc_id % 5 = 0 THEN translate(reference, '0123456789eaoEAO', 'OI2E4S678qpcuwxyz') WHEN doc_id % 5 = 1 THEN '' ELSE translate(reference, '5ürN', '6urM') END AS prediction,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (doc_id * 53 % 97) / 96.0E0 END AS confidence, doc_id % 400 AS latency_ms,
               CASE WHEN doc_id % 70 = 0 THEN 'EMPTY' ELSE NULL END AS error_code, '' AS warnings
        FROM scan
        UNION ALL
        SELECT doc_id AS sample_id, 'down' AS engine, v, document_type, t_merchant, t_date, t_total, t_tax, t_subtotal, t_payment, item1, amount1, item2, amount2, reference,
               '' AS prediction, NULL AS confidence, doc_id % 3 AS latency_ms, 'FILE_NOT_FOUND' AS error_code, '' AS warnings
        FROM scan WHERE doc_id % 10 = 0""",
    "field_patch": """
        SELECT l_orderkey AS doc_id, l_partkey * 10 + l_linenumber AS patch_id, max(l_shipdate) AS patched_at,
               CASE l_linenumber WHEN 1 THEN 'merchant' WHEN 2 THEN 'date' WHEN 3 THEN 'total_minor' WHEN 4 THEN 'tax_minor'
                 WHEN 5 THEN 'payment_method' WHEN 6 THEN 'currency' ELSE 'document_type' END AS field,
               max(CASE l_linenumber WHEN 1 THEN CASE WHEN l_partkey % 5 = 0 THEN '  ' ELSE 'Fixed ' || CAST(l_partkey AS STRING) END
                 WHEN 2 THEN '2024-02-' || CAST(10 + l_partkey % 25 AS STRING) WHEN 3 THEN CAST(l_partkey * 7 AS STRING)
                 WHEN 4 THEN NULL WHEN 5 THEN 'CASH' ELSE 'GBP' END) AS value
        FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber""",
    # Every document cut into pieces of at most 80 characters; the Spark side is in EXPLODED.
    "doc_line": """
        SELECT doc_id * 100000 + no AS sample_id, doc_id, source, lang, no, text FROM (
          SELECT doc_id, source, lang, generate_subscripts(ls, 1) - 1 AS no, trim(unnest(ls)) AS text
          FROM (SELECT *, regexp_extract_all(regexp_replace(text, '[^ -~\n]', '?', 'g'), '[^\n.]{1,80}') AS ls FROM documents))
        WHERE length(text) > 1""",
    "prediction": """
        SELECT sample_id, doc_id, source, 'alpha' AS engine, text AS reference, translate(text, 'rn', 'nr') AS prediction,
               (sample_id * 37 % 101) / 100.0E0 AS confidence, sample_id % 900 AS latency_ms,
               CASE WHEN sample_id % 50 = 0 THEN 'TIMEOUT' ELSE NULL END AS error_code
        FROM doc_line
        UNION ALL
        SELECT sample_id, doc_id, source, 'beta' AS engine, text AS reference, replace(text, 'e', '') AS prediction,
               CASE WHEN sample_id % 9 = 0 THEN NULL ELSE (sample_id * 53 % 97) / 96.0E0 END AS confidence,
               sample_id % 400 AS latency_ms, CASE WHEN sample_id % 70 = 0 THEN 'EMPTY' ELSE NULL END AS error_code
        FROM doc_line""",
    "label_pair": """
        SELECT CASE WHEN doc_id % 2 = 0 THEN 'run1' ELSE 'run2' END AS run, 'q' || CAST(quality AS STRING) || CAST(toxic AS STRING) AS actual,
               CASE WHEN doc_id % 5 = 0 THEN 'q' || CAST(1 - quality AS STRING) || CAST(toxic AS STRING)
                    WHEN doc_id % 11 = 0 THEN 'q' || CAST(quality AS STRING) || '9'
                    ELSE 'q' || CAST(quality AS STRING) || CAST(toxic AS STRING) END AS predicted, doc_id
        FROM labels""",
    "manifest": """
        SELECT sample_id AS id, source, doc_id, text,
               CASE WHEN sample_id % 13 = 0 THEN ' ' ELSE 'img-' || CAST(doc_id AS STRING) END AS image,
               sample_id % 17 <> 0 AS usable_for_training, CASE WHEN doc_id % 5 = 4 THEN 'validation' ELSE 'train' END AS split,
               CAST(sample_id % 6 AS INT) AS hardcase_weight, no % 4 AS box_w
        FROM doc_line""",
    "raw_box": """
        SELECT l_orderkey AS doc_id, 'truth' AS kind, l_partkey * 10 + l_linenumber AS ord, 'xywh' AS format,
               l_partkey % 400 AS a, (l_suppkey % 20) * 25 AS b, CAST(max(l_quantity) AS BIGINT) + 20 AS c, CAST(20 AS BIGINT) AS d
        FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber
        UNION ALL
        SELECT l_orderkey AS doc_id, 'pred' AS kind, l_partkey * 10 + l_linenumber AS ord, 'xyxy' AS format,
               l_partkey % 400 + l_linenumber AS a, (l_suppkey % 20) * 25 + l_linenumber - 3 AS b,
               l_partkey % 400 + CAST(max(l_quantity) AS BIGINT) + 20 AS c,
               (l_suppkey % 20) * 25 + CASE WHEN l_partkey % 9 = 0 THEN -9 ELSE 20 END AS d
        FROM lineitem WHERE l_partkey % 6 <> 0 GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber""",
    "message": """
        SELECT event_id AS offset_id, ts AS received_at, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN '{"id": ' WHEN k = 3 THEN '{"topic":"expense.created"}'
               ELSE '{"id":"e' || CAST(event_id % 6000 AS STRING) || '","topic":"' || CASE WHEN k = 4 THEN 'nope' ELSE 'expense.created' END ||
                 '","tenantId":"t' || CAST(tenant_id AS STRING) || '","aggregateId":"a' || CAST(user_id AS STRING) || '","correlationId":"c"' ||
                 CASE WHEN k = 5 THEN ',"schemaVersion":0' WHEN k = 6 THEN ',"schemaVersion":3' ELSE '' END || '}' END AS value
        FROM keyed_event""",
    "import_raw": """
        SELECT o_orderkey % 900 AS batch_id, o_orderkey AS row_no, CASE WHEN o_orderkey % 701 = 0 THEN ' ' ELSE ' Trip ' END AS title,
               CASE WHEN o_orderkey % 503 = 0 THEN '2024-13-40' ELSE '2024-01-' || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') END AS date,
               CASE WHEN o_orderkey % 401 = 0 THEN 'XXX' WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'EUR' END AS currency,
               CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS STRING) ELSE NULL END AS amount_minor,
               CASE WHEN o_orderkey % 601 = 0 THEN '12.345' ELSE CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ',5' ELSE '.25' END END AS amount,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 997 = 0 THEN 'abc' ELSE '-1.50' END AS tax,
               CASE o_orderkey % 5 WHEN 0 THEN 'Evet' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE CASE WHEN o_orderkey % 811 = 0 THEN 'maybe' ELSE '1' END END AS reimbursable,
               'hayir' AS business_expense
        FROM orders""",
    "payload": """
        SELECT o_orderkey AS payload_id, CASE o_orderkey % 5
          WHEN 0 THEN 'https://q.example/r?firma=Shop+' || CAST(o_custkey AS STRING) || '&fisNo=F' || CAST(o_orderkey AS STRING) || '&tarih=0102' || '2024&tutar=12%2C50&vkn=1234567890&kart_son4=**4321'
          WHEN 1 THEN '{"merchant":"Shop","receiptNo":"R' || CAST(o_orderkey AS STRING) || '","date":"2024-02-30","total":"10.00","kdv":"1.00","araToplam":"9.50","currency":"usd"}'
          WHEN 2 THEN 'unvan: Kafe; toplam: ' || CAST(o_custkey AS STRING) || ',25; tarih: 3.4.24; saat: 9:05; odeme: nakit; vkn: 12'
          WHEN 3 THEN 'garbage' ELSE '{"total":"abc","para birimi":"XYZ"}' END AS payload
        FROM orders""",
    "xml_payload": """
        SELECT o_orderkey AS payload_id, CASE WHEN o_orderkey % 7 = 0 THEN '<Invoice><open>' ELSE
          '<Invoice xmlns:cbc="urn:b" xmlns:cac="urn:a"><cbc:ID>INV' || CAST(o_orderkey AS STRING) || '</cbc:ID><cbc:IssueDate>2024-03-04</cbc:IssueDate><cbc:IssueTime>10:11:12</cbc:IssueTime>'
          || '<cbc:DocumentCurrencyCode>EUR</cbc:DocumentCurrencyCode><cac:AccountingSupplierParty><cac:Party><cac:PartyName><cbc:Name>Seller ' || CAST(o_custkey AS STRING)
          || '</cbc:Name></cac:PartyName><cac:PartyTaxScheme><cbc:CompanyID>1234567890</cbc:CompanyID></cac:PartyTaxScheme></cac:Party></cac:AccountingSupplierParty><cac:TaxTotal><cbc:TaxAmount>18.00</cbc:TaxAmount></cac:TaxTotal>'
          || '<cac:LegalMonetaryTotal><cbc:LineExtensionAmount>100.00</cbc:LineExtensionAmount><cbc:TaxInclusiveAmount>118.00</cbc:TaxInclusiveAmount><cbc:PayableAmount>'
          || CASE WHEN o_orderkey % 3 = 0 THEN '120.00' ELSE '118.00' END || '</cbc:PayableAmount></cac:LegalMonetaryTotal></Invoice>' END AS payload
        FROM orders""",
}


def _doc_lines(t: "Tables") -> DataFrame:
    plain = F.regexp_replace("text", r"[^ -~\n]", "?")
    cut = F.regexp_extract_all(plain, F.lit(r"[^\n.]{1,80}"), F.lit(0))
    pieces = t.documents.select("doc_id", "source", "lang", F.posexplode_outer(cut).alias("no", "text"))
    # The outer form: for the plain one Spark cuts every text again in a filter. A text without pieces falls to the length.
    return pieces.withColumn("text", F.trim("text")).where(F.length("text") > 1).select(
        (F.col("doc_id") * 100000 + F.col("no")).alias("sample_id"), "doc_id", "source", "lang",
        F.col("no").cast("long").alias("no"), "text",
    )


EXPLODED = {"doc_line": _doc_lines}

# Text inputs whose rows are expensive to process, and the key that spreads them.
SPREAD = {"documents": "doc_id", "receipt": "doc_id", "xml_payload": "payload_id"}
SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, key: str, source_bytes: int) -> DataFrame:
    """Use every core on an input of only a few file splits. Larger inputs have
    enough splits of their own and are left alone, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if source_bytes < cores * SPLIT_BYTES else df


class Tables:
    """Reads base tables and bindings of one data folder on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def sql(self, text: str) -> DataFrame:
        """Run dialect-neutral SQL over the tables it names."""
        for table in names_in(text):
            getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))

    def _load(self, name: str) -> DataFrame:
        df = self._read(name)
        if name in SPREAD:
            base = df if name in BASE else self.orders
            size = int(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
            return spread(df, SPREAD[name], size)
        return df

    def _read(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in EXPLODED:
            return EXPLODED[name](self)
        return self.sql(BINDINGS[name])


def names_in(text: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text))
    return sorted(w for w in words if w in BASE or w in BINDINGS)


def with_bindings(body: str, *ctes: str) -> str:
    """SQL for the checking engine: the bindings that ``body`` needs as common
    table expressions, then extra ``name AS (...)`` expressions, then the body."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text):
            if name in BINDINGS and name not in ordered:
                visit(BINDINGS[name])
                ordered.append(name)

    visit(" ".join([*ctes, body]))
    parts = [f"{n} AS ({BINDINGS[n].strip()})" for n in ordered] + list(ctes)
    # Named steps are computed once; inlining would repeat the text rules per use.
    parts = [re.sub(r"(^|[,)]\s+)([a-z_0-9]+) AS \(SELECT", r"\1\2 AS MATERIALIZED (SELECT", p) for p in parts]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
