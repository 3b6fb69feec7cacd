"""Expense lifecycle: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as life
from ..operators import spend
from .bindings import AS_OF, with_bindings
from .registry import query

LIVE = "live AS (SELECT *, CAST(date_trunc('month', occurred_at) AS DATE) AS month FROM expense WHERE archived_at IS NULL)"
SEARCH = "0001"
FOLD = """nullif(trim(regexp_replace(replace(lower(strip_accents({0})), 'ı', 'i'), '[^a-z0-9]+', ' ', 'g')), '')"""


def ago(later: str, earlier: str) -> str:
    """Floored minutes between two timestamps."""
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 60000000.0) AS BIGINT)"


@query("ledger_scan", with_bindings(
    "SELECT id, workspace_id, merchant_name, status, currency, amount_minor, occurred_at FROM live", LIVE))
def _(t):
    return spend.unarchived(t.expense).select(
        "id", "workspace_id", "merchant_name", "status", "currency", "amount_minor", "occurred_at")


@query("active_expenses", with_bindings(
    "SELECT workspace_id, status, count(*) AS n FROM live WHERE status <> 'ARCHIVED' GROUP BY workspace_id, status", LIVE))
def _(t):
    return spend.active(t.expense).groupBy("workspace_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("month_window", with_bindings(
    """SELECT id, workspace_id, occurred_at, amount_minor FROM expense
    WHERE occurred_at >= DATE '1997-02-01' AND occurred_at < DATE '1997-03-01'"""))
def _(t):
    from ..functions.dates import in_month
    return t.expense.where(in_month(F.col("occurred_at"), "1997-02-01")).select(
        "id", "workspace_id", "occurred_at", "amount_minor")


@query("enrich_names", with_bindings(
    """SELECT e.*, m.name AS merchant_name, p.name AS payment_method_name FROM expense_ids e
    LEFT JOIN merchant m ON m.id = e.merchant_id LEFT JOIN payment p ON p.id = e.payment_method_id"""))
def _(t):
    return life.enrich_names(t.expense_ids, t.merchant, t.payment)


@query("expense_search_page", with_bindings(
    f"""SELECT l.id, l.occurred_at, l.title, l.description, l.merchant_id FROM live l LEFT JOIN merchant m ON m.id = l.merchant_id
    WHERE status = 'DRAFT' AND (contains(lower(title), '{SEARCH}') OR contains(lower(description), '{SEARCH}')
      OR contains(lower(coalesce(m.name, '')), '{SEARCH}')) ORDER BY occurred_at DESC, l.id DESC LIMIT 26""", LIVE))
def _(t):
    page = life.search_page(t.expense, t.merchant, SEARCH, "DRAFT", 25)
    return page.select("id", "occurred_at", "title", "description", "merchant_id")


@query("claimable_expenses", with_bindings(
    """SELECT id, workspace_id, currency, amount_minor FROM live WHERE reimbursable AND amount_minor > 0
    AND status NOT IN ('REJECTED', 'REIMBURSED', 'ARCHIVED') AND id NOT IN (SELECT i.expense_id FROM claim_item i
      JOIN claim c ON c.id = i.claim_id WHERE c.status <> 'REJECTED')""", LIVE))
def _(t):
    return life.claimable(t.expense, t.claim, t.claim_item).select("id", "workspace_id", "currency", "amount_minor")


@query("claim_lines", with_bindings(
    """SELECT month, claim_id, claim_status, claimant_id, claim_total_minor, currency, expense_id,
      CASE WHEN month = expense_month THEN coalesce(title, '') ELSE '' END AS title,
      CASE WHEN month = expense_month THEN coalesce(merchant_name, '') ELSE '' END AS merchant_name,
      CASE WHEN month = expense_month THEN coalesce(expense_status, '') ELSE '' END AS expense_status, line_amount_minor
    FROM (SELECT expense_month AS month, * FROM lines WHERE expense_month IS NOT NULL
      UNION ALL SELECT claim_month, * FROM lines WHERE claim_id NOT IN (SELECT claim_id FROM lines WHERE expense_month = claim_month))""",
    LIVE,
    """lines AS (SELECT c.id AS claim_id, c.status AS claim_status, c.claimant_id, c.total_minor AS claim_total_minor, c.currency,
      i.expense_id, l.title, l.merchant_name, l.status AS expense_status, i.amount_minor AS line_amount_minor, l.month AS expense_month,
      CAST(date_trunc('month', coalesce(paid_at, submitted_at, c.created_at)) AS DATE) AS claim_month
    FROM claim c JOIN claim_item i ON i.claim_id = c.id LEFT JOIN live l ON l.id = i.expense_id
    WHERE c.status IN ('APPROVED', 'REIMBURSED'))"""))
def _(t):
    return life.claim_lines(t.claim, t.claim_item, t.expense)


@query("claim_totals", with_bindings(
    """SELECT i.claim_id, count(*) AS items, count(l.id) AS found,
    CASE WHEN count(l.id) = count(*) THEN CAST(sum(l.amount_minor) AS BIGINT) END AS total_minor
    FROM claim_item i LEFT JOIN live l ON l.id = i.expense_id GROUP BY i.claim_id""", LIVE))
def _(t):
    return life.claim_totals(t.claim_item, t.expense)


TRANSITIONS = """steps AS (
    SELECT d.claim_id, d.event_id, d.decided_at, d.action, c.status AS initial,
      min(CASE WHEN c.status = 'NEEDS_REVIEW' AND d.action IN ('APPROVED', 'REJECTED') THEN d.event_id END) OVER (PARTITION BY d.claim_id) AS s1
    FROM decision d JOIN claim c ON c.id = d.claim_id),
  step1 AS (SELECT s.*, f.action AS a1 FROM steps s LEFT JOIN decision f ON f.event_id = s.s1),
  step2 AS (SELECT *, min(CASE WHEN (initial = 'APPROVED' OR (a1 = 'APPROVED' AND event_id > s1)) AND action IN ('REJECTED', 'REIMBURSED')
      THEN event_id END) OVER (PARTITION BY claim_id) AS s2 FROM step1),
  states AS (SELECT p.*, CASE WHEN p.event_id > s2 THEN g.action WHEN p.event_id > s1 THEN a1 ELSE initial END AS state_before
    FROM step2 p LEFT JOIN decision g ON g.event_id = p.s2),
  transitions AS (SELECT claim_id, event_id, decided_at, action, state_before,
    CASE WHEN event_id = s1 OR event_id = s2 THEN action ELSE state_before END AS state_after,
    CASE WHEN coalesce(event_id = s1, FALSE) OR coalesce(event_id = s2, FALSE) THEN NULL WHEN action = 'APPROVED' THEN 'REIMBURSEMENT_CLAIM_NOT_REVIEWABLE'
      WHEN action = 'REJECTED' THEN 'REIMBURSEMENT_CLAIM_NOT_REJECTABLE' ELSE 'REIMBURSEMENT_CLAIM_NOT_PAYABLE' END AS error_code
    FROM states)"""


@query("claim_transitions", with_bindings("SELECT * FROM transitions", TRANSITIONS))
def _(t):
    return life.claim_transitions(t.claim, t.decision)


@query("claim_paid_expenses", with_bindings(
    """SELECT id, status AS previous_status, 'REIMBURSED' AS status FROM live WHERE id IN (SELECT expense_id FROM claim_item i
    JOIN transitions t ON t.claim_id = i.claim_id WHERE t.action = 'REIMBURSED' AND error_code IS NULL)""", LIVE, TRANSITIONS))
def _(t):
    return life.paid_expenses(life.claim_transitions(t.claim, t.decision), t.claim_item, t.expense)


SLA = f"""joined AS (SELECT l.id AS expense_id, l.workspace_id, l.title, l.status, l.occurred_at,
      coalesce(w.id, 'virtual-' || l.id) AS workflow_id, coalesce(w.state, 'PENDING') AS workflow_state, w.approver_id,
      CASE WHEN w.id IS NULL THEN l.created_at + INTERVAL 48 HOUR ELSE w.sla_due_at END AS sla_due_at, w.sla_breached_at AS stored_breach,
      coalesce(w.sla_status, 'ON_TRACK') AS stored_status, coalesce(w.sla_hours, 48) AS sla_hours,
      greatest(0, {ago(f"TIMESTAMP '{AS_OF}'", 'l.created_at')}) AS age_minutes
    FROM live l LEFT JOIN workflow w ON w.target_id = l.id),
  timed AS (SELECT *, {ago('sla_due_at', f"TIMESTAMP '{AS_OF}'")} AS remaining_minutes FROM joined),
  sla AS (SELECT * EXCLUDE (stored_breach, stored_status), CASE WHEN workflow_state <> 'PENDING' OR remaining_minutes IS NULL THEN stored_status
      WHEN remaining_minutes < 0 THEN 'BREACHED' WHEN remaining_minutes <= 360 THEN 'DUE_SOON' ELSE 'ON_TRACK' END AS sla_status,
      coalesce(stored_breach, CASE WHEN workflow_state = 'PENDING' AND remaining_minutes < 0 THEN sla_due_at END) AS sla_breached_at FROM timed)"""


@query("approval_sla", with_bindings("SELECT * FROM sla", LIVE, SLA))
def _(t):
    return life.approval_sla(t.expense, t.workflow, AS_OF)


@query("sla_outcome", with_bindings(
    """SELECT id AS workflow_id, state, CASE WHEN state = 'APPROVED' THEN 'MET' ELSE 'REJECTED' END ||
      CASE WHEN decided_at > sla_due_at THEN '_LATE' ELSE '_ON_TIME' END AS sla_status,
      CASE WHEN decided_at > sla_due_at THEN sla_due_at END AS sla_breached_at FROM workflow WHERE state <> 'PENDING'"""))
def _(t):
    return life.sla_outcome(t.workflow)


@query("approval_evidence", with_bindings(
    """SELECT s.expense_id, title, status, workflow_id, workflow_state, coalesce(CAST(approver_id AS VARCHAR), '') AS approver_id, sla_status,
    sla_due_at, sla_breached_at, sla_hours, remaining_minutes, age_minutes, coalesce(claim_ids, '') AS claim_ids,
    coalesce(claim_statuses, '') AS claim_statuses FROM sla s LEFT JOIN (SELECT expense_id,
      string_agg(CAST(c.id AS VARCHAR), '|' ORDER BY created_at DESC, c.id DESC) AS claim_ids,
      string_agg(c.status, '|' ORDER BY created_at DESC, c.id DESC) AS claim_statuses
      FROM claim_item i JOIN claim c ON c.id = i.claim_id GROUP BY expense_id) x ON x.expense_id = s.expense_id""", LIVE, SLA))
def _(t):
    return life.approval_evidence(t.expense, t.workflow, t.claim, t.claim_item, AS_OF)


@query("possible_duplicates", with_bindings(
    f"""SELECT id, workspace_id, merchant_key, amount_minor, day, copies FROM (SELECT *, count(*) OVER (PARTITION BY workspace_id,
      merchant_key, amount_minor, day) AS copies FROM (SELECT *, coalesce({FOLD.format('merchant_name')}, '') AS merchant_key,
        CAST(occurred_at AS DATE) AS day FROM small_ticket WHERE merchant_name IS NOT NULL)) WHERE copies > 1"""))
def _(t):
    return life.possible_duplicates(t.small_ticket)


PROFILE = f"""keyed AS (SELECT *, coalesce({FOLD.format('merchant_name')}, '') AS merchant_key, CAST(occurred_at AS DATE) AS day FROM small_ticket),
  profile AS (SELECT *, count(*) OVER (PARTITION BY workspace_id) - 1 AS peers,
    count(*) OVER (PARTITION BY workspace_id, merchant_key) - 1 AS merchant_peers,
    count(*) OVER (PARTITION BY workspace_id, merchant_key, amount_minor, day) - 1 AS copies_elsewhere,
    CAST(sum(CASE WHEN amount_minor > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id) AS BIGINT)
      - CASE WHEN amount_minor > 0 THEN 1 ELSE 0 END AS positive_peers,
    CAST(sum(greatest(amount_minor, 0)) OVER (PARTITION BY workspace_id) AS BIGINT) - greatest(amount_minor, 0) AS positive_peer_minor
  FROM keyed)"""
PROFILE_COLUMNS = "id, workspace_id, amount_minor, peers, merchant_peers, copies_elsewhere, positive_peers, positive_peer_minor"


@query("peer_profile", with_bindings(f"SELECT {PROFILE_COLUMNS} FROM profile", PROFILE))
def _(t):
    return life.peer_profile(t.small_ticket).select(*PROFILE_COLUMNS.split(", "))


@query("expense_anomalies", with_bindings(
    """SELECT id, workspace_id, 'NEGATIVE_AMOUNT' AS code, 'critical' AS severity FROM profile WHERE amount_minor < 0
    UNION ALL SELECT id, workspace_id, 'MISSING_MERCHANT', 'warning' FROM profile WHERE coalesce(trim(merchant_name), '') = ''
    UNION ALL SELECT id, workspace_id, 'UNUSUALLY_HIGH_AMOUNT', 'warning' FROM profile WHERE positive_peers >= 3
      AND positive_peer_minor // positive_peers > 0 AND amount_minor > 3 * (positive_peer_minor // positive_peers)
    UNION ALL SELECT id, workspace_id, 'POSSIBLE_DUPLICATE', 'warning' FROM profile WHERE coalesce(merchant_name, '') <> '' AND copies_elsewhere > 0
    UNION ALL SELECT id, workspace_id, 'WEEKEND_BUSINESS_EXPENSE', 'info' FROM profile WHERE business_expense AND dayofweek(occurred_at) IN (0, 6)
    UNION ALL SELECT id, workspace_id, 'UNUSUAL_MERCHANT', 'info' FROM profile WHERE merchant_key <> '' AND peers >= 5 AND merchant_peers = 0""",
    PROFILE))
def _(t):
    return life.expense_anomalies(life.peer_profile(t.small_ticket))


@query("policy_violations", with_bindings(
    """SELECT l.id AS expense_id, p.id AS policy_id, rule_type, severity, CASE rule_type WHEN 'MAX_AMOUNT_BY_CATEGORY' THEN 'MAX_AMOUNT_EXCEEDED'
      WHEN 'RECEIPT_REQUIRED_ABOVE' THEN 'RECEIPT_REQUIRED' WHEN 'PROJECT_REQUIRED' THEN 'PROJECT_REQUIRED'
      WHEN 'ALLOWED_CATEGORIES' THEN 'CATEGORY_NOT_ALLOWED' ELSE 'DUPLICATE_RECEIPT' END AS code, amount_minor,
      coalesce(max_minor, threshold_minor) AS limit_minor, l.category_id
    FROM (SELECT *, count(document_id) OVER (PARTITION BY workspace_id, document_id) AS uses FROM live) l
    JOIN (SELECT *, TRY_CAST(json_extract_string(config, '$.maxAmountMinor') AS BIGINT) AS max_minor,
      json_extract_string(config, '$.categoryId') AS only_category,
      TRY_CAST(json_extract_string(config, '$.thresholdMinor') AS BIGINT) AS threshold_minor,
      coalesce(json_extract_string(config, '$.onlyBusiness'), 'true') AS only_business,
      json_extract_string(config, '$.categoryIds') AS allowed FROM policy WHERE active) p ON p.workspace_id = l.workspace_id
    WHERE (rule_type = 'MAX_AMOUNT_BY_CATEGORY' AND (only_category IS NULL OR only_category = l.category_id) AND amount_minor > max_minor)
      OR (rule_type = 'RECEIPT_REQUIRED_ABOVE' AND amount_minor >= threshold_minor AND document_id IS NULL)
      OR (rule_type = 'PROJECT_REQUIRED' AND (only_business = 'false' OR business_expense) AND project_code IS NULL)
      OR (rule_type = 'ALLOWED_CATEGORIES' AND allowed <> '[]' AND NOT contains(allowed, '"' || coalesce(l.category_id, '?') || '"'))
      OR (rule_type = 'DUPLICATE_RECEIPT_REJECTION' AND uses > 1)""", LIVE))
def _(t):
    return life.policy_violations(t.expense, t.policy)


@query("recurring_candidates", with_bindings(
    """SELECT workspace_id, arg_max(name, (occurred_at, id, name)) AS name, amount_minor, currency,
      CASE WHEN bool_or(gap BETWEEN 5 AND 10) THEN 'weekly' ELSE 'monthly' END AS cadence, count(*) AS occurrences,
      arg_max(id, (occurred_at, id, name)) AS latest_id, max(occurred_at) AS latest_at,
      max(occurred_at) + CASE WHEN bool_or(gap BETWEEN 5 AND 10) THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END AS next_due_at
    FROM (SELECT *, floor((epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER (PARTITION BY workspace_id, key, amount_minor, currency
        ORDER BY occurred_at))) / 86400000000.0 + 0.5) AS gap
      FROM (SELECT *, trim(coalesce(merchant_name, title)) AS name,
        lower(regexp_replace(trim(coalesce(merchant_name, title)), '\\s+', ' ', 'g')) AS key FROM small_ticket WHERE amount_minor > 0))
    GROUP BY workspace_id, key, amount_minor, currency
    HAVING count(*) >= 2 AND bool_or(gap BETWEEN 5 AND 10 OR gap BETWEEN 25 AND 45)"""))
def _(t):
    return life.recurring_candidates(t.small_ticket)


@query("due_recurrences", with_bindings(
    f"""SELECT id AS rule_id, 'Recurring: ' || coalesce(merchant_name, 'expense') AS title, currency, amount_minor, 'DRAFT' AS status,
    next_due_at AS occurred_at, cadence, CASE WHEN cadence = 'weekly' THEN next_due_at + INTERVAL 7 DAY ELSE
      date_trunc('month', next_due_at) + INTERVAL 1 MONTH + (next_due_at - date_trunc('month', next_due_at)) END AS next_due_at
    FROM recurring WHERE next_due_at <= TIMESTAMP '{AS_OF}'"""))
def _(t):
    return life.due_recurrences(t.recurring, AS_OF)


@query("missing_chunks", with_bindings(
    """SELECT session_id, chunk_index, CASE WHEN chunk_index = 6 THEN size_bytes - 6 * CAST(chunk_size AS BIGINT) ELSE chunk_size END AS expected_bytes
    FROM (SELECT *, unnest(range(7)) AS chunk_index FROM upload_session) s
    WHERE NOT EXISTS (SELECT 1 FROM upload_chunk c WHERE c.session_id = s.session_id AND c.chunk_index = s.chunk_index)"""))
def _(t):
    return life.missing_chunks(t.upload_session, t.upload_chunk)


def extraction(t):
    """Extraction rows with the issue list the operator expects."""
    issue = F.struct(F.col("issue_code").alias("code"), F.col("issue_severity").alias("severity"))
    return t.extraction.withColumn(
        "issues", F.filter(F.array(issue), lambda i: i["severity"].isNotNull())).drop("issue_code", "issue_severity")


@query("latest_per_key", with_bindings(
    """SELECT document_id, id AS extraction_id, created_at, total_minor FROM extraction WHERE status = 'SUCCEEDED'
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1"""))
def _(t):
    from ..functions.groups import latest
    newest = latest(t.extraction.where(F.col("status") == "SUCCEEDED"), ["document_id"], "created_at", "id")
    return newest.select("document_id", F.col("id").alias("extraction_id"), "created_at", "total_minor")


@query("documents_without_expense", with_bindings(
    """SELECT document_id, id AS extraction_id, reject_code,
      CASE WHEN reject_code IS NULL THEN CASE WHEN reasons = '' THEN 'EXTRACTED' ELSE 'NEEDS_REVIEW' END END AS status,
      CASE WHEN reject_code IS NULL THEN reasons END AS reason_codes,
      CASE WHEN reject_code IS NULL THEN coalesce(merchant, 'Extracted expense') END AS title,
      CASE WHEN reject_code IS NULL THEN total_minor END AS amount_minor
    FROM (SELECT *, CASE WHEN total_minor IS NULL THEN 'EXTRACTION_TOTAL_REQUIRED'
        WHEN document_type = 'unknown_document' THEN 'UNSUPPORTED_DOCUMENT_TYPE_FOR_EXPENSE'
        WHEN document_type NOT IN ('retail_receipt', 'invoice', 'e_archive_invoice') THEN 'NON_EXPENSE_DOCUMENT_REQUIRES_CONFIRMATION'
        WHEN document_id IN (SELECT document_id FROM live WHERE document_id IS NOT NULL) THEN 'DUPLICATE_EXPENSE_FOR_DOCUMENT'
        WHEN issue_severity = 'critical' THEN 'EXTRACTION_REQUIRES_REVIEW'
        WHEN date IS NULL THEN 'EXTRACTION_DATE_REVIEW_REQUIRED' END AS reject_code,
      concat_ws(',', CASE WHEN issue_severity = 'warning' THEN issue_code END,
        CASE WHEN merchant_confidence < 0.55 THEN 'LOW_FIELD_CONFIDENCE_MERCHANTNAME' END,
        CASE WHEN date_confidence < 0.55 THEN 'LOW_FIELD_CONFIDENCE_DATE' END,
        CASE WHEN total_confidence < 0.55 THEN 'LOW_FIELD_CONFIDENCE_TOTAL' END,
        CASE WHEN document_type_confidence < 0.6 THEN 'LOW_DOCUMENT_TYPE_CONFIDENCE' END) AS reasons
      FROM (SELECT * FROM extraction WHERE status = 'SUCCEEDED'
        QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1))""", LIVE))
def _(t):
    return life.documents_without_expense(extraction(t), t.expense)


@query("split_reconciliation", with_bindings(
    """SELECT expense_id, CASE WHEN reject_code IS NULL THEN 'parent' ELSE 'rejected' END AS row_type, reject_code,
      CASE WHEN reject_code IS NULL THEN 'ARCHIVED' END AS status, NULL AS title, parent_minor AS amount_minor, currency,
      parent_project AS project_code, parent_business AS business_expense,
      CASE WHEN reject_code IS NULL THEN expense_id END AS split_group FROM judged
    UNION ALL SELECT a.expense_id, 'child', NULL, 'DRAFT', trim(a.title), a.amount_minor, j.currency,
      coalesce(a.project_code, parent_project), coalesce(a.business_expense, parent_business), a.expense_id
    FROM allocation a JOIN judged j ON j.expense_id = a.expense_id WHERE j.reject_code IS NULL""",
    """judged AS (SELECT s.expense_id, e.amount_minor AS parent_minor, e.currency, e.project_code AS parent_project,
      e.business_expense AS parent_business, CASE WHEN e.id IS NULL THEN 'EXPENSE_NOT_FOUND'
        WHEN e.status = 'ARCHIVED' OR e.archived_at IS NOT NULL THEN 'EXPENSE_ARCHIVED'
        WHEN parts < 2 THEN 'EXPENSE_SPLIT_REQUIRES_TWO_ALLOCATIONS' WHEN parts_minor <> e.amount_minor THEN 'EXPENSE_SPLIT_AMOUNT_MISMATCH'
        WHEN parts_tax <> e.tax_minor THEN 'EXPENSE_SPLIT_TAX_MISMATCH' END AS reject_code
    FROM (SELECT expense_id, count(*) AS parts, sum(amount_minor) AS parts_minor, sum(coalesce(tax_minor, 0)) AS parts_tax
      FROM allocation GROUP BY expense_id) s LEFT JOIN expense e ON e.id = s.expense_id)"""))
def _(t):
    return life.split_reconciliation(t.expense, t.allocation)
