"""Expense lifecycle: policies, approvals, claims, recurring spend, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups
from ..functions.dates import add_month_overflowing, is_weekend, minutes_between, month_of
from ..functions.money import exact, total, trunc_div
from ..functions.text import blank_to_null, fold, normalise_name
from .spend import unarchived

# Review windows.
SLA_HOURS = 48
DUE_SOON_MINUTES = 360


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.expr(f"interval {n} hours")


# --- names, pages, candidates ------------------------------------------------


def enrich_names(expense: DataFrame, merchant: DataFrame, payment: DataFrame) -> DataFrame:
    """Left lookup of both names; the planner broadcasts a side that is small."""
    m = merchant.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    p = payment.select(F.col("id").alias("payment_method_id"), F.col("name").alias("payment_method_name"))
    return expense.join(m, "merchant_id", "left").join(p, "payment_method_id", "left")


def search_page(
    expense: DataFrame, merchant: DataFrame, search: str, status: str | None, limit: int, after: tuple | None = None
) -> DataFrame:
    """One page of ``limit + 1`` rows, newest first; the extra row tells that
    another page follows. Merchant hits come through a join on their ids."""
    rows = unarchived(expense)
    if status:
        rows = rows.where(F.col("status") == status)
    if after:
        ts, row_id = instant(after[0]), F.lit(after[1])
        rows = rows.where(
            (F.col("occurred_at") < ts) | ((F.col("occurred_at") == ts) & (F.col("id") < row_id))
        )
    needle = F.lit(search.strip().lower())
    hits = merchant.where(F.contains(F.lower("name"), needle)).select(
        F.col("id").alias("merchant_id"), F.lit(True).alias("merchant_hit")
    )
    found = rows.join(hits, "merchant_id", "left").where(
        F.contains(F.lower("title"), needle)
        | F.contains(F.lower("description"), needle)
        | F.coalesce("merchant_hit", F.lit(False))
    )
    return found.drop("merchant_hit").orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit + 1)


def claimable(expense: DataFrame, claim: DataFrame, claim_item: DataFrame) -> DataFrame:
    """Expenses a new claim may take."""
    closed = ["REJECTED", "REIMBURSED", "ARCHIVED"]
    taken = claim_item.join(
        claim.where(F.col("status") != "REJECTED").select(F.col("id").alias("claim_id")), "claim_id", "left_semi"
    ).select(F.col("expense_id").alias("id"))
    candidates = unarchived(expense).where(
        F.col("reimbursable") & (F.col("amount_minor") > 0) & ~F.col("status").isin(closed)
    )
    return candidates.join(taken, "id", "left_anti")


# --- claims --------------------------------------------------------------------


def claim_lines(claim: DataFrame, claim_item: DataFrame, expense: DataFrame) -> DataFrame:
    """Lines of the reimbursement batch of every month.

    An item belongs to the month of its expense. A claim whose own month holds
    none of its items lists all of them there, without expense details."""
    claims = claim.where(F.col("status").isin("APPROVED", "REIMBURSED")).select(
        F.col("id").alias("claim_id"), "claimant_id", F.col("status").alias("claim_status"), "currency",
        exact("total_minor").alias("claim_total_minor"),
        month_of(F.coalesce("paid_at", "submitted_at", "created_at")).alias("claim_month"),
    )
    e = unarchived(expense).select(
        F.col("id").alias("expense_id"), "title", "merchant_name", F.col("status").alias("expense_status"),
        month_of("occurred_at").alias("expense_month"),
    )
    lines = claim_item.join(claims, "claim_id").join(e, "expense_id", "left")
    own = F.coalesce(F.bool_or(F.col("expense_month") == F.col("claim_month")), F.lit(False)).alias("own_month")
    lines = groups.attach(lines, ["claim_id"], own)
    months = F.array_distinct(
        F.filter(
            F.array(F.col("expense_month"), F.when(~F.col("own_month"), F.col("claim_month"))),
            lambda m: m.isNotNull(),
        )
    )
    placed = lines.withColumn("month", F.explode(months))
    here = F.col("month") == F.col("expense_month")
    return placed.select(
        "month", "claim_id", "claim_status", "claimant_id", "claim_total_minor", "currency", "expense_id",
        *[F.coalesce(F.when(here, F.col(c)), F.lit("")).alias(c) for c in ("title", "merchant_name", "expense_status")],
        F.col("amount_minor").alias("line_amount_minor"),
    )


def claim_totals(claim_item: DataFrame, expense: DataFrame) -> DataFrame:
    """Claim total, present only when every item names an unarchived expense."""
    e = unarchived(expense).select(F.col("id").alias("expense_id"), F.col("amount_minor").alias("expense_minor"),
                                   F.lit(True).alias("found"))
    items = claim_item.join(e, "expense_id", "left")
    return items.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("found").alias("found"),
        F.when(F.count("found") == F.count(F.lit(1)), total("expense_minor")).alias("total_minor"),
    )


def claim_transitions(claim: DataFrame, decision: DataFrame) -> DataFrame:
    """Outcome of every decision event on its claim, in event order.

    A claim takes at most two valid steps: the first approve/reject, then the
    first reject/pay after an approval. Both are minimum aggregates, so a claim
    with any number of events is never collected in one place."""
    start = claim.select(F.col("id").alias("claim_id"), F.col("status").alias("initial"))
    at = F.struct("decided_at", "event_id")
    events = decision.withColumn("at", at).join(start, "claim_id")
    fresh = F.col("initial") == "NEEDS_REVIEW"
    first = events.groupBy("claim_id").agg(
        F.min(F.when(fresh & F.col("action").isin("APPROVED", "REJECTED"), F.struct("at", "action"))).alias("step1")
    )
    events = events.join(first, "claim_id")
    approved_before = (F.col("initial") == "APPROVED") | (
        (F.col("step1.action") == "APPROVED") & (F.col("at") > F.col("step1.at"))
    )
    closes = F.col("action").isin("REJECTED", "REIMBURSED")
    second = events.groupBy("claim_id").agg(
        F.min(F.when(approved_before & closes, F.struct("at", "action"))).alias("step2")
    )
    state = (
        F.when(F.col("at") > F.col("step2.at"), F.col("step2.action"))
        .when(F.col("at") > F.col("step1.at"), F.col("step1.action"))
        .otherwise(F.col("initial"))
    )
    valid = (
        F.when(F.col("action") == "APPROVED", F.col("state_before") == "NEEDS_REVIEW")
        .when(F.col("action") == "REJECTED", F.col("state_before").isin("NEEDS_REVIEW", "APPROVED"))
        .otherwise(F.col("state_before") == "APPROVED")
    )
    error = (
        F.when(F.col("action") == "APPROVED", "REIMBURSEMENT_CLAIM_NOT_REVIEWABLE")
        .when(F.col("action") == "REJECTED", "REIMBURSEMENT_CLAIM_NOT_REJECTABLE")
        .otherwise("REIMBURSEMENT_CLAIM_NOT_PAYABLE")
    )
    return (
        events.join(second, "claim_id").withColumn("state_before", state)
        .select(
            "claim_id", "event_id", "decided_at", "action", "state_before",
            F.when(valid, F.col("action")).otherwise(F.col("state_before")).alias("state_after"),
            F.when(valid, F.lit(None).cast("string")).otherwise(error).alias("error_code"),
        )
    )


def paid_expenses(transitions: DataFrame, claim_item: DataFrame, expense: DataFrame) -> DataFrame:
    """Unarchived expenses that become REIMBURSED through a paid claim."""
    paid = transitions.where((F.col("action") == "REIMBURSED") & F.col("error_code").isNull())
    ids = claim_item.join(paid, "claim_id", "left_semi").select(F.col("expense_id").alias("id"))
    return unarchived(expense).join(ids, "id", "left_semi").select(
        "id", F.col("status").alias("previous_status"), F.lit("REIMBURSED").alias("status")
    )


# --- approvals -------------------------------------------------------------------


def approval_sla(expense: DataFrame, workflow: DataFrame, as_of: str) -> DataFrame:
    """Every expense with its approval workflow, a virtual pending one when none exists."""
    now = instant(as_of)
    w = workflow.select(
        F.col("target_id").alias("id"), F.col("id").alias("workflow_id"), "state", "approver_id", "sla_due_at",
        "sla_breached_at", "sla_status", "sla_hours",
    )
    missing = F.col("workflow_id").isNull()
    joined = unarchived(expense).join(w, "id", "left").select(
        F.col("id").alias("expense_id"), "workspace_id", "title", "status", "occurred_at", "created_at",
        F.coalesce("workflow_id", F.concat(F.lit("virtual-"), F.col("id").cast("string"))).alias("workflow_id"),
        F.coalesce("state", F.lit("PENDING")).alias("workflow_state"),
        "approver_id",
        F.when(missing, F.col("created_at") + hours(SLA_HOURS)).otherwise(F.col("sla_due_at")).alias("sla_due_at"),
        "sla_breached_at",
        F.coalesce("sla_status", F.lit("ON_TRACK")).alias("stored_status"),
        F.when(missing, SLA_HOURS).otherwise(F.col("sla_hours")).alias("sla_hours"),
        F.greatest(F.lit(0), minutes_between(now, F.col("created_at"))).alias("age_minutes"),
    )
    left = minutes_between(F.col("sla_due_at"), now)
    status = (
        F.when((F.col("workflow_state") != "PENDING") | left.isNull(), F.col("stored_status"))
        .when(left < 0, "BREACHED").when(left <= DUE_SOON_MINUTES, "DUE_SOON").otherwise("ON_TRACK")
    )
    return (
        joined.withColumn("remaining_minutes", left)
        .withColumn("sla_status", status)
        .withColumn("sla_breached_at", F.coalesce(
            "sla_breached_at", F.when(F.col("sla_status") == "BREACHED", F.col("sla_due_at"))))
        .drop("stored_status", "created_at")
    )


def sla_outcome(workflow: DataFrame) -> DataFrame:
    """Decided workflows: kept or missed deadline, by decision."""
    late = F.coalesce(F.col("decided_at") > F.col("sla_due_at"), F.lit(False))
    met = F.when(F.col("state") == "APPROVED", "MET").otherwise("REJECTED")
    return workflow.where(F.col("state").isin("APPROVED", "REJECTED")).select(
        F.col("id").alias("workflow_id"),
        "state",
        F.concat(met, F.when(late, "_LATE").otherwise("_ON_TIME")).alias("sla_status"),
        F.when(late, F.col("sla_due_at")).alias("sla_breached_at"),
    )


def approval_evidence(
    expense: DataFrame, workflow: DataFrame, claim: DataFrame, claim_item: DataFrame, as_of: str
) -> DataFrame:
    """Approval rows with the claims each expense sits in, newest claim first."""
    c = claim.select(F.col("id").alias("claim_id"), "status", "created_at")
    # (claim, expense) is unique, and a claim holds at most a hundred expenses.
    per_expense = claim_item.join(c, "claim_id").groupBy("expense_id").agg(
        F.sort_array(F.collect_list(F.struct("created_at", "claim_id", "status")), False).alias("c")
    )
    joined = approval_sla(expense, workflow, as_of).join(per_expense, "expense_id", "left")

    def piped(field: str) -> Column:
        return F.coalesce(F.array_join(F.transform("c", lambda x: x[field].cast("string")), "|"), F.lit(""))

    return joined.select(
        "expense_id", "title", "status", "workflow_id", "workflow_state",
        F.coalesce(F.col("approver_id").cast("string"), F.lit("")).alias("approver_id"),
        "sla_status", "sla_due_at", "sla_breached_at", "sla_hours", "remaining_minutes", "age_minutes",
        piped("claim_id").alias("claim_ids"), piped("status").alias("claim_statuses"),
    )


# --- peers, duplicates, policies -------------------------------------------------------


def possible_duplicates(expense: DataFrame) -> DataFrame:
    """Rows sharing workspace, folded merchant, amount and day with another row."""
    keys = ["workspace_id", "merchant_key", "amount_minor", "day"]
    rows = (
        expense.where(F.coalesce("merchant_name", F.lit("")) != "")
        .withColumn("merchant_key", fold(F.col("merchant_name")))
        .withColumn("day", F.col("occurred_at").cast("date"))
    )
    counted = groups.attach(rows, keys, F.count(F.lit(1)).alias("copies"))
    return counted.where(F.col("copies") > 1).select("id", *keys, "copies")


def peer_profile(expense: DataFrame) -> DataFrame:
    """What each expense looks like against its workspace peers, itself left out."""
    positive = F.when(F.col("amount_minor") > 0, F.col("amount_minor"))
    rows = expense.withColumn("merchant_key", fold(F.coalesce("merchant_name", F.lit("")))).withColumn(
        "day", F.col("occurred_at").cast("date")
    )
    # The finest grouping is summed once more for the coarser ones.
    by_copy = rows.groupBy("workspace_id", "merchant_key", "amount_minor", "day").agg(
        F.count(F.lit(1)).alias("copies")
    )
    by_merchant = by_copy.groupBy("workspace_id", "merchant_key").agg(F.sum("copies").alias("merchant_rows"))
    weighted = F.sum(F.when(F.col("amount_minor") > 0, exact("amount_minor") * F.col("copies")))
    by_workspace = by_copy.groupBy("workspace_id").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.when(F.col("amount_minor") > 0, F.col("copies")).otherwise(0)).alias("positive_rows"),
        weighted.cast("decimal(38,0)").alias("positive_minor"),
    )
    own = F.when(F.col("amount_minor") > 0, 1).otherwise(0)
    return (
        rows.join(by_copy, ["workspace_id", "merchant_key", "amount_minor", "day"])
        .join(by_merchant, ["workspace_id", "merchant_key"])
        .join(by_workspace, "workspace_id")
        .withColumn("peers", F.col("rows") - 1)
        .withColumn("positive_peers", F.col("positive_rows") - own)
        .withColumn("positive_peer_minor",
                    (F.coalesce("positive_minor", F.lit(0)) - F.coalesce(exact(positive), F.lit(0))).cast("decimal(38,0)"))
        .withColumn("merchant_peers", F.col("merchant_rows") - 1)
        .withColumn("copies_elsewhere", F.col("copies") - 1)
        .drop("rows", "positive_rows", "positive_minor", "merchant_rows", "copies")
    )


def expense_anomalies(profile: DataFrame) -> DataFrame:
    """Anomaly rows of each expense, in rule order."""
    mean = trunc_div(F.col("positive_peer_minor"), F.nullif(F.col("positive_peers"), F.lit(0)))
    amount = exact("amount_minor")
    high = (F.col("amount_minor") > 0) & (F.col("positive_peers") >= 3) & (mean > 0) & (amount > exact(mean) * 3)

    def rule(cond: Column, code: str, severity: str) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    rules = F.array(
        rule(F.col("amount_minor") < 0, "NEGATIVE_AMOUNT", "critical"),
        rule(blank_to_null(F.col("merchant_name")).isNull(), "MISSING_MERCHANT", "warning"),
        rule(high, "UNUSUALLY_HIGH_AMOUNT", "warning"),
        rule((F.coalesce("merchant_name", F.lit("")) != "") & (F.col("copies_elsewhere") > 0),
             "POSSIBLE_DUPLICATE", "warning"),
        rule(F.col("business_expense") & is_weekend("occurred_at"), "WEEKEND_BUSINESS_EXPENSE", "info"),
        rule((F.col("merchant_key") != "") & (F.col("peers") >= 5) & (F.col("merchant_peers") == 0),
             "UNUSUAL_MERCHANT", "info"),
    )
    hits = F.filter(rules, lambda r: r.isNotNull())
    return profile.select("id", "workspace_id", F.explode(hits).alias("r")).select("id", "workspace_id", "r.*")


def policy_violations(expense: DataFrame, policy: DataFrame) -> DataFrame:
    """Every active policy against every unarchived expense of its workspace.

    ``policy.config`` is JSON; it is read once per policy, before the join."""
    config = "max_minor string, category string, threshold string, only_business boolean, categories array<string>"
    parsed = F.from_json("config", config.replace("max_minor", "maxAmountMinor").replace("category ", "categoryId ")
                         .replace("threshold", "thresholdMinor").replace("only_business", "onlyBusiness")
                         .replace("categories", "categoryIds"))
    p = (
        policy.where("active")
        .withColumn("c", parsed)
        .select(
            F.col("id").alias("policy_id"), "workspace_id", "rule_type",
            F.when(F.col("severity") == "block", "block").otherwise("warning").alias("severity"),
            F.col("c.maxAmountMinor").try_cast("decimal(38,0)").alias("max_minor"),
            F.col("c.categoryId").alias("only_category"),
            F.col("c.thresholdMinor").try_cast("decimal(38,0)").alias("threshold_minor"),
            F.coalesce("c.onlyBusiness", F.lit(True)).alias("only_business"),
            F.col("c.categoryIds").alias("allowed"),
        )
    )
    rows = unarchived(expense).select(
        "id", "workspace_id", "category_id", "amount_minor", "document_id", "business_expense", "project_code"
    )
    receipts = rows.where(F.col("document_id").isNotNull()).groupBy("workspace_id", "document_id").agg(
        F.count(F.lit(1)).alias("receipt_uses")
    )
    e = rows.join(receipts, ["workspace_id", "document_id"], "left")
    amount = F.col("amount_minor")
    rule = F.col("rule_type")
    over = (F.col("only_category").isNull() | F.coalesce(F.col("category_id") == F.col("only_category"), F.lit(False))) & (
        exact(amount) > F.col("max_minor")
    )
    code = (
        F.when((rule == "MAX_AMOUNT_BY_CATEGORY") & over, "MAX_AMOUNT_EXCEEDED")
        .when((rule == "RECEIPT_REQUIRED_ABOVE") & (exact(amount) >= F.col("threshold_minor"))
              & F.col("document_id").isNull(), "RECEIPT_REQUIRED")
        .when((rule == "PROJECT_REQUIRED") & (~F.col("only_business") | F.col("business_expense"))
              & F.col("project_code").isNull(), "PROJECT_REQUIRED")
        .when((rule == "ALLOWED_CATEGORIES") & (F.size("allowed") > 0)
              & ~F.coalesce(F.array_contains("allowed", F.col("category_id")), F.lit(False)), "CATEGORY_NOT_ALLOWED")
        .when((rule == "DUPLICATE_RECEIPT_REJECTION") & (F.col("receipt_uses") > 1), "DUPLICATE_RECEIPT")
    )
    return (
        e.join(p, "workspace_id").withColumn("code", code).where(F.col("code").isNotNull())
        .select(
            F.col("id").alias("expense_id"), "policy_id", "rule_type", "severity", "code", "amount_minor",
            F.coalesce("max_minor", "threshold_minor").alias("limit_minor"), "category_id",
        )
    )


# --- time driven ------------------------------------------------------------------------


def recurring_candidates(expense: DataFrame) -> DataFrame:
    """Repeated (name, amount, currency) groups with a weekly or monthly gap.

    Rows of one day are merged first: a gap counts only from five days up, so
    the first and last instant of each day are enough. A hot key shrinks to its
    number of days before anything is ordered."""
    name = F.trim(F.coalesce("merchant_name", "title"))
    keys = ["workspace_id", "name_key", "amount_minor", "currency"]
    days = (
        expense.where(F.col("amount_minor") > 0)
        .withColumn("name_key", normalise_name(name))
        .withColumn("name", name)
        .groupBy(*keys, F.col("occurred_at").cast("date").alias("day"))
        .agg(
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
            F.max(F.struct("occurred_at", "id", "name")).alias("latest"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    from pyspark.sql import Window as W

    previous = F.lag("last_at").over(W.partitionBy(*keys).orderBy("day"))
    micros = F.unix_micros(F.col("first_at").cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    gap = F.floor(micros / F.lit(86_400_000_000.0) + 0.5)
    found = (
        days.withColumn("gap", gap)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("occurrences"),
            F.bool_or(F.col("gap").between(5, 10)).alias("weekly"),
            F.bool_or(F.col("gap").between(25, 45)).alias("monthly"),
            F.max("latest").alias("latest"),
        )
        .where((F.col("occurrences") >= 2) & (F.col("weekly") | F.col("monthly")))
    )
    return found.select(
        "workspace_id",
        F.col("latest.name").alias("name"),
        "amount_minor",
        "currency",
        F.when(F.col("weekly"), "weekly").otherwise("monthly").alias("cadence"),
        "occurrences",
        F.col("latest.id").alias("latest_id"),
        F.col("latest.occurred_at").alias("latest_at"),
        F.when(F.col("weekly"), F.col("latest.occurred_at") + F.expr("interval 7 days"))
        .otherwise(F.col("latest.occurred_at") + F.expr("interval 30 days"))
        .alias("next_due_at"),
    )


def due_recurrences(recurring: DataFrame, as_of: str) -> DataFrame:
    """Draft expense of every due rule and the rule's next date."""
    due = recurring.where(F.col("next_due_at") <= instant(as_of))
    following = F.when(F.col("cadence") == "weekly", F.col("next_due_at") + F.expr("interval 7 days")).otherwise(
        add_month_overflowing(F.col("next_due_at"))
    )
    return due.select(
        F.col("id").alias("rule_id"),
        F.concat(F.lit("Recurring: "), F.coalesce("merchant_name", F.lit("expense"))).alias("title"),
        "currency", "amount_minor", F.lit("DRAFT").alias("status"),
        F.col("next_due_at").alias("occurred_at"), "cadence", following.alias("next_due_at"),
    )


# --- documents and splits ------------------------------------------------------------------


def missing_chunks(session: DataFrame, chunk: DataFrame) -> DataFrame:
    """Chunks of an upload that never arrived, with the size each should have."""
    last = F.col("chunk_count") - 1
    expected = session.withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    size = F.when(
        F.col("chunk_index") == last, F.col("size_bytes") - F.col("chunk_size") * last
    ).otherwise(F.col("chunk_size"))
    return expected.join(chunk.select("session_id", "chunk_index"), ["session_id", "chunk_index"], "left_anti").select(
        "session_id", "chunk_index", size.alias("expected_bytes")
    )


def documents_without_expense(extraction: DataFrame, expense: DataFrame) -> DataFrame:
    """Gate from the latest extraction of a document to a new expense."""
    newest = groups.latest(extraction.where(F.col("status") == "SUCCEEDED"), ["document_id"], "created_at", "id")
    used = unarchived(expense).where(F.col("document_id").isNotNull()).select("document_id").distinct()
    rows = newest.join(used.withColumn("used", F.lit(True)), "document_id", "left")
    standard = F.col("document_type").isin("retail_receipt", "invoice", "e_archive_invoice")
    reject = (
        F.when(F.col("total_minor").isNull(), "EXTRACTION_TOTAL_REQUIRED")
        .when(F.col("document_type") == "unknown_document", "UNSUPPORTED_DOCUMENT_TYPE_FOR_EXPENSE")
        .when(~standard, "NON_EXPENSE_DOCUMENT_REQUIRES_CONFIRMATION")
        .when(F.col("used"), "DUPLICATE_EXPENSE_FOR_DOCUMENT")
        .when(F.exists("issues", lambda i: i["severity"] == "critical"), "EXTRACTION_REQUIRES_REVIEW")
        .when(F.col("date").isNull(), "EXTRACTION_DATE_REVIEW_REQUIRED")
    )
    warnings = F.transform(F.filter("issues", lambda i: i["severity"] == "warning"), lambda i: i["code"])
    low = F.array(
        F.when(F.col("merchant_confidence") < 0.55, "LOW_FIELD_CONFIDENCE_MERCHANTNAME"),
        F.when(F.col("date_confidence") < 0.55, "LOW_FIELD_CONFIDENCE_DATE"),
        F.when(F.col("total_confidence") < 0.55, "LOW_FIELD_CONFIDENCE_TOTAL"),
        F.when(F.col("document_type_confidence") < 0.6, "LOW_DOCUMENT_TYPE_CONFIDENCE"),
    )
    reasons = F.array_distinct(F.concat(warnings, F.filter(low, lambda c: c.isNotNull())))
    ok = F.col("reject_code").isNull()
    return rows.withColumn("reject_code", reject).withColumn("reasons", reasons).select(
        "document_id",
        F.col("id").alias("extraction_id"),
        "reject_code",
        F.when(ok, F.when(F.size("reasons") > 0, "NEEDS_REVIEW").otherwise("EXTRACTED")).alias("status"),
        F.when(ok, F.array_join("reasons", ",")).alias("reason_codes"),
        F.when(ok, F.coalesce("merchant", F.lit("Extracted expense"))).alias("title"),
        F.when(ok, F.col("total_minor")).alias("amount_minor"),
    )


def split_reconciliation(expense: DataFrame, allocation: DataFrame) -> DataFrame:
    """Proposed splits: a reject code, or child rows and the archived parent."""
    sums = allocation.groupBy("expense_id").agg(
        F.count(F.lit(1)).alias("parts"),
        total("amount_minor").alias("parts_minor"),
        total(F.coalesce("tax_minor", F.lit(0))).alias("parts_tax"),
    )
    parent = expense.select(
        F.col("id").alias("expense_id"), F.col("amount_minor").alias("parent_minor"),
        F.col("tax_minor").alias("parent_tax"), F.col("status").alias("parent_status"), "archived_at", "currency",
        "merchant_name", F.col("project_code").alias("parent_project"),
        F.col("business_expense").alias("parent_business"),
    )
    judged = sums.join(parent, "expense_id", "left").withColumn(
        "reject_code",
        F.when(F.col("parent_minor").isNull(), "EXPENSE_NOT_FOUND")
        .when((F.col("parent_status") == "ARCHIVED") | F.col("archived_at").isNotNull(), "EXPENSE_ARCHIVED")
        .when(F.col("parts") < 2, "EXPENSE_SPLIT_REQUIRES_TWO_ALLOCATIONS")
        .when(F.col("parts_minor") != exact("parent_minor"), "EXPENSE_SPLIT_AMOUNT_MISMATCH")
        .when(F.col("parts_tax") != exact("parent_tax"), "EXPENSE_SPLIT_TAX_MISMATCH"),
    )
    none = F.lit(None)
    parents = judged.select(
        "expense_id",
        F.when(F.col("reject_code").isNull(), "parent").otherwise("rejected").alias("row_type"),
        "reject_code",
        F.when(F.col("reject_code").isNull(), "ARCHIVED").alias("status"),
        none.cast("string").alias("title"), F.col("parent_minor").alias("amount_minor"), "currency",
        F.col("parent_project").alias("project_code"), F.col("parent_business").alias("business_expense"),
        F.when(F.col("reject_code").isNull(), F.col("expense_id")).alias("split_group"),
    )
    children = (
        allocation.join(judged.where(F.col("reject_code").isNull()), "expense_id")
        .select(
            "expense_id", F.lit("child").alias("row_type"), "reject_code", F.lit("DRAFT").alias("status"),
            F.trim("title").alias("title"), "amount_minor", "currency",
            F.coalesce("project_code", "parent_project").alias("project_code"),
            F.coalesce("business_expense", "parent_business").alias("business_expense"),
            F.col("expense_id").alias("split_group"),
        )
    )
    return parents.unionByName(children)
