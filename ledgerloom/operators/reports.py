"""Report datasets: quality rows, model evaluations, audit packs, labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import groups
from ..functions.dates import month_of
from ..functions.money import exact, total, total_where
from ..functions.text import fixed4
from .operations import json_value
from .spend import report_totals, unarchived, with_month

# How many rows the printed reports show.
TOP_MERCHANTS, LEDGER_ROWS, CLAIM_ROWS, CLAIM_LINES = 12, 24, 18, 28


def ocr_quality_rows(document: DataFrame, job: DataFrame, run: DataFrame) -> DataFrame:
    """One row per engine run; comparison metrics only on the ensemble's rows."""
    d = document.select(F.col("id").alias("document_id"), "workspace_id", "kind", "safe_name")
    j = job.select(
        F.col("id").alias("job_id"), "document_id", F.col("status").alias("job_status"), "requested_engines",
        month_of(F.coalesce("completed_at", "created_at")).alias("month"),
    )
    ensemble = F.when(F.col("engine") == "ENSEMBLE", F.try_parse_json("normalized_json"))
    rows = run.join(j, "job_id").join(d, "document_id").withColumn("v", ensemble)
    v = F.col("v")

    def metric(key: str):
        return fixed4(json_value(v, f"$.{key}", "double"))

    conflicts = F.try_variant_get(v, "$.conflictFields", "array<string>")
    return rows.select(
        "month", "workspace_id", "document_id", "kind", "safe_name", "job_id", "job_status", "requested_engines",
        "engine", F.col("status").alias("run_status"), "confidence", "latency_ms",
        F.coalesce(json_value(v, "$.selectedEngine", "string"), F.lit("")).alias("selected_engine"),
        metric("averageConfidence").alias("average_confidence"),
        metric("failureRate").alias("failure_rate"),
        metric("characterErrorRate").alias("character_error_rate"),
        metric("wordErrorRate").alias("word_error_rate"),
        F.coalesce(F.array_join(conflicts, "|"), F.lit("")).alias("conflict_fields"),
        F.coalesce("failure_reason", F.lit("")).alias("failure_reason"),
    )


def model_evaluation_rows(version: DataFrame, training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Evaluations with their model version and that version's latest training run."""
    newest = groups.latest(
        training.where(F.col("model_version_id").isNotNull()), ["model_version_id"], "created_at", "id"
    ).select("model_version_id", F.col("id").alias("training_run_id"), F.col("status").alias("training_status"))
    m = version.select(
        F.col("id").alias("model_version_id"), F.col("name").alias("model_name"), "engine",
        F.col("status").alias("model_status"),
    )
    e = evaluation.withColumn("v", F.try_parse_json("metrics"))
    v = F.col("v")
    blank = F.lit("")
    rows = e.select(
        F.col("id").alias("evaluation_run_id"), "model_version_id", F.col("status").alias("evaluation_status"),
        "completed_at",
        *[
            fixed4(json_value(v, f"$.{key}", "double")).alias(key)
            for key in ("accuracy", "macro_f1", "loss", "cer", "wer", "field_accuracy")
        ],
        F.coalesce(json_value(v, "$.accuracy_note", "string"), blank).alias("accuracy_note"),
    )
    return (
        rows.join(m, "model_version_id", "left").join(newest, "model_version_id", "left")
        .withColumns({c: F.coalesce(c, blank) for c in ("model_name", "engine", "model_status", "training_status")})
    )


def audit_pack(expense: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit pack of every (workspace, month): its expenses, the audit rows on
    them at any date, and the workspace's own audit rows of that month."""
    packed = with_month(unarchived(expense))
    expenses = packed.select(
        "workspace_id", "month", F.lit("expense").alias("row_type"), F.lit("Expense").alias("resource_type"),
        F.col("id").cast("string").alias("resource_id"), F.col("updated_at").alias("event_at"),
        F.col("status").alias("action_or_status"), exact("amount_minor").alias("amount_minor"), "currency",
    )
    logs = audit.select("id", "resource_type", "resource_id", "created_at", "action", "metadata")
    hits = logs.where(F.col("resource_type") == "Expense").join(
        packed.select(F.col("id").cast("string").alias("resource_id"), "workspace_id", "month"), "resource_id"
    )
    space = F.get_json_object("metadata", "$.workspaceId").try_cast("int")
    own = logs.withColumn("workspace_id", space).where(F.col("workspace_id").isNotNull()).withColumn(
        "month", month_of("created_at")
    )
    events = hits.unionByName(own.select(*hits.columns)).dropDuplicates(["workspace_id", "month", "id"])
    rows = events.select(
        "workspace_id", "month", F.lit("audit_event").alias("row_type"), "resource_type",
        F.coalesce("resource_id", F.lit("")).alias("resource_id"), F.col("created_at").alias("event_at"),
        F.col("action").alias("action_or_status"),
    )
    return expenses.unionByName(rows, allowMissingColumns=True)


def labelled_documents(
    document: DataFrame, annotation: DataFrame, correction: DataFrame, suggestion: DataFrame, part_size: int = 1000
) -> DataFrame:
    """Documents with their label, correction and suggestion arrays.

    Each child table is aggregated before the joins, so there is no fan-out. A
    document with very many children spans several parts of ``part_size``
    positions (``turn`` order), so no output row grows without bound."""

    def bundled(child: DataFrame, name: str) -> DataFrame:
        columns = [c for c in child.columns if c != "document_id"]
        part = F.floor(F.col("turn") / part_size).cast("long").alias("part")
        return child.groupBy("document_id", part).agg(
            F.array_sort(F.collect_list(F.struct("turn", *[c for c in columns if c != "turn"]))).alias(name)
        )

    keys = ["document_id", "part"]
    children = (
        bundled(annotation, "labels")
        .join(bundled(correction, "corrections"), keys, "full_outer")
        .join(bundled(suggestion, "suggestions"), keys, "full_outer")
    )
    d = document.where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("document_id"), "workspace_id", "kind", "safe_name", "created_at"
    )
    joined = d.join(children, "document_id", "left")
    return joined.withColumn("part", F.coalesce("part", F.lit(0)))


def dataset_export(labelled: DataFrame) -> DataFrame:
    """One JSON text per labelled document part, ready for a text sink."""
    empty = {name: F.coalesce(name, F.array()) for name in ("labels", "corrections", "suggestions")}
    row = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit("dataset_export_jsonl").alias("exportType"),
        F.col("workspace_id").alias("workspaceId"),
        F.struct(F.col("document_id").alias("id"), "kind", F.col("safe_name").alias("safeName"),
                 F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt")).alias("document"),
        "part",
        *[F.col(n) for n in ("labels", "corrections", "suggestions")],
    )
    filled = labelled.withColumns({n: F.coalesce(F.col(n), F.expr(f"cast(array() as {t.simpleString()})"))
                                   for n, t in ((f.name, f.dataType) for f in labelled.schema.fields) if n in empty})
    return filled.select("document_id", "part", F.to_json(row).alias("value"))


def monthly_report_summary(expense: DataFrame) -> DataFrame:
    return with_month(unarchived(expense)).groupBy("workspace_id", "month").agg(
        F.count(F.lit(1)).alias("expense_count"),
        F.array_join(F.array_sort(F.collect_set("currency")), ", ").alias("currencies"),
        total("amount_minor").alias("total_minor"),
        total("tax_minor").alias("tax_minor"),
        total_where(F.col("business_expense"), "amount_minor").alias("business_minor"),
        total_where(F.col("reimbursable"), "amount_minor").alias("reimbursable_minor"),
    )


def claim_report_summary(claim: DataFrame) -> DataFrame:
    rows = claim.where(F.col("status").isin("APPROVED", "REIMBURSED"))
    return rows.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.count_if(F.col("status") == "APPROVED").alias("approved"),
        F.count_if(F.col("status") == "REIMBURSED").alias("reimbursed"),
        F.array_join(F.array_sort(F.collect_set("currency")), ", ").alias("currencies"),
        total("total_minor").alias("total_minor"),
    )


def top_merchants(expense: DataFrame, n: int = TOP_MERCHANTS) -> DataFrame:
    return groups.top(
        report_totals(expense, "merchant"), ["workspace_id", "month"],
        [F.desc("total_minor"), F.asc("merchant"), F.asc("currency")], n,
    )


def ledger_head(expense: DataFrame, n: int = LEDGER_ROWS) -> DataFrame:
    rows = with_month(unarchived(expense)).select("workspace_id", "month", "id", "occurred_at", "title", "amount_minor")
    return groups.top(rows, ["workspace_id", "month"], [F.desc("occurred_at"), F.desc("id")], n)


def recent_items(expense: DataFrame, document: DataFrame, n: int = 5) -> DataFrame:
    """Newest expenses and documents of each workspace."""
    e = groups.top(unarchived(expense), ["workspace_id"], [F.desc("occurred_at"), F.desc("id")], n)
    d = groups.top(document.where(F.col("deleted_at").isNull()), ["workspace_id"],
                   [F.desc("created_at"), F.desc("id")], n)
    columns = ["workspace_id", "kind", "rank", "id", "at"]
    return (
        e.withColumns({"kind": F.lit("expense"), "at": F.col("occurred_at")}).select(*columns)
        .unionByName(d.withColumns({"kind": F.lit("document"), "at": F.col("created_at")}).select(*columns))
    )
