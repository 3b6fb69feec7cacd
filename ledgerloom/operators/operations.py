"""Operational tables: events, jobs, audit, requests, models, uploads, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups
from ..functions.money import EXACT, exact, percent_2dp, total
from ..functions.storage import written
from ..functions.text import fold
from .lifecycle import instant

# State lists and histogram edges.
OUTBOX_STATES = ("pending", "published", "failed")
INBOX_STATES = ("processed", "failed")
JOB_STATES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELED")
TASK_STATES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELED")
# Endpoints in one list of the event fan-out: what a joined row holds at once. Parquet packs eight numbers at a time.
FAN_LIST = 1_024
# Endpoint and topic pairs (8 bytes each) that are sent to all tasks.
FAN_SENT = 1_000_000
LATENCY_EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _zero_filled(counts: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts per listed value; missing values count zero."""
    grid = groups.literal_rows(counts.sparkSession, column, values)
    return grid.join(counts, column, "left").select(column, F.coalesce("count", F.lit(0)).alias("count"))


def _counts(rows: DataFrame, first: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """Counts by state (zero-filled) and by (first, state) from one aggregate."""
    fine = rows.groupBy(first, state).agg(F.count(F.lit(1)).alias("count"))
    coarse = _zero_filled(fine.groupBy(state).agg(F.sum("count").alias("count")), state, states)
    return fine.select(F.lit("detail").alias("level"), first, state, "count").unionByName(
        coarse.select(F.lit("total").alias("level"), F.lit(None).cast("string").alias(first), state, "count")
    )


# --- events ---------------------------------------------------------------------------


def with_state(outbox: DataFrame) -> DataFrame:
    failed = F.coalesce("failure_reason", F.lit("")) != ""
    state = F.when(failed, "failed").when(F.col("published_at").isNotNull(), "published").otherwise("pending")
    return outbox.withColumn("state", state)


def outbox_counts(outbox: DataFrame) -> DataFrame:
    return _counts(with_state(outbox), "topic", "state", OUTBOX_STATES)


def inbox_counts(inbox: DataFrame) -> DataFrame:
    return _counts(inbox, "topic", "status", INBOX_STATES)


def dead_letters(outbox: DataFrame, per_tenant: int, topic: str | None = None, reason: str | None = None) -> DataFrame:
    """Newest dead letters of each tenant under a replay policy."""
    rows = with_state(outbox).where((F.col("state") == "failed") & F.startswith("failure_reason", F.lit("DLQ:")))
    if topic:
        rows = rows.where(F.col("topic") == topic)
    if reason and reason.strip():
        rows = rows.where(F.contains(F.lower("failure_reason"), F.lit(reason.strip().lower())))
    return groups.top(rows, ["tenant_id"], [F.desc("created_at"), F.desc("id")], per_tenant)


def replay_plan(outbox: DataFrame, per_tenant: int, dry_run: bool, **policy: str) -> DataFrame:
    """What a replay does: preview rows, or requeued rows with a cleared failure."""
    picked = dead_letters(outbox, per_tenant, **policy)
    return picked.select(
        "id", "tenant_id", "topic", "aggregate_id",
        F.lit("would_requeue" if dry_run else "requeued").alias("action"),
        (F.col("failure_reason") if dry_run else F.lit(None).cast("string")).alias("failure_reason"),
    )


def event_subscriptions(outbox: DataFrame, endpoint: DataFrame) -> DataFrame:
    """One delivery row per event and enabled endpoint that lists its topic.

    The join meets events with lists of at most ``FAN_LIST`` endpoints; a list becomes rows after it. Events are dealt
    by their id first: topics are few, and the rows multiply in the task that holds the event. A task takes the events
    of one list after each other, so that a sink by columns sees the same endpoints again and again and keeps them small."""
    wanted = (
        endpoint.where("enabled")
        .select(F.col("id").alias("endpoint_id"), "tenant_id", F.explode(F.array_distinct("event_types")).alias("topic"))
    )
    numbered = groups.positions(wanted, ["tenant_id", "topic"], [F.asc("endpoint_id")], "n")
    part = F.floor((F.col("n") - 1) / FAN_LIST).alias("part")
    lists = numbered.groupBy("tenant_id", "topic", part).agg(F.sort_array(F.collect_list(F.struct("endpoint_id"))).alias("listed"))
    last = numbered.groupBy("tenant_id", "topic").agg(F.max(part).alias("last"))
    tasks = int(outbox.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = outbox.select(F.col("id").alias("event_id"), "tenant_id", "topic").join(last, ["tenant_id", "topic"]).repartition(tasks, "event_id")
    parts = met.select("event_id", "tenant_id", "topic", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    # Written, as a sort below a join has no effect.
    dealt = written(parts.sortWithinPartitions("tenant_id", "topic", "part", "event_id"), "fan-out")
    lists = lists.select("tenant_id", "topic", "part", F.col("listed.endpoint_id").alias("endpoints"))
    # Few events are the smaller side by bytes; to send them to the lists would leave all rows to the lists' few tasks.
    small = numbered.count() <= FAN_SENT
    fanned = dealt.join(F.broadcast(lists) if small else lists, ["tenant_id", "topic", "part"])
    return fanned.select("event_id", F.explode("endpoints").alias("endpoint_id"), "tenant_id", "topic")


def consumer_lag(committed: DataFrame, high: DataFrame) -> DataFrame:
    lag = F.greatest(F.lit(0), F.coalesce("high", "committed") - F.col("committed"))
    return committed.join(high, ["topic", "partition_id"], "left").select(
        "group_id", "topic", "partition_id", "committed", F.coalesce("high", "committed").alias("high"),
        lag.alias("lag"),
    )


# --- jobs, audit, requests ----------------------------------------------------------------


def job_counts(job: DataFrame) -> DataFrame:
    """By status, by (queue, status), and failures by (queue, worker), from one pass."""
    fine = job.groupBy("queue", "status", "locked_by").agg(F.count(F.lit(1)).alias("count"))
    none = F.lit(None).cast("string")
    by_status = _zero_filled(fine.groupBy("status").agg(F.sum("count").alias("count")), "status", JOB_STATES)
    by_queue = fine.groupBy("queue", "status").agg(F.sum("count").alias("count"))
    failed = fine.where((F.col("status") == "FAILED") & F.col("locked_by").isNotNull())
    return (
        by_status.select(F.lit("status").alias("level"), none.alias("queue"), "status", none.alias("worker"), "count")
        .unionByName(by_queue.select(F.lit("queue").alias("level"), "queue", "status", none.alias("worker"), "count"))
        .unionByName(failed.select(F.lit("failed").alias("level"), "queue", "status",
                                   F.col("locked_by").alias("worker"), "count"))
    )


def stale_and_retryable(job: DataFrame, as_of: str, stale_minutes: int) -> DataFrame:
    """Oldest stuck and oldest failed job per (queue, document) with attempts left."""
    idle = (F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")))
    left = F.col("attempts") < F.col("max_attempts")
    kind = (
        F.when((F.col("status") == "RUNNING") & (idle > stale_minutes * 60_000_000) & left, "stale")
        .when((F.col("status") == "FAILED") & left, "retryable")
    )
    return (
        job.withColumn("kind", kind).where(F.col("kind").isNotNull())
        .groupBy("queue", "document_id", "kind")
        .agg(F.min(F.struct("created_at", "id")).alias("oldest"), F.count(F.lit(1)).alias("candidates"))
        .select("queue", "document_id", "kind", "oldest.id", "oldest.created_at", "candidates")
    )


def audit_filter(audit: DataFrame, limit: int = 50, **equal: str) -> DataFrame:
    rows = audit
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def retention_cut(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per tenant: rows before the cutoff and rows that stay."""
    old = F.col("created_at") < instant(as_of) - F.expr(f"interval {days} days")
    return audit.groupBy("tenant_id").agg(F.count_if(old).alias("matched"), F.count_if(~old).alias("kept"))


def retention_sample(audit: DataFrame, as_of: str, days: int, n: int = 50) -> DataFrame:
    cut = instant(as_of) - F.expr(f"interval {days} days")
    return groups.top(audit.where(F.col("created_at") < cut), ["tenant_id"], [F.asc("created_at"), F.asc("id")], n)


def retention_apply(audit: DataFrame, as_of: str, days: int) -> DataFrame:
    """What a confirmed cut leaves; the caller overwrites the table with it."""
    return audit.where(F.col("created_at") >= instant(as_of) - F.expr(f"interval {days} days"))


def audit_top(audit: DataFrame, n: int = 10) -> DataFrame:
    """Per tenant: the total and the most frequent actions and resources."""
    fine = audit.groupBy("tenant_id", "action", "resource_type").agg(F.count(F.lit(1)).alias("count"))

    def level(column: str, kind: str) -> DataFrame:
        counts = fine.groupBy("tenant_id", F.col(column).alias("label")).agg(F.sum("count").alias("count"))
        ranked = groups.top(counts, ["tenant_id"], [F.desc("count"), F.asc("label")], n)
        return ranked.select("tenant_id", F.lit(kind).alias("kind"), "label", "count", "rank")

    totals = fine.groupBy("tenant_id").agg(F.sum("count").alias("count")).select(
        "tenant_id", F.lit("total").alias("kind"), F.lit(None).cast("string").alias("label"), "count",
        F.lit(1).alias("rank"),
    )
    return totals.unionByName(level("action", "action")).unionByName(level("resource_type", "resource"))


def latency_histogram(request: DataFrame) -> DataFrame:
    """Cumulative bucket counts, count and sum per (method, route, status)."""
    keys = ["method", "route", "status_code"]
    value = F.col("duration_seconds")
    counts = [F.count_if(value <= edge).alias(f"le_{i}") for i, edge in enumerate(LATENCY_EDGES)]
    sums = request.groupBy(*keys).agg(
        *counts, F.count(F.lit(1)).alias("observations"), F.sum(value).alias("seconds")
    )
    buckets = [
        F.struct(F.lit(f"{edge:g}").alias("le"), F.col(f"le_{i}").alias("bucket_count"))
        for i, edge in enumerate(LATENCY_EDGES)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket_count"))]
    return sums.select(
        *keys, "observations", F.round("seconds", 6).alias("seconds"), F.explode(F.array(*buckets)).alias("b")
    ).select(*keys, "b.le", "b.bucket_count", "observations", "seconds")


def unread_notifications(notification: DataFrame, per_user: int = 50) -> DataFrame:
    rows = notification.where(F.col("read_at").isNull())
    return groups.top(rows, ["user_id"], [F.desc("created_at"), F.desc("id")], per_user)


# --- documents, models ----------------------------------------------------------------------


def keyset_page(
    document: DataFrame, limit: int, cursor: tuple[str, int] | None = None, kind: str | None = None,
    search: str | None = None, created_from: str | None = None, created_to: str | None = None,
) -> DataFrame:
    rows = document.where(F.col("deleted_at").isNull())
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if search:
        needle = F.lit(search.lower())
        rows = rows.where(F.contains(F.lower("original_name"), needle) | F.contains(F.lower("safe_name"), needle))
    if created_from:
        rows = rows.where(F.col("created_at") >= instant(created_from))
    if created_to:
        rows = rows.where(F.col("created_at") <= instant(created_to))
    if cursor:
        at, row_id = instant(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < row_id)))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)


def lexical_search(fields: DataFrame, queries: dict[str, str], n: int = 10) -> DataFrame:
    """Top documents per query: 10 points per distinct matched term plus the
    field weight per term hit in a field; newest first among equals.

    ``fields`` holds (document_id, created_at, label, value, weight). All
    queries are scored in the same scan of each field text; a document's rows
    then meet in one small aggregate."""
    terms = {q: sorted(set(text.split()), key=text.split().index) for q, text in queries.items()}
    wanted = F.array(*[
        F.struct(F.lit(q).alias("query"), F.array(*[F.lit(w) for w in words]).alias("terms"))
        for q, words in terms.items()
    ])
    folded = fold(F.col("value"))
    scored = (
        fields.withColumn("folded", folded)
        .withColumn("q", F.explode(wanted))
        .withColumn("hits", F.filter("q.terms", lambda w: F.contains("folded", w)))
        .where(F.size("hits") > 0)
    )
    found = scored.groupBy(F.col("q.query").alias("query"), "document_id").agg(
        F.max("created_at").alias("created_at"),
        F.sum(F.col("weight") * F.size("hits")).alias("weighted"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("terms_matched"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("sources"),
    )
    score = F.round(F.col("weighted") + F.col("terms_matched") * 10, 2)
    ranked = groups.top(
        found.withColumn("score", score), ["query"],
        [F.desc("score"), F.desc("created_at"), F.asc("document_id")], n,
    )
    return ranked.select("query", "rank", "document_id", "score", "terms_matched", "sources")


def search_snippets(fields: DataFrame, results: DataFrame, queries: dict[str, str]) -> DataFrame:
    """Up to three snippets around the first term, only for documents in the results."""
    first = F.create_map(*[F.lit(x) for q, text in queries.items() for x in (q, text.split()[0])])
    size = F.create_map(*[x for q, text in queries.items() for x in (F.lit(q), F.lit(len(text)))])
    hit = fields.join(results.select("query", "document_id"), "document_id")
    at = F.call_function("locate", first[F.col("query")], fold(F.col("value")))
    start = F.greatest(F.lit(1), at - 60)
    stop = F.least(F.length("value"), at - 1 + size[F.col("query")] + 100)
    snippet = F.trim(F.regexp_replace(F.substring("value", start, stop - start + 1), r"\s+", " "))
    rows = hit.where(at > 0).withColumn("snippet", snippet).where(F.col("snippet") != "")
    return rows.groupBy("query", "document_id").agg(
        F.slice(F.array_sort(F.collect_set("snippet")), 1, 3).alias("snippets")
    )


def json_value(document: Column, path: str, kind: str) -> Column:
    """Value at ``path`` only when it has the JSON type ``kind``."""
    found = F.try_variant_get(document, path, "variant")
    types = {"string": r"^STRING$", "boolean": r"^BOOLEAN$", "double": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"}
    return F.when(F.schema_of_variant(found).rlike(types[kind]), F.try_variant_get(document, path, kind))


def promotable_models(version: DataFrame) -> DataFrame:
    """First blocking code of each custom model version, null when it may be promoted."""
    v = F.col("v")
    profile = F.coalesce(json_value(v, "$.training_profile", "string"), json_value(v, "$.profile", "string"))
    nested = "$.engines.CUSTOM_CRNN."
    status = F.coalesce(
        json_value(v, "$.realFixtureBenchmarkStatus", "string"),
        json_value(v, "$.real_fixture_benchmark_status", "string"),
        json_value(v, nested + "qualityGateStatus", "string"),
    )
    passed = F.coalesce(
        json_value(v, "$.qualityGatePassed", "boolean"), json_value(v, nested + "qualityGatePassed", "boolean")
    )
    wrong = F.coalesce(
        json_value(v, "$.highConfidenceWrongCount", "double"),
        json_value(v, nested + "highConfidenceWrongCount", "double"), F.lit(0.0),
    )
    false = F.lit(False)
    real = (
        F.coalesce(status == "passed", false)
        | F.coalesce(json_value(v, "$.validatedOnRealFixtures", "boolean"), false)
        | F.coalesce(json_value(v, "$.validated_on_real_fixtures", "boolean"), false)
    ) & F.coalesce(passed, false)
    empty = (F.coalesce("artifact_bucket", F.lit("")) == "") | (F.coalesce("artifact_key", F.lit("")) == "")
    code = (
        F.when(F.col("engine") != "CUSTOM_CRNN", F.lit(None).cast("string"))
        .when(empty, "CUSTOM_OCR_PROMOTION_ARTIFACT_REQUIRED")
        .when(F.coalesce(profile, F.lit("")).rlike("^$|smoke"), "CUSTOM_OCR_PROMOTION_SMOKE_MODEL_BLOCKED")
        .when(F.coalesce(status == "failed", false) | ~F.coalesce(passed, F.lit(True)) | (wrong > 0),
              "CUSTOM_OCR_PROMOTION_REAL_FIXTURE_GATE_FAILED")
        .when(~real, "CUSTOM_OCR_PROMOTION_REQUIRES_REAL_FIXTURE_VALIDATION")
    )
    return version.withColumn("v", F.try_parse_json("metrics")).select(
        F.col("id").alias("model_version_id"), "engine", code.alias("block_code"), code.isNull().alias("promotable")
    )


def engine_run_metrics(run: DataFrame) -> DataFrame:
    """Runs per (engine, status), and engine means that ignore missing values."""
    fine = run.groupBy("engine", "status").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("confidence").alias("c"), F.count("confidence").alias("cn"),
        F.sum("latency_ms").alias("l"), F.count("latency_ms").alias("ln"),
    )
    means = fine.groupBy("engine").agg(
        F.round(F.try_divide(F.sum("c"), F.sum("cn")), 6).alias("mean_confidence"),
        F.round(F.try_divide(F.sum("l").cast("double"), F.sum("ln")), 6).alias("mean_latency_ms"),
    )
    return fine.select("engine", "status", "count").join(means, "engine")


# --- usage, readiness, fingerprints -------------------------------------------------------------


def tenant_usage(workspace: DataFrame, document: DataFrame, expense: DataFrame, soft_limit: int) -> DataFrame:
    """Objects, bytes, spend by currency and storage quota of each tenant."""
    spaces = workspace.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("workspaces"))
    docs = document.where(F.col("deleted_at").isNull()).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("documents"), total("size_bytes").alias("bytes")
    )
    live = F.col("archived_at").isNull()
    by_currency = expense.groupBy("tenant_id", "currency").agg(
        F.count_if(live).alias("active"), F.count_if(~live).alias("archived"),
        F.sum(F.when(live, exact("amount_minor"))).alias("minor"),
    )
    money = by_currency.groupBy("tenant_id").agg(
        F.sum("active").alias("active_expenses"), F.sum("archived").alias("archived_expenses"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "currency", "minor"))), "|").alias("currency_totals"),
    )
    joined = spaces.join(docs, "tenant_id", "left").join(money, "tenant_id", "left")
    used = F.coalesce("bytes", F.lit(0).cast(EXACT))
    percent = percent_2dp(used, F.lit(soft_limit))
    return joined.select(
        "tenant_id", "workspaces", F.coalesce("documents", F.lit(0)).alias("documents"), used.alias("used_bytes"),
        (F.lit(soft_limit).cast(EXACT) - used).cast(EXACT).alias("remaining_bytes"), percent.alias("quota_percent"),
        F.when(percent >= 100, "exceeded").when(percent >= 80, "warning").otherwise("ok").alias("quota_status"),
        F.coalesce("active_expenses", F.lit(0)).alias("active_expenses"),
        F.coalesce("archived_expenses", F.lit(0)).alias("archived_expenses"),
        F.coalesce("currency_totals", F.lit("")).alias("currency_totals"),
    )


def currency_totals(expense: DataFrame) -> DataFrame:
    return expense.groupBy("workspace_id", "currency").agg(total("amount_minor").alias("total_minor"))


def table_fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free change digest of each slice, mergeable across partitions."""
    row = F.xxhash64(*columns)
    return df.groupBy(*keys).agg(
        F.bit_xor(row).alias("hash_xor"),
        F.sum(row.cast(EXACT)).cast("string").alias("hash_sum"),
        F.count(F.lit(1)).alias("rows"),
    )


def changed_slices(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Slices whose fingerprint is new or differs from the stored one."""
    return current.join(stored, [*keys, "hash_xor", "hash_sum", "rows"], "left_anti").select(*keys)


def dataset_readiness(
    user: DataFrame, document: DataFrame, expense: DataFrame, budget: DataFrame, period: DataFrame,
    workflow: DataFrame, export: DataFrame, ocr_job: DataFrame, extraction: DataFrame,
) -> DataFrame:
    """One row per data-quality check with its measured value."""

    def rows(agg: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
        items = [F.struct(F.lit(n).alias("check"), v.cast("long").alias("value"), p.alias("passed")) for n, v, p in checks]
        return agg.select(F.explode(F.array(*items)).alias("c")).select("c.*")

    def at_least(name: str, column: str, minimum: int) -> tuple[str, Column, Column]:
        return name, F.col(column), F.col(column) >= minimum

    def covers(df: DataFrame, column: str, wanted: list[str], name: str) -> DataFrame:
        seen = [F.coalesce(F.bool_or(F.col(column) == w), F.lit(False)).cast("int") for w in wanted]
        agg = df.agg(sum(seen[1:], seen[0]).alias("n"))
        return rows(agg, [(name, F.col("n"), F.col("n") == len(wanted))])

    months = expense.where(F.col("archived_at").isNull()).groupBy(F.trunc("occurred_at", "month").alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spent = groups.latest(period, ["budget_id"], "updated_at", "id").select("budget_id", "spent_minor")
    ratio = F.coalesce("spent_minor", F.lit(0)).cast("double") / F.greatest(F.lit(1), "amount_minor")
    ratios = budget.join(spent, budget["id"] == spent["budget_id"], "left").select(ratio.alias("r"))
    usage = ratios.agg(
        F.count(F.lit(1)).alias("budgets"),
        F.count_if((F.col("r") > 0) & (F.col("r") < 0.8)).alias("healthy"),
        F.count_if(F.col("r").between(0.8, 1.0)).alias("near"), F.count_if(F.col("r") > 1).alias("over"),
    )
    parts = [
        rows(user.agg(F.count_if(~F.col("disabled")).alias("n")), [at_least("users", "n", 6)]),
        rows(document.agg(F.count_if(F.col("deleted_at").isNull()).alias("n")), [at_least("documents", "n", 20)]),
        rows(months.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("m")),
             [at_least("expenses", "n", 25), at_least("expenseMonths", "m", 3)]),
        covers(expense, "status", ["DRAFT", "NEEDS_REVIEW", "APPROVED", "REJECTED", "REIMBURSED"], "expenseStates"),
        rows(usage, [at_least("budgets", "budgets", 3), at_least("budgetHealthy", "healthy", 1),
                     at_least("budgetNearLimit", "near", 1), at_least("budgetExceeded", "over", 1)]),
        covers(workflow, "state", ["PENDING", "APPROVED", "REJECTED"], "approvalStates"),
        rows(export.where(F.col("status") == "SUCCEEDED").agg(F.count_distinct("type").alias("n")),
             [at_least("reports", "n", 3)]),
        rows(ocr_job.agg(F.count(F.lit(1)).alias("n")), [at_least("ocrJobs", "n", 1)]),
        rows(extraction.agg(F.count_if(F.col("status") == "SUCCEEDED").alias("n")), [at_least("extractions", "n", 1)]),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
