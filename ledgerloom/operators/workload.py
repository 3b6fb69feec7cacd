"""Review workload: who may review, who carries what, what to move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups
from ..functions.dates import minutes_between
from .lifecycle import instant

# Permissions and the roles that carry them.
PERMISSIONS = (
    "tenant.manage", "users.manage", "workspace.manage", "documents.upload", "documents.read", "documents.delete",
    "ocr.run", "ocr.review", "annotations.manage", "expenses.create", "expenses.read", "expenses.update",
    "expenses.approve", "budgets.manage", "reports.export", "ai.use", "ai.manage", "models.train", "models.promote",
    "admin.health.read", "admin.events.read", "admin.events.publish", "admin.jobs.read", "admin.jobs.manage",
    "admin.cache.read", "admin.cache.manage", "admin.audit.read", "admin.audit.manage", "api_keys.manage",
    "webhooks.manage",
)
ROLE_PERMISSIONS = {
    "OWNER": PERMISSIONS,
    "ADMIN": tuple(p for p in PERMISSIONS if p != "tenant.manage"),
    "FINANCE_MANAGER": (
        "documents.read", "ocr.review", "expenses.create", "expenses.read", "expenses.update", "expenses.approve",
        "budgets.manage", "reports.export", "ai.use",
    ),
    "ACCOUNTANT": ("documents.read", "expenses.read", "reports.export", "admin.audit.read"),
    "EMPLOYEE": ("documents.upload", "documents.read", "ocr.run", "expenses.create", "expenses.read"),
    "REVIEWER": (
        "documents.read", "ocr.review", "annotations.manage", "expenses.read", "expenses.update", "ai.use",
    ),
    "ML_ENGINEER": (
        "documents.read", "ocr.run", "annotations.manage", "ai.use", "ai.manage", "models.train", "models.promote",
        "admin.health.read", "admin.events.read", "admin.jobs.read", "admin.jobs.manage", "admin.cache.read",
    ),
    "AUDITOR": ("documents.read", "expenses.read", "reports.export", "admin.audit.read"),
    "VIEWER": ("documents.read", "expenses.read"),
}
OPEN = ("QUEUED", "RUNNING")


def eligible_reviewers(user: DataFrame, user_role: DataFrame, permission: str = "ocr.review") -> DataFrame:
    """Enabled users with a role that carries the permission."""
    carriers = [role for role, granted in ROLE_PERMISSIONS.items() if permission in granted]
    holders = user_role.where(F.col("role").isin(carriers)).select(F.col("user_id").alias("id"))
    return user.where(~F.col("disabled")).join(holders, "id", "left_semi").select("id", "tenant_id", "display_name")


def _task_facts(task: DataFrame, as_of: str) -> DataFrame:
    now = instant(as_of)
    opened = F.col("status").isin(*OPEN)
    due_in = minutes_between(F.col("due_at"), now)
    late_by = minutes_between(now, F.col("due_at"))
    overdue = F.coalesce(F.col("due_at") < now, F.lit(False))
    soon = F.coalesce((F.col("due_at") >= now) & (F.col("due_at") <= now + F.expr("interval 24 hours")), F.lit(False))
    age = F.greatest(F.lit(0), minutes_between(now, F.col("created_at")))
    pressure = (
        F.when(F.col("due_at").isNull(), age)
        .when(overdue, age + late_by + 1440)
        .otherwise(age + F.greatest(F.lit(0), 1440 - due_in))
    )
    return task.select(
        "id", "tenant_id", "status", "assigned_to", opened.alias("open"), (opened & overdue).alias("overdue"),
        (opened & soon).alias("due_soon"), age.alias("age_minutes"), pressure.alias("pressure"),
        F.when(overdue, late_by).alias("overdue_minutes"),
        F.when(F.col("due_at").isNotNull(), due_in).alias("due_in_minutes"),
    )


def _load(facts: DataFrame, *keys: str) -> DataFrame:
    count = lambda cond: F.count_if(cond)
    return facts.groupBy(*keys).agg(
        count(F.col("status") == "QUEUED").alias("queued"),
        count(F.col("status") == "RUNNING").alias("running"),
        count(F.col("status") == "SUCCEEDED").alias("completed"),
        count(F.col("status") == "FAILED").alias("rejected"),
        count(F.col("overdue")).alias("overdue"),
        count(F.col("due_soon")).alias("due_soon"),
        F.max(F.when(F.col("open"), F.col("age_minutes"))).alias("oldest_open_minutes"),
    )


SCORE = "queued + running + overdue * 2 + due_soon"
COUNTS = ("queued", "running", "completed", "rejected", "overdue", "due_soon")


def reviewer_workload(reviewer: DataFrame, task: DataFrame, as_of: str) -> DataFrame:
    """A row per reviewer, one for unassigned tasks and one with the totals, per
    tenant. Tasks of people who may not review are left out."""
    load = _load(_task_facts(task, as_of), "tenant_id", "assigned_to")
    people = reviewer.join(
        load.withColumnRenamed("assigned_to", "id").where(F.col("id").isNotNull()), ["tenant_id", "id"], "left"
    ).select(
        "tenant_id", F.lit("reviewer").alias("row_type"), F.col("id").alias("reviewer_id"), "display_name",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], "oldest_open_minutes",
    )
    nobody = load.where(F.col("assigned_to").isNull()).select(
        "tenant_id", F.lit("unassigned").alias("row_type"), F.lit(None).cast("long").alias("reviewer_id"),
        F.lit(None).cast("string").alias("display_name"), "queued", "running",
        F.lit(0).cast("long").alias("completed"), F.lit(0).cast("long").alias("rejected"), "overdue", "due_soon",
        "oldest_open_minutes",
    )
    rows = people.unionByName(nobody)
    totals = rows.groupBy("tenant_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.max("oldest_open_minutes").alias("oldest_open_minutes")
    ).withColumns({
        "row_type": F.lit("total"), "reviewer_id": F.lit(None).cast("long"),
        "display_name": F.lit(None).cast("string"),
    })
    return rows.unionByName(totals).withColumn("workload_score", F.expr(SCORE))


def rebalance_suggestions(reviewer: DataFrame, task: DataFrame, as_of: str, n: int = 8) -> DataFrame:
    """Assign urgent unowned tasks to the least loaded reviewer and move the
    most pressing task away from overloaded ones; the first ``n`` per tenant."""
    facts = _task_facts(task, as_of)
    people = reviewer_workload(reviewer, task, as_of).where(F.col("row_type") == "reviewer").select(
        "tenant_id", F.col("reviewer_id").alias("id"), "display_name", F.col("workload_score").alias("score")
    )
    lightest = groups.top(people, ["tenant_id"], [F.asc("score"), F.asc("display_name"), F.asc("id")], 2)
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    spare = lightest.groupBy("tenant_id").agg(
        pick(1, "id").alias("first_id"), pick(1, "score").alias("first_score"),
        pick(2, "id").alias("second_id"), pick(2, "score").alias("second_score"),
    )
    urgent = facts.where(F.col("assigned_to").isNull() & (F.col("overdue") | F.col("due_soon")))
    assign = urgent.join(spare, "tenant_id").select(
        "tenant_id", F.lit("ASSIGN").alias("action"),
        F.when(F.col("overdue"), "SLA_OVERDUE_UNASSIGNED").otherwise("SLA_DUE_SOON_UNASSIGNED").alias("reason_code"),
        F.when(F.col("overdue"), 1000 + F.col("overdue_minutes"))
        .otherwise(700 - F.least(F.col("due_in_minutes"), F.lit(700))).alias("priority"),
        F.col("id").alias("task_id"), F.lit(None).cast("long").alias("current_assignee"),
        F.col("first_id").alias("target_reviewer"), "age_minutes",
    )
    busiest = (
        facts.where("open").groupBy("tenant_id", "assigned_to")
        .agg(F.max_by(F.struct("id", "pressure", "age_minutes"), F.struct("pressure", -F.col("id"))).alias("t"))
    )
    own = F.col("source_id") == F.col("first_id")
    moved = (
        people.withColumnRenamed("id", "source_id").join(spare, "tenant_id")
        .withColumn("target_id", F.when(own, F.col("second_id")).otherwise(F.col("first_id")))
        .withColumn("target_score", F.when(own, F.col("second_score")).otherwise(F.col("first_score")))
        .withColumn("gap", F.col("score") - F.col("target_score"))
        .where(F.col("gap") >= 3)
        .join(busiest.withColumnRenamed("assigned_to", "source_id"), ["tenant_id", "source_id"])
    )
    reassign = moved.select(
        "tenant_id", F.lit("REASSIGN").alias("action"), F.lit("OVERLOADED_REVIEWER").alias("reason_code"),
        (500 + F.col("gap") + F.col("t.pressure")).alias("priority"), F.col("t.id").alias("task_id"),
        F.col("source_id").alias("current_assignee"), F.col("target_id").alias("target_reviewer"), "t.age_minutes",
    )
    order = [F.desc("priority"), F.desc("age_minutes"), F.asc("task_id")]
    return groups.top(assign.unionByName(reassign), ["tenant_id"], order, n)


def escalation_plan(suggestions: DataFrame, task: DataFrame, max_actions: int = 8) -> DataFrame:
    """Tasks an escalation run changes, with merged reason codes and new owner."""
    limit = max(1, min(max_actions, 25))
    planned = suggestions.where(F.col("rank") <= limit)
    reasons = F.array_distinct(
        F.concat("reason_codes", F.array(F.lit("SLA_ESCALATED"), F.col("reason_code")))
    )
    return planned.join(task.select(F.col("id").alias("task_id"), "reason_codes"), "task_id").select(
        "tenant_id", "rank", "task_id", "target_reviewer", reasons.alias("reason_codes")
    )


def review_metrics(task: DataFrame, corrections: DataFrame, annotations: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Counts per review table and corrections per finished task, as metric rows."""
    from .operations import TASK_STATES

    counts = task.groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("value"))
    grid = groups.literal_rows(task.sparkSession, "status", TASK_STATES)
    states = grid.join(counts, "status", "left").select(
        F.concat(F.lit("tasks_"), F.lower("status")).alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value")
    )

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    sizes = size(corrections, "corrections").unionByName(size(annotations, "annotations")).unionByName(
        size(suggestions, "suggestions")
    )
    done = task.agg(F.count_if(F.col("status") == "SUCCEEDED").alias("n")).select(
        F.lit("done").alias("metric"), F.col("n").cast("double").alias("value")
    )
    made = F.max(F.when(F.col("metric") == "corrections", F.col("value")))
    finished = F.nullif(F.max(F.when(F.col("metric") == "done", F.col("value"))), F.lit(0.0))
    rate = sizes.unionByName(done).agg(F.round(F.coalesce(made / finished, F.lit(0.0)), 6).alias("value")).select(
        F.lit("correction_rate").alias("metric"), "value"
    )
    return states.unionByName(sizes).unionByName(rate)
