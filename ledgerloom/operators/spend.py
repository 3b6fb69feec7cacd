"""Monthly spend marts over every workspace and month in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import groups
from ..functions.dates import is_weekend, month_of
from ..functions.money import EXACT, exact, percent_2dp, total, total_where, trunc_div, zero
from ..functions.text import blank_to_null


def unarchived(expense: DataFrame) -> DataFrame:
    """Rows without an archive timestamp (ledger and report rule)."""
    return expense.where(F.col("archived_at").isNull())


def active(expense: DataFrame) -> DataFrame:
    """Insight rule: no archive timestamp and no archived status either."""
    return unarchived(expense).where(F.col("status") != "ARCHIVED")


def with_month(expense: DataFrame) -> DataFrame:
    return expense.withColumn("month", month_of("occurred_at"))


def monthly_spend(expense: DataFrame) -> DataFrame:
    return (
        with_month(unarchived(expense))
        .groupBy("workspace_id", "month")
        .agg(
            F.max_by("currency", F.struct("occurred_at", "id")).alias("currency"),
            total("amount_minor").alias("total_minor"),
            total_where(F.col("business_expense"), "amount_minor").alias("business_minor"),
            total_where(F.col("reimbursable"), "amount_minor").alias("reimbursable_minor"),
            F.count(F.lit(1)).alias("expense_count"),
        )
    )


def daily_spend(expense: DataFrame) -> DataFrame:
    """Workspace-day totals: the one shuffle of the ledger that the weekly,
    monthly, trend and forecast marts share."""
    return (
        active(expense)
        .groupBy("workspace_id", F.col("occurred_at").cast("date").alias("day"))
        .agg(
            total("amount_minor").alias("total_minor"),
            total_where(F.col("business_expense"), "amount_minor").alias("business_minor"),
            total_where(F.col("reimbursable"), "amount_minor").alias("reimbursable_minor"),
            F.count(F.lit(1)).alias("expense_count"),
            F.count_if("reimbursable").alias("reimbursable_count"),
            F.count_if("business_expense").alias("business_count"),
            F.min(F.when(F.col("business_expense"), F.col("occurred_at"))).alias("first_business_at"),
        )
    )


def month_grid(daily: DataFrame) -> DataFrame:
    """Every month between the first and the last of a workspace."""
    span = daily.groupBy("workspace_id").agg(
        month_of(F.min("day")).alias("first"), month_of(F.max("day")).alias("last")
    )
    months = F.sequence("first", "last", F.expr("interval 1 month"))
    return span.select("workspace_id", F.explode(months).alias("month"))


def month_totals(daily: DataFrame) -> DataFrame:
    """Dense workspace-month totals; empty months carry zeros."""
    weekend = is_weekend("day")
    sums = daily.groupBy("workspace_id", month_of("day").alias("month")).agg(
        F.sum("total_minor").cast(EXACT).alias("total_minor"),
        F.sum("business_minor").cast(EXACT).alias("business_minor"),
        F.sum("reimbursable_minor").cast(EXACT).alias("reimbursable_minor"),
        F.sum("expense_count").alias("expense_count"),
        F.sum("reimbursable_count").alias("reimbursable_count"),
        F.count(F.lit(1)).alias("observed_days"),
        F.sum(F.when(weekend, F.col("business_count")).otherwise(0)).alias("weekend_business_count"),
        F.min(F.when(weekend, F.col("first_business_at"))).alias("first_weekend_business_at"),
    )
    money = ["total_minor", "business_minor", "reimbursable_minor"]
    counts = ["expense_count", "reimbursable_count", "observed_days", "weekend_business_count"]
    return month_grid(daily).join(sums, ["workspace_id", "month"], "left").select(
        "workspace_id",
        "month",
        *[F.coalesce(F.col(c), zero()).alias(c) for c in money],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        "first_weekend_business_at",
    )


def weekly_spend(daily: DataFrame) -> DataFrame:
    """Seven-day buckets anchored at the first of the month, empty ones kept."""
    starts = F.sequence("month", F.last_day("month"), F.expr("interval 7 days"))
    weeks = month_grid(daily).select("workspace_id", "month", F.explode(starts).alias("week_start"))
    bucket = F.date_sub("day", (F.dayofmonth("day") - 1) % 7)
    sums = daily.groupBy("workspace_id", bucket.alias("week_start")).agg(
        F.sum("total_minor").cast(EXACT).alias("total_minor"), F.sum("expense_count").alias("expense_count")
    )
    next_month = F.add_months("month", 1)
    return weeks.join(sums, ["workspace_id", "week_start"], "left").select(
        "workspace_id",
        "month",
        "week_start",
        F.least(F.date_add("week_start", 7), next_month).alias("week_end"),
        F.coalesce("total_minor", zero()).alias("total_minor"),
        F.coalesce("expense_count", F.lit(0)).alias("expense_count"),
    )


def _breakdown(expense: DataFrame, label: Column, name: str) -> DataFrame:
    return (
        with_month(active(expense))
        .groupBy("workspace_id", "month", label.alias(name))
        .agg(total("amount_minor").alias("total_minor"), F.count(F.lit(1)).alias("expense_count"))
    )


def category_breakdown(expense: DataFrame) -> DataFrame:
    groups_ = _breakdown(expense, F.coalesce("category_id", F.lit("uncategorized")), "category_id")
    share = groups.attach(groups_, ["workspace_id", "month"], F.sum("total_minor").cast(EXACT).alias("__all"))
    return share.withColumn("share_percent", percent_2dp(F.col("total_minor"), F.col("__all"))).drop("__all")


def merchant_breakdown(expense: DataFrame) -> DataFrame:
    label = F.coalesce(blank_to_null(F.col("merchant_name")), blank_to_null(F.col("title")), F.lit("Unspecified"))
    return _breakdown(expense, label, "merchant")


def payment_breakdown(expense: DataFrame) -> DataFrame:
    return _breakdown(
        expense, F.coalesce(blank_to_null(F.col("payment_method_name")), F.lit("Unspecified")), "payment_method"
    )


def spend_rank(breakdown: DataFrame, label: str) -> DataFrame:
    """Rank by total descending, then label, in binary order."""
    return groups.positions(
        breakdown,
        ["workspace_id", "month"],
        [F.desc("total_minor"), F.asc(label)],
        "rank",
    )


def report_totals(expense: DataFrame, kind: str) -> DataFrame:
    """Report groups per label **and** currency; blank labels are ``unknown``."""
    if kind == "category":
        label, name = F.coalesce("category_id", F.lit("uncategorized")), "category_id"
    else:
        label, name = F.coalesce("merchant_name", "title"), "merchant"
    label = F.coalesce(blank_to_null(label), F.lit("unknown"))
    return (
        with_month(unarchived(expense))
        .groupBy("workspace_id", "month", label.alias(name), "currency")
        .agg(
            F.count(F.lit(1)).alias("expense_count"),
            total("amount_minor").alias("total_minor"),
            total("tax_minor").alias("tax_minor"),
        )
    )


def budget_match(expense: DataFrame, budget: DataFrame) -> DataFrame:
    """Budget × expense rows: same workspace and currency, and the budget's
    category when it has one. Two equi joins replace the OR condition; budgets
    without any expense stay, with a null expense. The joins are inner, so Spark may
    split a hot workspace on the expense side or broadcast the budgets; what has no
    match is found among the distinct keys of the expenses."""
    b = budget.select(
        F.col("id").alias("budget_id"), "workspace_id", "currency", F.col("category_id").alias("budget_category_id")
    )
    e = active(expense).select(
        F.col("id").alias("expense_id"), "workspace_id", "currency", "category_id", "amount_minor", "occurred_at"
    )
    columns = ["budget_id", "workspace_id", "currency", "expense_id", "amount_minor", "occurred_at"]

    def matched(budgets: DataFrame, keys: list[str]) -> DataFrame:
        lonely = budgets.join(e.select(*keys).distinct(), keys, "left_anti").select(*columns[:3], *[F.lit(None).cast(e.schema[c].dataType).alias(c) for c in columns[3:]])
        return e.join(budgets, keys).select(*columns).unionByName(lonely)

    whole = matched(b.where(F.col("budget_category_id").isNull()), ["workspace_id", "currency"])
    scoped = b.where(F.col("budget_category_id").isNotNull()).withColumn("category_id", F.col("budget_category_id"))
    return whole.unionByName(matched(scoped, ["workspace_id", "currency", "category_id"]))


def budget_spend(expense: DataFrame, budget: DataFrame) -> DataFrame:
    """Spend per budget and month. The ledger is summed to (workspace, currency,
    category, month) first, so the budget join never sees single expenses."""
    sums = (
        with_month(active(expense))
        .groupBy("workspace_id", "currency", "category_id", "month")
        .agg(total("amount_minor").alias("spent_minor"))
    )
    b = budget.select(F.col("id").alias("budget_id"), "workspace_id", "currency", "category_id")
    whole = b.where(F.col("category_id").isNull()).drop("category_id").join(sums, ["workspace_id", "currency"])
    scoped = b.where(F.col("category_id").isNotNull()).join(sums, ["workspace_id", "currency", "category_id"])
    columns = ["budget_id", "month", "spent_minor"]
    return (
        whole.select(*columns)
        .unionByName(scoped.select(*columns))
        .groupBy("budget_id", "month")
        .agg(F.sum("spent_minor").cast(EXACT).alias("spent_minor"))
    )


def budget_usage(expense: DataFrame, budget: DataFrame, months: DataFrame) -> DataFrame:
    """Utilisation of every budget in every month of its workspace."""
    grid = budget.withColumnRenamed("id", "budget_id").join(months, "workspace_id")
    usage = grid.join(budget_spend(expense, budget), ["budget_id", "month"], "left").withColumn(
        "spent_minor", F.coalesce("spent_minor", zero())
    )
    percent = percent_2dp(F.col("spent_minor"), F.col("amount_minor"))
    return usage.select(
        "budget_id",
        "workspace_id",
        "month",
        "name",
        exact("amount_minor").alias("amount_minor"),
        "spent_minor",
        percent.alias("utilization_percent"),
        (percent >= F.col("alert_percent")).alias("alert_triggered"),
        (exact("amount_minor") - F.col("spent_minor")).cast(EXACT).alias("remaining_minor"),
    )


def budget_alerts(usage: DataFrame) -> DataFrame:
    severity = (
        F.when(F.col("utilization_percent") >= 100, "over").when(F.col("alert_triggered"), "warning").otherwise("ok")
    )
    return usage.select(
        "budget_id", "workspace_id", "month", "name", severity.alias("severity"), "utilization_percent",
        "remaining_minor",
    )


def cashflow(months: DataFrame) -> DataFrame:
    return months.select(
        "workspace_id",
        "month",
        zero().alias("income_minor"),
        F.col("total_minor").alias("spend_minor"),
        (-F.col("total_minor")).alias("net_minor"),
        "business_minor",
        "reimbursable_minor",
    )


def month_trend(months: DataFrame) -> DataFrame:
    """Month against the month before, on the dense grid; a self equi join on
    the shifted month keeps this off one-task windows."""
    previous = months.select(
        "workspace_id", F.add_months("month", 1).alias("month"), F.col("total_minor").alias("previous_month_minor")
    )
    joined = months.join(previous, ["workspace_id", "month"], "left").withColumn(
        "previous_month_minor", F.coalesce("previous_month_minor", zero())
    )
    delta = (F.col("total_minor") - F.col("previous_month_minor")).cast(EXACT)
    return joined.select(
        "workspace_id",
        "month",
        F.col("total_minor").alias("current_month_minor"),
        "previous_month_minor",
        delta.alias("delta_minor"),
        F.when(F.col("previous_month_minor") != 0, percent_2dp(delta, F.col("previous_month_minor"))).alias(
            "delta_percent"
        ),
    )


def _projection(spent: Column) -> Column:
    """Divide by observed days first, then stretch to the whole month."""
    daily = trunc_div(spent, F.nullif(F.col("observed_days"), F.lit(0)))
    return (exact(F.coalesce(daily, F.lit(0))) * F.dayofmonth(F.last_day("month"))).cast(EXACT)


def budget_projection(usage: DataFrame, months: DataFrame) -> DataFrame:
    joined = usage.join(months.select("workspace_id", "month", "observed_days"), ["workspace_id", "month"])
    projected = joined.withColumn("projected_minor", _projection(F.col("spent_minor")))
    return projected.select(
        "workspace_id",
        "month",
        "budget_id",
        "name",
        percent_2dp(F.col("projected_minor"), F.col("amount_minor")).alias("projected_utilization_percent"),
        F.greatest(zero(), (F.col("projected_minor") - F.col("amount_minor")).cast(EXACT)).alias(
            "projected_overspend_minor"
        ),
    )


def largest_budget_risk(usage: DataFrame, months: DataFrame) -> DataFrame:
    """Budget with the highest projected utilisation; then overspend, then id."""
    rank = F.struct("projected_utilization_percent", "projected_overspend_minor", -F.col("budget_id"))
    fields = ["budget_id", "name", "projected_utilization_percent", "projected_overspend_minor"]
    best = F.max_by(F.struct(*fields), rank).alias("best")
    return (
        budget_projection(usage, months).groupBy("workspace_id", "month").agg(best)
        .select("workspace_id", "month", "best.*")
    )


def spend_forecast(months: DataFrame, usage: DataFrame) -> DataFrame:
    budgets = usage.groupBy("workspace_id", "month").agg(F.sum("amount_minor").cast(EXACT).alias("budget_minor"))
    trend = month_trend(months).select("workspace_id", "month", "previous_month_minor")
    daily = F.coalesce(trunc_div(F.col("total_minor"), F.nullif(F.col("observed_days"), F.lit(0))), F.lit(0))
    projected = _projection(F.col("total_minor"))
    joined = months.join(trend, ["workspace_id", "month"]).join(budgets, ["workspace_id", "month"], "left")
    has_budget = F.coalesce("budget_minor", zero()) != 0
    return joined.select(
        "workspace_id",
        "month",
        "observed_days",
        F.dayofmonth(F.last_day("month")).alias("month_days"),
        daily.alias("daily_average_minor"),
        projected.alias("projected_minor"),
        (projected - F.col("previous_month_minor")).cast(EXACT).alias("projected_delta_minor"),
        F.when(has_budget, percent_2dp(projected, F.col("budget_minor"))).alias("projected_budget_percent"),
    )


def anomaly_summary(expense: DataFrame, months: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per finding of a workspace-month, with its evidence as text."""
    keys = ["workspace_id", "month"]
    average = trunc_div(F.col("total_minor"), F.nullif(F.col("expense_count"), F.lit(0)))
    means = months.select(*keys, average.alias("average_minor")).where(
        (F.col("expense_count") > 1) & (F.col("average_minor") > 0)
    )
    high = (
        with_month(active(expense)).join(means, keys)
        .where(exact("amount_minor") >= exact("average_minor") * 2)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.concat_ws("/", F.max("average_minor"), F.max("amount_minor")).alias("evidence"),
        )
        .withColumn("code", F.lit("HIGH_AMOUNT_VS_MONTHLY_AVERAGE"))
        .withColumn("severity", F.lit("warning"))
    )
    over = (
        alerts.where(F.col("severity") == "over").groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("count"), F.max("utilization_percent").alias("peak"))
        .select(*keys, "count", F.format_string("%.2f", "peak").alias("evidence"),
                F.lit("BUDGET_OVER_UTILIZED").alias("code"), F.lit("critical").alias("severity"))
    )
    share = percent_2dp(F.col("reimbursable_minor"), F.col("total_minor"))
    concentrated = (F.col("total_minor") > 0) & (F.col("reimbursable_minor") * 100 >= F.col("total_minor") * 60)

    def finding(code: str, count: str, evidence: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit("info").alias("severity"),
                        F.col(count).cast("long").alias("count"), evidence.alias("evidence"))

    from_totals = F.filter(
        F.array(
            F.when(F.col("weekend_business_count") > 0,
                   finding("WEEKEND_BUSINESS_EXPENSE", "weekend_business_count",
                           F.date_format("first_weekend_business_at", "yyyy-MM-dd"))),
            F.when(concentrated,
                   finding("REIMBURSABLE_CONCENTRATION", "reimbursable_count", F.format_string("%.2f", share))),
        ),
        lambda f: f.isNotNull(),
    )
    simple = months.select(*keys, F.explode(from_totals).alias("f")).select(*keys, "f.*")
    columns = [*keys, "code", "severity", "count", "evidence"]
    return simple.select(*columns).unionByName(high.select(*columns)).unionByName(over.select(*columns))


def recommendations(
    months: DataFrame, budget: DataFrame, forecast: DataFrame, risk: DataFrame, anomalies: DataFrame
) -> DataFrame:
    """At most four advice rows per workspace-month, in rule order."""
    keys = ["workspace_id", "month"]
    critical = anomalies.groupBy(*keys).agg(F.bool_or(F.col("severity") == "critical").alias("critical"))
    budgets = budget.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("budgets"))
    state = (
        months.join(forecast.drop("observed_days"), keys)
        .join(risk.drop("name", "budget_id", "projected_utilization_percent"), keys, "left")
        .join(critical, keys, "left")
        .join(budgets, "workspace_id", "left")
    )

    def advice(code: str, severity: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), severity.alias("severity"))

    over = (F.coalesce("projected_budget_percent", F.lit(0.0)) >= 100) | (
        F.coalesce("projected_overspend_minor", zero()) > 0
    )
    rising = (F.col("projected_delta_minor") > 0) & (F.col("observed_days") > 0)
    run_rate = F.when(F.coalesce("critical", F.lit(False)), "warning").otherwise("info")
    rules = F.array(
        F.when(F.coalesce("budgets", F.lit(0)) == 0, advice("NO_BUDGET", F.lit("info"))),
        F.when(over, advice("PROJECTED_OVER_BUDGET", F.lit("critical"))),
        F.when(rising, advice("HIGH_RUN_RATE", run_rate)),
        F.when(F.col("reimbursable_minor") > 0, advice("REIMBURSABLE_FOLLOW_UP", F.lit("info"))),
    )
    hits = F.slice(F.filter(rules, lambda r: r.isNotNull()), 1, 4)
    return state.select(*keys, F.posexplode(hits).alias("pos", "r")).select(
        *keys, (F.col("pos") + 1).alias("position"), "r.*"
    )


def finance_insights(expense: DataFrame, budget: DataFrame) -> DataFrame:
    """The dashboard row of every workspace-month."""
    keys = ["workspace_id", "month"]
    months = month_totals(daily_spend(expense))
    usage = budget_usage(expense, budget, months.select(*keys))
    over = budget_alerts(usage).groupBy(*keys).agg(F.count_if(F.col("severity") == "over").alias("budgets_over"))
    forecast = spend_forecast(months, usage)
    flow = cashflow(months).drop("income_minor")
    trend = month_trend(months).select(*keys, "previous_month_minor", "delta_minor", "delta_percent")
    return (
        flow.join(trend, keys).join(forecast, keys).join(over, keys, "left")
        .withColumn("budgets_over", F.coalesce("budgets_over", F.lit(0)))
    )
