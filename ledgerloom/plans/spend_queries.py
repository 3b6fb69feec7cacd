"""Spend marts: registered queries and their SQL."""

from __future__ import annotations

from ..operators import spend
from .bindings import with_bindings
from .registry import query

ACTIVE = "active AS (SELECT *, CAST(date_trunc('month', occurred_at) AS DATE) AS month FROM expense WHERE archived_at IS NULL AND status <> 'ARCHIVED')"
UNARCHIVED = "live AS (SELECT *, CAST(date_trunc('month', occurred_at) AS DATE) AS month FROM expense WHERE archived_at IS NULL)"
GRID = """grid AS (SELECT workspace_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM active GROUP BY workspace_id)"""
MONTHS = """months AS (SELECT g.workspace_id, g.month, coalesce(sum(amount_minor), 0) AS total_minor,
    coalesce(sum(amount_minor) FILTER (WHERE business_expense), 0) AS business_minor,
    coalesce(sum(amount_minor) FILTER (WHERE reimbursable), 0) AS reimbursable_minor,
    count(a.id) AS expense_count, count(a.id) FILTER (WHERE reimbursable) AS reimbursable_count,
    count(DISTINCT CAST(occurred_at AS DATE)) AS observed_days,
    count(a.id) FILTER (WHERE business_expense AND dayofweek(occurred_at) IN (0, 6)) AS weekend_business_count,
    min(occurred_at) FILTER (WHERE business_expense AND dayofweek(occurred_at) IN (0, 6)) AS first_weekend_business_at,
    dayofmonth(last_day(g.month)) AS month_days
  FROM grid g LEFT JOIN active a ON a.workspace_id = g.workspace_id AND a.month = g.month GROUP BY g.workspace_id, g.month)"""
USAGE = """spent AS (SELECT b.id AS budget_id, b.workspace_id, g.month, b.name, b.amount_minor, b.alert_percent,
    coalesce(sum(a.amount_minor), 0) AS spent_minor
  FROM budget b JOIN grid g ON g.workspace_id = b.workspace_id
  LEFT JOIN active a ON a.workspace_id = b.workspace_id AND a.month = g.month AND a.currency = b.currency
    AND (b.category_id IS NULL OR a.category_id = b.category_id) GROUP BY ALL),
 usage AS (SELECT *, CASE WHEN amount_minor = 0 THEN 0.0 ELSE CAST((spent_minor * 10000) // amount_minor AS DOUBLE) / 100 END
    AS utilization_percent, amount_minor - spent_minor AS remaining_minor FROM spent),
 alerts AS (SELECT budget_id, workspace_id, month, name, CASE WHEN utilization_percent >= 100 THEN 'over'
    WHEN utilization_percent >= alert_percent THEN 'warning' ELSE 'ok' END AS severity, utilization_percent,
    remaining_minor FROM usage)"""
RISK = """projection AS (SELECT u.*, CASE WHEN observed_days = 0 THEN 0 ELSE (spent_minor // observed_days) * month_days END
    AS projected FROM usage u JOIN months m ON m.workspace_id = u.workspace_id AND m.month = u.month),
 risk AS (SELECT workspace_id, month, budget_id, name,
    CASE WHEN amount_minor = 0 THEN 0.0 ELSE CAST((projected * 10000) // amount_minor AS DOUBLE) / 100 END
      AS projected_utilization_percent,
    CASE WHEN projected > amount_minor THEN projected - amount_minor ELSE 0 END AS projected_overspend_minor
  FROM projection
  QUALIFY row_number() OVER (PARTITION BY workspace_id, month ORDER BY projected_utilization_percent DESC,
    projected_overspend_minor DESC, budget_id) = 1)"""
TREND = """trend AS (SELECT workspace_id, month, total_minor AS current_month_minor,
    coalesce(lag(total_minor) OVER w, 0) AS previous_month_minor FROM months WINDOW w AS (PARTITION BY workspace_id ORDER BY month))"""
FORECAST = """budget_total AS (SELECT workspace_id, sum(amount_minor) AS budget_minor FROM budget GROUP BY workspace_id),
 projected AS (SELECT m.*, t.previous_month_minor, coalesce(b.budget_minor, 0) AS budget_minor,
    CASE WHEN observed_days = 0 THEN 0 ELSE total_minor // observed_days END AS daily_average_minor
  FROM months m JOIN trend t ON t.workspace_id = m.workspace_id AND t.month = m.month
  LEFT JOIN budget_total b ON b.workspace_id = m.workspace_id),
 forecast AS (SELECT workspace_id, month, observed_days, month_days, daily_average_minor,
    daily_average_minor * month_days AS projected_minor,
    daily_average_minor * month_days - previous_month_minor AS projected_delta_minor,
    CASE WHEN budget_minor = 0 THEN NULL
      ELSE CAST((daily_average_minor * month_days * 10000) // budget_minor AS DOUBLE) / 100 END AS projected_budget_percent
  FROM projected)"""
ANOMALIES = """high AS (SELECT a.workspace_id, a.month, count(*) AS n, CAST(max(m.total_minor // m.expense_count) AS VARCHAR) || '/' ||
    CAST(max(a.amount_minor) AS VARCHAR) AS evidence
  FROM active a JOIN months m ON m.workspace_id = a.workspace_id AND m.month = a.month
  WHERE m.expense_count > 1 AND m.total_minor // m.expense_count > 0 AND a.amount_minor >= 2 * (m.total_minor // m.expense_count)
  GROUP BY ALL),
 anomalies AS (
  SELECT workspace_id, month, 'HIGH_AMOUNT_VS_MONTHLY_AVERAGE' AS code, 'warning' AS severity, n AS count, evidence FROM high
  UNION ALL SELECT workspace_id, month, 'WEEKEND_BUSINESS_EXPENSE', 'info', weekend_business_count,
    strftime(first_weekend_business_at, '%Y-%m-%d') FROM months WHERE weekend_business_count > 0
  UNION ALL SELECT workspace_id, month, 'BUDGET_OVER_UTILIZED', 'critical', count(*), format('{:.2f}', max(utilization_percent))
    FROM alerts WHERE severity = 'over' GROUP BY workspace_id, month
  UNION ALL SELECT workspace_id, month, 'REIMBURSABLE_CONCENTRATION', 'info', reimbursable_count,
    format('{:.2f}', CAST((reimbursable_minor * 10000) // total_minor AS DOUBLE) / 100) FROM months
    WHERE total_minor > 0 AND reimbursable_minor * 100 >= total_minor * 60)"""
BASE_CTES = (ACTIVE, GRID, MONTHS)


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


@query("monthly_spend", with_bindings(
    """SELECT workspace_id, month, arg_max(currency, (occurred_at, id)) AS currency, CAST(sum(amount_minor) AS BIGINT) AS total_minor,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE business_expense), 0) AS BIGINT) AS business_minor,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE reimbursable), 0) AS BIGINT) AS reimbursable_minor,
    count(*) AS expense_count FROM live GROUP BY workspace_id, month""", UNARCHIVED))
def _(t):
    return spend.monthly_spend(t.expense)


@query("weekly_spend", with_bindings(
    f"""SELECT workspace_id, month, week_start, CAST(least(week_start + 7, month + INTERVAL 1 MONTH) AS DATE) AS week_end,
    CAST((SELECT coalesce(sum(amount_minor), 0) FROM active a WHERE a.workspace_id = w.workspace_id AND occurred_at >= week_start
      AND occurred_at < least(w.week_start + 7, w.month + INTERVAL 1 MONTH)) AS BIGINT) AS total_minor,
    (SELECT count(*) FROM active a WHERE a.workspace_id = w.workspace_id AND occurred_at >= week_start
      AND occurred_at < least(w.week_start + 7, w.month + INTERVAL 1 MONTH)) AS expense_count
    FROM (SELECT workspace_id, month, CAST(unnest(generate_series(month, last_day(month), INTERVAL 7 DAY)) AS DATE) AS week_start FROM grid) w""",
    ACTIVE, GRID))
def _(t):
    return spend.weekly_spend(spend.daily_spend(t.expense))


@query("category_breakdown", with_bindings(
    """SELECT workspace_id, month, coalesce(category_id, 'uncategorized') AS category_id,
    CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS expense_count,
    CASE WHEN sum(sum(amount_minor)) OVER w = 0 THEN 0.0
      ELSE CAST((sum(amount_minor) * 10000) // sum(sum(amount_minor)) OVER w AS DOUBLE) / 100 END AS share_percent
    FROM active GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY workspace_id, month)""", ACTIVE))
def _(t):
    return spend.category_breakdown(t.expense)


MERCHANT = """merchants AS (SELECT workspace_id, month,
    coalesce(nullif(trim(merchant_name), ''), nullif(trim(title), ''), 'Unspecified') AS merchant,
    CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS expense_count FROM active GROUP BY 1, 2, 3)"""


@query("merchant_breakdown", with_bindings("SELECT * FROM merchants", ACTIVE, MERCHANT))
def _(t):
    return spend.merchant_breakdown(t.expense)


@query("payment_breakdown", with_bindings(
    """SELECT workspace_id, month, coalesce(nullif(trim(payment_method_name), ''), 'Unspecified') AS payment_method,
    CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS expense_count FROM active GROUP BY 1, 2, 3""", ACTIVE))
def _(t):
    return spend.payment_breakdown(t.expense)


@query("spend_rank", with_bindings(
    """SELECT *, row_number() OVER (PARTITION BY workspace_id, month ORDER BY total_minor DESC, merchant) AS rank
    FROM merchants""", ACTIVE, MERCHANT))
def _(t):
    return spend.spend_rank(spend.merchant_breakdown(t.expense), "merchant")


@query("report_category_totals", with_bindings(
    """SELECT workspace_id, month, coalesce(category_id, 'uncategorized') AS category_id, currency, count(*) AS expense_count,
    CAST(sum(amount_minor) AS BIGINT) AS total_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor FROM live GROUP BY 1, 2, 3, 4""",
    UNARCHIVED))
def _(t):
    return spend.report_totals(t.expense, "category")


@query("report_merchant_totals", with_bindings(
    """SELECT workspace_id, month, coalesce(nullif(trim(coalesce(merchant_name, title)), ''), 'unknown') AS merchant, currency,
    count(*) AS expense_count, CAST(sum(amount_minor) AS BIGINT) AS total_minor, CAST(sum(tax_minor) AS BIGINT) AS tax_minor
    FROM live GROUP BY 1, 2, 3, 4""", UNARCHIVED))
def _(t):
    return spend.report_totals(t.expense, "merchant")


@query("budget_match", with_bindings(
    """SELECT b.id AS budget_id, b.workspace_id, b.currency, a.id AS expense_id, a.amount_minor, a.occurred_at
    FROM budget b LEFT JOIN active a ON a.workspace_id = b.workspace_id AND a.currency = b.currency
      AND (b.category_id IS NULL OR a.category_id = b.category_id)""", ACTIVE))
def _(t):
    return spend.budget_match(t.expense, t.budget)


def _months(t):
    return spend.month_totals(spend.daily_spend(t.expense))


def _usage(t, months):
    return spend.budget_usage(t.expense, t.budget, months.select("workspace_id", "month"))


@query("budget_usage", with_bindings(
    f"""SELECT budget_id, workspace_id, month, name, {big('amount_minor', 'spent_minor', 'remaining_minor')}, utilization_percent,
    utilization_percent >= alert_percent AS alert_triggered FROM usage""", ACTIVE, GRID, USAGE))
def _(t):
    return _usage(t, spend.month_grid(spend.daily_spend(t.expense)))


@query("budget_alerts", with_bindings(
    f"SELECT * EXCLUDE (remaining_minor), {big('remaining_minor')} FROM alerts", ACTIVE, GRID, USAGE))
def _(t):
    return spend.budget_alerts(_usage(t, spend.month_grid(spend.daily_spend(t.expense))))


@query("cashflow", with_bindings(
    """SELECT workspace_id, month, CAST(0 AS BIGINT) AS income_minor, CAST(total_minor AS BIGINT) AS spend_minor,
    CAST(-total_minor AS BIGINT) AS net_minor, CAST(business_minor AS BIGINT) AS business_minor,
    CAST(reimbursable_minor AS BIGINT) AS reimbursable_minor FROM months""", *BASE_CTES))
def _(t):
    return spend.cashflow(_months(t))


@query("month_trend", with_bindings(
    f"""SELECT workspace_id, month, {big('current_month_minor', 'previous_month_minor')},
    CAST(current_month_minor - previous_month_minor AS BIGINT) AS delta_minor,
    CASE WHEN previous_month_minor = 0 THEN NULL
      ELSE CAST(((current_month_minor - previous_month_minor) * 10000) // previous_month_minor AS DOUBLE) / 100 END AS delta_percent
    FROM trend""", *BASE_CTES, TREND))
def _(t):
    return spend.month_trend(_months(t))


@query("spend_forecast", with_bindings(
    f"""SELECT workspace_id, month, observed_days, CAST(month_days AS INTEGER) AS month_days,
    {big('daily_average_minor', 'projected_minor', 'projected_delta_minor')}, projected_budget_percent FROM forecast""",
    *BASE_CTES, TREND, FORECAST))
def _(t):
    months = _months(t)
    return spend.spend_forecast(months, _usage(t, months))


@query("largest_budget_risk", with_bindings(
    f"""SELECT workspace_id, month, budget_id, name, projected_utilization_percent, {big('projected_overspend_minor')} FROM risk""",
    *BASE_CTES, USAGE, RISK))
def _(t):
    months = _months(t)
    return spend.largest_budget_risk(_usage(t, months), months)


@query("anomaly_summary", with_bindings("SELECT * FROM anomalies", *BASE_CTES, USAGE, ANOMALIES))
def _(t):
    months = _months(t)
    return spend.anomaly_summary(t.expense, months, spend.budget_alerts(_usage(t, months)))


@query("recommendations", with_bindings(
    """SELECT workspace_id, month, CAST(row_number() OVER (PARTITION BY workspace_id, month ORDER BY rule) AS INTEGER) AS position,
    code, severity FROM (
      SELECT m.workspace_id, m.month, 1 AS rule, 'NO_BUDGET' AS code, 'info' AS severity FROM months m
        WHERE m.workspace_id NOT IN (SELECT workspace_id FROM budget)
      UNION ALL SELECT f.workspace_id, f.month, 2, 'PROJECTED_OVER_BUDGET', 'critical' FROM forecast f
        LEFT JOIN risk r ON r.workspace_id = f.workspace_id AND r.month = f.month
        WHERE coalesce(projected_budget_percent, 0) >= 100 OR coalesce(projected_overspend_minor, 0) > 0
      UNION ALL SELECT f.workspace_id, f.month, 3, 'HIGH_RUN_RATE', CASE WHEN EXISTS (SELECT 1 FROM anomalies x
          WHERE x.workspace_id = f.workspace_id AND x.month = f.month AND x.severity = 'critical') THEN 'warning' ELSE 'info' END
        FROM forecast f WHERE projected_delta_minor > 0 AND observed_days > 0
      UNION ALL SELECT workspace_id, month, 4, 'REIMBURSABLE_FOLLOW_UP', 'info' FROM months WHERE reimbursable_minor > 0) rules
    QUALIFY row_number() OVER (PARTITION BY workspace_id, month ORDER BY rule) <= 4""",
    *BASE_CTES, USAGE, RISK, TREND, FORECAST, ANOMALIES))
def _(t):
    months = _months(t)
    usage = _usage(t, months)
    anomalies = spend.anomaly_summary(t.expense, months, spend.budget_alerts(usage))
    return spend.recommendations(
        months, t.budget, spend.spend_forecast(months, usage), spend.largest_budget_risk(usage, months), anomalies
    )


@query("finance_insights", with_bindings(
    f"""SELECT m.workspace_id, m.month, CAST(total_minor AS BIGINT) AS spend_minor, CAST(-total_minor AS BIGINT) AS net_minor,
    {big('business_minor', 'reimbursable_minor', 'previous_month_minor')},
    CAST(total_minor - previous_month_minor AS BIGINT) AS delta_minor,
    CASE WHEN previous_month_minor = 0 THEN NULL
      ELSE CAST(((total_minor - previous_month_minor) * 10000) // previous_month_minor AS DOUBLE) / 100 END AS delta_percent,
    f.observed_days, CAST(f.month_days AS INTEGER) AS month_days,
    {big('daily_average_minor', 'projected_minor', 'projected_delta_minor')},
    projected_budget_percent, (SELECT count(*) FROM alerts x WHERE x.workspace_id = m.workspace_id AND x.month = m.month
      AND severity = 'over') AS budgets_over
    FROM months m JOIN trend t ON t.workspace_id = m.workspace_id AND t.month = m.month
    JOIN forecast f ON f.workspace_id = m.workspace_id AND f.month = m.month""", *BASE_CTES, USAGE, TREND, FORECAST))
def _(t):
    return spend.finance_insights(t.expense, t.budget)
