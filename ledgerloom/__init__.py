"""Expense, document and event analytics as Spark DataFrame jobs."""
