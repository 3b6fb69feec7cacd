"""Registered queries: each binds an operator to tables and states its SQL."""
