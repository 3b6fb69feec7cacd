"""Registry of queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def edge_types(df: DataFrame) -> DataFrame:
    """Exact money sums leave as longs, the type of the stored minor units."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("long").alias(f.name)
            if isinstance(f.dataType, DecimalType) and f.dataType.scale == 0
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    """Register a builder ``(Tables) -> DataFrame`` under ``name``."""

    def wrap(build: Callable[["Tables"], DataFrame]):
        from .bindings import Tables

        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return edge_types(build(Tables(configure(spark), sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap
