"""Group operations that stay distributed when one group holds most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .storage import written


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join that also matches null keys; key columns come from the left."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Add whole-group aggregates to every row.

    A partial aggregate and a join back replace ``OVER (PARTITION BY ...)``:
    the window would sort a hot group in one task, the join can be split."""
    return join_null_safe(df, df.groupBy(*keys).agg(*aggregates), keys, "inner")


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "position", size: str | None = None) -> DataFrame:
    """1-based row numbers within ``keys`` for groups of any size, and the group's ``size`` where a name is given.

    Rows are dealt into ranges of (keys, order) and written in that order: their one shuffle. The number of a row
    is its place in its range plus the rows of its group in the ranges before; only one count per group and
    range meets in a window. Equal rows are spread by their place of reading."""
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    spread = df.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(*by, F.col("__spread"))
    dealt = written(spread.sortWithinPartitions(*by).drop("__spread").withColumn("__seq", F.monotonically_increasing_id()), "positions")
    dealt = dealt.withColumn("__range", F.shiftright("__seq", 33))
    counts = dealt.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    whole = W.partitionBy(*keys)
    before = F.sum("__n").over(whole.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    places = counts.select(*keys, "__range", (before - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(whole).alias("__size"))
    joined = join_null_safe(dealt, places, [*keys, "__range"], "inner").withColumn(name, F.col("__seq") + F.col("__shift"))
    return (joined.withColumn(size, F.col("__size")) if size else joined).drop("__seq", "__range", "__shift", "__size")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark trims each input partition to ``n``
    rows per group before the shuffle, so hot groups do not travel whole."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked.withColumn(name, F.col(name).cast("long"))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Newest row per key by ``order`` (ties: larger wins), as a mergeable aggregate."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*")


def literal_rows(spark: SparkSession, column: str, values: tuple) -> DataFrame:
    """A fixed list as a one-column table (planned, not shipped from Python)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def unnest(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Array of structs to rows. A plain explode makes Spark add a filter on the
    array and push it below, which evaluates the whole array expression again."""
    rows = df.select(*keep, F.explode_outer(column).alias("__row"))
    return rows.where(F.col("__row").isNotNull()).select(*keep, "__row.*")
