"""Grouped aggregates by name, pivots with margins, cross tables and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FUNCTIONS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp,
    "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True), "nunique": F.count_distinct, "mode": lambda c: F.mode(F.col(c), deterministic=True),
    "p25": lambda c: F.percentile(c, 0.25), "p75": lambda c: F.percentile(c, 0.75), "p90": lambda c: F.percentile(c, 0.9), "range": lambda c: F.max(c) - F.min(c),
}


def register_function(name: str, function: Callable[[str], Column]) -> None:
    """A name for a column aggregate, a grouped-aggregate pandas UDF among them."""
    FUNCTIONS[name] = function


def aggregate(df: DataFrame, group_by: list[str], specs: dict[str, tuple[str, str]], include_totals: bool = False) -> DataFrame:
    """``specs``: new name -> (column, function). Rows with a null key are left out. The totals row has the key TOTAL and is
    worked out from the rows, so that means and medians hold for it too."""
    kept = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group_by))
    figures = [FUNCTIONS[f](c).alias(name) for name, (c, f) in specs.items()]
    out = kept.groupBy(*group_by).agg(*figures)
    if include_totals:
        out = out.withColumns({c: F.col(c).cast("string") for c in group_by}).unionByName(kept.agg(*figures).withColumns({c: F.lit("TOTAL") for c in group_by}))
    return out


def pivot(df: DataFrame, index: str, columns: str, values: str, function: str = "sum", fill=0) -> DataFrame:
    return df.groupBy(index).pivot(columns).agg(FUNCTIONS[function](values)).fillna(fill)


def pivot_margins(df: DataFrame, index: str, columns: str, values: str, function: str = "sum") -> DataFrame:
    """Long form with the margins as ``All``."""
    got = df.cube(index, columns).agg(FUNCTIONS[function](values).alias("value"), F.grouping(index).alias("gi"), F.grouping(columns).alias("gc"))
    name = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c).cast("string")).alias(c)
    return got.select(name(index, "gi"), name(columns, "gc"), "value")


def crosstab(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    out = pivot_margins(df.withColumn("_one", F.lit(1)), a, b, "_one", "count")
    return out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))).withColumn("value", F.col("value") / F.col("_n")).drop("_n") if normalize else out


def broadcast_back(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Aggregates of each group beside its rows."""
    figures = {"count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))}
    out = df.groupBy(group).agg(*[f(c).alias(f"{c}_{group}_{k}") for c in columns for k, f in figures.items()])
    return df.join(out, group, "left")


def first_value_per_key(df: DataFrame, key: str, time: str) -> DataFrame:
    """Each row with its key's first time: an aggregate joined back, so that a hot key never sits in one window task."""
    return df.join(df.groupBy(key).agg(F.min(time).alias(f"first_{time}")), key)


def ratio(df: DataFrame, numerator: str, denominator: str, multiply_by: float = 100.0) -> DataFrame:
    n, d = F.sum(numerator), F.sum(denominator)
    return df.agg(F.when(d > 0, n * multiply_by / d).otherwise(F.lit(0.0)).alias("value"))


def weighted_average(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    return df.agg((F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)) if weight else F.avg(value)).alias("value"))


def conditional_count(df: DataFrame, column: str | None = None, equals=None) -> DataFrame:
    return df.agg((F.count_if(F.col(column) == equals) if column else F.count("*")).alias("value"))


def value_at_risk(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    cut = df.agg(F.percentile(column, 1 - confidence).alias("var"))
    return df.crossJoin(F.broadcast(cut)).agg(F.max("var").alias("var"), F.avg(F.when(F.col(column) <= F.col("var"), F.col(column))).alias("cvar"))


def compare_cohorts(df: DataFrame, cohort: str, value: str) -> DataFrame:
    out = df.groupBy(cohort).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))
    w = Window.orderBy(F.desc("sum"), cohort)
    return out.withColumn("place", F.row_number().over(w))


def average_order_value(df: DataFrame, amount: str, order: str | None = None) -> DataFrame:
    return (df.groupBy(order).agg(F.sum(amount).alias(amount)) if order else df).agg(F.avg(amount).alias("aov"))
