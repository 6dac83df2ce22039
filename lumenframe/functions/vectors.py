"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def top_k(df: DataFrame, key: str, column: str, query: list[float], k: int = 5, where: Column | None = None) -> DataFrame:
    """The rows of largest cosine to one query vector, after an optional filter on other columns."""
    kept = df.where(where) if where is not None else df
    return kept.select(key, cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.desc("score"), key).limit(k)
