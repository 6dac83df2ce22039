"""Parts of dates and times as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAU = 6.283185307179586


def parts(c: Column) -> dict[str, Column]:
    """Calendar parts, whether a date is on a weekend or at an end of its month, and hour and weekday on a circle."""
    day, hour = F.weekday(c), F.hour(c)
    return {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "dayofweek": day, "hour": hour, "minute": F.minute(c), "quarter": F.quarter(c),
        "week": F.weekofyear(c), "dayofyear": F.dayofyear(c), "is_weekend": (day >= 5).cast("int"), "is_month_start": (F.day(c) == 1).cast("int"), "is_month_end": (F.to_date(c) == F.last_day(c)).cast("int"),
        "hour_sin": F.sin(hour * (TAU / 24)), "hour_cos": F.cos(hour * (TAU / 24)), "dow_sin": F.sin(day * (TAU / 7)), "dow_cos": F.cos(day * (TAU / 7)),
    }


def features(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    made = parts(F.col(column))
    return df.withColumns({f"{column}_{n}": made[n] for n in names or made})


def business_hour(c: Column) -> Column:
    return F.hour(c).between(9, 17) & (F.weekday(c) < 5)


def weekday_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.date_format(column, "EEEE").alias("weekday")).agg(F.count("*").alias("count"))
