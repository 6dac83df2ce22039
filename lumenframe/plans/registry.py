"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coverage as _coverage  # noqa: F401  registers its functions
from . import queries as _queries  # noqa: F401  registers its functions
from .catalog import QUERIES, SQL, Query, load, query


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-30' GROUP BY 1, 2
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and means of line items by return flag and line status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        load(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2001-06-30").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("count_order"))
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
