"""Queries over the test tables: each applies an operator to whole tables, and most have DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, text, vectors
from ..operators import aggregates as A
from ..operators import business as B
from ..operators import eda, features, quality, sampling, simulation, transforms
from ..operators import statistics as S
from ..operators import timeseries as TS
from . import sql as guarded
from .catalog import load, query

Session = SparkSession


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating figures rounded, so that engines that add in another order agree."""
    return df.select(*[F.round(F.col(f"`{c}`").cast("double"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


# Transform pipeline


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice BETWEEN 50000 AND 400000 AND NOT contains(lower(o_orderpriority), 'low') AND o_orderstatus IN ('F', 'O')""")
def transform_filter(spark: Session, d: str) -> DataFrame:
    steps = [
        {"op": "filter_rows", "params": {"conditions": [{"column": "o_totalprice", "op": "between", "min": 50000, "max": 400000}, {"column": "o_orderstatus", "op": "in", "value": ["F", "O"]}]}},
        {"op": "filter_rows", "params": {"conditions": [{"column": "o_orderpriority", "op": "contains", "value": "LOW"}], "keep": False}},
        {"op": "drop_columns", "params": {"columns": ["o_orderdate", "o_orderstatus"]}},
    ]
    return transforms.apply(load(spark, d, "orders"), steps)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT median(v) FROM e)), 4) AS v FROM e""")
def transform_fill_median(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"))
    return rounded(transforms.apply(e, [{"op": "fill_missing", "params": {"columns": ["v"], "strategy": "median"}}]))


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(last_value(v IGNORE NULLS) OVER (ORDER BY event_id), 4) AS v FROM e""")
def transform_forward_fill(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return rounded(transforms.fill_missing(e, "v", "ffill", order_by="event_id"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def transform_deduplicate(spark: Session, d: str) -> DataFrame:
    return transforms.deduplicate(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], "first", ["event_id"])


@query("SELECT p_partkey, upper(replace(trim(p_name), ' ', '_')) AS p_name FROM part")
def transform_normalize(spark: Session, d: str) -> DataFrame:
    return transforms.apply(load(spark, d, "part").select("p_partkey", "p_name"), [{"op": "string_normalize", "params": {"columns": ["p_name"], "uppercase": True, "regex_replace": [{"pattern": " ", "repl": "_"}]}}])


@query("""SELECT o_orderkey, year(o_orderdate) AS t_year, quarter(o_orderdate) AS t_quarter, month(o_orderdate) AS t_month, week(o_orderdate) AS t_week,
day(o_orderdate) AS t_day, (dayofweek(o_orderdate) + 6) % 7 AS t_day_of_week, (dayofweek(o_orderdate) + 6) % 7 >= 5 AS t_is_weekend, hour(o_orderdate) AS t_hour FROM orders""")
def transform_time_features(spark: Session, d: str) -> DataFrame:
    return transforms.time_features(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", prefix="t", drop_source=True)


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders)
SELECT CAST((o_totalprice > e[1]) AS INT) + CAST((o_totalprice > e[2]) AS INT) + CAST((o_totalprice > e[3]) AS INT) AS bin, count(*) AS rows FROM orders, q GROUP BY 1""")
def transform_bin_quantile(spark: Session, d: str) -> DataFrame:
    out = transforms.bin_numeric(load(spark, d, "orders"), "o_totalprice", 4, "quantile", "codes", "bin")
    return out.groupBy("bin").agg(F.count("*").alias("rows"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT round(sum(least(greatest(l_extendedprice, a - 0.2 * (b - a)), b + 0.2 * (b - a))), 2) AS total,
       round(max(least(greatest(l_extendedprice, a - 0.2 * (b - a)), b + 0.2 * (b - a))), 4) AS top FROM lineitem, q""")
def transform_clip_outliers(spark: Session, d: str) -> DataFrame:
    out = transforms.clip_outliers(load(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice", iqr_multiplier=0.2)
    return out.agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.max("l_extendedprice"), 4).alias("top"))


@query("""SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_encoded FROM customer""")
def transform_encode_label(spark: Session, d: str) -> DataFrame:
    return transforms.encode_categorical(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").withColumn("c_mktsegment_encoded", F.col("c_mktsegment_encoded").cast("long"))


@query("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INT) AS s__AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INT) AS s__BUILDING,
CAST(c_mktsegment = 'FURNITURE' AS INT) AS s__FURNITURE, CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS s__HOUSEHOLD, CAST(c_mktsegment = 'MACHINERY' AS INT) AS s__MACHINERY FROM customer""")
def transform_encode_one_hot(spark: Session, d: str) -> DataFrame:
    return transforms.encode_categorical(load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("s")), "s", "one_hot")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def transform_top_rows(spark: Session, d: str) -> DataFrame:
    return transforms.sort_rows(load(spark, d, "events").select("event_id", "value"), ["value", "event_id"], [False, True]).limit(25)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def transform_json_convert(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return transforms.type_convert(e, "k", "int", errors="coerce")


# Exploratory operators


@query("""WITH t AS (SELECT o_orderkey, NULLIF(o_custkey % 5, 0) AS gap, NULLIF(o_orderstatus, 'P') AS state FROM orders)
SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS null_count, round(100.0 * (count(*) - count(o_orderkey)) / count(*), 4) AS null_pct FROM t
UNION ALL SELECT 'gap', count(*) - count(gap), round(100.0 * (count(*) - count(gap)) / count(*), 4) FROM t
UNION ALL SELECT 'state', count(*) - count(state), round(100.0 * (count(*) - count(state)) / count(*), 4) FROM t""")
def eda_missingness(spark: Session, d: str) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("gap"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("state"))
    return rounded(eda.missingness(t))


@query("""SELECT 'c_custkey' AS "column", count(c_custkey) AS non_null, count(*) - count(c_custkey) AS "null", count(DISTINCT c_custkey) AS "unique", round(count(DISTINCT c_custkey) / count(*), 4) AS unique_ratio, count(*) - count(DISTINCT c_custkey) AS duplicates, count(DISTINCT c_custkey) / count(*) >= 0.995 AS key_candidate FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), 0, count(DISTINCT c_mktsegment), round(count(DISTINCT c_mktsegment) / count(*), 4), count(*) - count(DISTINCT c_mktsegment), false FROM customer""")
def eda_uniqueness(spark: Session, d: str) -> DataFrame:
    return rounded(eda.uniqueness_scan(load(spark, d, "customer").select("c_custkey", "c_mktsegment")))


@query("""SELECT 'o_totalprice' AS "column", count(o_totalprice) AS "count", round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS "min",
round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(max(o_totalprice), 4) AS "max" FROM orders""")
def eda_numeric_summary(spark: Session, d: str) -> DataFrame:
    return rounded(eda.numeric_summary(load(spark, d, "orders").select("o_totalprice")))


@query("""WITH l AS (SELECT 'event_type' AS "column", event_type AS value FROM events UNION ALL SELECT 'parity', CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END FROM events),
c AS (SELECT "column", value, count(*) AS "count" FROM l GROUP BY ALL)
SELECT "column", value, "count", round("count" * 100.0 / sum("count") OVER (PARTITION BY "column"), 4) AS pct, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value NULLS LAST) AS rank FROM c QUALIFY rank <= 3""")
def eda_categorical_topk(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_type", F.when(F.col("user_id") % 3 == 0, None).when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("parity"))
    return rounded(eda.categorical_topk(e, k=3)).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT 'text' AS "column", count(text) AS non_null, round(avg(length(text)), 4) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(CASE WHEN trim(text) = '' THEN 1.0 ELSE 0.0 END), 4) AS blank_share FROM documents""")
def eda_text_summary(spark: Session, d: str) -> DataFrame:
    return rounded(eda.text_summary(load(spark, d, "documents").select("text")))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 4) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 4) FROM lineitem""")
def eda_correlation(spark: Session, d: str) -> DataFrame:
    return rounded(eda.correlation(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), t AS (SELECT avg(c_acctbal) AS m, sum(c_acctbal * c_acctbal) - sum(c_acctbal) ** 2 / count(*) AS v, count(*) AS n FROM customer)
SELECT 'c_mktsegment' AS a, 'c_acctbal' AS b, round(sum(g.n * (g.m - t.m) ** 2) / max(t.v), 4) AS score, max(t.n) AS n FROM g, t""")
def eda_eta_squared(spark: Session, d: str) -> DataFrame:
    return rounded(eda.eta_squared(load(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


@query("""WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), k AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), t AS (SELECT sum(n) AS t FROM c),
g AS (SELECT (coalesce(n, 0) - nx * ny / t) ** 2 / (nx * ny / t) AS z FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (x, y))
SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, round(sum(z), 4) AS chi2, CAST(2 AS BIGINT) AS dof, round(sqrt(sum(z) / max(t)), 4) AS score, CAST(max(t) AS BIGINT) AS n FROM g, t""")
def eda_cramers_v(spark: Session, d: str) -> DataFrame:
    return rounded(eda.cramers_v(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus")).withColumn("dof", F.col("dof").cast("long"))


@query("""SELECT event_type, count(*) AS "count", round(avg(value), 4) AS mean, round(sum(value), 2) AS "sum", round(median(value), 4) AS median FROM events GROUP BY 1""")
def eda_segment_summary(spark: Session, d: str) -> DataFrame:
    return rounded(eda.segment_summary(load(spark, d, "events"), "event_type", "value")).withColumn("sum", F.round("sum", 2))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer)
SELECT 'c_acctbal' AS "column", round(max(a - 0.3 * (b - a)), 4) AS lower, round(max(b + 0.3 * (b - a)), 4) AS upper, count(*) FILTER (c_acctbal < a - 0.3 * (b - a) OR c_acctbal > b + 0.3 * (b - a)) AS outliers,
round(100.0 * count(*) FILTER (c_acctbal < a - 0.3 * (b - a) OR c_acctbal > b + 0.3 * (b - a)) / count(*), 4) AS outlier_pct FROM customer, q""")
def eda_outlier_scan(spark: Session, d: str) -> DataFrame:
    return rounded(eda.outlier_scan(load(spark, d, "customer"), ["c_acctbal"], 0.3))


@query("""WITH g AS (SELECT date_trunc('month', o_orderdate) AS period, count(*) AS n, avg(o_totalprice) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(period) FROM g), (SELECT max(period) FROM g), INTERVAL 1 MONTH)) AS period)
SELECT CAST(s.period AS TIMESTAMP) AS period, coalesce(n, 0) AS "count", round(m, 4) AS mean, round(coalesce(s, 0), 2) AS "sum" FROM s LEFT JOIN g ON g.period = s.period""")
def eda_resample(spark: Session, d: str) -> DataFrame:
    return rounded(TS.resample(load(spark, d, "orders"), "o_orderdate", "o_totalprice", "M")).withColumn("sum", F.round("sum", 2))


@query("""WITH s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(sum(value), 6) AS value FROM events GROUP BY 1), x AS (SELECT period, value, value - lag(value) OVER (ORDER BY period) AS delta FROM s), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM s),
r AS (SELECT *, value < a - 1.0 * (b - a) OR value > b + 1.0 * (b - a) AS anomaly, row_number() OVER (ORDER BY abs(delta) DESC NULLS LAST, period) AS place FROM x, q)
SELECT period, round(value, 3) AS value, CASE WHEN anomaly AND place <= 5 AND delta IS NOT NULL THEN 'anomaly_change_point' WHEN anomaly THEN 'anomaly' ELSE 'change_point' END AS event FROM r WHERE anomaly OR (place <= 5 AND delta IS NOT NULL)""")
def eda_time_anomaly(spark: Session, d: str) -> DataFrame:
    out = eda.time_anomaly_scan(load(spark, d, "events"), "ts", "value", "D", 1.0, 5)
    return out.select("period", F.round("value", 3).alias("value"), "event")


@query("""WITH o AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem), g AS (SELECT l_returnflag, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1)
SELECT l_returnflag AS segment, 'l_quantity' AS "column", round(g.q, 4) AS mean, round(g.q - o.q, 4) AS delta FROM g, o UNION ALL SELECT l_returnflag, 'l_extendedprice', round(g.p, 4), round(g.p - o.p, 4) FROM g, o""")
def eda_segment_deep_dive(spark: Session, d: str) -> DataFrame:
    return rounded(eda.segment_deep_dive(load(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]))


@query("""WITH t AS (SELECT o_orderpriority, NULLIF(o_custkey % 4, 0) AS x FROM orders)
SELECT o_orderpriority AS value, count(*) AS rows, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing_rate FROM t GROUP BY 1 HAVING count(*) >= 25""")
def eda_missingness_patterns(spark: Session, d: str) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderpriority", F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("x"))
    return rounded(eda.missingness_patterns(t, "x", "o_orderpriority"))


@query("""WITH q AS (SELECT quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem)
SELECT CAST(l_quantity > e[1] AS INT) + CAST(l_quantity > e[2] AS INT) + CAST(l_quantity > e[3] AS INT) + CAST(l_quantity > e[4] AS INT) AS bin, min(l_quantity) AS a_min, max(l_quantity) AS a_max, count(*) AS "count", round(avg(l_extendedprice), 4) AS b_mean, round(median(l_extendedprice), 4) AS b_median FROM lineitem, q GROUP BY 1""")
def eda_relationship(spark: Session, d: str) -> DataFrame:
    return rounded(eda.relationship_bins(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 5))


# Aggregates


@query("""SELECT n_name, sum(c_acctbal) IS NOT NULL AS any_balance, count(*) AS customers, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS mid, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, round(max(c_acctbal) - min(c_acctbal), 4) AS spread, count(DISTINCT c_mktsegment) AS segments
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'TOTAL', true, count(*), round(avg(c_acctbal), 4), round(median(c_acctbal), 4), round(quantile_cont(c_acctbal, 0.9), 4), round(max(c_acctbal) - min(c_acctbal), 4), count(DISTINCT c_mktsegment) FROM customer""")
def aggregate_with_totals(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    specs = {"total": ("c_acctbal", "sum"), "customers": ("c_custkey", "count"), "mean": ("c_acctbal", "mean"), "mid": ("c_acctbal", "median"), "p90": ("c_acctbal", "p90"), "spread": ("c_acctbal", "range"), "segments": ("c_mktsegment", "nunique")}
    out = A.aggregate(df, ["n_name"], specs, include_totals=True)
    return rounded(out.withColumn("any_balance", F.col("total").isNotNull()).drop("total"))


@query("""SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS F, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS O FROM lineitem GROUP BY 1""")
def pivot_quantity(spark: Session, d: str) -> DataFrame:
    return rounded(A.pivot(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 2)


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS value FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab_margins(spark: Session, d: str) -> DataFrame:
    return A.crosstab(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT round(100.0 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS value FROM lineitem")
def metric_ratio(spark: Session, d: str) -> DataFrame:
    return rounded(A.ratio(load(spark, d, "lineitem").withColumn("off", F.col("l_extendedprice") * F.col("l_discount")), "off", "l_extendedprice"))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS value FROM lineitem")
def metric_weighted_average(spark: Session, d: str) -> DataFrame:
    return rounded(A.weighted_average(load(spark, d, "lineitem"), "l_discount", "l_quantity"), 6)


@query("SELECT count(*) FILTER (event_type = 'purchase') AS value FROM events")
def metric_conditional_count(spark: Session, d: str) -> DataFrame:
    return A.conditional_count(load(spark, d, "events"), "event_type", "purchase")


@query("SELECT round(avg(t), 4) AS aov FROM (SELECT l_orderkey, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1)")
def metric_average_order_value(spark: Session, d: str) -> DataFrame:
    return rounded(A.average_order_value(load(spark, d, "lineitem"), "l_extendedprice", "l_orderkey"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS v FROM customer) SELECT round(max(v), 4) AS "var", round(avg(c_acctbal) FILTER (c_acctbal <= v), 4) AS cvar FROM customer, q""")
def metric_value_at_risk(spark: Session, d: str) -> DataFrame:
    return rounded(A.value_at_risk(load(spark, d, "customer"), "c_acctbal"))


@query("""SELECT event_type, count(value) AS "count", round(sum(value), 2) AS "sum", round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, row_number() OVER (ORDER BY sum(value) DESC, event_type) AS place FROM events GROUP BY 1""")
def compare_cohorts(spark: Session, d: str) -> DataFrame:
    return rounded(A.compare_cohorts(load(spark, d, "events"), "event_type", "value")).withColumns({"sum": F.round("sum", 2), "place": F.col("place").cast("long")})


@query("""SELECT round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS users, count(*) AS orders, round(sum(o_totalprice) / count(*), 4) AS aov, round(sum(o_totalprice) / count(DISTINCT o_custkey), 4) AS arpu FROM orders""")
def core_metrics(spark: Session, d: str) -> DataFrame:
    return rounded(B.core_metrics(load(spark, d, "orders"), "o_totalprice", "o_custkey")).withColumn("revenue", F.round("revenue", 2))


# Windows


@query("""SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 4) END AS value_rolling_mean, CASE WHEN count(value) OVER w = 3 THEN round(max(value) OVER w, 4) END AS value_rolling_max
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)""")
def window_rolling(spark: Session, d: str) -> DataFrame:
    out = TS.rolling(load(spark, d, "events"), "value", "event_id", 3, ("mean", "max"), ["user_id"])
    return rounded(out.select("event_id", "value_rolling_mean", "value_rolling_max"))


@query("""SELECT event_id, round(sum(value) OVER w, 2) AS value_cumsum, count(*) OVER w AS value_cumcount FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def window_cumulative(spark: Session, d: str) -> DataFrame:
    return rounded(TS.cumulative(load(spark, d, "events"), "value", "event_id", ["event_type"]).select("event_id", "value_cumsum", "value_cumcount"), 2)


@query("""SELECT event_id, round(lag(value, 1) OVER w, 4) AS value_lag_1, round(value - lag(value, 1) OVER w, 4) AS value_diff_1, round(lag(value, 7) OVER w, 4) AS value_lag_7, round(value - lag(value, 7) OVER w, 4) AS value_diff_7 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_lags(spark: Session, d: str) -> DataFrame:
    out = TS.lags(load(spark, d, "events").select("event_id", "user_id", "value"), "value", "event_id", (1, 7), ["user_id"])
    return rounded(out.drop("user_id", "value"))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS s, avg(o_totalprice) AS m, count(o_totalprice) AS n FROM orders GROUP BY 1)
SELECT period, round(s, 2) AS "sum", round(m, 4) AS mean, n AS "count", round(lag(s) OVER (ORDER BY period), 2) AS previous, round((s - lag(s) OVER (ORDER BY period)) / lag(s) OVER (ORDER BY period) * 100, 4) AS growth_pct FROM m""")
def window_period_comparison(spark: Session, d: str) -> DataFrame:
    return rounded(TS.period_comparison(load(spark, d, "orders"), "o_orderdate", "o_totalprice")).withColumns({c: F.round(c, 2) for c in ("sum", "previous")})


@query("""WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT y AS "year", m AS "month", round(s, 2) AS "sum", round((s - lag(s) OVER (PARTITION BY m ORDER BY y)) / lag(s) OVER (PARTITION BY m ORDER BY y) * 100, 4) AS growth_pct FROM m""")
def window_year_over_year(spark: Session, d: str) -> DataFrame:
    return rounded(TS.yoy(load(spark, d, "orders"), "o_orderdate", "o_totalprice")).withColumn("sum", F.round("sum", 2))


def monthly(spark: Session, d: str) -> DataFrame:
    return TS.resample(load(spark, d, "orders"), "o_orderdate", "o_totalprice", "M").select("period", F.col("sum").alias("y"))


MONTHLY = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS y FROM orders GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 MONTH)) AS TIMESTAMP) AS period),
t AS (SELECT s.period, coalesce(m.y, 0) AS y, row_number() OVER (ORDER BY s.period) - 1 AS i FROM s LEFT JOIN m ON m.period = s.period)"""


@query(f"WITH {MONTHLY} SELECT period, round(y, 2) AS y, round(y - lag(y) OVER (ORDER BY period), 2) AS \"change\", round((y - first_value(y) OVER (ORDER BY period)) * 100 / first_value(y) OVER (ORDER BY period), 4) AS cumulative_growth FROM t")
def series_growth(spark: Session, d: str) -> DataFrame:
    return TS.growth(monthly(spark, d), "period", "y").select("period", F.round("y", 2).alias("y"), F.round("change", 2).alias("change"), F.round("cumulative_growth", 4).alias("cumulative_growth"))


@query(f"""WITH {MONTHLY}, c AS (SELECT *, avg(y) OVER w AS a, count(y) OVER w AS n FROM t WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
d AS (SELECT *, CASE WHEN n = 7 THEN a END AS trend FROM c), e AS (SELECT *, avg(coalesce(y - trend, 0)) OVER (PARTITION BY i % 7) AS s0 FROM d), l AS (SELECT avg(s0) AS level FROM (SELECT DISTINCT i % 7 AS p, s0 FROM e))
SELECT period, round(trend, 2) AS trend, round(s0 - level, 2) AS seasonal, round(y - trend - (s0 - level), 2) AS residual FROM e, l""")
def series_decomposition(spark: Session, d: str) -> DataFrame:
    return rounded(TS.decompose(monthly(spark, d), "period", "y", 7).select("period", "trend", "seasonal", "residual"), 2)


@query(f"WITH {MONTHLY}, p AS (SELECT (i % 12) AS position, avg(y) AS mean FROM t GROUP BY 1) SELECT CAST(position AS INT) AS position, round(mean, 5) AS mean, round(mean * 100 / avg(mean) OVER (), 4) AS \"index\" FROM p")
def series_seasonality(spark: Session, d: str) -> DataFrame:
    return TS.seasonality(monthly(spark, d), "period", "y", 12).select("position", F.round("mean", 5).alias("mean"), F.round("index", 4).alias("index"))


@query(f"""WITH {MONTHLY}, k AS (SELECT sum(sign(b.y - a.y)) AS s FROM t a JOIN t b ON a.i < b.i)
SELECT round(regr_slope(y, i), 3) AS slope, round(regr_intercept(y, i), 2) AS intercept, round(regr_r2(y, i), 4) AS r2, count(*) AS n, round(max(s) * 2 / (count(*) * (count(*) - 1)), 4) AS tau, round((regr_r2(y, i) + abs(max(s) * 2 / (count(*) * (count(*) - 1)))) / 2, 4) AS strength FROM t, k""")
def series_trend(spark: Session, d: str) -> DataFrame:
    out = TS.trend(monthly(spark, d), "period", "y")
    return out.select(F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), *[F.round(c, 4).alias(c) for c in ("r2", "tau", "strength")], "n")


@query(f"""WITH RECURSIVE {MONTHLY}, h AS (SELECT 1 AS i, (SELECT y FROM t WHERE i = 0) AS level, (SELECT b.y - a.y FROM t a, t b WHERE a.i = 0 AND b.i = 1) AS tr
UNION ALL SELECT h.i + 1, 0.3 * t.y + 0.7 * (h.level + h.tr), 0.1 * (0.3 * t.y + 0.7 * (h.level + h.tr) - h.level) + 0.9 * h.tr FROM h JOIN t ON t.i = h.i),
e AS (SELECT level, tr FROM h ORDER BY i DESC LIMIT 1)
SELECT CAST(k AS INT) AS h, round(level + k * tr, 2) AS forecast, round(level + k * tr - 0.196 * abs(level) * sqrt(k), 2) AS "lower", round(level + k * tr + 0.196 * abs(level) * sqrt(k), 2) AS "upper" FROM e, range(1, 13) r(k)""")
def series_holt_forecast(spark: Session, d: str) -> DataFrame:
    return rounded(TS.holt(monthly(spark, d), "period", "y"), 2)


@query(f"WITH {MONTHLY}, q AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM (SELECT y FROM t ORDER BY i DESC LIMIT 7)) SELECT CAST(k AS INT) AS h, round(m, 2) AS forecast, round(m - 1.96 * s, 2) AS \"lower\", round(m + 1.96 * s, 2) AS \"upper\" FROM q, range(1, 13) r(k)")
def series_moving_average_forecast(spark: Session, d: str) -> DataFrame:
    return rounded(TS.moving_average_forecast(monthly(spark, d), "period", "y"), 2)


@query(f"WITH {MONTHLY} SELECT CAST(k AS INT) AS h, round(regr_intercept(y, i) + regr_slope(y, i) * (count(*) - 1 + k), 2) AS forecast FROM t, range(1, 13) r(k) GROUP BY k")
def series_linear_forecast(spark: Session, d: str) -> DataFrame:
    return rounded(TS.linear_forecast(monthly(spark, d), "period", "y").select("h", "forecast"), 2)


@query(f"WITH {MONTHLY}, c AS (SELECT i, y - avg(y) OVER () AS x, count(*) OVER () AS n FROM t), k AS (SELECT unnest([7, 12, 4, 24]) AS lag) SELECT CAST(k.lag AS INT) AS lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM c), 4) AS acf FROM k JOIN c a ON true JOIN c b ON b.i = a.i - k.lag WHERE 2 * k.lag <= a.n GROUP BY 1")
def series_autocorrelation(spark: Session, d: str) -> DataFrame:
    return rounded(TS.autocorrelation(monthly(spark, d), "period", "y", (7, 12, 4, 24)))


@query("""WITH g AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS period FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM g), (SELECT max(period) FROM g), INTERVAL 1 DAY)) AS TIMESTAMP) AS period) SELECT period FROM s EXCEPT SELECT period FROM g""")
def series_missing_dates(spark: Session, d: str) -> DataFrame:
    return TS.missing_dates(load(spark, d, "orders"), "o_orderdate")


# Business


RFM_SQL = """WITH p AS (SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
q AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS r, quantile_cont(frequency, [0.2, 0.4, 0.6, 0.8]) AS f, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM p)
SELECT o_custkey, CAST(recency AS INT) AS recency, frequency, round(monetary, 2) AS monetary, 5 - CAST(recency > r[1] AS INT) - CAST(recency > r[2] AS INT) - CAST(recency > r[3] AS INT) - CAST(recency > r[4] AS INT) AS r_score,
1 + CAST(frequency > f[1] AS INT) + CAST(frequency > f[2] AS INT) + CAST(frequency > f[3] AS INT) + CAST(frequency > f[4] AS INT) AS f_score, 1 + CAST(monetary > m[1] AS INT) + CAST(monetary > m[2] AS INT) + CAST(monetary > m[3] AS INT) + CAST(monetary > m[4] AS INT) AS m_score FROM p, q"""
RFM_CASE = "CASE " + " ".join(f"WHEN r_score = {r} AND f_score = {f} THEN '{name.replace(chr(39), chr(39) * 2)}'" for (r, f), name in B.SEGMENTS.items()) + " END"


@query(f"SELECT *, {RFM_CASE} AS segment FROM ({RFM_SQL})")
def rfm_scores(spark: Session, d: str) -> DataFrame:
    return rounded(B.rfm(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2002-01-01"), 2)


@query(f"""SELECT segment, count(*) AS customers, round(avg(recency), 4) AS recency, round(avg(frequency), 4) AS frequency, round(sum(monetary), 1) AS revenue,
round(count(*) / sum(count(*)) OVER (), 4) AS share FROM (SELECT *, {RFM_CASE} AS segment FROM ({RFM_SQL})) GROUP BY 1""")
def rfm_segments(spark: Session, d: str) -> DataFrame:
    return rounded(B.segment_table(B.rfm(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2002-01-01"))).withColumn("revenue", F.round("revenue", 1))


@query("""WITH f AS (SELECT o_custkey, date_trunc('quarter', min(o_orderdate)) AS c FROM orders GROUP BY 1),
a AS (SELECT f.c AS cohort, CAST(date_diff('month', f.c, date_trunc('quarter', o.o_orderdate)) / 3 AS INT) AS periods, count(DISTINCT o.o_custkey) AS users, sum(o_totalprice) AS revenue FROM orders o JOIN f USING (o_custkey) GROUP BY 1, 2)
SELECT CAST(cohort AS TIMESTAMP) AS cohort, periods, users, round(revenue, 2) AS revenue, round(users / max(CASE WHEN periods = 0 THEN users END) OVER (PARTITION BY cohort), 4) AS retention FROM a""")
def cohort_retention(spark: Session, d: str) -> DataFrame:
    return rounded(B.cohorts(load(spark, d, "orders"), "o_custkey", "o_orderdate", "Q", "o_totalprice")).withColumn("revenue", F.round("revenue", 2))


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY 1),
n AS (SELECT count(*) FILTER (a) AS x, count(*) FILTER (a AND b) AS y, count(*) FILTER (a AND b AND c) AS z FROM u)
SELECT 1 AS step, 'view' AS name, x AS users, 1.0 AS conversion, 0 AS drop_off, 1.0 AS overall FROM n UNION ALL SELECT 2, 'click', y, round(y / x, 4), x - y, round(y / x, 4) FROM n UNION ALL SELECT 3, 'purchase', z, round(z / y, 4), y - z, round(z / x, 4) FROM n""")
def funnel(spark: Session, d: str) -> DataFrame:
    return rounded(B.funnel(load(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase"]))


@query("""WITH u AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1)
SELECT 'view' AS from_step, 'purchase' AS to_step, round(avg(CASE WHEN b > a THEN (epoch_us(b) - epoch_us(a)) / 3.6e9 END), 4) AS hours FROM u""")
def funnel_times(spark: Session, d: str) -> DataFrame:
    return rounded(B.time_between_steps(load(spark, d, "events"), "user_id", "event_type", "ts", ["view", "purchase"]))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000 THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, count(DISTINCT event_type) AS pages, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, count(*) = 1 AS bounce FROM s GROUP BY 1, 2""")
def sessions(spark: Session, d: str) -> DataFrame:
    return rounded(B.sessions(load(spark, d, "events"), "user_id", "ts", "event_type").select("user_id", "session", "events", "pages", "seconds", "bounce"), 6)


@query("""SELECT o_custkey, count(*) AS activity, round(sum(o_totalprice), 2) AS value_sum, count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 30) AS active_30, count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') <= 90) AS active_90,
CAST(min(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) AS INT) AS recency, min(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) > 90 AS churned FROM orders GROUP BY 1""")
def churn_features(spark: Session, d: str) -> DataFrame:
    return rounded(B.churn_features(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2001-08-01").select("o_custkey", "activity", "value_sum", "active_30", "active_90", "recency", "churned"), 2)


@query()
def lifetime_value(spark: Session, d: str) -> DataFrame:
    return B.lifetime_value(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2002-01-01")


@query("""WITH p AS (SELECT p_brand, sum(l_extendedprice) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), c AS (SELECT p_brand, t, t * 100 / sum(t) OVER () AS share, row_number() OVER w AS rank, sum(t) OVER w * 100 / sum(t) OVER () AS cum FROM p WINDOW w AS (ORDER BY t DESC, p_brand))
SELECT p_brand, round(t, 2) AS total, round(share, 4) AS share, rank, round(cum, 4) AS cumulative, CASE WHEN cum <= 80 THEN 'A' WHEN cum <= 95 THEN 'B' ELSE 'C' END AS class FROM c""")
def pareto(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(B.pareto(df, "p_brand", "l_extendedprice")).withColumns({"total": F.round("total", 2), "rank": F.col("rank").cast("long")})


@query("""WITH s AS (SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1), r AS (SELECT *, (rank() OVER (ORDER BY total DESC) + (count(*) OVER (PARTITION BY total) - 1) / 2.0) / count(*) OVER () AS pct FROM s)
SELECT l_partkey, total, round(pct, 6) AS pct, CASE WHEN pct <= 0.2 THEN 'A' WHEN pct <= 0.5 THEN 'B' ELSE 'C' END AS class FROM r""")
def abc_by_rank(spark: Session, d: str) -> DataFrame:
    return rounded(B.abc_by_rank(load(spark, d, "lineitem"), "l_partkey", "l_quantity").select("l_partkey", "total", "pct", "class"), 6)


@query("SELECT round(regr_slope(ln(l_quantity + 1), ln(l_extendedprice / l_quantity + 1)), 6) AS elasticity, round(regr_r2(ln(l_quantity + 1), ln(l_extendedprice / l_quantity + 1)), 6) AS r2 FROM lineitem")
def price_elasticity(spark: Session, d: str) -> DataFrame:
    return rounded(B.elasticity(load(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")), "price", "l_quantity"), 6)


@query("""SELECT p_type, round(sum(l_extendedprice), 2) AS revenue, round(sum(p_retailprice * l_quantity), 2) AS cost, round(sum(l_extendedprice) - sum(p_retailprice * l_quantity), 2) AS profit, round((sum(l_extendedprice) - sum(p_retailprice * l_quantity)) * 100 / sum(l_extendedprice), 4) AS margin_pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def profit_by_type(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("cost", F.col("p_retailprice") * F.col("l_quantity"))
    return rounded(B.profit(df, "l_extendedprice", "cost", ["p_type"])).withColumns({c: F.round(c, 2) for c in ("revenue", "cost", "profit")})


@query("""SELECT l_returnflag, round(sum(l_extendedprice), 2) AS budget, round(sum(l_extendedprice * (1 - l_discount)), 2) AS actual, round(sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice), 2) AS variance, round((sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice)) * 100 / sum(l_extendedprice), 4) AS variance_pct, sum(l_extendedprice * (1 - l_discount)) >= sum(l_extendedprice) AS favorable FROM lineitem GROUP BY 1""")
def budget_variance(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(B.variance(df, "l_returnflag", "l_extendedprice", "net")).withColumns({c: F.round(c, 2) for c in ("budget", "actual", "variance")})


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, round((c_acctbal - lo) * 100 / (hi - lo), 4) AS score, 'c_acctbal' AS top_factor, CASE WHEN (c_acctbal - lo) * 100 / (hi - lo) >= 80 THEN 'critical' WHEN (c_acctbal - lo) * 100 / (hi - lo) >= 60 THEN 'high' WHEN (c_acctbal - lo) * 100 / (hi - lo) >= 40 THEN 'medium' WHEN (c_acctbal - lo) * 100 / (hi - lo) >= 20 THEN 'low' ELSE 'minimal' END AS band FROM customer, b""")
def risk_scores(spark: Session, d: str) -> DataFrame:
    return rounded(B.risk_scores(load(spark, d, "customer"), "c_custkey", {"c_acctbal": 1.0}))


@query("""SELECT event_id, count(*) OVER w AS count_3600s, round(coalesce(sum(value) OVER w, 0), 3) AS amount_3600s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)""")
def velocity(spark: Session, d: str) -> DataFrame:
    return rounded(B.velocity(load(spark, d, "events"), "user_id", "ts", "value", (3600,)).select("event_id", "count_3600s", "amount_3600s"), 3)


@query("""WITH b AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.p_type AS a, y.p_type AS b, count(*) AS "count" FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_type < y.p_type GROUP BY 1, 2""")
def basket_pairs(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return B.pair_counts(df, "l_orderkey", "p_type")


@query("""WITH b AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM b), s AS (SELECT p_type, count(*) / max(n) AS s FROM b, n GROUP BY 1), p AS (SELECT x.p_type AS a, y.p_type AS c, count(*) / max(n) AS s FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_type <> y.p_type, n GROUP BY 1, 2)
SELECT p.a, p.c, round(p.s, 4) AS support, round(p.s / x.s, 4) AS confidence, round(p.s / x.s / y.s, 4) AS lift FROM p JOIN s x ON x.p_type = p.a JOIN s y ON y.p_type = p.c""")
def basket_rules(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    rules = B.association_rules(B.frequent_itemsets(df, "l_orderkey", "p_type", 0.001, 2), 0.0, 0.0)
    return rounded(rules.select(F.col("antecedent")[0].alias("a"), F.col("consequent")[0].alias("c"), "support", "confidence", "lift"))


@query("""WITH r AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), n AS (SELECT i, sqrt(sum(r * r)) AS n FROM r GROUP BY 1)
SELECT x.i AS a, y.i AS b, round(sum(x.r * y.r) / max(p.n * q.n), 4) AS similarity FROM r x JOIN r y ON x.u = y.u AND x.i < y.i JOIN n p ON p.i = x.i JOIN n q ON q.i = y.i GROUP BY 1, 2""")
def item_similarity(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("r"))
    return rounded(B.item_similarity(df, "u", "i", "r"))


# Quality


@query("""SELECT count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem""")
def quality_duplicate_rows(spark: Session, d: str) -> DataFrame:
    return quality.duplicate_rows(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("""SELECT * FROM (SELECT count(*) AS rows FROM orders), (
SELECT 'o_totalprice_range' AS rule, 'o_totalprice' AS "column", 'error' AS "level", count(*) FILTER (o_totalprice < 2000 OR o_totalprice > 450000) AS failed, count(*) FILTER (o_totalprice < 2000 OR o_totalprice > 450000) = 0 AS passed FROM orders
UNION ALL SELECT 'o_orderstatus_in_set', 'o_orderstatus', 'warning', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders
UNION ALL SELECT 'o_orderpriority_pattern', 'o_orderpriority', 'error', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]')), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]')) = 0 FROM orders
UNION ALL SELECT 'o_custkey_not_null', 'o_custkey', 'error', count(*) FILTER (o_custkey IS NULL), true FROM orders)""")
def quality_validation(spark: Session, d: str) -> DataFrame:
    rules = [quality.Rule("o_totalprice", "range", {"min": 2000, "max": 450000}), quality.Rule("o_orderstatus", "in_set", {"values": ["F", "O"]}, "warning"), quality.Rule("o_orderpriority", "pattern", {"pattern": "[1-4]"}), quality.Rule("o_custkey", "not_null")]
    return quality.validate(load(spark, d, "orders"), rules)


@query("SELECT coalesce(sum(n), 0) AS failed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def quality_unique_violations(spark: Session, d: str) -> DataFrame:
    return quality.unique_violations(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'a' END, CASE WHEN event_id % 5 = 0 THEN 'b' END) AS missing, count(*) AS rows FROM events GROUP BY 1""")
def quality_missing_patterns(spark: Session, d: str) -> DataFrame:
    t = load(spark, d, "events").select(F.nullif(F.col("event_id") % 3, F.lit(0)).alias("a"), F.nullif(F.col("event_id") % 5, F.lit(0)).alias("b"))
    return quality.missing_patterns(t)


@query("""SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1""")
def quality_exact_duplicates(spark: Session, d: str) -> DataFrame:
    return quality.exact_duplicates(load(spark, d, "documents"), ["text"])


@query("""WITH a AS (SELECT o_orderkey AS k, hash(o_totalprice) AS h FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, hash(CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END) AS h FROM orders WHERE o_orderkey % 10 <> 1)
SELECT CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status, count(*) AS rows FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def quality_compare_rows(spark: Session, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return quality.compare_rows(o.where("o_orderkey % 10 != 0"), b.where("o_orderkey % 10 != 1"), ["o_orderkey"])


@query("""SELECT count(*) FILTER (x > 0 AND y > 0) AS common, count(*) AS "all", round(count(*) FILTER (x > 0 AND y > 0) / count(*), 4) AS share FROM (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS x, count(*) FILTER (o_orderkey % 2 = 1) AS y FROM orders GROUP BY 1)""")
def quality_compare_values(spark: Session, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return rounded(quality.compare_values(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey"))


@query("""WITH c AS (SELECT sum(n - 1) AS copies FROM (SELECT count(*) AS n FROM documents GROUP BY text)), f AS (SELECT count(*) AS r, count(*) FILTER (trim(text) = '') AS e, count(*) FILTER (length(text) < 50) AS s, avg(length(text)) AS l, count(DISTINCT doc_id) AS k FROM documents)
SELECT 'rows' AS "check", CAST(r AS DOUBLE) AS value FROM f UNION ALL SELECT 'empty', e FROM f UNION ALL SELECT 'short', s FROM f UNION ALL SELECT 'mean_length', round(l, 6) FROM f UNION ALL SELECT 'odd_characters', 0 UNION ALL SELECT 'keys', k FROM f UNION ALL SELECT 'copies', copies FROM c""")
def quality_corpus_checks(spark: Session, d: str) -> DataFrame:
    return rounded(quality.corpus_checks(load(spark, d, "documents"), "doc_id", "text"), 6)


@query("""WITH s AS (SELECT unnest([('base', 100.0, 5.0, 200.0), ('optimistic', 120.0, 6.0, 240.0), ('pessimistic', 80.0, 4.0, 160.0)]) AS r) SELECT r[1] AS scenario, round(CAST(r[2] AS DOUBLE) * CAST(r[3] AS DOUBLE) - CAST(r[4] AS DOUBLE), 6) AS value FROM s""")
def scenario_values(spark: Session, d: str) -> DataFrame:
    return rounded(simulation.scenarios(spark, {"units": 100, "price": 5, "cost": 200}, "units * price - cost"), 6)


@query()
def simulated_revenue(spark: Session, d: str) -> DataFrame:
    return simulation.revenue_paths(spark, 1000.0, 0.02, 0.05)


@query()
def series_holt_winters(spark: Session, d: str) -> DataFrame:
    return TS.holt_winters(monthly(spark, d), "period", "y", 12)


@query()
def geo_dbscan(spark: Session, d: str) -> DataFrame:
    return geo.dbscan(places(spark, d), "c_custkey", "lat", "lon", 300.0, 2)


@query()
def quality_profile(spark: Session, d: str) -> DataFrame:
    return quality.profile(load(spark, d, "lineitem"))


@query()
def quality_insights(spark: Session, d: str) -> DataFrame:
    return quality.insights(load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))


@query()
def quality_alerts(spark: Session, d: str) -> DataFrame:
    return quality.check_alerts(load(spark, d, "events"), [quality.Alert("gaps", "missing", "value", 10), quality.Alert("spikes", "anomaly", "value", 3), quality.Alert("load", "threshold", "rate", 5)], {"rate": 7.0})


# Sampling, outliers, features


@query("""WITH s AS (SELECT stddev_samp(c_acctbal) AS s, avg(c_acctbal) AS m FROM customer) SELECT c_custkey, round(abs(c_acctbal - m) / s, 4) AS score, abs(c_acctbal - m) / s > 1.5 AS is_outlier FROM customer, s""")
def outliers_zscore(spark: Session, d: str) -> DataFrame:
    return rounded(sampling.zscores(load(spark, d, "customer"), "c_acctbal", 1.5).select("c_custkey", "score", "is_outlier"))


@query("""WITH m AS (SELECT median(value) AS m FROM events), g AS (SELECT event_id, abs(value - m) AS g FROM events, m), s AS (SELECT median(g) AS mad FROM g) SELECT event_id, round(0.6745 * g / mad, 4) AS score, 0.6745 * g / mad > 3.5 AS is_outlier FROM g, s""")
def outliers_modified_zscore(spark: Session, d: str) -> DataFrame:
    return rounded(sampling.modified_zscores(load(spark, d, "events"), "value").select("event_id", "score", "is_outlier"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events, q""")
def outliers_iqr(spark: Session, d: str) -> DataFrame:
    return sampling.iqr_outliers(load(spark, d, "events"), "value").select("event_id", "is_outlier")


@query("""WITH c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d, avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem), x AS (SELECT l_quantity - mq AS q, l_discount - md AS p, a + 1e-6 AS a, b, d + 1e-6 AS d FROM lineitem, c)
SELECT round(avg(sqrt(greatest((d * q * q - 2 * b * q * p + a * p * p) / (a * d - b * b), 0))), 4) AS mean_distance FROM x""")
def outliers_mahalanobis(spark: Session, d: str) -> DataFrame:
    return rounded(sampling.mahalanobis(load(spark, d, "lineitem"), ["l_quantity", "l_discount"]).agg(F.avg("distance").alias("mean_distance")))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE value END AS v FROM events), x AS (SELECT event_id, v, last_value(v IGNORE NULLS) OVER a AS p, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER a AS pi, first_value(v IGNORE NULLS) OVER b AS n, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS ni FROM e WINDOW a AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING), b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, p + (n - p) * (event_id - pi) / (ni - pi), p), 4) AS v FROM x""")
def impute_interpolate(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("v"))
    return rounded(sampling.interpolate(e, "v", "event_id"))


@query()
def sample_stratified(spark: Session, d: str) -> DataFrame:
    return sampling.stratified_sample(load(spark, d, "events"), 200, "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 4) AS o_totalprice FROM orders, s""")
def feature_standardize(spark: Session, d: str) -> DataFrame:
    return rounded(features.scale(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("""WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / (b - a), 6) AS o_totalprice FROM orders, s""")
def feature_minmax(spark: Session, d: str) -> DataFrame:
    return rounded(features.scale(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "minmax"), 6)


@query("""WITH g AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part) AS f FROM part GROUP BY 1) SELECT p_partkey, round(f, 6) AS p_brand_frequency FROM part JOIN g USING (p_brand)""")
def feature_frequency(spark: Session, d: str) -> DataFrame:
    return rounded(features.encode(load(spark, d, "part"), "p_brand").select("p_partkey", "p_brand_frequency"), 6)


@query("""WITH t AS (SELECT avg(p_retailprice) AS m FROM part), g AS (SELECT p_brand, (sum(p_retailprice) + 10 * max(m)) / (count(*) + 10) AS v FROM part, t GROUP BY 1) SELECT p_partkey, round(v, 4) AS p_brand_target FROM part JOIN g USING (p_brand)""")
def feature_target_encoding(spark: Session, d: str) -> DataFrame:
    return rounded(features.encode(load(spark, d, "part"), "p_brand", "target", "p_retailprice").select("p_partkey", "p_brand_target"))


@query("""SELECT event_id, year(ts) AS ts_year, dayofyear(ts) AS ts_dayofyear, CAST(day(ts) = 1 AS INT) AS ts_is_month_start, round(sin(hour(ts) * 2 * pi() / 24), 4) AS ts_hour_sin, round(cos(((dayofweek(ts) + 6) % 7) * 2 * pi() / 7), 4) AS ts_dow_cos FROM events""")
def feature_dates(spark: Session, d: str) -> DataFrame:
    return rounded(dates.features(load(spark, d, "events").select("event_id", "ts"), "ts", ["year", "dayofyear", "is_month_start", "hour_sin", "dow_cos"]).drop("ts"))


# Statistics


@query("""SELECT round((avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus = 'O')) / sqrt(((count(*) FILTER (l_linestatus = 'F') - 1) * var_samp(l_quantity) FILTER (l_linestatus = 'F') + (count(*) FILTER (l_linestatus = 'O') - 1) * var_samp(l_quantity) FILTER (l_linestatus = 'O')) / (count(*) - 2) * (1 / count(*) FILTER (l_linestatus = 'F') + 1 / count(*) FILTER (l_linestatus = 'O'))), 4) AS statistic, CAST(count(*) - 2 AS DOUBLE) AS df FROM lineitem""")
def stats_t_test(spark: Session, d: str) -> DataFrame:
    return rounded(S.t_test(load(spark, d, "lineitem"), "l_linestatus", "l_quantity", "F", "O").select("statistic", "df"))


@query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT avg(value) AS m, count(*) AS n FROM events), s AS (SELECT sum(g.n * (g.m - t.m) ** 2) AS b, sum((g.n - 1) * v) AS w, count(*) AS k, max(t.n) AS n FROM g, t)
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS statistic, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within, round(b / (b + w), 6) AS eta_squared FROM s""")
def stats_anova(spark: Session, d: str) -> DataFrame:
    return S.anova(load(spark, d, "events"), "event_type", "value").select(F.round("statistic", 4).alias("statistic"), "df_between", "df_within", F.round("eta_squared", 6).alias("eta_squared"))


@query("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY value) AS t FROM events), s AS (SELECT event_type, sum(r) AS r, count(*) AS n FROM r GROUP BY 1), c AS (SELECT count(*) AS n, sum(t * t - 1) AS t FROM r)
SELECT round((12 / (max(c.n) * (max(c.n) + 1)) * sum(s.r * s.r / s.n) - 3 * (max(c.n) + 1)) / (1 - max(c.t) / (CAST(max(c.n) AS DOUBLE) ** 3 - max(c.n))), 4) AS statistic FROM s, c""")
def stats_kruskal(spark: Session, d: str) -> DataFrame:
    return rounded(S.kruskal(load(spark, d, "events"), "event_type", "value").select("statistic"))


@query("""WITH x AS (SELECT event_type, value FROM events WHERE event_type IN ('view', 'click')), r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM x)
SELECT round(sum(r) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'view') * (count(*) FILTER (event_type = 'view') + 1) / 2, 2) AS statistic FROM r""")
def stats_mann_whitney(spark: Session, d: str) -> DataFrame:
    return rounded(S.mann_whitney(load(spark, d, "events"), "event_type", "value", "view", "click").select("statistic"), 2)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT round(corr(x, y), 5) AS statistic, count(*) AS n FROM r""")
def stats_spearman(spark: Session, d: str) -> DataFrame:
    return rounded(S.correlation_test(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "spearman").select("statistic", "n"), 5)


@query("""SELECT count(*) AS n, round(skewness(l_quantity) * (count(*) - 2) / sqrt(count(*) * (CAST(count(*) AS DOUBLE) - 1)), 4) AS skewness, round(kurtosis_pop(l_quantity), 4) AS kurtosis FROM lineitem""")
def stats_normality(spark: Session, d: str) -> DataFrame:
    return rounded(S.normality(load(spark, d, "lineitem"), "l_quantity").select("n", "skewness", "kurtosis"))


@query("""WITH r AS (SELECT avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) FILTER (user_id % 2 = 0) AS a, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) FILTER (user_id % 2 = 1) AS b, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) AS p, count(*) FILTER (user_id % 2 = 0) AS n, count(*) FILTER (user_id % 2 = 1) AS m FROM events)
SELECT round(a, 6) AS control_rate, round(b, 6) AS treatment_rate, round((b - a) / a, 6) AS lift, round((b - a) / sqrt(p * (1 - p) * (1 / n + 1 / m)), 6) AS z FROM r""")
def stats_ab_proportions(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select((F.col("user_id") % 2).alias("variant"), (F.col("event_type") == "purchase").alias("bought"))
    return rounded(S.ab_proportions(e, "variant", "bought", 0, 1).select("control_rate", "treatment_rate", "lift", "z"), 6)


@query("""SELECT round(avg(value) FILTER (user_id % 2 = 1 AND day(ts) <= 15), 4) AS treated_before, round(avg(value) FILTER (user_id % 2 = 1 AND day(ts) > 15), 4) AS treated_after, round(avg(value) FILTER (user_id % 2 = 0 AND day(ts) <= 15), 4) AS control_before, round(avg(value) FILTER (user_id % 2 = 0 AND day(ts) > 15), 4) AS control_after,
round(avg(value) FILTER (user_id % 2 = 1 AND day(ts) > 15) - avg(value) FILTER (user_id % 2 = 1 AND day(ts) <= 15) - avg(value) FILTER (user_id % 2 = 0 AND day(ts) > 15) + avg(value) FILTER (user_id % 2 = 0 AND day(ts) <= 15), 4) AS effect FROM events""")
def stats_diff_in_diff(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "events").select((F.col("user_id") % 2).alias("t"), (F.day("ts") > 15).cast("int").alias("after"), "value")
    return rounded(S.diff_in_diff(e, "t", "after", "value"))


@query("""WITH x AS (SELECT l_linenumber AS t, count(*) AS leaving, count(*) FILTER (l_returnflag = 'R') AS events FROM lineitem GROUP BY 1), r AS (SELECT *, sum(leaving) OVER (ORDER BY t DESC) AS at_risk FROM x)
SELECT t AS "time", CAST(events AS BIGINT) AS events, leaving, CAST(at_risk AS BIGINT) AS at_risk, round(exp(sum(ln((at_risk - events) / at_risk)) OVER (ORDER BY t)), 6) AS survival FROM r""")
def survival_curve(spark: Session, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("back", F.col("l_returnflag") == "R")
    return rounded(S.kaplan_meier(df, "l_linenumber", "back").drop("ci_low", "ci_high"), 6)


@query("""WITH a AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS x, count(*) FILTER (l_returnflag = 'R') AS y FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) SELECT round(max(d), 6) AS statistic FROM (SELECT abs(sum(x) OVER (ORDER BY v) / sum(x) OVER () - sum(y) OVER (ORDER BY v) / sum(y) OVER ()) AS d FROM a)""")
def drift_ks(spark: Session, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return rounded(S.ks_two_sample(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_quantity").select("statistic"), 6)


# Text, vectors and geography


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', ' ', 'g'), '[!"#$%&''()*+,\\-./:;<=>?@\\[\\]\\\\^_`{|}~]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def text_cleaning(spark: Session, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", text.clean(F.col("text"), ["lowercase", "remove_numbers", "remove_punctuation", "remove_whitespace"]).alias("cleaned"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS word FROM documents) WHERE regexp_matches(word, '^[\\p{L}\\p{M}]{2,}$') GROUP BY 1""")
def text_word_counts(spark: Session, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, left(sha256(text), 16) AS hashed, '[TEXT]' AS redacted, left(text, 1) || repeat('*', CAST(length(text) - 1 AS INT)) AS masked FROM conversations""")
def text_masking(spark: Session, d: str) -> DataFrame:
    c = F.col("text")
    return load(spark, d, "conversations").select("conv_id", "turn", text.hash_value(c).alias("hashed"), text.redact(c, "text").alias("redacted"), text.partial_mask(c, "other").alias("masked"))


@query("""WITH q AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS x, string_split('green linen box', ' ') AS y FROM part) SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS jaccard, levenshtein(lower(p_name), 'green box') AS edits FROM q JOIN part USING (p_partkey)""")
def text_similarity(spark: Session, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return rounded(p.select("p_partkey", text.jaccard(F.col("p_name"), F.lit("green linen box")).alias("jaccard"), F.levenshtein(F.lower("p_name"), F.lit("green box")).cast("long").alias("edits")))


@query()
def text_tfidf(spark: Session, d: str) -> DataFrame:
    return text.tfidf(load(spark, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k", "text", 5)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 50) / 150.0) AS BIGINT), 1))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id AS key, CAST(i AS INT) AS chunk_index, CAST(i * 150 AS INT) AS "start", len(list_slice(w, i * 150 + 1, i * 150 + 200)) AS token_count, left(sha256(array_to_string(list_slice(w, i * 150 + 1, i * 150 + 200), ' ')), 16) AS hash FROM c""")
def text_chunks(spark: Session, d: str) -> DataFrame:
    return text.chunks(load(spark, d, "documents"), "doc_id", "text", 200, 50).drop("text").withColumn("token_count", F.col("token_count").cast("long"))


@query()
def text_sentiment(spark: Session, d: str) -> DataFrame:
    c = F.col("text")
    return load(spark, d, "conversations").select("conv_id", "turn", text.lexicon_sentiment(c).alias("lexicon"), text.scanned_sentiment(c).alias("scanned"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def vector_top_k(spark: Session, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return rounded(vectors.top_k(e, "vec_id", "embedding", list(q), 10), 6)


def places(spark: Session, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 120 - 60).cast("double").alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).cast("double").alias("lon"), "c_acctbal")


PLACES = "p AS (SELECT c_custkey, CAST(c_custkey % 120 - 60 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 360 - 180 AS DOUBLE) AS lon, c_acctbal FROM customer)"


@query(f"""WITH {PLACES} SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(least(sin(radians(lat - 48.0) / 2) ** 2 + cos(radians(48.0)) * cos(radians(lat)) * sin(radians(lon - 11.0) / 2) ** 2, 1))), 3) AS km,
round((degrees(atan2(sin(radians(lon - 11.0)) * cos(radians(lat)), cos(radians(48.0)) * sin(radians(lat)) - sin(radians(48.0)) * cos(radians(lat)) * cos(radians(lon - 11.0)))) + 360) % 360, 3) AS heading FROM p""")
def geo_distance(spark: Session, d: str) -> DataFrame:
    here, there = (F.lit(48.0), F.lit(11.0)), (F.col("lat"), F.col("lon"))
    return rounded(places(spark, d).select("c_custkey", geo.haversine(*here, *there).alias("km"), geo.bearing(*here, *there).alias("heading")), 3)


@query(f"""WITH {PLACES} SELECT 'g2_' || CAST(floor(lat / 12.8) AS BIGINT) || '_' || CAST(floor(lon / 12.8) AS BIGINT) AS cell, count(*) AS "count", round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon, round(avg(c_acctbal), 8) AS mean FROM p GROUP BY 1""")
def geo_cells(spark: Session, d: str) -> DataFrame:
    return rounded(geo.by_cell(places(spark, d), "lat", "lon", "c_acctbal", 2), 8)


@query(f"WITH {PLACES}, n AS (SELECT count(*) AS c FROM p GROUP BY floor(lat / 12.8), floor(lon / 12.8)) SELECT round(avg(c), 4) AS lat_spread, count(*) AS cells FROM n")
def geo_cell_spread(spark: Session, d: str) -> DataFrame:
    return rounded(geo.by_cell(places(spark, d), "lat", "lon", resolution=2).agg(F.avg("count").alias("lat_spread"), F.count("*").alias("cells")))


# SQL surface


@query("SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_dataset(spark: Session, d: str) -> DataFrame:
    return guarded.query_dataset(load(spark, d, "orders"), "WITH f AS (SELECT * FROM dataset WHERE o_orderstatus = 'F') SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM f GROUP BY o_orderpriority;")


@query("SELECT event_type, avg(value) AS value FROM events WHERE value > 100 GROUP BY 1".replace("avg(value)", "round(avg(value), 4)"))
def sql_question(spark: Session, d: str) -> DataFrame:
    return rounded(guarded.ask(load(spark, d, "events"), "What is the average value by event_type where value is above 100"))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name HAVING count(*) > 1")
def sql_builder(spark: Session, d: str) -> DataFrame:
    b = guarded.Builder().select("n_name", "count(*) AS customers").table("customer").join("nation", "c_nationkey = n_nationkey").where("c_acctbal > 0").group_by("n_name").having("count(*) > 1")
    return b.run(spark, customer=load(spark, d, "customer"), nation=load(spark, d, "nation"))


# Event-time windows


@query("""SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS "count", round(sum(value), 3) AS "sum" FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: Session, d: str) -> DataFrame:
    from ..streaming import windows

    out = windows.tumbling(load(spark, d, "events"), "ts", "6 hours", "value", keys=["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "count", F.round("sum", 3).alias("sum"))


@query("""SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS TIMESTAMP) AS window_start, count(*) AS "count", round(sum(value), 3) AS "sum" FROM events, range(0, 4) r(k) GROUP BY 1""")
def stream_sliding(spark: Session, d: str) -> DataFrame:
    from ..streaming import windows

    out = windows.sliding(load(spark, d, "events"), "ts", "24 hours", "6 hours", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "count", F.round("sum", 3).alias("sum"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS "count" FROM s GROUP BY user_id, k""")
def stream_sessions(spark: Session, d: str) -> DataFrame:
    from ..streaming import windows

    out = windows.session(load(spark, d, "events"), "ts", "2 hours", "value", ["count"], ["user_id"])
    return out.select("user_id", F.col("first_event").cast("timestamp_ntz").alias("first_event"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "count")


# Models


@query()
def ml_clusters(spark: Session, d: str) -> DataFrame:
    from ..operators import ml

    li = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return ml.cluster_quality(ml.cluster(li, ["l_quantity", "l_extendedprice", "l_discount"], 3))


@query()
def ml_leaderboard(spark: Session, d: str) -> DataFrame:
    from ..operators import ml

    o = load(spark, d, "orders").withColumn("big", (F.col("o_totalprice") > 250_000).cast("int")).select("o_orderkey", "o_orderpriority", "o_orderstatus", F.month("o_orderdate").alias("m"), "big")
    return ml.train(o, "big", "o_orderkey", "classification", ["logistic", "tree"])[0]


@query()
def ml_target_candidates(spark: Session, d: str) -> DataFrame:
    from ..operators import ml

    return ml.target_candidates(load(spark, d, "orders"))
