"""Further queries over the test tables, each with its SQL: exploratory operators, predicates, text and figures by period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import business as B
from ..operators import eda, transforms
from ..operators import sampling
from .catalog import load, query
from .queries import rounded

Session = SparkSession


@query("""SELECT * FROM (VALUES ('c_custkey', 'bigint', true, false, 0), ('c_name', 'string', true, true, 1), ('c_nationkey', 'int', true, false, 2),
('c_acctbal', 'double', true, false, 3), ('c_mktsegment', 'string', true, false, 4)) AS t("column", "type", nullable, is_pii, position)""")
def eda_schema_snapshot(spark: Session, d: str) -> DataFrame:
    return eda.schema_snapshot(load(spark, d, "customer"))


@query("""SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem""")
def eda_dataset_overview(spark: Session, d: str) -> DataFrame:
    return eda.dataset_overview(load(spark, d, "lineitem"))


@query("""SELECT c_custkey, '[REDACTED]' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 40""")
def eda_preview_rows(spark: Session, d: str) -> DataFrame:
    return eda.preview_rows(load(spark, d, "customer"), 40, ["c_custkey"])


@query("""SELECT o_orderstatus, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median,
round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders), 4) AS delta, round((SELECT avg(o_totalprice) FROM orders), 4) AS overall FROM orders GROUP BY 1""")
def eda_relationship_by_category(spark: Session, d: str) -> DataFrame:
    return rounded(eda.relationship_explain(load(spark, d, "orders"), "o_orderstatus", "o_totalprice"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2""")
def eda_relationship_pairs(spark: Session, d: str) -> DataFrame:
    return eda.relationship_explain(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH e AS (SELECT 'o_orderstatus' AS a, o_orderstatus AS c, o_totalprice AS x FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM orders),
g AS (SELECT a, c, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY 1, 2 HAVING count(*) >= 10),
h AS (SELECT a, (sum(s * s / n) - pow(sum(s), 2) / sum(n)) / (sum(q) - pow(sum(s), 2) / sum(n)) AS score FROM g GROUP BY 1),
p AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2), px AS (SELECT x, sum(n) AS nx FROM p GROUP BY 1), py AS (SELECT y, sum(n) AS ny FROM p GROUP BY 1),
t AS (SELECT sum(n) AS total, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM p),
v AS (SELECT sum(pow(coalesce(n, 0) - nx * ny / total, 2) / (nx * ny / total)) AS chi2 FROM px CROSS JOIN py CROSS JOIN t LEFT JOIN p USING (x, y))
SELECT a, 'o_totalprice' AS b, 'eta_squared' AS kind, round(score, 6) AS score FROM h
UNION ALL SELECT 'o_orderstatus', 'o_orderpriority', 'cramers_v', round(sqrt(chi2 / (total * (least(r, k) - 1))), 6) FROM v, t""")
def eda_association_scan(spark: Session, d: str) -> DataFrame:
    return rounded(eda.association_scan(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]), 6)


@query("""SELECT 'c_custkey' AS "column", false AS is_pii, true AS key_candidate, false AS is_constant UNION ALL SELECT 'c_name', true, count(DISTINCT c_name) >= 0.995 * count(*), count(DISTINCT c_name) <= 1 FROM customer
UNION ALL SELECT 'c_nationkey', false, count(DISTINCT c_nationkey) >= 0.995 * count(*), count(DISTINCT c_nationkey) <= 1 FROM customer
UNION ALL SELECT 'c_acctbal', false, count(DISTINCT c_acctbal) >= 0.995 * count(*), count(DISTINCT c_acctbal) <= 1 FROM customer
UNION ALL SELECT 'c_mktsegment', false, count(DISTINCT c_mktsegment) >= 0.995 * count(*), count(DISTINCT c_mktsegment) <= 1 FROM customer""")
def eda_privacy_risk_scan(spark: Session, d: str) -> DataFrame:
    return eda.privacy_risk_scan(load(spark, d, "customer"))


@query("""WITH s AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT "column", round(quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 4) AS lower, round(quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 4) AS upper,
round(quantile_cont(x, 0.01), 4) AS p01, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99 FROM s GROUP BY 1""")
def eda_outlier_explain(spark: Session, d: str) -> DataFrame:
    return rounded(eda.outlier_explain(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("""WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY 1)
SELECT CASE WHEN rn < 10 THEN p_brand ELSE '__OTHER__' END AS p_brand, count(*) AS n FROM part JOIN c USING (p_brand) GROUP BY 1""")
def eda_normalize_categorical(spark: Session, d: str) -> DataFrame:
    return eda.normalize_categorical(load(spark, d, "part").select("p_brand"), "p_brand", 10).groupBy("p_brand").agg(F.count("*").alias("n"))


#: Name and condition of each predicate that is counted, and the same condition in SQL.
PREDICATES = [
    ("eq", {"column": "s", "op": "eq", "value": "F"}, "coalesce(s = 'F', false)"),
    ("ne", {"column": "s", "op": "ne", "value": "F"}, "NOT coalesce(s = 'F', false)"),
    ("gt", {"column": "x", "op": "gt", "value": 100000}, "x > 100000"),
    ("gte", {"column": "x", "op": "gte", "value": 100000}, "x >= 100000"),
    ("lt", {"column": "x", "op": "lt", "value": 100000}, "x < 100000"),
    ("lte", {"column": "x", "op": "lte", "value": 100000}, "x <= 100000"),
    ("not_in", {"column": "s", "op": "not_in", "value": ["F", "O"]}, "NOT coalesce(s IN ('F', 'O'), false)"),
    ("startswith", {"column": "p", "op": "startswith", "value": "1-u"}, "starts_with(lower(p), '1-u')"),
    ("endswith", {"column": "p", "op": "endswith", "value": "GENT", "case_sensitive": True}, "ends_with(p, 'GENT')"),
    ("matches", {"column": "p", "op": "contains", "value": "^[1-3]-", "regex": True}, "regexp_matches(p, '^[1-3]-')"),
    ("is_null", {"column": "s", "op": "is_null"}, "s IS NULL"),
    ("not_null", {"column": "s", "op": "not_null"}, "s IS NOT NULL"),
]


@query("WITH t AS (SELECT NULLIF(o_orderstatus, 'P') AS s, o_totalprice AS x, o_orderpriority AS p FROM orders) " + " UNION ALL ".join(f"SELECT '{name}' AS predicate, count(*) AS n FROM t WHERE {sql}" for name, _, sql in PREDICATES))
def transform_predicates(spark: Session, d: str) -> DataFrame:
    t = load(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_totalprice").alias("x"), F.col("o_orderpriority").alias("p"))
    wide = t.agg(*[F.count_if(transforms.predicate(t, condition)).alias(name) for name, condition, _ in PREDICATES])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("predicate"), F.col(name).alias("n")) for name, _, _ in PREDICATES])))


@query("""SELECT o_orderkey AS key, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'""")
def transform_drop_missing_and_rename(spark: Session, d: str) -> DataFrame:
    t = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return transforms.rename_columns(transforms.drop_columns(transforms.drop_missing(t, ["s"]), ["s"]), {"o_orderkey": "key", "o_totalprice": "price"})


@query("""SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 30""")
def transform_last_rows(spark: Session, d: str) -> DataFrame:
    return transforms.limit_rows(load(spark, d, "events").select("event_id", "value"), 30, from_end=True, order_by=["event_id"])


_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"""WITH w AS (SELECT conv_id, turn, len(list_filter({_WORDS}, lambda x: list_contains({_listed(text.POSITIVE)}, x))) AS g, len(list_filter({_WORDS}, lambda x: list_contains({_listed(text.NEGATIVE)}, x))) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN g + b = 0 THEN 0.0 ELSE (g - b) / (g + b) END, 4) AS polarity FROM w""")
def text_lexicon_sentiment(spark: Session, d: str) -> DataFrame:
    return rounded(load(spark, d, "conversations").select("conv_id", "turn", text.lexicon_sentiment(F.col("text")).alias("polarity")))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE l_extendedprice < a OR l_extendedprice > b""")
def outliers_percentile(spark: Session, d: str) -> DataFrame:
    out = sampling.percentile_outliers(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 1.0)
    flags = [c for c, t in out.dtypes if t == "boolean"]
    return (out.where(reduce(lambda a, b: a | b, map(F.col, flags))) if flags else out).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, item LIMIT 20""")
def popular_parts(spark: Session, d: str) -> DataFrame:
    out = B.popular_items(load(spark, d, "lineitem").withColumn("one", F.lit(1.0)), "l_partkey", "one", 20)
    return out.join(load(spark, d, "lineitem"), "l_partkey").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"))
