"""Profiles, quality scores, validation rules, schema checks, drift of datasets, alerts and insights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import PATTERNS
from .eda import correlation, is_pii, missingness, moments, numeric_columns, outlier_scan, stacked, uniqueness_scan, value_ranks


def profile(df: DataFrame) -> DataFrame:
    """A row per column: counts, distinct values, range and moments of numbers, lengths of texts, and flags."""
    x = lambda c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")
    size = lambda c: F.char_length(c) if isinstance(df.schema[c].dataType, T.StringType) else F.lit(None).cast("int")
    out = stacked(df, df.columns, {
        "rows": lambda c: F.count("*"), "non_null": lambda c: F.count(c), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)), "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c)),
        "skewness": lambda c: F.skewness(x(c)), "kurtosis": lambda c: F.kurtosis(x(c)), "min_length": lambda c: F.min(size(c)), "max_length": lambda c: F.max(size(c)), "avg_length": lambda c: F.avg(size(c)),
    })
    # Distinct counts expand the rows once per column, so the other figures stay out of that aggregate.
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    numbers = numeric_columns(df)
    seen = stacked(df, [c for c in df.columns if c not in numbers], {"unique": lambda c: F.count_distinct(F.col(c))}).select("column", F.col("unique").cast("long").alias("unique"), *[F.lit(None).cast("double").alias(k) for k in shares])
    seen = seen.unionByName(value_ranks(df, numbers, shares)) if numbers else seen
    out = out.join(F.broadcast(seen), "column", "left").withColumn("unique", F.coalesce("unique", F.lit(0).cast("long")))
    out = out.select("column", "rows", "non_null", "mean", "std", "min", *shares, "max", "skewness", "kurtosis", "min_length", "max_length", "avg_length", "unique")
    kinds = F.create_map(*[F.lit(v) for c, t in df.dtypes for v in (c, t)])
    pii = F.array(*[F.lit(c) for c in df.columns if is_pii(c)]).cast("array<string>")
    return out.withColumns({
        "type": kinds[F.col("column")], "null_pct": F.coalesce(F.try_divide((F.col("rows") - F.col("non_null")) * 100.0, F.col("rows")), F.lit(0.0)),
        "is_constant": F.col("unique") <= 1, "is_unique_id": (F.col("unique") == F.col("rows")) & (F.col("rows") > 1), "is_pii": F.array_contains(pii, F.col("column")),
    })


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct")).select("rows", (F.col("rows") - F.col("distinct")).alias("duplicates"))


def overall_score(df: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 uniqueness + 0.3 consistency."""
    cells = missingness(df).agg(F.sum("null_count").alias("nulls"))
    known = sum(not isinstance(f.dataType, T.NullType) for f in df.schema.fields) / max(1, len(df.columns))
    out = cells.crossJoin(duplicate_rows(df)).select(
        (1 - F.coalesce(F.try_divide("nulls", F.col("rows") * len(df.columns)), F.lit(0.0))).alias("completeness"),
        (1 - F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0))).alias("uniqueness"), F.lit(known).alias("consistency"),
    )
    return out.withColumn("overall", 0.4 * F.col("completeness") + 0.3 * F.col("uniqueness") + 0.3 * F.col("consistency"))


def column_scores(df: DataFrame) -> DataFrame:
    """100 less half of the null share (30 at most) and 0.3 of the outlier share (15 at most)."""
    out = missingness(df).join(outlier_scan(df).select("column", "outlier_pct"), "column", "left")
    score = 100 - F.least(0.5 * F.col("null_pct"), F.lit(30.0)) - F.least(0.3 * F.coalesce("outlier_pct", F.lit(0.0)), F.lit(15.0))
    return out.withColumns({"score": score, "grade": F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")})


def missing_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows by which columns they lack."""
    names = columns or df.columns
    mask = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)).otherwise(F.lit("")) for c in names]), lambda c: c != ""), ",")
    return df.groupBy(mask.alias("missing")).agg(F.count("*").alias("rows"))


def missing_mechanism(df: DataFrame, column: str) -> DataFrame:
    """Correlation of the null flag with each numeric column: none large MCAR, few MAR, many MNAR."""
    from .eda import safe_corr

    others = [c for c in numeric_columns(df) if c != column]
    flag = F.col(column).isNull().cast("double")
    wide = df.agg(*[safe_corr(flag, F.col(c)).alias(f"r{i}") for i, c in enumerate(others)])
    large = sum([(F.coalesce(F.abs(F.col(f"r{i}")), F.lit(0.0)) > 0.1).cast("int") for i in range(len(others))], F.lit(0))
    return wide.select(F.lit(column).alias("column"), large.alias("related"), F.when(large == 0, "MCAR").when(large <= max(1, len(df.columns) // 3), "MAR").otherwise("MNAR").alias("mechanism"))


@dataclass
class Rule:
    """``kind``: not_null, type, range, pattern, in_set, length or custom (a Column that is true where a row passes)."""

    column: str
    kind: str
    params: dict = field(default_factory=dict)
    level: str = "error"
    name: str = ""

    def fails(self, df: DataFrame) -> Column:
        c, p = F.col(self.column), self.params
        if self.kind == "not_null":
            out = c.isNull()
        elif self.kind == "type":
            out = c.try_cast({"numeric": "double", "datetime": "timestamp", "boolean": "boolean"}.get(p["type"], p["type"])).isNull() & c.isNotNull()
        elif self.kind == "range":
            out = (c < p["min"] if "min" in p else F.lit(False)) | (c > p["max"] if "max" in p else F.lit(False))
        elif self.kind == "pattern":
            out = ~c.cast("string").rlike(f"(?i)^(?:{p['pattern']})")
        elif self.kind == "in_set":
            out = ~c.isin(*p["values"])
        elif self.kind == "length":
            out = ~F.char_length(c).between(p.get("min", 0), p.get("max", 1 << 30))
        else:
            out = ~p["check"]
        return F.coalesce(out, F.lit(False))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Failing rows of all rules in one pass; a null passes every rule but not_null."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(r.fails(df)).alias(f"f{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name or f"{r.column}_{r.kind}").alias("rule"), F.lit(r.column).alias("column"), F.lit(r.level).alias("level"), F.col(f"f{i}").alias("failed")) for i, r in enumerate(rules)])
    return wide.select("rows", F.inline(rows)).withColumn("passed", F.col("failed") == 0)


def violations(df: DataFrame, rule: Rule, limit: int = 100) -> DataFrame:
    return df.where(rule.fails(df)).limit(limit)


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Members of all groups of equal keys, nulls being equal."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed"))


def validate_schema(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    own = dict(df.dtypes)
    rows = [(c, t, own.get(c), "missing" if c not in own else "ok" if own[c] == t else "type") for c, t in expected.items()] + [(c, None, t, "unexpected") for c, t in own.items() if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, status string")


def infer_semantic_types(df: DataFrame, least: float = 0.8) -> DataFrame:
    """By the share of values that match a pattern, then by type, then by how many values are distinct."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wide = df.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in texts], *[F.avg(F.char_length(c)).alias(f"l_{c}") for c in texts], *[F.avg(F.col(c).rlike(p).cast("double")).alias(f"s_{c}_{k}") for c in texts for k, p in PATTERNS.items()]).first()
    rows = []
    for f in df.schema.fields:
        kind, sure = "numeric" if isinstance(f.dataType, T.NumericType) else "datetime" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else f.dataType.typeName(), 1.0
        if f.name in texts:
            best = max(PATTERNS, key=lambda k: wide[f"s_{f.name}_{k}"] or 0.0)
            sure = wide[f"s_{f.name}_{best}"] or 0.0
            if sure >= least:
                kind = best
            else:
                few = wide[f"d_{f.name}"] < 20 or wide[f"d_{f.name}"] < 0.05 * wide["_n"]
                kind, sure = ("categorical" if few else "text" if (wide[f"l_{f.name}"] or 0) > 50 else "string"), 0.7
        rows.append((f.name, kind, float(sure)))
    return df.sparkSession.createDataFrame(rows, "column string, semantic_type string, confidence double")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two profiles by column: means and deviations within 5 % match."""
    pick = lambda df, s: moments(df, numeric_columns(df)[:100]).select("column", F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}"), F.col("count").alias(f"count_{s}"))
    both = pick(a, "a").join(pick(b, "b"), "column", "full")
    gap = lambda x: F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) <= 0.05 * F.abs(F.col(f"{x}_a"))
    return both.withColumn("matches", F.coalesce(gap("mean") & gap("std"), F.lit(False)))


def compare_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by status: same, changed, only in a, only in b."""
    others = [c for c in a.columns if c in b.columns and c not in keys]
    x = a.select(*keys, F.xxhash64(*others).alias("_a") if others else F.lit(0).alias("_a"))
    y = b.select(*keys, F.xxhash64(*others).alias("_b") if others else F.lit(0).alias("_b"))
    status = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return x.join(y, keys, "full").groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def compare_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.intersect(y).agg(F.count("*").alias("common")).crossJoin(x.union(y).distinct().agg(F.count("*").alias("all"))).withColumn("share", F.try_divide("common", "all"))


# Duplicates


def duplicate_key(columns: list[str]) -> Column:
    """Lower-cased values with runs of white space as one, joined."""
    return F.concat_ws("|", *[F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"\s+", " ")) for c in columns])


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(duplicate_key(columns).alias("key")).agg(F.count("*").alias("rows")).where("rows > 1")


def fuzzy_duplicates(df: DataFrame, key: str, column: str, least: float = 0.8, block: int = 3) -> DataFrame:
    """Distinct values whose edit ratio reaches ``least``, met by the beginnings of ``block`` letters of any of their words."""
    own = df.groupBy(duplicate_key([column]).alias("v")).agg(F.min(key).alias("k"), F.count("*").alias("rows"))
    blocked = own.select("v", "k", "rows", F.explode(F.array_distinct(F.transform(F.split("v", " "), lambda w: F.left(w, F.lit(block))))).alias("b"))
    pairs = blocked.alias("x").join(blocked.alias("y"), (F.col("x.b") == F.col("y.b")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.col("x.k").alias("key_a"), F.col("y.k").alias("key_b")).distinct()
    ratio = 1 - F.levenshtein("a", "b") / F.greatest(F.char_length("a"), F.char_length("b"))
    return pairs.withColumn("ratio", ratio).where(F.col("ratio") >= least)


def corpus_checks(docs: DataFrame, key: str, text: str, time: str | None = None, short: int = 50) -> DataFrame:
    """check, value: rows, empty and short texts, copies, mean length, odd characters and the oldest row, measured on all rows."""
    c = F.coalesce(F.col(text), F.lit(""))
    copies = docs.groupBy(F.sha2(c, 256).alias("h")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).cast("double").alias("copies"))
    odd = F.char_length(F.regexp_replace(c, r"[^\x{FFFD}\x{0}-\x{8}]", ""))
    figures = docs.agg(
        F.count("*").cast("double").alias("rows"), F.count_if(F.trim(c) == "").cast("double").alias("empty"), F.count_if(F.char_length(c) < short).cast("double").alias("short"),
        F.avg(F.char_length(c)).alias("mean_length"), F.count_if(odd > 0).cast("double").alias("odd_characters"), F.count_distinct(key).cast("double").alias("keys"),
        *([F.min(F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("oldest")] if time else []),
    )
    wide = figures.crossJoin(copies)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value")) for n in wide.columns])))


# Alerts and insights


@dataclass
class Alert:
    """``kind``: threshold (metric, condition, limit), missing (column, limit in percent), anomaly (column, limit in deviations) or custom
    (a function from a DataFrame to a one-row DataFrame with a ``fired`` column)."""

    name: str
    kind: str
    column: str = ""
    limit: float = 0.0
    condition: str = ">"
    severity: str = "warning"
    check: Callable[[DataFrame], DataFrame] | None = None
    enabled: bool = True


def check_alerts(df: DataFrame, alerts: list[Alert], metrics: dict[str, float] | None = None) -> DataFrame:
    """name, severity, value, fired; rules over columns share one aggregate."""
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    rows, columns = [], [a for a in alerts if a.enabled and a.kind in ("missing", "anomaly")]
    if columns:
        figures = []
        for i, a in enumerate(columns):
            x = F.col(a.column)
            figures += [F.avg(x.isNull().cast("double")).alias(f"m{i}")] if a.kind == "missing" else [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
        got = df.agg(*figures).first()
        for i, a in enumerate(columns):
            if a.kind == "missing":
                value = 100.0 * (got[f"m{i}"] or 0.0)
            else:
                s = got[f"s{i}"] or 0.0
                value = max(got[f"hi{i}"] - got[f"a{i}"], got[f"a{i}"] - got[f"lo{i}"]) / s if s and got[f"n{i}"] >= 10 else 0.0
            rows.append((a.name, a.severity, float(value), bool(value > a.limit)))
    for a in alerts:
        if a.enabled and a.kind == "threshold" and metrics and a.column in metrics:
            rows.append((a.name, a.severity, float(metrics[a.column]), compare[a.condition](metrics[a.column], a.limit)))
        elif a.enabled and a.kind == "custom" and a.check:
            r = a.check(df).first()
            rows.append((a.name, a.severity, 0.0, bool(r and r["fired"])))
    return df.sparkSession.createDataFrame(rows, "name string, severity string, value double, fired boolean")


def insights(df: DataFrame, top: int = 20) -> DataFrame:
    """Findings of several detectors with a score, the strongest first: gaps, skew, outliers, strong correlations, keys and constants."""
    numbers = profile(df)
    text = lambda kind, message, score: (F.lit(kind).alias("kind"), message.alias("message"), score.cast("double").alias("score"))
    parts = [
        numbers.where("null_pct > 5").select(*text("missing", F.format_string("%s is missing in %.1f %% of rows", "column", "null_pct"), F.col("null_pct") / 100)),
        numbers.where("abs(skewness) > 1").select(*text("skew", F.format_string("%s is skewed (%.2f)", "column", "skewness"), F.least(F.abs("skewness") / 10, F.lit(1.0)))),
        numbers.where("is_constant").select(*text("constant", F.format_string("%s has one value", "column"), F.lit(0.5))),
        outlier_scan(df).where("outlier_pct > 5").select(*text("outliers", F.format_string("%s has %.1f %% outliers", "column", "outlier_pct"), F.col("outlier_pct") / 100)),
        correlation(df).where("abs(r) > 0.7").select(*text("correlation", F.format_string("%s and %s correlate (%.2f)", "a", "b", "r"), F.abs("r"))),
        uniqueness_scan(df).where("key_candidate").select(*text("key", F.format_string("%s identifies rows", "column"), F.lit(0.3))),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "message").limit(top)
