"""Exploratory operators by name. Each takes a DataFrame and parameters, which are clamped to their limits, and returns a table.

Column-wise figures come from one wide aggregate that is turned into rows, so a table is read once however many columns it has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.order import in_ranges
from .timeseries import resample

#: Words in a column's name that mark personal data.
PII_WORDS = ("email", "phone", "ssn", "address", "name", "passport", "card")
MISSING, OTHER = "__MISSING__", "__OTHER__"


def clamp(x, lo, hi):
    return max(lo, min(x, hi))


def is_pii(column: str) -> bool:
    return any(w in column.lower() for w in PII_WORDS)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def category_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def stacked(df: DataFrame, columns: list[str], figures: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One aggregate over all columns, a row for each column."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{k} double" for k in figures))
    wide = df.agg(*[f(c).alias(f"{k}__{i}") for i, c in enumerate(columns) for k, f in figures.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}__{i}").alias(k) for k in figures]) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def value_ranks(df: DataFrame, columns: list[str], shares: dict[str, float]) -> DataFrame:
    """A row per numeric column: its distinct values and exact percentiles, interpolated as ``percentile`` does.

    No task holds a column's values: they are counted, the counts lie in stored ranges of (column, value), and only ranges that
    hold a wanted rank are added up row by row.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, unique long, " + ", ".join(f"{k} double" for k in shares))
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(i)
    counted = []
    for those in kinds.values():
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(columns[i]).alias("x")) for i in those]))).where(F.col("x").isNotNull())
        counted.append(rows.groupBy("_c", "x").agg(F.count("*").alias("n")).select("_c", F.col("x").cast("double").alias("x"), "n"))
    ranked = in_ranges(reduce(DataFrame.unionAll, counted), "_c", "x")
    every = Window.partitionBy("_c")
    parts = ranked.groupBy("_c", "_part").agg(F.sum("n").alias("_rows"), F.count("*").alias("_values"))
    parts = parts.withColumns({"_before": F.sum("_rows").over(every.orderBy("_part")) - F.col("_rows"), "_last": F.sum("_rows").over(every) - 1, "unique": F.sum("_values").over(every)})
    at = {k: F.col("_last") * F.lit(q) for k, q in shares.items()}
    ends = [e(p).cast("long") for p in at.values() for e in (F.floor, F.ceil)]
    held = reduce(lambda x, y: x | y, [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_rows")) for k in ends])
    some = ranked.join(F.broadcast(parts.where(held).drop("_values")), ["_c", "_part"])
    some = some.withColumn("_to", F.col("_before") + F.sum("n").over(Window.partitionBy("_c", "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    found = lambda k: F.max(F.when((F.col("_to") - F.col("n") <= k) & (k < F.col("_to")), F.col("x")))
    wide = some.groupBy("_c", "_last", "unique").agg(*[found(k).alias(f"_e{j}") for j, k in enumerate(ends)])
    figures = []
    for j, (k, p) in enumerate(at.items()):
        low, high = F.col(f"_e{2 * j}"), F.col(f"_e{2 * j + 1}")
        figures.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(k))
    return wide.select(F.array(*[F.lit(c) for c in columns])[F.col("_c")].alias("column"), "unique", *figures)


def schema_snapshot(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable, is_pii(f.name), i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean, is_pii boolean, position int")


def dataset_overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def preview_rows(df: DataFrame, limit: int = 25, order_by: list[str] | None = None) -> DataFrame:
    """The first rows along ``order_by``; values of personal columns are masked."""
    out = df.orderBy(*order_by) if order_by else df
    return out.limit(clamp(limit, 1, 200)).withColumns({c: F.when(F.col(c).isNotNull(), F.lit("[REDACTED]")) for c in df.columns if is_pii(c)})


def missingness(df: DataFrame) -> DataFrame:
    return stacked(df, df.columns, {"null_count": lambda c: F.count_if(F.col(c).isNull()), "rows": lambda c: F.count("*")}).select(
        "column", "null_count", F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("rows")), F.lit(0.0)).alias("null_pct")
    )


def uniqueness_scan(df: DataFrame, max_columns: int = 200) -> DataFrame:
    out = stacked(df, df.columns[: clamp(max_columns, 1, 200)], {"rows": lambda c: F.count("*"), "non_null": lambda c: F.count(c), "unique": lambda c: F.count_distinct(F.col(c))})
    ratio = F.col("unique") / F.greatest(F.col("non_null"), F.lit(1))
    return out.select("column", "non_null", (F.col("rows") - F.col("non_null")).alias("null"), "unique", ratio.alias("unique_ratio"), (F.col("non_null") - F.col("unique")).alias("duplicates"), ((ratio >= 0.995) & (F.col("rows") == F.col("non_null")) & (F.col("rows") > 0)).alias("key_candidate"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min and max, a row for each numeric column."""
    x = lambda c: F.col(c).cast("double")
    return stacked(df, columns, {"count": lambda c: F.count(c), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)), "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c))})


def numeric_summary(df: DataFrame, max_columns: int = 25) -> DataFrame:
    """Moments and quartiles, a row for each numeric column; the quartiles' counted values are stored when it is called."""
    names, shares = numeric_columns(df)[: clamp(max_columns, 1, 100)], {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    ranks = value_ranks(df, names, shares).drop("unique")
    return moments(df, names).join(F.broadcast(ranks), "column", "left").select("column", "count", "mean", "std", "min", *shares, "max")


def categorical_topk(df: DataFrame, k: int = 10, max_columns: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The most frequent values, null among them, of categorical columns that aren't personal and have 1 to 1000 values."""
    names = columns or [c for c in category_columns(df) if not is_pii(c)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, pct double")
    distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    names = [c for c in names if 1 <= (distinct[c] or 0) <= 1000][: clamp(max_columns, 1, 50)]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    by = Window.partitionBy("column")
    return counts.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), F.asc_nulls_last("value")))).where(F.col("rank") <= clamp(k, 3, 50))


def text_summary(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return stacked(df, names, {
        "non_null": lambda c: F.count(c), "avg_length": lambda c: F.avg(F.char_length(c)), "min_length": lambda c: F.min(F.char_length(c)), "max_length": lambda c: F.max(F.char_length(c)),
        "blank_share": lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.trim(c) == "").cast("double"))),
    })


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; null where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation(df: DataFrame, columns: list[str] | None = None, top: int = 200) -> DataFrame:
    """Pairwise Pearson, by absolute value; infinite values count as missing and personal columns are left out."""
    names = columns or [c for c in numeric_columns(df) if not is_pii(c)]
    finite = df.select(*[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in names])
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    wide = finite.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))
    return rows.where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def normalize_categorical(df: DataFrame, column: str, max_levels: int = 50) -> DataFrame:
    """Null becomes ``__MISSING__``; beyond ``max_levels`` the rarer levels become ``__OTHER__``."""
    filled = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(MISSING)))
    counts = filled.groupBy(column).count().withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("count"), column)))
    kept = counts.where((F.col("_rn") < max_levels) | ((F.col("_rn") == max_levels) & (F.lit(counts.count()) <= max_levels))).select(F.col(column).alias("_kept"))
    return filled.join(F.broadcast(kept), F.col(column) == F.col("_kept"), "left").withColumn(column, F.coalesce("_kept", F.lit(OTHER))).drop("_kept")


def eta_squared(df: DataFrame, category: str, value: str, min_group: int = 10) -> DataFrame:
    """Share of a value's variance that lies between groups of at least ``min_group`` rows."""
    x = F.col(value).cast("double")
    groups = df.where(x.isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where(F.col("n") >= min_group)
    total = F.sum("q") - F.pow(F.sum("s"), 2) / F.sum("n")
    between = F.sum(F.pow(F.col("s"), 2) / F.col("n")) - F.pow(F.sum("s"), 2) / F.sum("n")
    return groups.agg(F.lit(category).alias("a"), F.lit(value).alias("b"), F.when(total > 0, between / total).alias("score"), F.sum("n").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = False) -> DataFrame:
    """Chi-square over the contingency table and Cramer's V; no continuity correction unless ``yates`` and 2 x 2."""
    cells = df.groupBy(F.coalesce(F.col(a).cast("string"), F.lit(MISSING)).alias("x"), F.coalesce(F.col(b).cast("string"), F.lit(MISSING)).alias("y")).agg(F.count("*").alias("n"))
    all_x, all_y = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    size = cells.agg(F.sum("n").alias("total"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
    grid = F.broadcast(all_x).crossJoin(F.broadcast(all_y)).join(cells, ["x", "y"], "left").crossJoin(F.broadcast(size))
    expected = F.col("nx") * F.col("ny") / F.col("total")
    gap = F.abs(F.coalesce(F.col("n"), F.lit(0)) - expected)
    gap = F.when(F.lit(yates) & (F.col("r") == 2) & (F.col("c") == 2), F.greatest(gap - 0.5, F.lit(0.0))).otherwise(gap)
    out = grid.agg(F.sum(F.pow(gap, 2) / expected).alias("chi2"), F.max("total").alias("n"), (F.least(F.max("r"), F.max("c")) - 1).alias("k"), ((F.max("r") - 1) * (F.max("c") - 1)).alias("dof"))
    return out.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "chi2", "dof", F.when(F.col("k") > 0, F.sqrt(F.col("chi2") / (F.col("n") * F.col("k")))).alias("score"), "n")


def association_scan(df: DataFrame, categories: list[str] | None = None, values: list[str] | None = None, min_group_size: int = 10, max_pairs: int = 200) -> DataFrame:
    cats = categories or [c for c in category_columns(df) if not is_pii(c)]
    nums = values or [c for c in numeric_columns(df) if not is_pii(c)]
    parts = [eta_squared(df, a, b, min_group_size).select("a", "b", F.lit("eta_squared").alias("kind"), "score") for a in cats for b in nums]
    parts += [cramers_v(df, a, b).select("a", "b", F.lit("cramers_v").alias("kind"), "score") for a, b in combinations(cats, 2)]
    out = parts[0]
    for p in parts[1:max_pairs]:
        out = out.unionByName(p)
    return out.where("score IS NOT NULL").orderBy(F.desc("score"), "a", "b")


def relationship_bins(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Equal-count bins of ``a`` with the range of a and the count, mean and median of b."""
    from .transforms import bin_code, quantile_edges

    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = quantile_edges(both, a, bins)
    coded = both.withColumn("bin", bin_code(F.col(a), edges) if len(edges) > 1 else F.lit(0))
    return coded.groupBy("bin").agg(F.min(a).alias("a_min"), F.max(a).alias("a_max"), F.count("*").alias("count"), F.avg(b).alias("b_mean"), F.median(b).alias("b_median"))


def relationship_explain(df: DataFrame, a: str, b: str, top: int = 250) -> DataFrame:
    """By the columns' kinds: binned statistics, statistics by category, or the most frequent pairs."""
    if is_pii(a) or is_pii(b):
        raise ValueError("personal columns aren't explained")
    numbers = numeric_columns(df)
    if a in numbers and b in numbers:
        return relationship_bins(df, a, b)
    if a not in numbers and b not in numbers:
        return df.groupBy(a, b).agg(F.count("*").alias("count")).orderBy(F.desc("count"), a, b).limit(top)
    cat, num = (a, b) if b in numbers else (b, a)
    overall = df.agg(F.avg(num).alias("overall"))
    stats = df.groupBy(cat).agg(F.count(num).alias("count"), F.avg(num).alias("mean"), F.median(num).alias("median"))
    return stats.crossJoin(F.broadcast(overall)).withColumn("delta", F.col("mean") - F.col("overall"))


def resample_aggregate(df: DataFrame, time_column: str, value_column: str, freq: str = "D", max_points: int = 200) -> DataFrame:
    """Count, mean and sum by period, empty periods included; days give way to weeks and months until the points fit."""
    lo, hi = df.agg(F.min(time_column), F.max(time_column)).first()
    days = (hi - lo).days + 1 if lo is not None else 0
    for wider in ("D", "W", "M"):
        if "DWM".index(wider) >= "DWM".index(freq):
            freq = wider
            if days / {"D": 1, "W": 7, "M": 30.44}[wider] <= clamp(max_points, 10, 2000):
                break
    return resample(df, time_column, value_column, freq)


def time_anomaly_scan(df: DataFrame, time_column: str, value_column: str | None = None, freq: str = "D", iqr_k: float = 3.0, max_change_points: int = 10) -> DataFrame:
    """Periods outside the fences, and the largest changes between periods."""
    made = resample(df, time_column, value_column, freq)
    series = made.select("period", F.col("sum" if value_column else "count").cast("double").alias("value"))
    k = clamp(iqr_k, 1.0, 10.0)
    fences = series.agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"), F.count("value").alias("points"))
    by = Window.orderBy("period")
    delta = F.col("value") - F.lag("value").over(by)
    scored = series.withColumn("delta", delta).crossJoin(F.broadcast(fences))
    iqr = F.col("q3") - F.col("q1")
    anomaly = (F.col("points") >= 6) & ((F.col("value") < F.col("q1") - k * iqr) | (F.col("value") > F.col("q3") + k * iqr))
    ranked = scored.withColumn("anomaly", F.coalesce(anomaly, F.lit(False))).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("delta")), "period")))
    change = F.col("delta").isNotNull() & (F.col("place") <= clamp(max_change_points, 1, 50)) & (F.col("delta") != 0)
    kind = F.when(F.col("anomaly") & change, "anomaly_change_point").when(F.col("anomaly"), "anomaly").when(change, "change_point")
    return ranked.select("period", "value", "delta", F.try_divide(F.col("delta") * 100.0, F.abs(F.col("value") - F.col("delta"))).alias("pct_change"), kind.alias("event")).where("event IS NOT NULL")


def segment_summary(df: DataFrame, group_by: str, value: str | None = None, sort_by: str = "count", ascending: bool = False, limit: int = 50) -> DataFrame:
    x = F.col(value).cast("double") if value else None
    figures = [F.count("*").alias("count")] + ([F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.median(x).alias("median")] if value else [])
    out = df.groupBy(group_by).agg(*figures)
    return out.orderBy(F.col(sort_by).asc() if ascending else F.col(sort_by).desc(), group_by).limit(clamp(limit, 5, 200))


def outlier_scan(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Values beyond the fences; the share is of all rows, those without a value included."""
    from .transforms import bounds

    fences = {c: b for c, b in bounds(df, columns or numeric_columns(df), "iqr", k).items() if b[0] < b[1]}
    return stacked(df, list(fences), {
        "lower": lambda c: F.max(F.lit(fences[c][0])), "upper": lambda c: F.max(F.lit(fences[c][1])),
        "outliers": lambda c: F.count_if((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1])),
        "outlier_pct": lambda c: F.count_if((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1])) * 100.0 / F.count("*"),
    })


def privacy_risk_scan(df: DataFrame) -> DataFrame:
    u = uniqueness_scan(df)
    return u.select("column", F.lower("column").rlike("|".join(PII_WORDS)).alias("is_pii"), "key_candidate", (F.col("unique") <= 1).alias("is_constant"))


def missingness_patterns(df: DataFrame, column: str, by: str, min_rows: int = 25) -> DataFrame:
    """Missing rate of a column within each value of another that has enough rows."""
    return df.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("rows"), F.avg(F.col(column).isNull().cast("double")).alias("missing_rate")).where(F.col("rows") >= min_rows)


def outlier_explain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fences and percentiles, a row for each column that has values; the counted values are stored when it is called."""
    names, shares = list(dict.fromkeys(columns)), {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    places = [str(i) for i in range(len(names))]
    ranks = value_ranks(df.select(*[F.col(c).cast("double").alias(i) for i, c in zip(places, names)]), places, shares)
    place, reach = F.col("column").cast("int"), 1.5 * (F.col("p75") - F.col("p25"))
    return ranks.orderBy(place).select(F.array(*map(F.lit, names)).cast("array<string>")[place].alias("column"), (F.col("p25") - reach).alias("lower"), (F.col("p75") + reach).alias("upper"), "p01", "p05", "p50", "p95", "p99")


def segment_deep_dive(df: DataFrame, group_by: str, columns: list[str] | None = None, limit: int = 250) -> DataFrame:
    """Each segment's mean of each numeric column minus the overall mean, by size."""
    names = columns or numeric_columns(df)
    overall = df.agg(*[F.avg(c).alias(f"o{i}") for i, c in enumerate(names)])
    means = df.groupBy(group_by).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).crossJoin(F.broadcast(overall))
    long = means.select(F.col(group_by).alias("segment"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), (F.col(f"m{i}") - F.col(f"o{i}")).alias("delta")) for i, c in enumerate(names)])))
    return long.orderBy(F.desc_nulls_last(F.abs("delta")), "segment", "column").limit(limit)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (schema_snapshot, dataset_overview, preview_rows, missingness, uniqueness_scan, numeric_summary, categorical_topk, text_summary, correlation, association_scan, relationship_explain, resample_aggregate, time_anomaly_scan, segment_summary, outlier_scan, privacy_risk_scan, missingness_patterns, outlier_explain, segment_deep_dive)
}


def register(name: str, operator: Callable[..., DataFrame]) -> None:
    OPERATORS[name] = operator


def run_plan(df: DataFrame, plan: list[dict]) -> dict[str, DataFrame]:
    """The tables of a plan ``[{"operator": name, "params": {...}}]``, by place and name, all lazy."""
    return {f"{i}_{s['operator']}": OPERATORS[s["operator"]](df, **s.get("params", {})) for i, s in enumerate(plan)}
