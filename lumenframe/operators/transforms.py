"""The transform pipeline: a list of steps, each ``{"op": name, "params": {...}}``, folded over a DataFrame.

Row order means a given ``order_by``; steps that depend on it (forward and backward fill, keep first or last, head and tail)
ask for it. Bounds, modes and bin edges come from one aggregate a step, joined as a one-row broadcast or read as literals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Limits of parameters.
MAX_LIMIT, MIN_BINS, MAX_BINS = 5_000_000, 2, 100
TIME_FEATURES = ("year", "quarter", "month", "week", "day", "day_of_week", "is_weekend", "hour")
_TYPES = {"int": "bigint", "integer": "bigint", "float": "double", "numeric": "double", "number": "double", "string": "string", "text": "string", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
_TRUE = ("true", "1", "yes", "y", "t")


def _need(df: DataFrame, columns: list[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return columns


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _order(order_by) -> list[Column]:
    if not order_by:
        raise ValueError("this step depends on row order: give order_by")
    return [F.col(c) for c in _listed(order_by)]


def type_convert(df: DataFrame, column: str, to: str, errors: str = "raise", format: str | None = None) -> DataFrame:
    """Cast; ``errors="coerce"`` makes what can't be cast null. Text becomes True only for true, 1, yes, y and t."""
    _need(df, [column])
    kind = _TYPES.get(to, to)
    c = F.col(column)
    if kind == "boolean" and isinstance(df.schema[column].dataType, T.StringType):
        out = F.coalesce(F.lower(F.trim(c)).isin(*_TRUE), F.lit(False))
    elif kind in ("timestamp", "date") and format:
        parsed = F.try_to_timestamp(c, F.lit(format)) if errors == "coerce" else F.to_timestamp(c, format)
        out = parsed.cast(kind)
    else:
        out = c.try_cast(kind) if errors == "coerce" else c.cast(kind)
    return df.withColumn(column, out)


def fill_missing(df: DataFrame, columns, strategy: str = "constant", value=None, order_by=None) -> DataFrame:
    """constant, mean, median, mode (the smallest most frequent value), ffill or bfill (along ``order_by``)."""
    columns = _need(df, _listed(columns))
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in columns})
    if strategy in ("ffill", "bfill"):
        forward = strategy == "ffill"
        w = Window.orderBy(*_order(order_by)).rowsBetween(*((Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)))
        take = F.last if forward else F.first
        return df.withColumns({c: take(c, ignorenulls=True).over(w) for c in columns})
    if strategy == "mode":
        fills = {c: (df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first() or [None])[0] for c in columns}
    else:
        how = {"mean": F.avg, "median": F.median}[strategy]
        fills = df.agg(*[how(c).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType if strategy == "mode" else "double")) for c, v in fills.items() if v is not None})


def drop_missing(df: DataFrame, columns=None, how: str = "any") -> DataFrame:
    return df.dropna(how, subset=_need(df, _listed(columns)) or None)


def deduplicate(df: DataFrame, subset=None, keep: str = "first", order_by=None) -> DataFrame:
    subset = _need(df, _listed(subset)) or df.columns
    if order_by is None:
        return df.dropDuplicates(subset)
    order = [c.asc() if keep == "first" else c.desc() for c in _order(order_by)]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*subset).orderBy(*order))).where("_rn = 1").drop("_rn")


def string_normalize(df: DataFrame, columns, trim: bool = True, strip_chars: str | None = None, lowercase: bool = False, uppercase: bool = False, regex_replace=()) -> DataFrame:
    if lowercase and uppercase:
        raise ValueError("lowercase and uppercase exclude each other")

    def clean(c: Column) -> Column:
        c = F.trim(c) if trim else c
        c = F.btrim(c, F.lit(strip_chars)) if strip_chars else c
        c = F.lower(c) if lowercase else F.upper(c) if uppercase else c
        return reduce(lambda x, r: F.regexp_replace(x, r["pattern"], r.get("repl", "")), regex_replace, c)

    return df.withColumns({c: clean(F.col(c)) for c in _need(df, _listed(columns))})


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*_need(df, _listed(columns)))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    _need(df, list(mapping))
    if len(set(mapping.values())) != len(mapping) or not all(mapping.values()):
        raise ValueError("new names must be distinct and not empty")
    return df.withColumnsRenamed(mapping)


def predicate(df: DataFrame, condition: dict) -> Column:
    """One condition as a Column that is never null: a null cell fails it, but passes ne and not_in."""
    column, op, value = condition["column"], condition["op"], condition.get("value")
    _need(df, [column])
    c, kind = F.col(column), df.schema[column].dataType
    same = lambda v: F.lit(v).cast(kind)
    if op in ("is_null", "not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if op in ("ne", "not_in"):
        hit = c == same(value) if op == "ne" else c.isin(*[same(v) for v in value])
        return ~F.coalesce(hit, F.lit(False))
    if op in ("eq", "gt", "gte", "lt", "lte"):
        out = {"eq": c == same(value), "gt": c > same(value), "gte": c >= same(value), "lt": c < same(value), "lte": c <= same(value)}[op]
    elif op == "in":
        out = c.isin(*[same(v) for v in value])
    elif op == "between":
        out = c.between(same(condition.get("min", value[0] if value else None)), same(condition.get("max", value[1] if value else None)))
    else:
        text, exact = c.cast("string"), condition.get("case_sensitive", False)
        if op == "contains" and condition.get("regex"):
            out = text.rlike(value if exact else f"(?i){value}")
        else:
            a, b = (text, F.lit(value)) if exact else (F.lower(text), F.lower(F.lit(value)))
            out = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op](a, b)
    return F.coalesce(out, F.lit(False))


def filter_rows(df: DataFrame, conditions: list[dict], combine: str = "all", keep: bool = True) -> DataFrame:
    """Two-valued: with ``keep=False`` rows whose condition is unknown are returned."""
    masks = [predicate(df, c) for c in conditions]
    mask = reduce((lambda a, b: a & b) if combine == "all" else (lambda a, b: a | b), masks)
    return df.where(mask if keep else ~mask)


def sort_rows(df: DataFrame, columns, ascending=True, na_position: str = "last") -> DataFrame:
    columns = _need(df, _listed(columns))
    ways = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(columns)
    return df.orderBy(*[getattr(F.col(c), f"{'asc' if up else 'desc'}_nulls_{na_position}")() for c, up in zip(columns, ways)])


def limit_rows(df: DataFrame, n: int, from_end: bool = False, order_by=None) -> DataFrame:
    n = max(0, min(int(n), MAX_LIMIT))
    if not from_end:
        return (df.orderBy(*_order(order_by)) if order_by else df).limit(n)
    return df.orderBy(*[c.desc() for c in _order(order_by)]).limit(n)


def time_features(df: DataFrame, column: str, features=TIME_FEATURES, prefix: str | None = None, drop_source: bool = False, format: str | None = None) -> DataFrame:
    c = F.to_timestamp(_need(df, [column])[0], format) if format else F.col(column)
    made = {"year": F.year(c), "quarter": F.quarter(c), "month": F.month(c), "week": F.weekofyear(c), "day": F.day(c), "day_of_week": F.weekday(c), "is_weekend": F.weekday(c) >= 5, "hour": F.hour(c)}
    out = df.withColumns({f"{prefix or column}_{f}": made[f] for f in features})
    return out.drop(column) if drop_source else out


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct edges of linear-interpolated quantiles."""
    got = df.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0] or []
    return sorted(set(got))


def bin_code(c: Column, edges: list[float]) -> Column:
    """Place of the right-closed interval that holds a value; the lowest edge belongs to the first, null outside."""
    inside = F.greatest(sum([(c > F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0)), F.lit(0))
    return F.when((c >= edges[0]) & (c <= edges[-1]), inside)


def bin_numeric(df: DataFrame, column: str, bins: int = 10, strategy: str = "quantile", output: str = "labels", new_column: str | None = None, include_lowest: bool = True) -> DataFrame:
    _need(df, [column])
    bins = max(MIN_BINS, min(int(bins), MAX_BINS))
    if strategy == "quantile":
        edges = quantile_edges(df, column, bins)
    else:
        lo, hi = df.agg(F.min(column), F.max(column)).first()
        edges = [] if lo is None else [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    if len(edges) < 2:
        return df.withColumn(new_column or f"{column}_bin", F.lit(None).cast("int" if output == "codes" else "string"))
    code = bin_code(F.col(column), edges)
    if not include_lowest and strategy == "uniform":
        code = F.when(F.col(column) > edges[0], code)
    names = F.array(*[F.lit(f"({a:g}, {b:g}]") for a, b in zip(edges, edges[1:])])
    return df.withColumn(new_column or f"{column}_bin", code if output == "codes" else F.get(names, code))


def bounds(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5, lower: float = 0.01, upper: float = 0.99) -> dict[str, tuple[float, float]]:
    """Fences of each column over its values, from one aggregate."""
    p = (0.25, 0.75) if method == "iqr" else (lower, upper)
    row = df.agg(*[F.percentile(c, F.array(*map(F.lit, p))).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        if row[c]:
            a, b = row[c]
            out[c] = (a - k * (b - a), b + k * (b - a)) if method == "iqr" else (a, b)
    return out


def clip_outliers(df: DataFrame, columns, method: str = "iqr", iqr_multiplier: float = 1.5, lower_quantile: float = 0.01, upper_quantile: float = 0.99, action: str = "clip", combine: str = "any") -> DataFrame:
    """``clip`` moves values to the fences; ``drop`` removes rows where any or all of the columns lie outside."""
    fences = bounds(df, _need(df, _listed(columns)), method, iqr_multiplier, lower_quantile, upper_quantile)
    if action == "clip":
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(b)), F.lit(a))) for c, (a, b) in fences.items()})
    outside = [F.coalesce((F.col(c) < a) | (F.col(c) > b), F.lit(False)) for c, (a, b) in fences.items()]
    return df.where(~reduce((lambda x, y: x | y) if combine == "any" else (lambda x, y: x & y), outside)) if outside else df


def encode_categorical(df: DataFrame, columns, strategy: str = "label", max_categories: int = 100, drop_original: bool = True, drop_first: bool = False, dummy_na: bool = False) -> DataFrame:
    """label: place among the sorted distinct values, by a join; one_hot: a column ``name__value`` for each value."""
    for c in _need(df, _listed(columns)):
        text = F.col(c).cast("string")
        if strategy == "label":
            values = df.select(text.alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_code", F.row_number().over(Window.orderBy("_v")) - 1)
            df = df.join(F.broadcast(values.limit(max_categories)), text == F.col("_v"), "left").withColumn(f"{c}_encoded", F.col("_code")).drop("_v", "_code")
        else:
            top = [r[0] for r in df.where(text.isNotNull()).groupBy(text.alias("v")).count().orderBy(F.desc("count"), "v").limit(max_categories).collect()]
            kept = sorted(top)[1 if drop_first else 0 :]
            df = df.withColumns({f"{c}__{v}": F.coalesce(text == v, F.lit(False)).cast("int") for v in kept})
            if dummy_na:
                df = df.withColumn(f"{c}__nan", text.isNull().cast("int"))
        df = df.drop(c) if drop_original else df
    return df


STEPS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (type_convert, fill_missing, drop_missing, deduplicate, string_normalize, drop_columns, rename_columns, filter_rows, sort_rows, limit_rows, time_features, bin_numeric, clip_outliers, encode_categorical)
}


def apply(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Fold the steps; a step's name stands under op, operator or type, and an unknown one is an error."""
    for step in steps:
        name = step.get("op") or step.get("operator") or step.get("type")
        if name not in STEPS:
            raise ValueError(f"unknown step: {name}")
        df = STEPS[name](df, **step.get("params", {}))
    return df


def preview_diff(before: DataFrame, after: DataFrame) -> dict:
    """Added and removed columns, changed types and row counts."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    return {
        "added": [c for c in b if c not in a],
        "removed": [c for c in a if c not in b],
        "changed": {c: (a[c], b[c]) for c in a if c in b and a[c] != b[c]},
        "rows_before": before.count(),
        "rows_after": after.count(),
    }


def suggest(df: DataFrame, max_steps: int = 8) -> list[dict]:
    """Steps by rule from one aggregate: drop constant and almost empty columns, fill gaps, clip outliers, trim text."""
    n = df.count()
    if not n:
        return []
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    row = df.agg(*[F.count(c).alias(f"n_{c}") for c in names], *[F.approx_count_distinct(c).alias(f"d_{c}") for c in names]).first()
    drop = [c for c in names if row[f"n_{c}"] <= 0.02 * n or row[f"d_{c}"] <= 1]
    out = [{"op": "drop_columns", "params": {"columns": drop}}] if drop else []
    gaps = [c for c in names if c not in drop and row[f"n_{c}"] < n]
    out += [{"op": "fill_missing", "params": {"columns": [c], "strategy": "median" if _numeric(df, c) else "mode"}} for c in gaps]
    numbers = [c for c in names if c not in drop and _numeric(df, c)]
    if numbers:
        out.append({"op": "clip_outliers", "params": {"columns": numbers}})
    texts = [c for c in names if c not in drop and isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        out.append({"op": "string_normalize", "params": {"columns": texts}})
    return out[:max_steps]
