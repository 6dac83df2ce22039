"""Scaling, encoding, interactions, enrichment and importance of features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, text
from .eda import numeric_columns, safe_corr


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """standard, minmax (0.5 if constant), robust (median and IQR) or quantile (share of values up to the row's), from one aggregate."""
    if method == "quantile":
        for c in columns:
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
            ranks = counts.withColumn("_q", F.sum("_n").over(Window.orderBy(c)) / F.sum("_n").over(Window.partitionBy())).drop("_n")
            df = df.join(ranks, c, "left").withColumn(c, F.col("_q")).drop("_q").select(*df.columns)
        return df
    figures = {"standard": (F.avg, F.stddev_samp), "minmax": (F.min, F.max), "robust": (F.median, lambda c: F.percentile(c, 0.75) - F.percentile(c, 0.25))}[method]
    r = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in zip("ab", figures)]).first()

    def scaled(c: str) -> Column:
        a, b = r[f"a_{c}"], r[f"b_{c}"]
        if method == "minmax":
            return F.when(F.col(c).isNotNull(), F.lit(0.5) if a is None or a == b else (F.col(c) - a) / (b - a))
        return F.when(F.col(c).isNotNull(), (F.col(c) - (a or 0.0)) / (b or 1.0) if b else F.lit(0.0))

    return df.withColumns({c: scaled(c) for c in columns})


def transform(df: DataFrame, column: str, kind: str, output: str | None = None, bins: int = 5) -> DataFrame:
    """log (shifted above 0 if need be), sqrt (of the absolute value), square, normalize, standardize, binning or encoding."""
    c, out = F.col(column), output or f"{column}_{kind}"
    if kind in ("normalize", "standardize"):
        return scale(df.withColumn(out, c.cast("double")), [out], "minmax" if kind == "normalize" else "standard")
    if kind == "log":
        low = df.agg(F.min(column)).first()[0] or 0.0
        return df.withColumn(out, F.ln(c if low > 0 else c - low + 1))
    if kind == "binning":
        lo, hi = df.agg(F.min(column), F.max(column)).first()
        width = (hi - lo) / bins or 1.0
        return df.withColumn(out, F.when(c.isNotNull(), F.concat(F.lit("bin_"), F.least(F.greatest(F.ceil((c - lo) / width), F.lit(1)), F.lit(bins)).cast("string"))))
    if kind == "encoding":
        values = df.where(c.isNotNull()).select(c.alias("_v")).distinct().withColumn("_code", F.row_number().over(Window.orderBy("_v")) - 1)
        return df.join(values, c == F.col("_v"), "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")
    return df.withColumn(out, {"sqrt": F.sqrt(F.abs(c)), "square": c * c}[kind])


def encode(df: DataFrame, column: str, method: str = "frequency", target: str | None = None, smoothing: float = 10.0, buckets: int = 32) -> DataFrame:
    """frequency, ordinal (by frequency), target (smoothed mean), woe (log odds with 0.5 added) or hash."""
    out, c = f"{column}_{method}", F.col(column)
    if method == "hash":
        return df.withColumn(out, F.conv(F.right(F.md5(c.cast("string")), F.lit(8)), 16, 10).cast("long") % buckets)
    if method in ("frequency", "ordinal"):
        g = df.groupBy(c.alias("_v")).agg(F.count("*").alias("_n"))
        value = F.col("_n") / F.sum("_n").over(Window.partitionBy()) if method == "frequency" else F.row_number().over(Window.orderBy(F.desc("_n"), "_v")) - 1
    else:
        whole = df.agg(F.avg(target).alias("_m"), F.sum(target).alias("_p"), F.count(target).alias("_t"))
        g = df.groupBy(c.alias("_v")).agg(F.count(target).alias("_n"), F.sum(target).alias("_s")).crossJoin(F.broadcast(whole))
        value = (F.col("_s") + smoothing * F.col("_m")) / (F.col("_n") + smoothing) if method == "target" else F.ln(((F.col("_s") + 0.5) / (F.col("_p") + 0.5)) / ((F.col("_n") - F.col("_s") + 0.5) / (F.col("_t") - F.col("_p") + 0.5)))
    codes = g.select("_v", value.alias(out))
    return df.join(codes, c.eqNullSafe(F.col("_v")), "left").drop("_v")


def interactions(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """Products, quotients, sums and differences of all pairs, of which the ``most`` of largest variance stay."""
    made = {k: v for a, b in combinations(columns, 2) for k, v in ((f"{a}_x_{b}", F.col(a) * F.col(b)), (f"{a}_div_{b}", F.col(a) / (F.abs(b) + 1e-8)), (f"{a}_plus_{b}", F.col(a) + F.col(b)), (f"{a}_minus_{b}", F.col(a) - F.col(b)))}
    var = df.agg(*[F.var_samp(v).alias(k) for k, v in made.items()]).first().asDict()
    kept = sorted(made, key=lambda k: (-(var[k] or 0.0), k))[:most]
    return df.withColumns({k: made[k] for k in kept})


def enrich(df: DataFrame) -> DataFrame:
    """Parts of dates and features of texts beside the columns."""
    from pyspark.sql import types as T

    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            df = dates.features(df, f.name, ["year", "quarter", "month", "day", "dayofweek", "is_weekend"])
        elif isinstance(f.dataType, T.StringType):
            df = text.text_features(df, f.name)
    return df


def importance(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """By absolute correlation with the target."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    wide = df.agg(*[safe_corr(F.col(c), F.col(target)).alias(f"r{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.coalesce(F.col(f"r{i}"), F.lit(0.0))).alias("importance")) for i, c in enumerate(names)])))


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Of two numeric columns in equal-width bins, in nats."""
    r = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    place = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1))
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(place(a, r[0], r[1]).alias("x"), place(b, r[2], r[3]).alias("y")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    joint = cells.select("n", F.sum("n").over(Window.partitionBy("x")).alias("nx"), F.sum("n").over(Window.partitionBy("y")).alias("ny"), F.sum("n").over(every).alias("t"))
    return joint.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """The share of variance of the first k components of the standardised columns, from one covariance aggregate."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = df.dropna(subset=columns).agg(*[safe_corr(F.col(columns[i]), F.col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = r[f"c{i}_{j}"] if r[f"c{i}_{j}"] is not None else float(i == j)
    values = np.sort(np.linalg.eigvalsh(m))[::-1]
    return df.sparkSession.createDataFrame([(i + 1, float(v / values.sum())) for i, v in enumerate(values[:k])], "component int, share double")
