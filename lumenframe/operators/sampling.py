"""Samples, splits, imputation, outliers and anomalies. Draws come from hashes of a key and a seed, so they repeat."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import in_ranges
from .transforms import bounds


def uniform(key: list[str] | str, seed: int = 42) -> Column:
    """A number in (0, 1) from the key's hash."""
    cols = [key] if isinstance(key, str) else key
    return (F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def random_sample(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """The n rows of smallest hash: a top-k, not a sort of the table."""
    return df.withColumn("_u", uniform(key, seed)).orderBy("_u").limit(n).drop("_u")


reservoir_sample = random_sample


def stratified_sample(df: DataFrame, n: int, stratum: str, key, seed: int = 42) -> DataFrame:
    """max(1, int(n * share)) rows of each stratum: the hash threshold that holds them comes from counts, so no stratum is ranked whole."""
    total = df.count()
    wanted = df.groupBy(stratum).agg(F.count("*").alias("_size")).withColumn("_want", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_size") / max(1, total)).cast("int")))
    slack = F.least(F.lit(1.0), (F.col("_want") + 6 * F.sqrt("_want") + 10) / F.col("_size"))
    some = df.join(F.broadcast(wanted), df[stratum].eqNullSafe(wanted[stratum])).drop(wanted[stratum]).withColumn("_u", uniform(key, seed)).where(F.col("_u") <= slack)
    ranked = some.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy("_u")))
    return ranked.where(F.col("_rn") <= F.col("_want")).drop("_u", "_rn", "_size", "_want")


def systematic_sample(df: DataFrame, every: int, order_by: str, start: int = 0) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.orderBy(order_by)) - 1).where(F.pmod(F.col("_rn"), F.lit(every)) == start % every).drop("_rn")


def cluster_sample(df: DataFrame, clusters: int, cluster: str, seed: int = 42) -> DataFrame:
    return df.join(random_sample(df.select(cluster).distinct(), clusters, cluster, seed), cluster, "left_semi")


def bootstrap_sample(df: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def weighted_sample(df: DataFrame, n: int, weight: str, key, seed: int = 42) -> DataFrame:
    """Without replacement, the n largest u^(1/w)."""
    low = df.agg(F.min(weight)).first()[0] or 0.0
    w = F.col(weight) - low + 1e-10
    return df.withColumn("_k", F.ln(uniform(key, seed)) / w).orderBy(F.desc("_k")).limit(n).drop("_k")


def train_test_split(df: DataFrame, key, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    test = uniform(key, seed) < test_size
    return df.where(~test), df.where(test)


def folds(df: DataFrame, key, n: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform(key, seed) * n).cast("int"))


def representativeness(whole: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """1 less the relative gap of means, by column."""
    a, b = (d.agg(*[F.avg(c).alias(c) for c in columns]).first() for d in (whole, sample))
    rows = [(c, max(0.0, 1 - abs((a[c] or 0) - (b[c] or 0)) / (abs(a[c] or 0) or 1.0))) for c in columns]
    return whole.sparkSession.createDataFrame(rows, "column string, score double")


# Imputation


def interpolate(df: DataFrame, value: str, order_by: str, limit: int | None = None) -> DataFrame:
    """Linear between the nearest values on either side, along the row's place; among equal places nulls and small values come first.

    Windows run within ranges of the order and look back only, as a frame that reaches ahead to its end is read again for every
    row. What lies before and after a range comes from a table with a row for each range.
    """
    w = Window.partitionBy("_part")
    within = in_ranges(df, order_by).withColumn("_i", F.row_number().over(w.orderBy(order_by, value)).cast("long"))
    within = within.withColumn("_seen", F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))))
    up, down = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col("_start") + F.col(c)["i"]).alias("i"), F.col(c)["v"].alias("v")))
    edges = within.groupBy("_part").agg(F.count("*").alias("n"), F.min_by("_seen", F.col("_seen")["i"]).alias("low"), F.max_by("_seen", F.col("_seen")["i"]).alias("high"))
    edges = edges.withColumn("_start", F.coalesce(F.sum("n").over(up), F.lit(0)))
    edges = edges.select("_part", "_start", F.last(moved("high"), ignorenulls=True).over(up).alias("_before"), F.last(moved("low"), ignorenulls=True).over(down).alias("_after"))
    back = w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    out = within.withColumns({"_a": F.last("_seen", ignorenulls=True).over(back), "_b": F.last("_seen", ignorenulls=True).over(ahead)})
    out = out.join(F.broadcast(edges), "_part").withColumns({"_i": F.col("_start") + F.col("_i"), "_a": F.coalesce(moved("_a"), "_before"), "_b": F.coalesce(moved("_b"), "_after")})
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / (b["i"] - a["i"])
    near = (F.col("_i") - a["i"]) <= limit if limit else F.lit(True)
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(near, F.coalesce(line, a["v"]))).select(*[f"`{c}`" for c in df.columns])


def hot_deck(df: DataFrame, value: str, key: str, stratum: str | None = None, seed: int = 42, salts: int = 64) -> DataFrame:
    """A missing value takes that of a donor of its stratum: donors are thinned to one for each of ``salts`` places, so none is a hot row."""
    by = [stratum] if stratum else []
    place = F.floor(uniform(key, seed) * salts).cast("int")
    donors = df.where(F.col(value).isNotNull()).withColumn("_place", place).groupBy(*by, "_place").agg(F.min_by(value, F.struct(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))).alias("_donor"))
    mean = df.groupBy(*by).agg(F.median(value).alias("_mid")) if by else df.agg(F.median(value).alias("_mid"))
    out = df.withColumn("_place", place).join(F.broadcast(donors), [*by, "_place"], "left")
    out = out.join(F.broadcast(mean), by, "left") if by else out.crossJoin(F.broadcast(mean))
    return out.withColumn(value, F.coalesce(value, "_donor", "_mid")).drop("_place", "_donor", "_mid")


def regression_impute(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A missing value takes the prediction of a linear model of the other columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    seen = VectorAssembler(inputCols=by, outputCol="_x", handleInvalid="keep").transform(df.fillna(0, by))
    model = LinearRegression(featuresCol="_x", labelCol=value, predictionCol="_p", regParam=1e-3).fit(seen.where(F.col(value).isNotNull()))
    return model.transform(seen).withColumn(value, F.coalesce(value, "_p")).drop("_x", "_p")


def knn_impute(df: DataFrame, value: str, by: list[str], k: int = 5, block_rows: int = 5000) -> DataFrame:
    """The distance-weighted mean of the k nearest of all rows with a value; ties go to the smaller value.

    Blocks of donors meet blocks of distinct places to fill in cells, and each cell keeps k donors a place.
    """
    import numpy as np
    import pyarrow as pa

    names = [f"_{i}" for i in range(len(by))]
    places = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(by, names)]
    whole = " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names)
    donors = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_y"), *places).where(f"{whole} AND NOT isnan(_y)")
    asked = df.where(F.col(value).isNull()).select(*places).where(whole).distinct()
    n, *spread = donors.agg(F.count("*"), *[F.stddev_pop(c) for c in names]).first()
    scale = np.array([x if x and x > 0 else 1.0 for x in spread])
    blocks, sets = max(1, -(-n // block_rows)), max(1, -(-asked.count() // block_rows))
    deal = lambda parts, salt, *c: F.pmod(F.xxhash64(*c, F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = donors.select("_y", *names, F.floor(F.rand(7) * blocks).cast("int").alias("i"), every(sets).alias("j"))
    right = asked.select(*names, every(blocks).alias("i"), deal(sets, 2, *names).alias("j"))

    def cell(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and asking.num_rows:
            x, q = (np.column_stack([t[c].to_numpy() for c in names]) for t in (own, asking))
            y = own["_y"].to_numpy()
            for p in q:
                d = np.sqrt((((x - p) / scale) ** 2).sum(axis=1))
                out += [(*p, d[i], y[i]) for i in np.lexsort((y, d))[:k]]
        return pa.table({c: pa.array([r[i] for r in out], pa.float64()) for i, c in enumerate([*names, "_d", "_y"])})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, ", ".join(f"{c} double" for c in [*names, "_d", "_y"]))
    near = found.withColumn("_rn", F.row_number().over(Window.partitionBy(*names).orderBy("_d", "_y"))).where(F.col("_rn") <= k)
    weight = 1 / (F.col("_d") + 1e-9)
    guess = near.groupBy(*names).agg((F.sum(weight * F.col("_y")) / F.sum(weight)).alias("_guess"))
    out = df.withColumns({n: F.col(f"`{c}`").cast("double") for c, n in zip(by, names)}).join(guess, names, "left")
    return out.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.col("_guess")).alias(c) if c == value else F.col(f"`{c}`") for c in df.columns])


def smart_impute(df: DataFrame) -> DataFrame:
    """Median of numbers, mode of the rest, for the columns that have gaps."""
    from .eda import numeric_columns
    from .transforms import fill_missing

    got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    gaps, numbers = [c for c in df.columns if got[c]], numeric_columns(df)
    for how, names in (("median", [c for c in gaps if c in numbers]), ("mode", [c for c in gaps if c not in numbers])):
        df = fill_missing(df, names, how) if names else df
    return df


# Outliers and anomalies


def severity(score: Column) -> Column:
    """By the score over its threshold."""
    return F.when(score >= 4, "critical").when(score >= 2.5, "high").when(score >= 1.5, "medium").otherwise("low")


def zscores(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    s = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    out = df.crossJoin(F.broadcast(s)).withColumn("score", F.abs(F.try_divide(F.col(column) - F.col("_m"), F.col("_s")))).drop("_m", "_s")
    return out.withColumns({"is_outlier": F.coalesce(F.col("score") > threshold, F.lit(False)), "severity": severity(F.col("score") / threshold)})


def modified_zscores(df: DataFrame, column: str, threshold: float = 3.5) -> DataFrame:
    """0.6745 (x - median) / MAD; a MAD of 0 gives way to the mean absolute deviation."""
    mid = df.agg(F.median(column)).first()[0]
    gap = F.abs(F.col(column) - F.lit(mid))
    s = df.agg(F.median(gap).alias("_mad"), F.avg(gap).alias("_aad"))
    score = F.when(F.col("_mad") > 0, 0.6745 * gap / F.col("_mad")).otherwise(F.try_divide(gap, 1.2533 * F.col("_aad")))
    return df.crossJoin(F.broadcast(s)).withColumn("score", score).drop("_mad", "_aad").withColumn("is_outlier", F.coalesce(F.col("score") > threshold, F.lit(False)))


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    a, b = bounds(df, [column], "iqr", k).get(column, (None, None))
    c, iqr = F.col(column), (b - a) / (1 + 2 * k) if a is not None else 1.0
    far = F.when(c < a, F.lit(a) - c).when(c > b, c - F.lit(b)).otherwise(0.0)
    return df.withColumns({"score": far / (iqr or 1.0), "is_outlier": F.coalesce((c < a) | (c > b), F.lit(False))})


def percentile_outliers(df: DataFrame, column: str, pct: float = 1.0) -> DataFrame:
    a, b = bounds(df, [column], "quantile", lower=pct / 100, upper=1 - pct / 100)[column]
    return df.withColumn("is_outlier", F.coalesce((F.col(column) < a) | (F.col(column) > b), F.lit(False)))


def treat_outliers(df: DataFrame, column: str, strategy: str = "cap", k: float = 1.5) -> DataFrame:
    """cap, mean, median, null or remove."""
    a, b = bounds(df, [column], "iqr", k)[column]
    c = F.col(column)
    out = (c < a) | (c > b)
    if strategy == "remove":
        return df.where(~F.coalesce(out, F.lit(False)))
    if strategy == "cap":
        return df.withColumn(column, F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(a)), F.lit(b))))
    fill = F.lit(None) if strategy == "null" else F.lit(df.agg((F.avg if strategy == "mean" else F.median)(column)).first()[0])
    return df.withColumn(column, F.when(out, fill).otherwise(c))


def mahalanobis(df: DataFrame, columns: list[str], percentile: float = 0.975) -> DataFrame:
    """Distance by the inverse of the covariance, which one aggregate gives; outliers lie beyond the percentile of distances."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    inv = np.linalg.inv(cov + 1e-6 * np.eye(len(columns)))
    gaps = [F.col(c) - F.lit(r[f"m{i}"]) for i, c in enumerate(columns)]
    square = reduce(lambda a, b: a + b, [gaps[i] * gaps[j] * float(inv[i, j]) for i in range(len(columns)) for j in range(len(columns))])
    out = df.withColumn("distance", F.sqrt(F.greatest(square, F.lit(0.0))))
    cut = out.agg(F.percentile("distance", percentile).alias("_cut"))
    return out.crossJoin(F.broadcast(cut)).withColumn("is_outlier", F.col("distance") > F.col("_cut")).drop("_cut")


def isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 50, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Trees grown on a bounded sample on the driver; every row is scored by column expressions in Arrow batches."""
    import numpy as np

    rows = np.array([[float(v) for v in r] for r in random_sample(df.dropna(subset=columns), trees * sample // 4, key, seed).select(*columns).collect()])
    rng = np.random.default_rng(seed)

    def grow(x, depth: int):
        if depth >= 8 or len(x) <= 1 or (x.max(axis=0) == x.min(axis=0)).all():
            n = len(x)
            return depth + (2 * (np.log(n - 1) + 0.5772) - 2 * (n - 1) / n if n > 2 else float(n == 2))
        c = int(rng.choice(np.flatnonzero(x.max(axis=0) > x.min(axis=0))))
        cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        left = x[:, c] < cut
        return c, cut, grow(x[left], depth + 1), grow(x[~left], depth + 1)

    forest = [grow(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], 0) for _ in range(trees)]
    n = min(sample, len(rows))
    norm = 2 * (np.log(n - 1) + 0.5772) - 2 * (n - 1) / n if n > 2 else 1.0

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        def walk(node, x, at, out):
            if not isinstance(node, tuple):
                out[at] += node
            elif len(at):
                c, cut, a, b = node
                left = x[at, c] < cut
                walk(a, x, at[left], out)
                walk(b, x, at[~left], out)

        for columns_ in parts:
            x = np.nan_to_num(np.column_stack([c.astype(float) for c in columns_]))
            out = np.zeros(len(x))
            for t in forest:
                walk(t, x, np.arange(len(x)), out)
            yield pd.Series(2 ** (-out / trees / norm))

    out = df.withColumn("score", score(*[F.col(c) for c in columns]))
    cut = out.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("_cut"))
    return out.crossJoin(F.broadcast(cut)).withColumn("is_outlier", F.col("score") > F.col("_cut")).drop("_cut")


def rolling_anomalies(df: DataFrame, value: str, order_by: str, size: int = 20, n_std: float = 3.0) -> DataFrame:
    """Distance to the mean of a centred window in its deviations."""
    w = Window.orderBy(order_by).rowsBetween(-(size // 2), size - size // 2 - 1)
    z = F.abs(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))
    return df.withColumn("z", z).withColumn("is_anomaly", F.coalesce(z > n_std, F.lit(False)))


def ensemble_anomalies(df: DataFrame, column: str, min_votes: int = 2) -> DataFrame:
    """Votes of the z-score, the modified z-score and the fences."""
    out = df
    for i, f in enumerate((zscores, modified_zscores, iqr_outliers)):
        out = f(out, column).withColumn(f"_v{i}", F.col("is_outlier").cast("int")).drop("score", "is_outlier", "severity")
    votes = F.col("_v0") + F.col("_v1") + F.col("_v2")
    return out.withColumns({"votes": votes, "is_anomaly": votes >= min_votes}).drop("_v0", "_v1", "_v2")


def grubbs(df: DataFrame, column: str, alpha: float = 0.05, most: int = 20) -> DataFrame:
    """The extreme values that the iterated test removes, one aggregate a round."""
    import math

    from ..functions.distributions import t_quantile

    out, kept = [], df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    for _ in range(most):
        r = kept.agg(F.count("x"), F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x")).first()
        n, m, s = r[0], r[1], r[2] or 0.0
        if n < 3 or s == 0:
            break
        x = r[4] if r[4] - m >= m - r[3] else r[3]
        t = t_quantile(1 - alpha / (2 * n), n - 2)
        if abs(x - m) / s <= (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t)):
            break
        out.append((float(x), abs(x - m) / s))
        kept = kept.where(F.col("x") != x)
    return df.sparkSession.createDataFrame(out, "value double, g double")
