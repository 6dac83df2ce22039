"""Monte Carlo draws, scenario and sensitivity analysis over SQL formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAU = 6.283185307179586


def uniform(seed: int, stream: int = 0) -> Column:
    """In (0, 1) from the row's id, so that a lost task draws the same again."""
    return (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(stream)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(seed: int, stream: int = 0) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, 2 * stream))) * F.cos(TAU * uniform(seed, 2 * stream + 1))


def draw(kind: str, params: dict, seed: int = 42, stream: int = 0) -> Column:
    """normal (mean, std), lognormal (mean, std of the logarithm), uniform (low, high), triangular (low, mode, high) or poisson (rate)."""
    u = uniform(seed, 2 * stream)
    if kind == "uniform":
        return params["low"] + (params["high"] - params["low"]) * u
    if kind == "triangular":
        a, c, b = params["low"], params["mode"], params["high"]
        cut = (c - a) / (b - a)
        return F.when(u < cut, a + F.sqrt(u * ((b - a) * (c - a)))).otherwise(b - F.sqrt((1 - u) * ((b - a) * (b - c))))
    if kind == "poisson":
        import math

        p = total = math.exp(-params["rate"])
        cuts, k = [total], 0
        while total < 1 - 1e-12 and k < 10_000:
            k += 1
            p *= params["rate"] / k
            total += p
            cuts.append(total)
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < u)).cast("double")
    x = params["mean"] + params["std"] * normal(seed, stream)
    return F.exp(x) if kind == "lognormal" else x


def simulate(spark: SparkSession, kind: str, params: dict, n: int = 10_000, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", draw(kind, params, seed).alias("value"))


def summary(draws: DataFrame, column: str = "value") -> DataFrame:
    p = lambda q: F.percentile(column, q)
    return draws.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.avg((F.col(column) < 0).cast("double")).alias("share_below_zero"))


def revenue_paths(spark: SparkSession, base: float, mean: float, std: float, periods: int = 12, n: int = 1000, seed: int = 42) -> DataFrame:
    """Quantiles of compounded random growth by period."""
    rates = F.array(*[F.lit(mean) + F.lit(std) * normal(seed, i) for i in range(periods)])
    path = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.aggregate(F.slice("r", 1, i), F.lit(float(base)), lambda s, x: s * (1 + x)))
    long = spark.range(n).select("id", rates.alias("r")).select(F.posexplode(path).alias("period", "value"))
    return long.groupBy((F.col("period") + 1).alias("period")).agg(F.avg("value").alias("mean"), F.percentile("value", 0.05).alias("p5"), F.percentile("value", 0.95).alias("p95"))


def monte_carlo(spark: SparkSession, base: dict[str, float], formula: str, std: dict[str, float], n: int = 10_000, seed: int = 42) -> DataFrame:
    """The formula over normal draws of its inputs."""
    inputs = spark.range(n).select("id", *[(F.lit(float(v)) + F.lit(float(std.get(k, 0.0))) * normal(seed, i)).alias(k) for i, (k, v) in enumerate(sorted(base.items()))])
    return summary(inputs.select(F.expr(formula).cast("double").alias("value")))


def scenarios(spark: SparkSession, base: dict[str, float], formula: str, changes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The formula for the base, for all inputs a fifth higher or lower, or for named factors of inputs."""
    changes = changes or {"optimistic": {k: 1.2 for k in base}, "pessimistic": {k: 0.8 for k in base}}
    rows = [("base", *map(float, base.values()))] + [(name, *[float(v) * f.get(k, 1.0) for k, v in base.items()]) for name, f in changes.items()]
    df = spark.createDataFrame(rows, "scenario string, " + ", ".join(f"`{k}` double" for k in base))
    return df.select("scenario", F.expr(formula).cast("double").alias("value"))


def sensitivity(spark: SparkSession, base: dict[str, float], formula: str, reach: float = 0.2, steps: int = 5) -> DataFrame:
    """The formula as each input alone moves through a range around its base."""
    rows = []
    for k in base:
        for s in range(steps):
            factor = 1 - reach + 2 * reach * s / (steps - 1)
            rows.append((k, factor, *[float(v) * (factor if x == k else 1.0) for x, v in base.items()]))
    df = spark.createDataFrame(rows, "input string, factor double, " + ", ".join(f"`{k}` double" for k in base))
    return df.select("input", "factor", F.expr(formula).cast("double").alias("value"))
