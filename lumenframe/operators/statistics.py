"""Statistical tests: Spark reduces the rows to moments, counts or ranks; the distributions follow on the driver.

Each test returns a one-row DataFrame. Ranks with ties are average ranks; ranking counts the rows of each distinct
value first, so its window holds distinct values, not rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as D
from .eda import cramers_v, safe_corr


def _row(like: DataFrame, /, **values) -> DataFrame:
    kinds = {float: "double", int: "long", str: "string", bool: "boolean"}
    schema = ", ".join(f"`{k}` {kinds.get(type(v), 'double')}" for k, v in values.items())
    return like.sparkSession.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in values.values())], schema)


def moments(df: DataFrame, group: str, value: str) -> list[dict]:
    """n, mean and sample variance by group, ordered by group."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))
    return [r.asDict() | {"group": r[group]} for r in rows.orderBy(group).collect()]


def _two_sided(t: float, df: float, alternative: str) -> float:
    return {"two-sided": D.t_two_sided(t, df), "greater": 1 - D.t_cdf(t, df), "less": D.t_cdf(t, df)}[alternative]


def t_test(df: DataFrame, group: str, value: str, a, b, equal_var: bool = True, alternative: str = "two-sided") -> DataFrame:
    """Student's or Welch's test of two groups, with Cohen's d, Hedges' g and the difference's interval."""
    got = {m["group"]: m for m in moments(df.where(F.col(group).isin(a, b)), group, value)}
    x, y = got[a], got[b]
    pooled = ((x["n"] - 1) * x["var"] + (y["n"] - 1) * y["var"]) / (x["n"] + y["n"] - 2)
    if equal_var:
        se, dof = math.sqrt(pooled * (1 / x["n"] + 1 / y["n"])), float(x["n"] + y["n"] - 2)
    else:
        u, v = x["var"] / x["n"], y["var"] / y["n"]
        se, dof = math.sqrt(u + v), (u + v) ** 2 / (u * u / (x["n"] - 1) + v * v / (y["n"] - 1)) if u + v else 1.0
    gap = x["mean"] - y["mean"]
    t = gap / se if se else 0.0
    d = gap / math.sqrt(pooled) if pooled else 0.0
    return _row(df, statistic=t, df=dof, p_value=_two_sided(t, dof, alternative), difference=gap, ci_low=gap - 1.96 * se, ci_high=gap + 1.96 * se, cohens_d=d, hedges_g=d * (1 - 3 / (4 * (x["n"] + y["n"]) - 9)))


def one_sample_t(df: DataFrame, value: str, mean: float, alternative: str = "two-sided") -> DataFrame:
    r = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    n, m, s = int(r[0]), r[1], r[2] or 0.0
    t = (m - mean) / (s / math.sqrt(n)) if s else 0.0
    return _row(df, statistic=t, df=float(n - 1), p_value=_two_sided(t, n - 1, alternative), mean=m, effect=(m - mean) / s if s else 0.0)


def paired_t(df: DataFrame, a: str, b: str, alternative: str = "two-sided") -> DataFrame:
    return one_sample_t(df.select((F.col(a) - F.col(b)).alias("d")).where("d IS NOT NULL"), "d", 0.0, alternative)


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    g = moments(df, group, value)
    n, k = sum(x["n"] for x in g), len(g)
    grand = sum(x["n"] * x["mean"] for x in g) / n
    between, within = sum(x["n"] * (x["mean"] - grand) ** 2 for x in g), sum((x["n"] - 1) * x["var"] for x in g)
    f = (between / (k - 1)) / (within / (n - k)) if within else math.inf
    mse = within / (n - k)
    return _row(df, statistic=f, df_between=float(k - 1), df_within=float(n - k), p_value=D.f_sf(f, k - 1, n - k), eta_squared=between / (between + within), omega_squared=(between - (k - 1) * mse) / (between + within + mse))


def welch_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    g = [x for x in moments(df, group, value) if x["var"] > 0]
    k = len(g)
    w = [x["n"] / x["var"] for x in g]
    total = sum(w)
    grand = sum(a * x["mean"] for a, x in zip(w, g)) / total
    tail = sum((1 - a / total) ** 2 / (x["n"] - 1) for a, x in zip(w, g))
    f = sum(a * (x["mean"] - grand) ** 2 for a, x in zip(w, g)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * tail)
    dof = (k * k - 1) / (3 * tail)
    return _row(df, statistic=f, df_between=float(k - 1), df_within=dof, p_value=D.f_sf(f, k - 1, dof))


def tukey_hsd(df: DataFrame, group: str, value: str) -> DataFrame:
    g = moments(df, group, value)
    n, k = sum(x["n"] for x in g), len(g)
    mse = sum((x["n"] - 1) * x["var"] for x in g) / (n - k)
    rows = []
    for i, x in enumerate(g):
        for y in g[i + 1 :]:
            q = abs(x["mean"] - y["mean"]) / math.sqrt(mse / 2 * (1 / x["n"] + 1 / y["n"]))
            rows.append((str(x["group"]), str(y["group"]), x["mean"] - y["mean"], q, D.studentized_range_sf(q, k, n - k)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, difference double, q double, p_value double")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The rows with ``rank``: the mean place of their value among all rows (of their ``by`` group)."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("_c").over(w), F.lit(0)) + (F.col("_c") + 1) / 2)
    return df.join(ranked.withColumnRenamed("_c", "ties"), [*by, value])


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    ranked = average_ranks(df, value)
    sums = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("t")).collect()
    n = sum(s["n"] for s in sums)
    h = 12 / (n * (n + 1)) * sum(s["r"] ** 2 / s["n"] for s in sums) - 3 * (n + 1)
    h /= 1 - sum(s["t"] for s in sums) / (n**3 - n)
    return _row(df, statistic=h, df=float(len(sums) - 1), p_value=D.chi2_sf(h, len(sums) - 1))


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """U of the first group by the normal approximation with ties and continuity; rank-biserial r."""
    ranked = average_ranks(df.where(F.col(group).isin(a, b)), value)
    sums = {s[group]: s for s in ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("t")).collect()}
    m, n = sums[a]["n"], sums[b]["n"]
    u = sums[a]["r"] - m * (m + 1) / 2
    total = m + n
    s = math.sqrt(m * n / 12 * (total + 1 - sum(x["t"] for x in sums.values()) / (total * (total - 1))))
    z = max(0.0, abs(u - m * n / 2) - 0.5) / s if s else 0.0
    return _row(df, statistic=u, z=z, p_value=2 * (1 - D.normal_cdf(z)), rank_biserial=1 - 2 * u / (m * n))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d != 0").withColumn("m", F.abs("d"))
    r = average_ranks(d, "m").agg(F.sum(F.when(F.col("d") > 0, F.col("rank"))).alias("p"), F.sum(F.when(F.col("d") < 0, F.col("rank"))).alias("q"), F.count("*").alias("n"), F.sum(F.pow(F.col("ties"), 2) - 1).alias("t")).first()
    n, w = r["n"], min(r["p"] or 0.0, r["q"] or 0.0)
    s = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (r["t"] or 0.0) / 48)
    z = (w - n * (n + 1) / 4) / s if s else 0.0
    return _row(df, statistic=float(w), p_value=2 * D.normal_cdf(-abs(z)))


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    r = cramers_v(df, a, b, yates).first()
    return _row(df, statistic=r["chi2"], df=float(r["dof"]), p_value=D.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else 1.0, cramers_v=r["score"] or 0.0)


def goodness_of_fit(df: DataFrame, column: str, expected: dict | None = None) -> DataFrame:
    counts = {r[0]: r[1] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
    n = sum(counts.values())
    share = expected or {k: 1 / len(counts) for k in counts}
    x = sum((counts.get(k, 0) - n * p) ** 2 / (n * p) for k, p in share.items())
    return _row(df, statistic=x, df=float(len(share) - 1), p_value=D.chi2_sf(x, len(share) - 1))


def fisher_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two columns of booleans."""
    r = df.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)) for x in (True, False) for y in (True, False)]).first()
    return _row(df, odds_ratio=(r[0] * r[3]) / (r[1] * r[2]) if r[1] * r[2] else math.nan, p_value=D.hypergeom_two_sided(*map(int, r)))


def correlation_test(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Pearson, Spearman (of average ranks) or Kendall's tau-b (by counts of distinct value pairs)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    n = both.count()
    if method == "kendall":
        cells = both.groupBy("x", "y").agg(F.count("*").alias("c"))
        p = cells.alias("p").join(cells.alias("q"), (F.col("p.x") < F.col("q.x")) & (F.col("p.y") != F.col("q.y"))).agg(F.sum(F.col("p.c") * F.col("q.c") * F.when(F.col("p.y") < F.col("q.y"), 1).otherwise(-1))).first()[0] or 0
        tie = lambda c: both.groupBy(c).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0.0
        pairs = n * (n - 1) / 2
        base = math.sqrt((pairs - tie("x")) * (pairs - tie("y")))
        r = p / base if base else 0.0
        z = 3 * r * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5)) if n > 1 else 0.0
        return _row(df, statistic=float(r), p_value=2 * D.normal_cdf(-abs(z)), n=n)
    if method == "spearman":
        rx = average_ranks(both, "x").withColumnRenamed("rank", "rx").drop("ties")
        both = average_ranks(rx, "y").select(F.col("rx").alias("x"), F.col("rank").alias("y"))
    r = both.agg(safe_corr(F.col("x"), F.col("y"))).first()[0]
    r = 0.0 if r is None else max(-1.0, min(1.0, r))
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 and n > 2 else math.inf
    return _row(df, statistic=r, p_value=0.0 if math.isinf(t) else D.t_two_sided(t, n - 2), n=n)


def levene(df: DataFrame, group: str, value: str, center: str = "median") -> DataFrame:
    mid = df.groupBy(group).agg((F.median(value) if center == "median" else F.avg(value)).alias("_mid"))
    return anova(df.join(F.broadcast(mid), group).withColumn("_gap", F.abs(F.col(value) - F.col("_mid"))), group, "_gap").select("statistic", "p_value")


def bartlett(df: DataFrame, group: str, value: str) -> DataFrame:
    g = moments(df, group, value)
    n, k = sum(x["n"] for x in g), len(g)
    pooled = sum((x["n"] - 1) * x["var"] for x in g) / (n - k)
    t = ((n - k) * math.log(pooled) - sum((x["n"] - 1) * math.log(x["var"]) for x in g)) / (1 + (sum(1 / (x["n"] - 1) for x in g) - 1 / (n - k)) / (3 * (k - 1)))
    return _row(df, statistic=t, p_value=D.chi2_sf(t, k - 1))


def normality(df: DataFrame, value: str) -> DataFrame:
    """Jarque-Bera and D'Agostino's K2 from the moments of all rows."""
    r = df.agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k")).first()
    n, s, k = r["n"], r["s"] or 0.0, r["k"] or 0.0
    jb = n / 6 * (s * s + k * k / 4)
    y = s * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    zs = math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e, v = 3.0 * (n - 1) / (n + 1), 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k + 3 - e) / math.sqrt(v)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6.0 + 8.0 / sb * (2.0 / sb + math.sqrt(1 + 4.0 / (sb * sb)))
    base = (1 - 2.0 / a) / (1 + x * math.sqrt(2.0 / (a - 4.0)))
    zk = (1 - 2.0 / (9.0 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2.0 / (9.0 * a))
    return _row(df, n=n, skewness=s, kurtosis=k, jarque_bera=jb, jarque_bera_p=D.chi2_sf(jb, 2), dagostino=zs * zs + zk * zk, dagostino_p=D.chi2_sf(zs * zs + zk * zk, 2))


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """Largest gap between the empirical and the fitted normal distribution, over distinct values."""
    m, s, n = df.agg(F.avg(value), F.stddev_samp(value), F.count(value)).first()
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v")
    z = (F.col("v") - m) / (s or 1.0)
    cdf = F.when(z >= 0, 1 - F.exp(-0.717 * z - 0.416 * z * z) / 2).otherwise(F.exp(0.717 * z - 0.416 * z * z) / 2)
    steps = counts.select("v", (F.sum("c").over(w) / n).alias("after"), ((F.sum("c").over(w) - F.col("c")) / n).alias("before"), cdf.alias("cdf"))
    d = steps.agg(F.max(F.greatest(F.abs(F.col("after") - F.col("cdf")), F.abs(F.col("before") - F.col("cdf"))))).first()[0] or 0.0
    return _row(df, statistic=d, p_value=D.kolmogorov_sf(d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))))


def ks_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Largest gap between two empirical distributions, over distinct values."""
    both = a.select(F.col(column).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(column, F.lit(0), F.lit(1))).where("v IS NOT NULL").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w, every = Window.orderBy("v"), Window.partitionBy()
    gaps = both.select(F.abs(F.sum("x").over(w) / F.sum("x").over(every) - F.sum("y").over(w) / F.sum("y").over(every)).alias("d"), F.sum("x").over(every).alias("n"), F.sum("y").over(every).alias("m"))
    r = gaps.agg(F.max("d").alias("d"), F.max("n").alias("n"), F.max("m").alias("m")).first()
    e = math.sqrt(r["n"] * r["m"] / (r["n"] + r["m"]))
    return _row(a, statistic=r["d"], p_value=D.kolmogorov_sf((e + 0.12 + 0.11 / e) * r["d"]))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability over equal-width bins of the reference."""
    lo, hi = reference.agg(F.min(column), F.max(column)).first()
    place = F.least(F.greatest(F.floor((F.col(column) - lo) / ((hi - lo) / bins or 1.0)), F.lit(0)), F.lit(bins - 1))
    share = lambda df, name: df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("c")).select("bin", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias(name))
    both = share(reference, "p").join(share(current, "q"), "bin", "full").select(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-4)).alias("p"), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-4)).alias("q"))
    out = both.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return out.withColumn("drift", F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.25, "moderate").otherwise("strong"))


def ab_proportions(df: DataFrame, variant: str, success: str, control, treatment) -> DataFrame:
    """Pooled z test of two shares, with lift and the difference's interval."""
    got = {r[variant]: r for r in df.where(F.col(variant).isin(control, treatment)).groupBy(variant).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("int")).alias("s")).collect()}
    c, t = got[control], got[treatment]
    a, b, p = c["s"] / c["n"], t["s"] / t["n"], (c["s"] + t["s"]) / (c["n"] + t["n"])
    pooled = math.sqrt(p * (1 - p) * (1 / c["n"] + 1 / t["n"]))
    z = (b - a) / pooled if pooled else 0.0
    se = math.sqrt(a * (1 - a) / c["n"] + b * (1 - b) / t["n"])
    return _row(df, control_rate=a, treatment_rate=b, lift=(b - a) / a if a else 0.0, z=z, p_value=2 * D.normal_cdf(-abs(z)), ci_low=b - a - 1.96 * se, ci_high=b - a + 1.96 * se)


def bayesian_proportions(successes: tuple[int, int], totals: tuple[int, int], draws: int = 10_000, seed: int = 42) -> dict:
    """Chance that the treatment is better, and the expected loss, from Beta posteriors of four counts."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a, b = (rng.beta(1 + s, 1 + n - s, draws) for s, n in zip(successes, totals))
    return {"p_better": float((b > a).mean()), "expected_loss": float(np.maximum(a - b, 0).mean()), "lift": float(((b - a) / a).mean())}


def bootstrap_means(df: DataFrame, group: str, value: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of each group's mean: each row gets a weight per round from a hash, and one aggregate sums them all."""
    u = (F.pmod(F.xxhash64(F.col("_id"), F.col("round"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weight = sum([(u > F.lit(c)).cast("int") for c in (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)], F.lit(0))
    long = df.select(group, value).withColumn("_id", F.monotonically_increasing_id()).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    means = long.withColumn("w", weight).groupBy(group, "round").agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w")).alias("mean"))
    return means.groupBy(group).agg(F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))


def sample_size_proportions(base: float, effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    p2 = base + effect
    z = D.normal_quantile(1 - alpha / 2) + D.normal_quantile(power)
    return math.ceil(z * z * (base * (1 - base) + p2 * (1 - p2)) / effect**2)


def sample_size_means(std: float, effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    return math.ceil(2 * ((D.normal_quantile(1 - alpha / 2) + D.normal_quantile(power)) * std / effect) ** 2)


def minimum_detectable_effect(base: float, n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    return (D.normal_quantile(1 - alpha / 2) + D.normal_quantile(power)) * math.sqrt(2 * base * (1 - base) / n)


def stopping_boundary(look: int, looks: int, alpha: float = 0.05, method: str = "obrien_fleming") -> float:
    """The p-value below which a sequential test stops at a look."""
    if method == "obrien_fleming":
        return 2 * (1 - D.normal_cdf(D.normal_quantile(1 - alpha / 2) * math.sqrt(looks / look)))
    return {1: alpha, 2: 0.0294, 3: 0.0221, 4: 0.0182, 5: 0.0158}.get(looks, alpha / looks) if method == "pocock" else alpha / looks


def diff_in_diff(df: DataFrame, treated: str, after: str, outcome: str) -> DataFrame:
    m = lambda t, a: F.avg(F.when((F.col(treated) == t) & (F.col(after) == a), F.col(outcome)))
    return df.agg(m(1, 0).alias("treated_before"), m(1, 1).alias("treated_after"), m(0, 0).alias("control_before"), m(0, 1).alias("control_after")).withColumn("effect", (F.col("treated_after") - F.col("treated_before")) - (F.col("control_after") - F.col("control_before")))


def inverse_propensity(df: DataFrame, treated: str, outcome: str, propensity: str) -> DataFrame:
    """Ratio estimate of the mean effect with propensities held to .05 to .95."""
    p = F.least(F.greatest(F.col(propensity), F.lit(0.05)), F.lit(0.95))
    a, b = F.col(treated) / p, (1 - F.col(treated)) / (1 - p)
    return df.agg((F.sum(a * F.col(outcome)) / F.sum(a) - F.sum(b * F.col(outcome)) / F.sum(b)).alias("ate"))


def doubly_robust(df: DataFrame, treated: str, outcome: str, propensity: str, mu1: str, mu0: str) -> DataFrame:
    p, t, y = F.least(F.greatest(F.col(propensity), F.lit(0.05)), F.lit(0.95)), F.col(treated), F.col(outcome)
    return df.agg(F.avg(F.col(mu1) - F.col(mu0) + t * (y - F.col(mu1)) / p - (1 - t) * (y - F.col(mu0)) / (1 - p)).alias("ate"))


def propensity_match(df: DataFrame, key: str, treated: str, outcome: str, propensity: str, caliper: float = 0.2, width: float = 0.01) -> DataFrame:
    """Nearest control of each treated row within the caliper (of the propensity's deviation), with replacement: controls are
    summed up by fine steps of the propensity, so a step shared by many rows is one entry, and the nearest step decides."""
    s = (df.agg(F.stddev_samp(propensity)).first()[0] or 0.0) * caliper
    reach = max(1, math.ceil(s / width))
    step = F.floor(F.col(propensity) / width)
    controls = df.where(F.col(treated) == 0).groupBy(step.alias("step")).agg(F.avg(outcome).alias("y0"), F.avg(propensity).alias("p0"))
    own = df.where(F.col(treated) == 1).select(F.col(key).alias("k"), F.col(outcome).alias("y1"), F.col(propensity).alias("p1"), F.explode(F.sequence(step - reach, step + reach)).alias("step"))
    near = own.join(controls, "step").withColumn("gap", F.abs(F.col("p1") - F.col("p0"))).where(F.col("gap") <= s).groupBy("k").agg(F.min_by(F.struct("y1", "y0"), F.struct("gap", "step")).alias("m"))
    return near.agg(F.avg(F.col("m.y1") - F.col("m.y0")).alias("att"), F.count("*").alias("matched"))


def balance(df: DataFrame, treated: str, covariates: list[str], weight: str | None = None) -> DataFrame:
    """Standardised mean differences."""
    w = F.col(weight) if weight else F.lit(1.0)

    def mean(c: str, t: int):
        return F.sum(F.when(F.col(treated) == t, F.col(c) * w)) / F.sum(F.when(F.col(treated) == t, w))

    wide = df.agg(*[x for i, c in enumerate(covariates) for x in (mean(c, 1).alias(f"a{i}"), mean(c, 0).alias(f"b{i}"), F.sqrt((F.var_samp(F.when(F.col(treated) == 1, F.col(c))) + F.var_samp(F.when(F.col(treated) == 0, F.col(c)))) / 2).alias(f"s{i}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.try_divide(F.col(f"a{i}") - F.col(f"b{i}"), F.col(f"s{i}")).alias("smd")) for i, c in enumerate(covariates)])))


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """Product-limit survival with Greenwood's interval, held to 0 to 1."""
    by = [group] if group else []
    times = df.groupBy(*by, F.col(duration).alias("time")).agg(F.sum(F.col(event).cast("int")).alias("events"), F.count("*").alias("leaving"))
    w = Window.partitionBy(*by).orderBy("time")
    risk = times.withColumn("at_risk", F.sum("leaving").over(Window.partitionBy(*by).orderBy(F.desc("time"))))
    keep, gone = F.col("at_risk") - F.col("events"), F.min(F.col("at_risk") - F.col("events")).over(w) <= 0
    out = risk.withColumn("survival", F.when(gone, 0.0).otherwise(F.exp(F.sum(F.when(keep > 0, F.ln(keep / F.col("at_risk"))).otherwise(0.0)).over(w))))
    half = 1.96 * F.col("survival") * F.sqrt(F.sum(F.coalesce(F.try_divide(F.col("events"), F.col("at_risk") * keep), F.lit(0.0))).over(w))
    return out.withColumns({"ci_low": F.greatest(F.col("survival") - half, F.lit(0.0)), "ci_high": F.least(F.col("survival") + half, F.lit(1.0))})


def log_rank(df: DataFrame, duration: str, event: str, group: str, a, b) -> DataFrame:
    own = df.where(F.col(group).isin(a, b)).groupBy(F.col(duration).alias("t")).agg(*[f.alias(n) for g, s in ((a, "1"), (b, "2")) for f, n in ((F.sum(F.when(F.col(group) == g, F.col(event).cast("int")).otherwise(0)), f"d{s}"), (F.count_if(F.col(group) == g), f"l{s}"))])
    w = Window.orderBy(F.desc("t"))
    x = own.select("d1", "d2", F.sum("l1").over(w).alias("n1"), F.sum("l2").over(w).alias("n2")).withColumns({"d": F.col("d1") + F.col("d2"), "n": F.col("n1") + F.col("n2")})
    v = F.when(F.col("n") > 1, F.col("d") * (F.col("n1") / F.col("n")) * (F.col("n2") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    r = x.agg(F.sum(F.col("d1") - F.col("d") * F.col("n1") / F.col("n")).alias("o"), F.sum(v).alias("v")).first()
    z = r["o"] ** 2 / r["v"] if r["v"] else 0.0
    return _row(df, statistic=float(z), p_value=D.chi2_sf(z, 1))


def regression_diagnostics(df: DataFrame, actual: str, predicted: str, order_by: str) -> DataFrame:
    """Mean and spread of the residuals, Durbin-Watson, and the correlation of their size with the prediction."""
    e = df.withColumn("e", F.col(actual) - F.col(predicted)).withColumn("d", F.col("e") - F.lag("e").over(Window.orderBy(order_by)))
    return e.agg(F.avg("e").alias("mean_residual"), F.stddev_samp("e").alias("std_residual"), F.try_divide(F.sum(F.col("d") * F.col("d")), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"), safe_corr(F.abs("e"), F.col(predicted)).alias("spread_correlation"))


def compare_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's test of two groups, an analysis of variance of more."""
    names = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(3).collect()]
    out = t_test(df, group, value, *names, equal_var=False) if len(names) == 2 else anova(df, group, value)
    return out.select(F.lit("welch" if len(names) == 2 else "anova").alias("test"), "statistic", "p_value")


def npv(rate: float, cashflows: list[float]) -> float:
    return sum(c / (1 + rate) ** i for i, c in enumerate(cashflows))


def irr(cashflows: list[float], lo: float = -0.99, hi: float = 10.0) -> float | None:
    if npv(lo, cashflows) * npv(hi, cashflows) > 0:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if npv(lo, cashflows) * npv(mid, cashflows) > 0 else (lo, mid)
    return (lo + hi) / 2
