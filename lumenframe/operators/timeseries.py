"""Time series: regular periods, windows over rows, growth, decomposition, seasonality, trend and forecasts.

A series is a DataFrame with a time or position column and a value; windows over a whole series run over its periods, which are few
however many rows were aggregated into them. Folds over a series use ``aggregate`` over the ordered array of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lags at which a period is sought, and the least autocorrelation that counts.
PERIODS, LEAST_ACF = (7, 12, 4, 52, 24, 30, 365), 0.3
_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "H": "hour"}
_STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR", "H": "INTERVAL 1 HOUR"}


def period_of(time: Column, freq: str) -> Column:
    return F.date_trunc(_UNIT[freq], time.cast("timestamp_ntz"))


def resample(df: DataFrame, time_column: str, value_column: str | None, freq: str = "D") -> DataFrame:
    """period (its start), count, and mean and sum of the value; empty periods have count 0, sum 0 and no mean."""
    figures = [F.count("*").alias("count")] + ([F.avg(value_column).alias("mean"), F.sum(value_column).alias("sum")] if value_column else [])
    got = df.where(F.col(time_column).isNotNull()).groupBy(period_of(F.col(time_column), freq).alias("period")).agg(*figures)
    spine = got.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.expr(f"sequence(lo, hi, {_STEP[freq]})")).alias("period"))
    out = spine.join(got, "period", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.withColumn("sum", F.coalesce("sum", F.lit(0.0))) if value_column else out


def frame(order_by, size: int, partition_by: list[str] | None = None, centered: bool = False) -> Window:
    w = Window.partitionBy(*(partition_by or [])).orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return w.rowsBetween(-(size // 2), size - size // 2 - 1) if centered else w.rowsBetween(-(size - 1), 0)


_FIGURES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def rolling(df: DataFrame, value: str, order_by, size: int = 3, functions=("mean", "sum", "min", "max"), partition_by=None, min_periods: int | None = None) -> DataFrame:
    """Trailing figures over ``size`` rows, null until the window holds ``min_periods`` (by default all) values."""
    w = frame(order_by, size, partition_by)
    full = F.count(value).over(w) >= (size if min_periods is None else min_periods)
    return df.withColumns({f"{value}_rolling_{f}": F.when(full, _FIGURES[f](value).over(w)) for f in functions})


def cumulative(df: DataFrame, value: str, order_by, partition_by=None) -> DataFrame:
    """Running sum, running row count (rows without a value count) and their quotient."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*([order_by] if isinstance(order_by, str) else order_by)).rowsBetween(Window.unboundedPreceding, 0)
    total, rows = F.sum(value).over(w), F.count("*").over(w)
    return df.withColumns({f"{value}_cumsum": total, f"{value}_cumcount": rows, f"{value}_cummean": total / rows})


def lags(df: DataFrame, value: str, order_by, steps=(1, 2, 3, 7, 14, 30), partition_by=None) -> DataFrame:
    w = Window.partitionBy(*(partition_by or [])).orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return df.withColumns({k: v for s in steps for k, v in ((f"{value}_lag_{s}", F.lag(value, s).over(w)), (f"{value}_diff_{s}", F.col(value) - F.lag(value, s).over(w)))})


def rolling_features(df: DataFrame, value: str, order_by, sizes=(7, 14, 30), partition_by=None) -> DataFrame:
    """Trailing mean, std (0 where undefined), min and max of however many rows there are."""
    out = {}
    for n in sizes:
        w = frame(order_by, n, partition_by)
        out |= {f"{value}_mean_{n}": F.avg(value).over(w), f"{value}_std_{n}": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), f"{value}_min_{n}": F.min(value).over(w), f"{value}_max_{n}": F.max(value).over(w)}
    return df.withColumns(out)


def growth(series: DataFrame, order_by: str, value: str) -> DataFrame:
    """Change and percent change to the row before (by its absolute value, 0 where that is 0), and growth since the first row."""
    w = Window.orderBy(order_by)
    before, first = F.lag(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda now, then: F.when(then == 0, 0.0).otherwise((now - then) * 100.0 / F.abs(then))
    return series.withColumns({"change": F.col(value) - before, "pct_change": share(F.col(value), before), "cumulative_growth": share(F.col(value), first)})


def pct_change(series: DataFrame, order_by: str, value: str, rows_back: int = 1) -> DataFrame:
    """Month over month with 1 row back, year over year with 12."""
    before = F.lag(value, rows_back).over(Window.orderBy(order_by))
    return series.withColumn("growth_pct", F.try_divide(F.col(value), before) * 100 - 100)


def cagr(series: DataFrame, order_by: str, value: str, per_year: int = 12) -> DataFrame:
    got = series.agg(F.min_by(value, order_by).alias("first"), F.max_by(value, order_by).alias("last"), F.count(value).alias("n"))
    return got.select("first", "last", "n", F.when((F.col("first") > 0) & (F.col("last") > 0), F.pow(F.col("last") / F.col("first"), F.lit(float(per_year)) / F.col("n")) - 1).alias("cagr"))


def period_comparison(df: DataFrame, date: str, value: str, freq: str = "M") -> DataFrame:
    made = df.groupBy(period_of(F.col(date), freq).alias("period")).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(value).alias("count"))
    before = F.lag("sum").over(Window.orderBy("period"))
    return made.withColumns({"previous": before, "growth_pct": F.try_divide(F.col("sum") - before, before) * 100})


def yoy(df: DataFrame, date: str, value: str) -> DataFrame:
    """Sums by month and year, and the growth of each month over the same month a year before."""
    made = df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.sum(value).alias("sum"))
    before = F.lag("sum").over(Window.partitionBy("month").orderBy("year"))
    return made.withColumn("growth_pct", F.try_divide(F.col("sum") - before, before) * 100)


def centered_mean(order_by: str, value: str, size: int) -> Column:
    """Mean of 2 * (size // 2) + 1 rows around, null at the edges."""
    half = size // 2
    w = Window.orderBy(order_by).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) == 2 * half + 1, F.avg(value).over(w))


def smooth(series: DataFrame, order_by: str, value: str, size: int = 7) -> DataFrame:
    """Centred moving average, its first and last values carried to the edges."""
    w = Window.orderBy(order_by)
    out = series.withColumn("_m", centered_mean(order_by, value, size))
    ahead, behind = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("smoothed", F.coalesce("_m", ahead, behind)).drop("_m")


def autocorrelation(series: DataFrame, order_by: str, value: str, steps=PERIODS) -> DataFrame:
    """lag, acf for the lags shorter than half of the series."""
    w = Window.orderBy(order_by)
    centred = series.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy()))
    wide = centred.withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in steps}).agg(F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("v"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"c{k}") for k in steps])
    long = wide.select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"c{k}"), F.col("v")).alias("acf")) for k in steps])))
    return long.where(F.col("lag") * 2 <= F.col("n")).select("lag", "acf")


def detect_period(series: DataFrame, order_by: str, value: str) -> int | None:
    best = autocorrelation(series, order_by, value).where(F.col("acf") > LEAST_ACF).orderBy(F.desc("acf"), "lag").first()
    return best["lag"] if best else None


def decompose(series: DataFrame, order_by: str, value: str, period: int, model: str = "additive") -> DataFrame:
    """Classical decomposition: trend (centred mean, twice for an even period), seasonal (mean of the detrended values by place
    in the period, normalised) and residual. Where the trend has no value, the detrended value counts as neutral."""
    w = Window.orderBy(order_by)
    add = model == "additive"
    df = series.withColumn("_i", F.row_number().over(w) - 1).withColumn("_t", centered_mean("_i", value, period))
    if period % 2 == 0:
        df = df.withColumn("_t", F.when(F.lag("_t").over(w).isNotNull(), (F.col("_t") + F.lag("_t").over(w)) / 2))
    neutral = F.lit(0.0 if add else 1.0)
    loose = F.coalesce(F.col(value) - F.col("_t") if add else F.try_divide(F.col(value), F.col("_t")), neutral)
    place = Window.partitionBy(F.col("_i") % period)
    df = df.withColumn("_d", loose).withColumn("_s", F.avg("_d").over(place))
    means = df.groupBy((F.col("_i") % period).alias("_p")).agg(F.first("_s").alias("_m")).agg(F.avg("_m").alias("_level"))
    df = df.crossJoin(F.broadcast(means)).withColumn("seasonal", F.col("_s") - F.col("_level") if add else F.try_divide(F.col("_s"), F.col("_level")))
    rest = F.col(value) - F.col("_t") - F.col("seasonal") if add else F.try_divide(F.col(value), F.col("_t") * F.col("seasonal"))
    return df.select(*series.columns, F.col("_t").alias("trend"), "seasonal", rest.alias("residual"))


def deseasonalize(series: DataFrame, order_by: str, value: str, period: int) -> DataFrame:
    return decompose(series, order_by, value, period).withColumn("adjusted", F.col(value) - F.col("seasonal"))


def seasonality(series: DataFrame, order_by: str, value: str, period: int) -> DataFrame:
    """Index of each place in the period, 100 on average."""
    places = series.withColumn("position", (F.row_number().over(Window.orderBy(order_by)) - 1) % period).groupBy("position").agg(F.avg(value).alias("mean"))
    return places.withColumn("index", F.try_divide(F.col("mean") * 100, F.avg("mean").over(Window.partitionBy())))


def trend(series: DataFrame, order_by: str, value: str) -> DataFrame:
    """Slope, intercept and R2 over the row's place, Kendall's tau, and strength (their mean). Tau compares all pairs of a
    series of periods, by one fold for each value over those before it."""
    numbered = series.withColumn("i", (F.row_number().over(Window.orderBy(order_by)) - 1).cast("double")).withColumn("y", F.col(value).cast("double"))
    line = numbered.agg(F.regr_slope("y", "i").alias("slope"), F.regr_intercept("y", "i").alias("intercept"), F.coalesce(F.regr_r2("y", "i"), F.lit(0.0)).alias("r2"), F.count("y").alias("n"), F.array_sort(F.collect_list(F.struct("i", "y"))).alias("s"))
    ys = F.transform("s", lambda x: x["y"])
    pairs = F.aggregate(F.sequence(F.lit(1), F.size("s")), F.lit(0.0), lambda t, i: t + F.aggregate(F.slice(ys, 1, i), F.lit(0.0), lambda u, v: u + F.signum(F.element_at(ys, i) - v)))
    tau = F.try_divide(pairs * 2, F.col("n") * (F.col("n") - 1))
    return line.select("slope", "intercept", "r2", "n", tau.alias("tau")).withColumn("strength", (F.col("r2") + F.abs("tau")) / 2)


def change_points(series: DataFrame, order_by: str, value: str, size: int = 10, t_least: float = 2.88) -> DataFrame:
    """Rows where the means of the ``size`` rows before and after differ by a t of at least ``t_least`` (p < .01 at size 10)."""
    w = Window.orderBy(order_by)
    left, right = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    out = series.withColumns({f"_{k}{s}": f(value).over(x) for s, x in (("l", left), ("r", right)) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))})
    t = F.try_divide(F.abs(F.col("_ml") - F.col("_mr")), F.sqrt((F.col("_vl") + F.col("_vr")) / size))
    return out.where((F.col("_nl") == size) & (F.col("_nr") == size)).withColumn("t", t).where(F.col("t") >= t_least).select(*series.columns, "t")


def segments(series: DataFrame, order_by: str, value: str, breaks: list) -> DataFrame:
    """A line through each stretch between the breaks."""
    numbered = series.withColumn("i", F.row_number().over(Window.orderBy(order_by)).cast("double"))
    part = sum([(F.col(order_by) >= F.lit(b)).cast("int") for b in breaks], F.lit(0))
    return numbered.groupBy(part.alias("segment")).agg(F.regr_slope(F.col(value).cast("double"), "i").alias("slope"), F.coalesce(F.regr_r2(F.col(value).cast("double"), "i"), F.lit(0.0)).alias("r2"), F.count("*").alias("n"))


def _ordered(order_by: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("k"), F.col(value).cast("double").alias("y")))), lambda x: x["y"])


def holt(series: DataFrame, order_by: str, value: str, horizon: int = 12, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Level and trend by one fold over the ordered values; an interval of 1.96 times a tenth of the level times sqrt(h)."""
    ys = series.where(F.col(value).isNotNull()).agg(_ordered(order_by, value).alias("ys"))
    start = F.struct(F.col("ys")[0].alias("level"), F.when(F.size("ys") > 1, F.get("ys", F.lit(1)) - F.col("ys")[0]).otherwise(F.lit(0.0)).alias("trend"))

    def step(s, y):
        level = alpha * y + (1 - alpha) * (s["level"] + s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend"))

    end = ys.where(F.size("ys") > 0).select(F.aggregate(F.slice("ys", 2, F.size("ys")), start, step).alias("s"))
    out = end.select("s", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    at, half = F.col("s.level") + F.col("h") * F.col("s.trend"), 1.96 * 0.1 * F.abs(F.col("s.level")) * F.sqrt("h")
    return out.select("h", at.alias("forecast"), (at - half).alias("lower"), (at + half).alias("upper"))


def moving_average_forecast(series: DataFrame, order_by: str, value: str, horizon: int = 12, window: int = 7) -> DataFrame:
    tail = series.orderBy(F.desc(order_by)).limit(window).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    out = tail.select("m", "s", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return out.select("h", F.col("m").alias("forecast"), (F.col("m") - 1.96 * F.col("s")).alias("lower"), (F.col("m") + 1.96 * F.col("s")).alias("upper"))


def linear_forecast(series: DataFrame, order_by: str, value: str, horizon: int = 12) -> DataFrame:
    numbered = series.withColumn("i", (F.row_number().over(Window.orderBy(order_by)) - 1).cast("double")).withColumn("y", F.col(value).cast("double"))
    line = numbered.agg(F.regr_slope("y", "i").alias("b"), F.regr_intercept("y", "i").alias("a"), F.count("y").alias("n"), F.sqrt(F.try_divide(F.regr_syy("y", "i") - F.try_divide(F.pow(F.regr_sxy("y", "i"), 2), F.regr_sxx("y", "i")), F.regr_count("y", "i"))).alias("s"))
    out = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    at = F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("h"))
    return out.select("h", at.alias("forecast"), (at - 1.96 * F.col("s")).alias("lower"), (at + 1.96 * F.col("s")).alias("upper"))


def holt_winters(series: DataFrame, order_by: str, value: str, period: int, horizon: int = 12, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> DataFrame:
    """Additive level, trend and seasons by one fold; the first two periods give the start."""
    ys = series.where(F.col(value).isNotNull()).agg(_ordered(order_by, value).alias("ys")).where(F.size("ys") >= 2 * period)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / period
    first, second = F.slice("ys", 1, period), F.slice("ys", period + 1, period)
    start = F.struct(mean(first).alias("level"), ((mean(second) - mean(first)) / period).alias("trend"), F.transform(first, lambda y: y - mean(first)).alias("season"))

    def step(s, y):
        old = s["season"][0]
        level = alpha * (y - old) + (1 - alpha) * (s["level"] + s["trend"])
        season = F.concat(F.slice(s["season"], 2, period - 1), F.array(gamma * (y - level) + (1 - gamma) * old))
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend"), season.alias("season"))

    end = ys.select(F.aggregate(F.slice("ys", period + 1, F.size("ys")), start, step).alias("s"))
    out = end.select("s", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return out.select("h", (F.col("s.level") + F.col("h") * F.col("s.trend") + F.get(F.col("s.season"), (F.col("h") - 1) % period)).alias("forecast"))


def polynomial_trend(series: DataFrame, order_by: str, value: str, degree: int = 2) -> DataFrame:
    """Coefficients, the constant first, over the row's place scaled to 0 to 1, from sums of powers in one aggregate."""
    import numpy as np

    n = series.count()
    x = ((F.row_number().over(Window.orderBy(order_by)) - 1) / max(1, n - 1)).cast("double")
    numbered = series.select(x.alias("x"), F.col(value).cast("double").alias("y")).where("y IS NOT NULL")
    r = numbered.agg(*[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)]).first()
    a = np.array([[r[f"s{i + j}"] or 0.0 for j in range(degree + 1)] for i in range(degree + 1)])
    c = np.linalg.lstsq(a, np.array([r[f"t{k}"] or 0.0 for k in range(degree + 1)]), rcond=None)[0]
    return series.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(c)], "power int, coefficient double")


FORECASTS = {"holt": holt, "moving_average": moving_average_forecast, "linear": linear_forecast}


def ensemble_forecast(series: DataFrame, order_by: str, value: str, horizon: int = 12, members: dict[str, float] | None = None) -> DataFrame:
    members = members or {k: 1.0 for k in FORECASTS}
    out = None
    for name, weight in members.items():
        part = FORECASTS[name](series, order_by, value, horizon).withColumn("w", F.lit(float(weight)))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("h").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("forecast", "lower", "upper")])


def evaluate(df: DataFrame, actual: str, predicted: str, order_by: str) -> DataFrame:
    """MAE, RMSE, MAPE over actual values that aren't 0, and MAE against the step-back forecast's."""
    e = F.abs(F.col(actual) - F.col(predicted))
    naive = F.abs(F.col(actual) - F.lag(actual).over(Window.orderBy(order_by)))
    got = df.withColumn("_n", naive).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(F.col(actual) != 0, e / F.abs(actual))) * 100).alias("mape"), F.avg("_n").alias("_n"))
    return got.select("mae", "rmse", "mape", F.try_divide("mae", "_n").alias("mase"))


def outside_interval(actual: DataFrame, forecast: DataFrame, key: str, value: str) -> DataFrame:
    return actual.join(forecast, key).where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def missing_dates(df: DataFrame, date: str, freq: str = "D") -> DataFrame:
    return resample(df, date, None, freq).where("count = 0").select("period")


def ewma_residuals(series: DataFrame, order_by: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted mean at each place (a missing value carries it on) and the absolute residual."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("k"), F.col(value).cast("double").alias("y"))))
    item = "array<struct<k:{0},y:double,ewma:double>>".format(series.schema[order_by].dataType.simpleString())

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))["ewma"]
        now = F.when(x["y"].isNull(), last).when(last.isNull(), x["y"]).otherwise(alpha * x["y"] + (1 - alpha) * last)
        return F.concat(done, F.array(F.struct(x["k"].alias("k"), x["y"].alias("y"), now.alias("ewma"))))

    folded = series.agg(pairs.alias("s")).select(F.inline(F.aggregate("s", F.array().cast(item), step)))
    return folded.select(F.col("k").alias(order_by), F.col("y").alias(value), "ewma", F.abs(F.col("y") - F.col("ewma")).alias("residual"))


def portfolio(prices: DataFrame, order_by: str, price: str, risk_free: float = 0.02, days: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe and Sortino ratios, deepest drawdown, value at risk and its tail mean at 95 %."""
    w = Window.orderBy(order_by)
    r = prices.withColumns({"r": F.col(price) / F.lag(price).over(w) - 1, "dd": F.col(price) / F.max(price).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    cut = r.agg(F.percentile("r", 0.05).alias("var95"))
    got = r.crossJoin(F.broadcast(cut)).agg(
        (F.avg("r") * days).alias("annual_return"), (F.stddev_pop("r") * days**0.5).alias("volatility"), (F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))) * days**0.5).alias("downside"),
        F.min("dd").alias("max_drawdown"), F.max("var95").alias("var95"), F.avg(F.when(F.col("r") <= F.col("var95"), F.col("r"))).alias("cvar95"),
    )
    return got.withColumns({"sharpe": F.try_divide(F.col("annual_return") - risk_free, F.col("volatility")), "sortino": F.try_divide(F.col("annual_return") - risk_free, F.col("downside"))})


def beta(df: DataFrame, own: str, market: str) -> DataFrame:
    """Sample covariance over population variance."""
    return df.agg(F.try_divide(F.covar_samp(own, market), F.var_pop(market)).alias("beta"))


def rolling_finance(prices: DataFrame, order_by: str, price: str, size: int = 252) -> DataFrame:
    w = Window.orderBy(order_by)
    r = prices.withColumn("_r", F.col(price) / F.lag(price).over(w) - 1)
    back, enough = w.rowsBetween(-(size - 1), 0), F.count("_r").over(w.rowsBetween(-(size - 1), 0)) == size
    return r.withColumns({"rolling_return": F.col(price) / F.lag(price, size).over(w) - 1, "rolling_volatility": F.when(enough, F.stddev_samp("_r").over(back) * 252**0.5), "rolling_drawdown": F.col(price) / F.max(price).over(back) - 1}).drop("_r")
