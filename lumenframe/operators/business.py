"""Customers, products and money: RFM, cohorts, funnels, sessions, churn, value, Pareto, stock, prices, profit, risk, fraud, baskets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..llm.common import prepare, shared_folder, shuffle_parts, stored
from .timeseries import period_of

#: Segments by (recency score, frequency score).
SEGMENTS = {
    (5, 5): "Champions", (5, 4): "Champions", (4, 5): "Champions",
    (4, 4): "Loyal Customers", (3, 5): "Loyal Customers", (3, 4): "Loyal Customers",
    (5, 3): "Potential Loyalists", (4, 3): "Potential Loyalists", (5, 2): "Potential Loyalists",
    (5, 1): "New Customers", (4, 1): "New Customers",
    (4, 2): "Promising", (3, 1): "Promising",
    (3, 3): "Need Attention", (3, 2): "Need Attention", (2, 3): "Need Attention",
    (2, 2): "About to Sleep", (2, 1): "About to Sleep",
    (2, 5): "At Risk", (2, 4): "At Risk",
    (1, 5): "Can't Lose Them", (1, 4): "Can't Lose Them",
    (1, 3): "Hibernating", (1, 2): "Hibernating",
    (1, 1): "Lost",
}


def quintile(order: Column, key: str, n: int = 5) -> Column:
    """The bucket 1 to n of a row's place, as equal-count cuts of distinct ranks give it; ties go by key."""
    place = F.row_number().over(Window.orderBy(order, key)) - 1
    rows = F.count("*").over(Window.partitionBy())
    return F.when(rows > 1, F.greatest(F.ceil(place * n / (rows - 1)), F.lit(1))).otherwise(1).cast("int")


def rfm(df: DataFrame, customer: str, date: str, amount: str, reference: str) -> DataFrame:
    """recency (days to the reference date), frequency, monetary, scores 1 to 5 and the segment. Bounds of the scores are
    quantiles of all customers, compared by value, so no window holds every customer."""
    per = df.groupBy(customer).agg(F.datediff(F.lit(reference).cast("date"), F.max(date).cast("date")).alias("recency"), F.count("*").alias("frequency"), F.sum(amount).alias("monetary"))
    cuts = F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])
    edges = per.agg(*[F.percentile(c, cuts).alias(f"_{c}") for c in ("recency", "frequency", "monetary")])
    bucket = lambda c: (1 + sum([(F.col(c) > F.col(f"_{c}")[i]).cast("int") for i in range(4)], F.lit(0))).cast("int")
    scored = per.crossJoin(F.broadcast(edges)).withColumns({"r_score": (6 - bucket("recency")).cast("int"), "f_score": bucket("frequency"), "m_score": bucket("monetary")}).drop("_recency", "_frequency", "_monetary")
    names = F.create_map(*[x for (r, f), name in SEGMENTS.items() for x in (F.lit(10 * r + f), F.lit(name))])
    return scored.withColumn("segment", names[F.col("r_score") * 10 + F.col("f_score")])


def segment_table(scored: DataFrame) -> DataFrame:
    out = scored.groupBy("segment").agg(F.count("*").alias("customers"), F.avg("recency").alias("recency"), F.avg("frequency").alias("frequency"), F.sum("monetary").alias("revenue"))
    return out.withColumn("share", F.col("customers") / F.sum("customers").over(Window.partitionBy()))


def cohorts(df: DataFrame, user: str, date: str, freq: str = "M", value: str | None = None) -> DataFrame:
    """cohort (first period), periods since, users, their share of the cohort's first period, and revenue."""
    first = df.groupBy(user).agg(period_of(F.min(date), freq).alias("cohort"))
    period = period_of(F.col(date), freq)
    months = {"M": F.months_between(F.col("p"), F.col("cohort")), "Q": F.months_between(F.col("p"), F.col("cohort")) / 3, "Y": F.months_between(F.col("p"), F.col("cohort")) / 12, "W": F.datediff("p", "cohort") / 7, "D": F.datediff("p", "cohort")}[freq]
    active = df.withColumn("p", period).join(first, user).withColumn("periods", F.round(months).cast("int"))
    figures = [F.count_distinct(user).alias("users")] + ([F.sum(value).alias("revenue")] if value else [])
    out = active.groupBy("cohort", "periods").agg(*figures)
    size = F.max(F.when(F.col("periods") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return out.withColumn("retention", F.col("users") / size)


def funnel(df: DataFrame, user: str, event: str, steps: list[str], time: str | None = None, ordered: bool = False) -> DataFrame:
    """Users who have a step and all steps before it; with ``ordered``, in the order of their first times."""
    per = df.where(F.col(event).isin(*steps)).groupBy(user).agg(*[(F.min(F.when(F.col(event) == s, F.col(time))) if ordered else F.max(F.when(F.col(event) == s, 1))).alias(f"s{i}") for i, s in enumerate(steps)])
    reached = [F.col("s0").isNotNull()]
    for i in range(1, len(steps)):
        reached.append(reached[-1] & (F.col(f"s{i}") >= F.col(f"s{i - 1}") if ordered else F.col(f"s{i}").isNotNull()))
    wide = per.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(f"u{i}") for i, r in enumerate(reached)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("name"), F.col(f"u{i}").alias("users"), F.col(f"u{max(i - 1, 0)}").alias("before"), F.col("u0").alias("first")) for i, s in enumerate(steps)])))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return long.select("step", "name", "users", rate("users", "before").alias("conversion"), (F.col("before") - F.col("users")).alias("drop_off"), rate("users", "first").alias("overall"))


def time_between_steps(df: DataFrame, user: str, event: str, time: str, steps: list[str]) -> DataFrame:
    per = df.groupBy(user).agg(*[F.min(F.when(F.col(event) == s, F.col(time))).alias(f"s{i}") for i, s in enumerate(steps)])
    hours = lambda i: (F.unix_micros(F.col(f"s{i}").cast("timestamp")) - F.unix_micros(F.col(f"s{i - 1}").cast("timestamp"))) / 3.6e9
    wide = per.agg(*[F.avg(F.when(F.col(f"s{i}") > F.col(f"s{i - 1}"), hours(i))).alias(f"h{i}") for i in range(1, len(steps))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(steps[i - 1]).alias("from_step"), F.lit(steps[i]).alias("to_step"), F.col(f"h{i}").alias("hours")) for i in range(1, len(steps))])))


def sessions(df: DataFrame, user: str, time: str, page: str | None = None, gap_minutes: int = 30, conversion: Column | None = None) -> DataFrame:
    """A session ends with a gap of more than ``gap_minutes``: events, distinct pages, duration, bounce and conversion."""
    w = Window.partitionBy(user).orderBy(time)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.when(micros - F.lag(micros).over(w) > gap_minutes * 60_000_000, 1).otherwise(0)
    cut = df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w))
    figures = [F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events")]
    figures += [F.count_distinct(page).alias("pages"), F.min_by(page, time).alias("entry"), F.max_by(page, time).alias("exit")] if page else []
    figures += [F.max(F.coalesce(conversion, F.lit(False))).alias("converted")] if conversion is not None else []
    out = cut.groupBy(user, "session").agg(*figures)
    return out.withColumns({"seconds": (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6, "bounce": F.col("events") == 1})


def churn_features(df: DataFrame, customer: str, date: str, value: str, reference: str) -> DataFrame:
    """First and last activity, recency, tenure, monthly frequency, value figures and activity of the last 30 and 90 days."""
    ref = F.lit(reference).cast("date")
    ago = F.datediff(ref, F.col(date).cast("date"))
    out = df.groupBy(customer).agg(
        F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("activity"), F.sum(value).alias("value_sum"), F.avg(value).alias("value_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("value_std"),
        F.count_if(ago <= 30).alias("active_30"), F.count_if(ago <= 90).alias("active_90"), F.min(ago).alias("recency"),
    )
    tenure = F.datediff(F.col("last").cast("date"), F.col("first").cast("date")) + 1
    return out.withColumns({"tenure": tenure, "monthly_frequency": F.col("activity") / (tenure / 30.0), "trend": F.col("active_30") - F.col("active_90") / 3.0, "churned": F.col("recency") > 90})


def lifetime_value(df: DataFrame, customer: str, date: str, amount: str, reference: str, months: int = 12, discount: float = 0.1) -> DataFrame:
    """Simple, historical and predictive value: purchases a month, chance of being alive from recency, discounted sums."""
    per = df.groupBy(customer).agg(F.count("*").alias("orders"), F.sum(amount).alias("total"), F.avg(amount).alias("mean_order"), F.datediff(F.max(date).cast("date"), F.min(date).cast("date")).alias("tenure"), F.datediff(F.lit(reference).cast("date"), F.max(date).cast("date")).alias("recency"))
    rate = F.when(F.col("tenure") > 0, F.col("orders") / (F.col("tenure") / 30.0)).otherwise(F.lit(1.0))
    alive = F.when(F.col("tenure") > 0, 1 - F.col("recency") / (F.col("recency") + 30 / F.col("rate"))).otherwise(F.lit(0.5))
    annuity = sum(1 / (1 + discount / 12) ** i for i in range(1, months + 1)) / months
    return per.withColumn("rate", rate).withColumn("p_alive", alive).withColumns({"expected_orders": F.col("rate") * months * F.col("p_alive"), "predicted_value": F.col("rate") * months * F.col("p_alive") * F.col("mean_order") * annuity})


def probabilistic_value(rfm_table: DataFrame, months: int = 12, discount: float = 0.1) -> DataFrame:
    """A sigmoid of recency for the chance of being alive, which counts twice, times the sum of monthly discount factors."""
    factors = sum(1 / (1 + discount / 12) ** i for i in range(1, months + 1))
    alive = 1 / (1 + F.exp((F.col("recency") - 90) / 30.0))
    return rfm_table.withColumn("p_alive", alive).withColumn("expected_orders", F.col("frequency") / 12.0 * F.col("p_alive")).withColumn("clv", F.col("expected_orders") * F.col("p_alive") * F.col("monetary") / F.col("frequency") * factors)


def pareto(df: DataFrame, category: str, value: str) -> DataFrame:
    """Sums by category, largest first, with share, running share, place and class A to 80 %, B to 95 %, else C."""
    sums = df.groupBy(category).agg(F.sum(value).alias("total"))
    w = Window.orderBy(F.desc("total"), category)
    share = F.col("total") * 100 / F.sum("total").over(Window.partitionBy())
    out = sums.withColumns({"share": share, "rank": F.row_number().over(w), "cumulative": F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100 / F.sum("total").over(Window.partitionBy())})
    return out.withColumn("class", F.when(F.col("cumulative") <= 80, "A").when(F.col("cumulative") <= 95, "B").otherwise("C"))


def abc_by_rank(df: DataFrame, item: str, value: str) -> DataFrame:
    """A for the first fifth of items by value, B to the half, C after; equal values share their mean place."""
    sums = df.groupBy(item).agg(F.sum(value).alias("total"))
    counts = sums.groupBy("total").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("pct", (F.coalesce(F.sum("c").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("c") + 1) / 2) / F.sum("c").over(Window.partitionBy()))
    return sums.join(ranked.select("total", "pct"), "total").withColumn("class", F.when(F.col("pct") <= 0.2, "A").when(F.col("pct") <= 0.5, "B").otherwise("C"))


def inventory(df: DataFrame, item: str, quantity: str, date: str, stock: Column, lead_days: int = 7, safety: float = 1.5) -> DataFrame:
    """Daily sales, days of stock (999 without sales), reorder point and status."""
    per = df.groupBy(item).agg(F.sum(quantity).alias("sold"), (F.datediff(F.max(date).cast("date"), F.min(date).cast("date")) + 1).alias("days"), F.max(stock).alias("stock"))
    out = per.withColumn("daily", F.col("sold") / F.col("days")).withColumns({"days_of_stock": F.when(F.col("daily") > 0, F.col("stock") / F.col("daily")).otherwise(999.0), "reorder_point": F.col("daily") * lead_days * safety})
    return out.withColumn("status", F.when(F.col("stock") <= 0, "out").when(F.col("stock") <= F.col("reorder_point"), "reorder").when(F.col("days_of_stock") > 90, "overstock").otherwise("ok"))


def elasticity(df: DataFrame, price: str, quantity: str) -> DataFrame:
    """Slope of ln(quantity + 1) over ln(price + 1)."""
    x, y = F.ln(F.col(price) + 1), F.ln(F.col(quantity) + 1)
    return df.agg(F.regr_slope(y, x).alias("elasticity"), F.regr_r2(y, x).alias("r2"))


def price_tiers(df: DataFrame, price: str, tiers: int = 4) -> DataFrame:
    from .transforms import bin_code, quantile_edges

    return df.withColumn("tier", bin_code(F.col(price), quantile_edges(df, price, tiers))).groupBy("tier").agg(F.count("*").alias("rows"), F.min(price).alias("low"), F.max(price).alias("high"), F.avg(price).alias("mean"))


def best_price(df: DataFrame, price: str, quantity: str, bins: int = 10) -> DataFrame:
    """The equal-width price range of largest revenue."""
    lo, hi = df.agg(F.min(price), F.max(price)).first()
    place = F.least(F.floor((F.col(price) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.sum(F.col(price) * F.col(quantity)).alias("revenue"), F.avg(price).alias("mean_price"), F.count("*").alias("rows")).orderBy(F.desc("revenue"), "bin").limit(1)


def profit(df: DataFrame, revenue: str, cost: str, by: list[str] | None = None) -> DataFrame:
    out = df.groupBy(*(by or [])).agg(F.sum(revenue).alias("revenue"), F.sum(cost).alias("cost"))
    return out.withColumn("profit", F.col("revenue") - F.col("cost")).withColumn("margin_pct", F.coalesce(F.try_divide(F.col("profit") * 100, F.col("revenue")), F.lit(0.0)))


def break_even(fixed_costs: float, variable_cost: float, price: float) -> dict:
    margin = price - variable_cost
    units = fixed_costs / margin if margin > 0 else None
    return {"units": units, "revenue": units * price if units is not None else None, "margin": margin}


def variance(df: DataFrame, category: str, budget: str, actual: str, expense: bool = False) -> DataFrame:
    out = df.groupBy(category).agg(F.sum(budget).alias("budget"), F.sum(actual).alias("actual")).withColumn("variance", F.col("actual") - F.col("budget"))
    return out.withColumns({"variance_pct": F.coalesce(F.try_divide(F.col("variance") * 100, F.abs("budget")), F.lit(0.0)), "favorable": F.col("variance") <= 0 if expense else F.col("variance") >= 0})


def benchmark(current: dict[str, float], targets: dict[str, float], lower_is_better: set[str] = frozenset()) -> dict[str, dict]:
    out = {}
    for name, target in targets.items():
        if name in current:
            pct = (current[name] - target) / abs(target) * 100 if target else 0.0
            good = -pct if name in lower_is_better else pct
            out[name] = {"variance_pct": pct, "band": "above" if good >= 5 else "on" if good >= -5 else "below" if good >= -20 else "far below"}
    return out


def percentile_of(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.agg((F.count_if(F.col(column) <= value) * 100.0 / F.count(column)).alias("percentile"))


def core_metrics(df: DataFrame, revenue: str, user: str, order: str | None = None) -> DataFrame:
    orders = F.count_distinct(order) if order else F.count("*")
    return df.agg(F.sum(revenue).alias("revenue"), F.count_distinct(user).alias("users"), orders.alias("orders")).withColumns({"aov": F.try_divide("revenue", "orders"), "arpu": F.try_divide("revenue", "users")})


def dau_mau(df: DataFrame, user: str, date: str) -> DataFrame:
    daily = df.groupBy(F.to_date(date).alias("day")).agg(F.count_distinct(user).alias("dau")).groupBy(F.date_trunc("month", "day").alias("month")).agg(F.avg("dau").alias("dau"))
    monthly = df.groupBy(F.date_trunc("month", date).alias("m")).agg(F.count_distinct(user).alias("mau"))
    return daily.join(monthly, F.to_date("month") == F.to_date("m")).select(F.to_date("month").alias("month"), "dau", "mau", (F.col("dau") / F.col("mau")).alias("stickiness"))


def kpi(df: DataFrame, formulas: dict[str, str], targets: dict[str, float] | None = None) -> DataFrame:
    """SQL aggregate expressions by name, with target and status: met from 100 %, near from 90 %."""
    wide = df.agg(*[F.expr(x).cast("double").alias(n) for n, x in formulas.items()])
    goals = F.create_map(*[F.lit(x) for n in formulas for x in (n, (targets or {}).get(n))]) if targets else None
    out = wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(n).alias("value")) for n in formulas])))
    if goals is None:
        return out
    out = out.withColumn("target", goals[F.col("kpi")].cast("double"))
    return out.withColumn("status", F.when(F.col("target").isNull(), "none").when(F.col("value") >= F.col("target"), "met").when(F.col("value") >= 0.9 * F.col("target"), "near").otherwise("missed"))


def risk_scores(df: DataFrame, entity: str, factors: dict[str, float]) -> DataFrame:
    """Factors with medians for gaps, stretched to 0 to 100 (50 if constant), their weighted mean, a band and the top factor."""
    r = df.agg(*[x for c in factors for x in (F.median(c).alias(f"m_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()

    def part(c: str) -> Column:
        lo, hi = r[f"a_{c}"], r[f"b_{c}"]
        return F.lit(50.0) if lo is None or hi == lo else (F.coalesce(F.col(c).cast("double"), F.lit(float(r[f"m_{c}"]))) - float(lo)) * (100.0 / (float(hi) - float(lo)))

    total = sum(factors.values())
    score = reduce(lambda a, b: a + b, [part(c) * (w / total) for c, w in factors.items()])
    top = F.array_sort(F.array(*[F.struct((-part(c) * w).alias("k"), F.lit(c).alias("c")) for c, w in factors.items()]))[0]["c"]
    band = F.when(F.col("score") >= 80, "critical").when(F.col("score") >= 60, "high").when(F.col("score") >= 40, "medium").when(F.col("score") >= 20, "low").otherwise("minimal")
    return df.select(entity, score.alias("score"), top.alias("top_factor")).withColumn("band", band)


#: Rules of a transaction and their weights; columns are amount, hour, mean_amount, new_device, country and home_country.
FRAUD_RULES = {"large_amount": ("amount > 10000", 30), "night": ("hour BETWEEN 0 AND 4", 10), "above_habit": ("amount > 5 * mean_amount", 25), "new_device": ("new_device", 15), "abroad": ("country != home_country", 20), "round_amount": ("amount >= 1000 AND amount % 1000 = 0", 10)}


def fraud_rules(df: DataFrame, rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """The summed weights of the rules that hold (100 at most) and the action: review from 30, challenge from 60, block from 80."""
    score = reduce(lambda a, b: a + b, [F.when(F.expr(c), w).otherwise(0) for c, w in (rules or FRAUD_RULES).values()])
    out = df.withColumn("fraud_score", F.least(score, F.lit(100)))
    return out.withColumn("action", F.when(F.col("fraud_score") >= 80, "block").when(F.col("fraud_score") >= 60, "challenge").when(F.col("fraud_score") >= 30, "review").otherwise("allow"))


def velocity(df: DataFrame, entity: str, time: str, amount: str, seconds: tuple[int, ...] = (60, 3600, 86400)) -> DataFrame:
    """Earlier events of the entity, and their amount, within each span before a row."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(entity).orderBy(at)
    return df.withColumns({k: v for s in seconds for k, v in ((f"count_{s}s", F.count("*").over(w.rangeBetween(-s * 1_000_000, -1))), (f"amount_{s}s", F.coalesce(F.sum(amount).over(w.rangeBetween(-s * 1_000_000, -1)), F.lit(0.0))))})


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("fingerprint", F.left(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), F.lit(32)))


# Baskets


def baskets(df: DataFrame, transaction: str, item: str) -> DataFrame:
    return df.where(F.col(item).isNotNull()).groupBy(transaction).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))


def frequent_itemsets(df: DataFrame, transaction: str, item: str, min_support: float = 0.01, longest: int = 5) -> DataFrame:
    """items (sorted), count, support; an itemset needs int(min_support * n) transactions."""
    from pyspark.ml.fpm import FPGrowth

    b = baskets(df, transaction, item)
    n = b.count()
    least = max(1, int(min_support * n))
    model = FPGrowth(itemsCol="items", minSupport=max(1e-12, (least - 0.5) / max(1, n)), minConfidence=1.0).fit(b)
    return model.freqItemsets.where(F.size("items") <= longest).select(F.array_sort("items").alias("items"), F.col("freq").alias("count"), (F.col("freq") / n).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5, min_lift: float = 1.0) -> DataFrame:
    """All splits of an itemset into antecedent and consequent, with confidence, lift, leverage and conviction (999.99 at most)."""
    whole = itemsets.where(F.size("items") > 1).select("items", "support", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)).alias("mask"))
    side_of = lambda bit: F.expr(f"filter(items, (x, i) -> floor(mask / power(2, i)) % 2 = {bit})")
    split = whole.select("support", side_of(1).alias("antecedent"), side_of(0).alias("consequent"))
    side = lambda n: itemsets.select(F.col("items").alias(n), F.col("support").alias(f"{n}_support"))
    out = split.join(side("antecedent"), "antecedent").join(side("consequent"), "consequent")
    out = out.withColumn("confidence", F.col("support") / F.col("antecedent_support")).withColumn("lift", F.col("confidence") / F.col("consequent_support")).withColumn("leverage", F.col("support") - F.col("antecedent_support") * F.col("consequent_support"))
    out = out.withColumn("conviction", F.when(F.col("confidence") >= 1, 999.99).otherwise(F.least((1 - F.col("consequent_support")) / (1 - F.col("confidence")), F.lit(999.99))))
    return out.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def pair_counts(df: DataFrame, transaction: str, item: str) -> DataFrame:
    """Pairs of items by the transactions that hold both; the items of a transaction are an array, and its pairs come from that."""
    i = F.flatten(F.transform(F.sequence(F.lit(1), F.size("items") - 1), lambda k: F.transform(F.slice("items", k + 1, F.size("items")), lambda y: F.struct(F.element_at("items", k).alias("a"), y.alias("b")))))
    return baskets(df, transaction, item).where(F.size("items") > 1).select(F.inline(i)).groupBy("a", "b").agg(F.count("*").alias("count"))


def basket_recommendations(rules: DataFrame, basket: list[str], top: int = 5) -> DataFrame:
    own = F.array(*[F.lit(x) for x in basket]).cast("array<string>")
    fit = rules.where((F.size(F.array_except("antecedent", own)) == 0)).select(F.explode(F.array_except("consequent", own)).alias("item"), "confidence", "lift")
    return fit.groupBy("item").agg(F.max("confidence").alias("confidence"), F.max("lift").alias("lift")).orderBy(F.desc("confidence"), F.desc("lift"), "item").limit(top)


def cross_sell(rules: DataFrame) -> DataFrame:
    pairs = rules.where((F.size("antecedent") == 1) & (F.size("consequent") == 1)).select(F.col("antecedent")[0].alias("a"), F.col("consequent")[0].alias("b"), "lift")
    return pairs.groupBy("a").pivot("b").agg(F.max("lift"))


# Recommendations


def item_similarity(ratings: DataFrame, user: str, item: str, rating: str, most: int = 500, cell_items: int = 2_000_000) -> DataFrame:
    """Cosine of item vectors over shared users; ratings without a user count for an item's norm only.

    Pairs are never shuffled. Items lie in ranges, and a user's sorted basket goes once to each range that holds one of its items:
    those items, and all that come after the first of them. A range adds up its pairs a million at a time. A range that gets more
    than about ``cell_items`` items is split by the hash of a pair's second item, and baskets travel in runs of ``most`` items,
    each run of first items with each of second ones, so neither a frequent item nor a long basket fills a task.
    """
    spark = ratings.sparkSession
    prepare(spark)
    dealt = ratings.where(F.col(item).isNotNull()).select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(rating).alias("r")).repartitionByRange(shuffle_parts(spark), "i")
    per = dealt.withColumn("part", F.spark_partition_id()).groupBy("u", "i", "part").agg(F.avg("r").cast("double").alias("r"))
    per = per.withColumn("ss", F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("i"))).where(F.col("u").isNotNull())
    whole = per.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("i", "part", "r", "ss"))).alias("x")).where(F.size("x") > 1)
    numbered = F.transform("x", lambda e, at: F.struct(e["i"].alias("i"), e["part"].alias("part"), e["r"].alias("r"), e["ss"].alias("ss"), at.alias("at")))
    baskets = stored(whole.select(numbered.alias("x")), shared_folder(spark, "baskets"))
    spans = baskets.select("x", F.explode(F.array_distinct(F.col("x")["part"])).alias("part")).withColumn("first", F.array_position(F.col("x")["part"], F.col("part")).cast("int")).where(F.col("first") < F.size("x"))
    loads = spans.groupBy("part").agg(F.sum(F.size("x") - F.col("first")).alias("n")).where(F.col("n") > cell_items).collect()
    subs = F.coalesce(F.create_map(*[F.lit(v) for part, n in loads for v in (part, -(-n // cell_items))])[F.col("part")], F.lit(1)) if loads else F.lit(1)
    cells = spans.withColumns({"left": F.filter("x", lambda e: e["part"] == F.col("part")), "right": F.slice("x", F.col("first") + 1, F.size("x")), "subs": subs.cast("int")}).drop("x")
    cells = cells.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    cells = cells.withColumn("right", F.when(F.col("subs") > 1, F.filter("right", lambda e: F.pmod(F.xxhash64(e["i"]), F.col("subs")) == F.col("sub"))).otherwise(F.col("right"))).where(F.size("right") > 0)
    for side in ("left", "right"):
        cells = cells.withColumn("run", F.explode(F.sequence(F.lit(1), F.size(side), F.lit(most)))).withColumn(side, F.slice(side, F.col("run"), most))
    cells = cells.where(F.element_at("right", -1)["at"] > F.col("left")[0]["at"])
    fields = [F.col(side)[f].alias(f"{side}_{f}") for side in ("left", "right") for f in ("i", "r", "ss", "at")]
    kind = ratings.schema[item].dataType
    schema = T.StructType().add("a", kind).add("b", kind).add("similarity", "double")
    return cells.select("part", "sub", *fields).groupBy("part", "sub").applyInArrow(_products(), schema)


def _products(most_pairs: int = 1_000_000):
    """For the runs of one cell: each pair of a first item and one further on in the same basket, once, with its cosine."""
    import numpy as np
    import pyarrow as pa

    def similar(batches):
        t = pa.Table.from_batches(batches)
        lists = {c: pa.concat_arrays(t.column(c).chunks) for c in t.column_names if c not in ("part", "sub")}
        flat = {c: x.flatten() for c, x in lists.items()}
        number = lambda c: flat[c].cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        known = lambda c: flat[c].is_valid().to_numpy(zero_copy_only=False)
        side = {}
        for k in ("left", "right"):
            coded = flat[f"{k}_i"].dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            norm = np.full(len(coded.dictionary), np.nan)
            told = np.zeros(len(norm), bool)
            norm[code], told[code] = np.sqrt(number(f"{k}_ss")), known(f"{k}_ss")
            size = lists[f"{k}_i"].value_lengths().to_numpy().astype(np.int64)
            side[k] = coded.dictionary, code, norm, told, size, number(f"{k}_r"), known(f"{k}_r")
        (names_a, code_a, norm_a, told_a, size_a, r_a, known_a), (names_b, code_b, norm_b, told_b, size_b, r_b, known_b) = side["left"], side["right"]
        del t, lists
        at_a, at_b = (flat[f"{k}_at"].to_numpy().astype(np.int64) for k in ("left", "right"))
        wide = int(max(at_a.max(), at_b.max())) + 1
        row_a, row_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        low = np.searchsorted(row_b * wide + at_b, row_a * wide + at_a, side="right")
        count = np.cumsum(size_b)[row_a] - low
        nulls = not (known_a.all() and known_b.all())

        def made(of):
            """Places in both sides of the pairs of some first items."""
            n = count[of]
            left = np.repeat(of, n)
            return left, np.arange(len(left)) + np.repeat(low[of] - (np.cumsum(n) - n), n)

        def rows(a, b, dot, any_known):
            below = norm_a[a] * norm_b[b]
            with np.errstate(divide="ignore", invalid="ignore"):
                value = dot / below
            without = ~(any_known & told_a[a] & told_b[b]) | (below == 0)
            return pa.RecordBatch.from_arrays([names_a.take(pa.array(a)), names_b.take(pa.array(b)), pa.array(value, mask=without)], names=["a", "b", "similarity"])

        order = np.argsort(code_a, kind="stable")
        done = np.cumsum(count[order])
        ends = np.append(np.flatnonzero(np.diff(code_a[order])) + 1, len(order))
        start, g = 0, 0
        while start < len(order):
            before = done[start - 1] if start else 0
            g = max(g + 1, int(np.searchsorted(done[ends - 1], before + most_pairs, side="right")))
            end, here = int(ends[g - 1]), order[start : ends[g - 1]]
            pairs = done[end - 1] - before
            start = end
            if pairs > most_pairs:  # one item alone: its sums by second item
                dot, seen, met = np.zeros(len(norm_b)), np.zeros(len(norm_b), np.int64), np.zeros(len(norm_b), np.int64)
                turn = (np.cumsum(count[here]) - 1) // most_pairs
                for some in np.split(here, np.flatnonzero(np.diff(turn)) + 1):
                    left, right = made(some)
                    both = known_a[left] & known_b[right]
                    dot += np.bincount(code_b[right], np.where(both, r_a[left] * r_b[right], 0.0), len(dot))
                    seen += np.bincount(code_b[right[both]], minlength=len(dot))
                    met += np.bincount(code_b[right], minlength=len(dot))
                b = np.flatnonzero(met)
                yield rows(np.full(len(b), code_a[here[0]]), b, dot[b], seen[b] > 0)
            elif pairs:
                left, right = made(here)
                key = code_a[left] * len(norm_b) + code_b[right]
                place = np.argsort(key)
                key = key[place]
                first = np.append(0, np.flatnonzero(np.diff(key)) + 1)
                p, seen = (r_a[left] * r_b[right])[place], np.ones(len(first), bool)
                if nulls:
                    both = (known_a[left] & known_b[right])[place]
                    p, seen = np.where(both, p, 0.0), np.logical_or.reduceat(both, first)
                yield rows(*np.divmod(key[first], len(norm_b)), np.add.reduceat(p, first), seen)

    similar.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return similar


def popular_items(ratings: DataFrame, item: str, rating: str, top: int = 10) -> DataFrame:
    return ratings.groupBy(item).agg(F.sum(rating).alias("score")).orderBy(F.desc("score"), item).limit(top)


def recommend(ratings: DataFrame, user: str, item: str, rating: str, who, top: int = 10, exclude_known: bool = True) -> DataFrame:
    """By the similarity to the items a user rated; popular items for a user without ratings."""
    own = ratings.where(F.col(user) == who).groupBy(item).agg(F.avg(rating).alias("r"))
    if own.isEmpty():
        return popular_items(ratings, item, rating, top)
    sim = item_similarity(ratings, user, item, rating)
    both = sim.select("a", "b", "similarity").union(sim.select("b", "a", "similarity"))
    scored = both.join(F.broadcast(own), both["a"] == own[item]).groupBy(F.col("b").alias("item")).agg((F.sum(F.col("similarity") * F.col("r")) / F.sum(F.abs("similarity"))).alias("score"))
    scored = scored.join(own, scored["item"] == own[item], "left_anti") if exclude_known else scored
    return scored.orderBy(F.desc("score"), "item").limit(top)


def content_recommend(items: DataFrame, ratings: DataFrame, user: str, item: str, rating: str, features: list[str], who, top: int = 10) -> DataFrame:
    """Items nearest to a user's rating-weighted mean of row-normalised features, without those rated."""
    length = F.sqrt(sum([F.col(f) * F.col(f) for f in features], F.lit(0.0)))
    unit = items.select(item, *[F.coalesce(F.try_divide(F.col(f).cast("double"), length), F.lit(0.0)).alias(f) for f in features])
    own = ratings.where(F.col(user) == who).groupBy(item).agg(F.avg(rating).alias("_r"))
    taste = unit.join(F.broadcast(own), item).agg(*[F.try_divide(F.sum(F.col(f) * F.col("_r")), F.sum("_r")).alias(f"_{f}") for f in features])
    scored = unit.join(F.broadcast(own), item, "left_anti").crossJoin(F.broadcast(taste)).select(item, sum([F.col(f) * F.col(f"_{f}") for f in features], F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), item).limit(top)


def hybrid_recommend(a: DataFrame, b: DataFrame, key: str, weight: float = 0.5, top: int = 10) -> DataFrame:
    """A weighted blend of two lists of scores, each stretched to 0 to 1."""
    every = Window.partitionBy()

    def stretched(df: DataFrame, name: str) -> DataFrame:
        lo, hi = F.min("score").over(every), F.max("score").over(every)
        return df.select(key, F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0).alias(name))

    both = stretched(a, "_a").join(stretched(b, "_b"), key, "full")
    return both.select(key, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), key).limit(top)


def financial_ratios(df: DataFrame) -> DataFrame:
    """Ratios of the columns that are there; a zero denominator gives null."""
    wanted = {
        "current_ratio": ("current_assets", "current_liabilities"), "debt_to_equity": ("total_liabilities", "equity"), "debt_ratio": ("total_liabilities", "total_assets"), "equity_ratio": ("equity", "total_assets"),
        "net_margin": ("net_income", "revenue"), "gross_margin": ("gross_profit", "revenue"), "operating_margin": ("operating_income", "revenue"), "return_on_assets": ("net_income", "total_assets"), "return_on_equity": ("net_income", "equity"),
        "asset_turnover": ("revenue", "total_assets"), "inventory_turnover": ("cost_of_goods", "inventory"), "receivables_turnover": ("revenue", "accounts_receivable"), "payables_turnover": ("cost_of_goods", "accounts_payable"),
        "cash_ratio": ("cash", "current_liabilities"), "interest_coverage": ("operating_income", "interest_expense"),
    }
    return df.withColumns({n: F.try_divide(F.col(a).cast("double"), F.col(b)) for n, (a, b) in wanted.items() if a in df.columns and b in df.columns})
