"""Models on pyspark.ml: training with a leaderboard, clustering and its quality, ensembles, explanations, topics, targets."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .eda import is_pii, numeric_columns, safe_corr, uniqueness_scan
from .sampling import uniform

CLASSIFIERS = {"logistic": lambda: C.LogisticRegression(maxIter=30), "forest": lambda: C.RandomForestClassifier(numTrees=20, seed=42), "boosting": lambda: C.GBTClassifier(maxIter=10, seed=42), "svm": lambda: C.LinearSVC(maxIter=30), "tree": lambda: C.DecisionTreeClassifier(seed=42), "bayes": lambda: C.NaiveBayes(modelType="gaussian")}
REGRESSORS = {"linear": lambda: R.LinearRegression(), "ridge": lambda: R.LinearRegression(regParam=0.1), "lasso": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=1.0), "forest": lambda: R.RandomForestRegressor(numTrees=20, seed=42), "boosting": lambda: R.GBTRegressor(maxIter=10, seed=42), "tree": lambda: R.DecisionTreeRegressor(seed=42)}


def feature_pipeline(df: DataFrame, target: str | None = None, exclude: list[str] = ()) -> Pipeline:
    """Gaps of numbers filled by the median, texts of few values one-hot, all scaled into ``features``."""
    left_out = {target, *exclude}
    numbers = [c for c in numeric_columns(df) if c not in left_out]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in left_out]
    few = df.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
    texts = [c for c in texts if 1 < few[c] <= 50]
    stages = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__filled" for c in numbers])] if numbers else []
    if texts:
        stages += [StringIndexer(inputCols=texts, outputCols=[f"{c}__index" for c in texts], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index" for c in texts], outputCols=[f"{c}__hot" for c in texts])]
    stages += [VectorAssembler(inputCols=[f"{c}__filled" for c in numbers] + [f"{c}__hot" for c in texts], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features")]
    return Pipeline(stages=stages)


def task_of(df: DataFrame, target: str) -> str:
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "classification"
    return "classification" if df.select(target).distinct().limit(21).count() <= 20 and not isinstance(kind, (T.DoubleType, T.FloatType)) else "regression"


def train(df: DataFrame, target: str, key: str, task: str | None = None, models: list[str] | None = None, test_size: float = 0.2) -> tuple[DataFrame, dict]:
    """A leaderboard by model on the held-back rows, and the fitted models. Both splits share one cached feature table."""
    task = task or task_of(df, target)
    kept = df.where(F.col(target).isNotNull())
    label = StringIndexer(inputCol=target, outputCol="label") if task == "classification" and isinstance(df.schema[target].dataType, T.StringType) else None
    kept = label.fit(kept).transform(kept) if label else kept.withColumn("label", F.col(target).cast("double"))
    made = feature_pipeline(df, target, [key]).fit(kept).transform(kept).select(key, "features", "label").cache()
    held = uniform(key) < test_size
    fit, test = made.where(~held), made.where(held)
    binary = task == "classification" and made.agg(F.max("label")).first()[0] <= 1
    rows, fitted = [], {}
    for name, new in (CLASSIFIERS if task == "classification" else REGRESSORS).items():
        if (models and name not in models) or (not binary and name in ("boosting", "svm") and task == "classification"):
            continue
        fitted[name] = new().fit(fit)
        out = fitted[name].transform(test)
        if task == "classification":
            scores = {m: MulticlassClassificationEvaluator(metricName=m).evaluate(out) for m in ("accuracy", "f1")}
            scores["auc"] = BinaryClassificationEvaluator().evaluate(out) if binary and "rawPrediction" in out.columns else None
        else:
            scores = {m: RegressionEvaluator(metricName=m).evaluate(out) for m in ("rmse", "mae", "r2")}
        rows += [(name, m, float(v)) for m, v in scores.items() if v is not None]
    made.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, metric string, value double"), fitted


def vote(parts: list[DataFrame], key: str, weights: list[float] | None = None) -> DataFrame:
    """Soft votes: weighted mean probability of the tables' ``probability`` vectors."""
    weights = weights or [1.0] * len(parts)
    rows = [p.select(key, F.posexplode(vector_to_array("probability")).alias("class", "p")).withColumn("w", F.lit(w)) for p, w in zip(parts, weights)]
    mean = reduce(DataFrame.unionByName, rows).groupBy(key, "class").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))
    return mean.groupBy(key).agg(F.max_by("class", "p").alias("prediction"), F.max("p").alias("confidence"))


def stack(train_parts: list[DataFrame], key: str, labels: DataFrame):
    """A logistic model over the members' probabilities."""
    joined = labels.select(key, "label")
    for i, p in enumerate(train_parts):
        joined = joined.join(p.select(key, vector_to_array("probability")[1].alias(f"p{i}")), key)
    names = [f"p{i}" for i in range(len(train_parts))]
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), C.LogisticRegression()]).fit(joined)


def vectors(df: DataFrame, columns: list[str], scaled: bool = True) -> DataFrame:
    out = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.dropna(subset=columns))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(out).transform(out).drop("_raw") if scaled else out.withColumnRenamed("_raw", "features")


def cluster(df: DataFrame, columns: list[str], k: int = 5, method: str = "kmeans", seed: int = 42) -> DataFrame:
    made = vectors(df, columns)
    model = {"kmeans": K.KMeans(k=k, seed=seed), "bisecting": K.BisectingKMeans(k=k, seed=seed), "mixture": K.GaussianMixture(k=k, seed=seed)}[method].fit(made)
    return model.transform(made).withColumnRenamed("prediction", "segment")


def cluster_quality(df: DataFrame, label: str = "segment") -> DataFrame:
    """Silhouette, Calinski-Harabasz, Davies-Bouldin (from centres, counts and sums) and the balance of sizes."""
    import numpy as np

    rows = df.select(label, vector_to_array("features").alias("x"))
    width = rows.first() and len(rows.first()["x"])
    per = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)], *[F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in range(width)]).orderBy(label).collect()
    n = np.array([r["n"] for r in per], float)
    s, q = (np.array([[r[f"{c}{i}"] for i in range(width)] for r in per]) for c in "sq")
    centres, total = s / n[:, None], n.sum()
    within = (q - s * s / n[:, None]).sum(axis=1)
    between = (n[:, None] * (centres - s.sum(axis=0) / total) ** 2).sum()
    k = len(n)
    spread = np.sqrt(np.maximum(within / n, 0))
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(k) * 1e18
    db = float(((spread[:, None] + spread[None]) / gap).max(axis=1).mean()) if k > 1 else 0.0
    sil = ClusteringEvaluator(predictionCol=label).evaluate(df) if k > 1 else 0.0
    ch = float(between / (k - 1) / (within.sum() / (total - k))) if k > 1 and within.sum() else 0.0
    return df.sparkSession.createDataFrame([(k, float(sil), ch, db, float(n.min() / n.max()))], "k int, silhouette double, calinski_harabasz double, davies_bouldin double, balance double")


def best_k(df: DataFrame, columns: list[str], most: int = 8, seed: int = 42) -> DataFrame:
    made = vectors(df, columns).cache()
    rows = []
    for k in range(2, most + 1):
        model = K.KMeans(k=k, seed=seed).fit(made)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(made)))))
    made.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def rule_segments(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The name of the first SQL condition that holds, else ``unmatched``."""
    out = reduce(lambda c, r: c.when(F.expr(r[1]), r[0]), rules[1:], F.when(F.expr(rules[0][1]), rules[0][0]))
    return df.withColumn("segment", out.otherwise("unmatched"))


def permutation_importance(model, df: DataFrame, columns: list[str], evaluator, seed: int = 42) -> DataFrame:
    """The metric's fall when a feature's place in the vector takes another row's value: rows are dealt at random into groups
    of about 10,000, and values shift by one place around each group, so every row's value is used once."""
    base, rows = evaluator.evaluate(model.transform(df)), []
    wide = df.withColumn("_x", vector_to_array("features")).withColumn("_id", F.monotonically_increasing_id()).cache()
    n = max(1, -(-wide.count() // 10_000))
    group = Window.partitionBy("_b")
    order = group.orderBy(F.xxhash64("_id", F.lit(seed)), "_id")
    for i, c in enumerate(columns):
        value = F.col("_x")[i]
        salted = wide.withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(n)))
        moved = salted.withColumn("_v", F.coalesce(F.lag(value).over(order), F.last(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        changed = moved.withColumn("features", array_to_vector(F.transform("_x", lambda x, j: F.when(j == i, F.col("_v")).otherwise(x))))
        rows.append((c, float(base - evaluator.evaluate(model.transform(changed)))))
    wide.unpersist()
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def partial_dependence(model, df: DataFrame, place: int, grid: list[float]) -> DataFrame:
    """Mean prediction with one feature set to each value of a grid."""
    wide = df.withColumn("_x", vector_to_array("features")).crossJoin(F.broadcast(df.sparkSession.createDataFrame([(float(g),) for g in grid], "value double")))
    set_to = wide.withColumn("features", array_to_vector(F.transform("_x", lambda x, j: F.when(j == place, F.col("value")).otherwise(x))))
    return model.transform(set_to.select("value", "features")).groupBy("value").agg(F.avg("prediction").alias("prediction"))


def topics(df: DataFrame, column: str, k: int = 5, top: int = 10, vocabulary: int = 2000, seed: int = 42) -> DataFrame:
    """Words of each topic by latent Dirichlet allocation over tf-idf weighted counts."""
    from ..functions.text import STOPWORDS, tokens

    words = df.select(F.filter(tokens(F.col(column)), lambda w: ~w.isin(*STOPWORDS)).alias("w")).where(F.size("w") > 0)
    counted = CountVectorizer(inputCol="w", outputCol="c", vocabSize=vocabulary).fit(words)
    made = counted.transform(words)
    made = IDF(inputCol="c", outputCol="features").fit(made).transform(made)
    model = K.LDA(k=k, maxIter=10, seed=seed).fit(made)
    names = F.array(*[F.lit(v) for v in counted.vocabulary])
    return model.describeTopics(top).select("topic", F.posexplode("termIndices").alias("rank", "i"), "termWeights").select("topic", (F.col("rank") + 1).alias("rank"), F.get(names, F.col("i")).alias("word"), F.get("termWeights", F.col("rank")).alias("weight"))


def target_candidates(df: DataFrame, top: int = 8) -> DataFrame:
    """Columns by how likely they are a target: names that say so, few classes, not identifiers, last places."""
    u = uniqueness_scan(df)
    said = F.lower("column").rlike("target|label|class|outcome|churn|price|amount|score|status")
    places = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i / max(1, len(df.columns) - 1)))])
    score = said.cast("double") * 0.5 + (F.col("unique").between(2, 20)).cast("double") * 0.3 + places[F.col("column")] * 0.2 - F.col("key_candidate").cast("double")
    return u.select("column", score.alias("score"), F.when(F.col("unique") <= 20, "classification").otherwise("regression").alias("task")).orderBy(F.desc("score"), "column").limit(top)


def leakage(df: DataFrame, target: str, least: float = 0.98) -> DataFrame:
    names = [c for c in numeric_columns(df) if c != target and not is_pii(c)]
    wide = df.agg(*[safe_corr(F.col(c), F.col(target)).alias(f"r{i}") for i, c in enumerate(names)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("r")) for i, c in enumerate(names)]))).where(F.abs("r") >= least)


def multilayer(df: DataFrame, layers: list[int], seed: int = 42):
    return C.MultilayerPerceptronClassifier(layers=layers, seed=seed).fit(df)


def save_version(model, folder: str, name: str, version: int, stage: str = "staging") -> str:
    path = f"{folder}/{name}/v{version}-{stage}"
    model.write().overwrite().save(path)
    return path
