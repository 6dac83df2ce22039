import math

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import distributions as D
from lumenframe.functions import geo, text
from lumenframe.operators import business, eda, features, quality, sampling, transforms
from lumenframe.operators import statistics as S
from lumenframe.operators import timeseries as TS
from lumenframe.plans import sql as guarded
from lumenframe.sources import files
from lumenframe.streaming import windows


def test_transform_steps(spark):
    df = spark.createDataFrame([(1, "1", None), (2, "bad", 3.0), (2, "bad", 3.0), (None, "3", 5.0)], "a int, x string, v double")
    assert transforms.apply(df, [{"op": "type_convert", "params": {"column": "x", "to": "int", "errors": "coerce"}}]).where("x IS NULL").count() == 2
    assert transforms.deduplicate(df).count() == 3
    keep_null = transforms.filter_rows(df, [{"column": "a", "op": "gt", "value": 1}], keep=False)
    assert sorted(str(r["a"]) for r in keep_null.collect()) == ["1", "None"]
    assert transforms.filter_rows(df, [{"column": "a", "op": "ne", "value": 2}]).count() == 2
    assert [r["v"] for r in transforms.fill_missing(df, "v", "mode").collect()].count(3.0) == 3
    with pytest.raises(ValueError):
        transforms.apply(df, [{"op": "explode_everything"}])
    with pytest.raises(ValueError):
        transforms.drop_columns(df, ["nothing"])
    empty = df.limit(0)
    assert transforms.bin_numeric(empty, "v").count() == 0
    assert transforms.clip_outliers(empty, ["v"]).count() == 0


def test_eda_on_known_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 1.0), (4, "b", None), (5, "b", 1.0)], "id long, dup string, v double")
    got = {r["column"]: r for r in eda.uniqueness_scan(df).collect()}
    assert got["id"]["key_candidate"] and got["dup"]["unique"] == 2 and got["dup"]["duplicates"] == 3
    assert {r["column"]: r["null_count"] for r in eda.missingness(df).collect()}["v"] == 2
    seg = spark.createDataFrame([("A", 1), ("A", 2), ("B", 10), ("B", 20), ("B", 30)], "s string, v int")
    b = {r["s"]: r for r in eda.segment_summary(seg, "s", "v").collect()}["B"]
    assert (b["count"], b["sum"], b["mean"], b["median"]) == (3, 60.0, 20.0, 20.0)
    assert eda.correlation(spark.createDataFrame([(1, 5), (2, 5)], "x int, y int")).count() == 0
    assert eda.missingness(df.limit(0)).agg(F.sum("null_pct")).first()[0] == 0


def test_distributions():
    assert math.isclose(D.t_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(D.chi2_sf(3.841459, 1), 0.05, rel_tol=1e-5)
    assert math.isclose(D.f_sf(4.0, 2, 20), 1.4**-10, rel_tol=1e-9)
    assert math.isclose(D.normal_quantile(0.975), 1.959964, rel_tol=1e-6)
    assert math.isclose(D.studentized_range_sf(3.578, 3, 20), 0.05, abs_tol=2e-3)
    assert math.isclose(D.hypergeom_two_sided(8, 2, 1, 5), 0.03496503, rel_tol=1e-5)


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (3, 4, 5, 6, 9)], "g string, v double")
    t = S.t_test(df, "g", "v", "a", "b").first()
    assert math.isclose(t["statistic"], -2.4 / math.sqrt(3.9 * 0.4), rel_tol=1e-9) and t["df"] == 8
    assert S.anova(df, "g", "v").first()["statistic"] == pytest.approx(t["statistic"] ** 2)
    assert S.mann_whitney(df, "g", "v", "a", "b").first()["statistic"] == 4.5
    assert S.correlation_test(spark.createDataFrame([(1, 2), (2, 4), (3, 6), (4, 9)], "x int, y int"), "x", "y", "kendall").first()["statistic"] == pytest.approx(1.0)
    assert S.kaplan_meier(spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "d int, e int"), "d", "e").orderBy("time").collect()[-1]["survival"] == 0
    assert S.irr([-100, 60, 60]) == pytest.approx(0.13066, abs=1e-4)


def test_sampling_and_outliers(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 900, "x").otherwise("y")).withColumn("v", F.col("id").cast("double"))
    got = {r["s"]: r["count"] for r in sampling.stratified_sample(df, 100, "s", "id").groupBy("s").count().collect()}
    assert got == {"x": 90, "y": 10}
    train, test = sampling.train_test_split(df, "id")
    assert train.count() + test.count() == 1000 and 120 < test.count() < 280
    assert sampling.random_sample(df, 7, "id").count() == 7
    x = spark.createDataFrame([(float(i),) for i in [0, 1, 2, 3, 1000]], "v double")
    assert sampling.iqr_outliers(x, "v").where("is_outlier").count() == 1
    assert sampling.treat_outliers(x, "v").agg(F.max("v")).first()[0] < 10
    gaps = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, None)], "i int, v double")
    assert [r["v"] for r in sampling.interpolate(gaps, "v", "i").orderBy("i").collect()] == [1.0, 2.0, 3.0, 3.0]
    assert sampling.hot_deck(gaps, "v", "i").where("v IS NULL").count() == 0


def test_series(spark):
    s = spark.createDataFrame([(i, float(i % 7) + i) for i in range(70)], "i int, y double")
    out = TS.decompose(s, "i", "y", 7).where("trend IS NOT NULL").agg(F.max(F.abs("residual"))).first()[0]
    assert out < 3.1
    assert TS.linear_forecast(spark.createDataFrame([(i, 2.0 * i) for i in range(10)], "i int, y double"), "i", "y", 1).first()["forecast"] == pytest.approx(20.0)
    assert TS.ewma_residuals(spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "i int, y double"), "i", "y").orderBy("i").collect()[2]["ewma"] == pytest.approx(1.3)


def test_text(spark):
    df = spark.createDataFrame([(1, "Not good and very bad idea!"), (2, "great great"), (3, None), (4, "")], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", text.scanned_sentiment(F.col("t")).alias("s")).collect()}
    assert got[1] < 0 < got[2] and got[4] == 0
    assert df.select(text.similarity_ratio(F.lit("kitten"), F.lit("sitting"))).first()[0] == pytest.approx(1 - 3 / 7)
    kinds = {r["kind"] for r in text.entities(spark.createDataFrame([(1, "Ann Lee paid $5.00 on 2024-01-02 a@b.co")], "id int, t string"), "id", "t").collect()}
    assert {"PERSON", "MONEY", "DATE", "EMAIL"} <= kinds
    assert text.porter_stem("relational") == "relate" and text.porter_stem("hopping") == "hop"
    tok = text.tokenize_values(spark.createDataFrame([("b",), ("a",), ("b",)], "v string"), "v")
    assert sorted(r["v"] for r in tok.collect()) == ["TOKEN_000001", "TOKEN_000002", "TOKEN_000002"]
    assert text.rake_keywords(df, "t").count() >= 1 and text.textrank(df, "t", rounds=3).count() >= 0


def test_geo(spark):
    km = spark.range(1).select(geo.haversine(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522))).first()[0]
    assert km == pytest.approx(877.5, abs=1)


def test_business(spark):
    ev = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b")], "u int, e string")
    assert [r["users"] for r in business.funnel(ev, "u", "e", ["a", "b"]).orderBy("step").collect()] == [2, 1]
    p = {r["c"]: r["class"] for r in business.pareto(spark.createDataFrame([("x", 85.0), ("y", 9.0), ("z", 6.0)], "c string, v double"), "c", "v").collect()}
    assert p == {"x": "B", "y": "B", "z": "C"}
    rules = business.association_rules(business.frequent_itemsets(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "t int, i string"), "t", "i", 0.3), 0.5, 0.0)
    assert {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in rules.collect()} == {(("a",), ("b",)), (("b",), ("a",))}


def test_quality(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None)], "id int, t string")
    assert quality.exact_duplicates(df, ["t"]).first()["rows"] == 2
    r = quality.validate(df, [quality.Rule("t", "not_null"), quality.Rule("id", "range", {"min": 2})]).collect()
    assert [x["failed"] for x in r] == [1, 1]
    assert quality.overall_score(df).first()["completeness"] == pytest.approx(5 / 6)
    near = quality.fuzzy_duplicates(spark.createDataFrame([(1, "john smith"), (2, "jon smith"), (3, "mary")], "id int, t string"), "id", "t")
    assert near.count() == 1


def test_features(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, "x")], "v double, c string")
    assert [r["v"] for r in features.scale(df, ["v"], "minmax").collect()] == [0.0, 1.0, None]
    assert features.encode(df, "c", "hash").where("c_hash BETWEEN 0 AND 31").count() == 3
    assert {r["c"]: r["c_encoding"] for r in features.transform(df, "c", "encoding").collect()} == {"x": 0, "y": 1}


def test_guarded_sql(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, value int")
    assert guarded.query_dataset(df, "SELECT sum(value) AS s FROM dataset;").first()["s"] == 30
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM read_parquet('x')", "SELECT * FROM other", "WITH a AS (SELECT 1) DELETE FROM a", "SELECT * FROM '/etc/passwd'", ""):
        with pytest.raises(guarded.UnsafeSQL):
            guarded.query_dataset(df, bad)
    assert guarded.ask(df, "total value").first()["value"] == 30
    assert [r["value"] for r in guarded.ask(df, "top 1 by value").collect()] == [20]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;y\n")
    assert files.read(spark, str(tmp_path / "a.csv")).columns == ["id", "name"]
    spark.range(5).withColumn("x", F.lit(None).cast("int")).write.parquet(str(tmp_path / "v" / "base"))
    child = files.transform_version(spark, str(tmp_path / "v"), "base", [{"op": "drop_columns", "params": {"columns": ["x"]}}])
    assert spark.read.parquet(str(tmp_path / "v" / child)).columns == ["id"]
    assert child == files.version_id("base", [{"op": "drop_columns", "params": {"columns": ["x"]}}])
    assert files.write_table(spark.range(3), str(tmp_path), "t").first()["rows"] == 3
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert {r["node"] for r in files.lineage(edges, "c").collect()} == {"a", "b"}


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, t string, k int, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r["window_start"], r["k"]): r["sum"] for r in windows.tumbling(df, "t", "10 minutes", "v", ["sum"], ["k"]).collect()}
    live = windows.tumbling(windows.from_folder(spark, str(tmp_path / "in")), "t", "10 minutes", "v", ["sum"], ["k"], late="5 minutes")
    got = {(r["window_start"], r["k"]): r["sum"] for r in windows.run_to_memory(live, "tumbled").collect()}
    assert got == batch and len(got) == 6
    p = windows.Processor("p").filter("v > 3").map({"w": F.col("v") * 2}).key_by(F.col("k"))
    assert p(df).where("key = 1").count() == 13


def test_models(spark):
    from lumenframe.operators import ml

    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) > 9).cast("int").alias("y"))
    board, fitted = ml.train(df, "y", "id", models=["logistic", "tree"])
    assert {r["model"] for r in board.collect()} == {"logistic", "tree"} and board.where("metric = 'accuracy'").agg(F.min("value")).first()[0] > 0.9
    assert ml.cluster_quality(ml.cluster(df, ["x"], 2)).first()["silhouette"] > 0.5


def test_simulation(spark):
    from lumenframe.operators import simulation

    for kind, params, mean in (("normal", {"mean": 3, "std": 2}, 3), ("uniform", {"low": 0, "high": 4}, 2), ("triangular", {"low": 0, "mode": 1, "high": 5}, 2), ("poisson", {"rate": 2.5}, 2.5), ("lognormal", {"mean": 0, "std": 0.5}, math.exp(0.125))):
        got = simulation.summary(simulation.simulate(spark, kind, params, 20_000)).first()["mean"]
        assert got == pytest.approx(mean, abs=0.06), kind
    assert simulation.sensitivity(spark, {"a": 2.0, "b": 3.0}, "a * b").count() == 10


def test_seasonal_forecast_and_polynomial(spark):
    s = spark.createDataFrame([(i, 10.0 + i + 5.0 * (i % 4)) for i in range(40)], "i int, y double")
    got = [r["forecast"] for r in TS.holt_winters(s, "i", "y", 4, 4).orderBy("h").collect()]
    assert got == pytest.approx([10 + i + 5 * (i % 4) for i in range(40, 44)], abs=1.5)
    p = TS.polynomial_trend(spark.createDataFrame([(i, 1 + 2 * (i / 9) + 3 * (i / 9) ** 2) for i in range(10)], "i int, y double"), "i", "y")
    assert [r["coefficient"] for r in p.orderBy("power").collect()] == pytest.approx([1, 2, 3])


def test_dbscan(spark):
    rows = [(i, 10.0 + i * 0.001, 20.0) for i in range(8)] + [(50 + i, 30.0, 40.0 + i * 0.001) for i in range(6)] + [(99, -5.0, 5.0)]
    got = {r["id"]: r["cluster"] for r in geo.dbscan(spark.createDataFrame(rows, "id long, lat double, lon double"), "id", "lat", "lon", 0.3, 3).collect()}
    assert got == {**{i: 0 for i in range(8)}, **{50 + i: 50 for i in range(6)}, 99: -1}


def test_runs_and_charts(spark, tmp_path):
    for i, v in enumerate((0.3, 0.9)):
        files.log_run(spark, str(tmp_path), f"r{i}", {"a": i}, {"auc": v})
    assert files.best_run(spark, str(tmp_path), "auc").first()["run"] == "r1"
    df = spark.createDataFrame([(1, "a")], "x int, c string")
    assert files.choose_chart(df, "c", "x") == "bar" and files.choose_chart(df, "x") == "histogram"


def test_words_of_texts_with_any_character(spark):
    df = spark.createDataFrame([("Café naïve, x1 a_b don’t 😀 the THE",), ("ещё the",), ("plain ab1 ab",), (None,)], "text string")
    got = {r["w"]: r["n"] for r in df.select(F.explode(text.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert got == {"café": 1, "naïve": 1, "don": 1, "the": 3, "ещё": 1, "plain": 1, "ab": 1}


def test_word_counts_read_every_document(spark):
    import re
    from collections import Counter

    from lumenframe.plans import registry

    sf = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert any(not x.isascii() for x in texts if x)
    got = {r["word"]: r["n"] for r in registry.queries()["text_word_counts"](spark, sf).collect()}
    plain = Counter(w for x in texts for w in re.findall(r"[^\W]+", (x or "").lower()) if w.isascii() and w.isalpha() and len(w) > 1)
    assert {w: n for w, n in got.items() if w.isascii()} == plain and any(not w.isascii() for w in got)


def test_item_similarity_of_a_user_with_many_items(spark):
    ratings = [("hot", i, float(1 + i % 5)) for i in range(40)] + [(f"u{i % 7}", i, 2.0) for i in range(0, 40, 3)]
    got = {(r["a"], r["b"]): r["similarity"] for r in business.item_similarity(spark.createDataFrame(ratings, "u string, i int, r double"), "u", "i", "r", most=6).collect()}
    by, vec = {}, {}
    for u, i, r in ratings:
        by.setdefault(u, []).append(i)
        vec.setdefault(i, {})[u] = r
    norm = {i: math.sqrt(sum(r * r for r in v.values())) for i, v in vec.items()}
    want = {(a, b): sum(vec[a][u] * vec[b][u] for u in vec[a] if u in vec[b]) / norm[a] / norm[b] for a in vec for b in vec if a < b}
    assert got == pytest.approx(want) and len(got) == 780


def test_similar_pairs_of_frequent_words(spark):
    texts = ["alpha beta gamma delta"] * 5 + ["alpha beta gamma", "alpha beta", "beta other", "gamma Delta delta", "", None]
    got = {(r["a"], r["b"]): r["score"] for r in text.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 0.6).collect()}
    sets = [set((t or "").lower().split()) for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])) for a in range(11) for b in range(a + 1, 11) if sets[a] & sets[b]}
    assert got == pytest.approx({p: s for p, s in want.items() if s >= 0.6}) and (0, 4) in got


def test_knn_imputation_searches_every_donor(spark):
    rows = [(i, float(i), float(i % 7), float(i * i)) for i in range(60)] + [(100 + i, i + 0.25, 1.0, None) for i in range(0, 60, 7)] + [(200, None, 1.0, None)]
    got = {r["id"]: r["v"] for r in sampling.knn_impute(spark.createDataFrame(rows, "id int, x double, z double, v double"), "v", ["x", "z"], 3, block_rows=8).collect()}
    sd = [math.sqrt(sum(r[c] ** 2 for r in rows[:60]) / 60 - (sum(r[c] for r in rows[:60]) / 60) ** 2) for c in (1, 2)]
    for key, x, z, _ in rows[60:-1]:
        near = sorted((math.hypot((r[1] - x) / sd[0], (r[2] - z) / sd[1]), r[3]) for r in rows[:60])[:3]
        assert got[key] == pytest.approx(sum(v / (d + 1e-9) for d, v in near) / sum(1 / (d + 1e-9) for d, _ in near))
    assert got[200] is None and got[5] == 25.0 and len(got) == len(rows)


def test_permutation_uses_every_value_once(spark):
    from pyspark.ml.functions import array_to_vector

    from lumenframe.operators import ml

    seen = []

    class Model:
        def transform(self, df):
            return df

    class Evaluator:
        def evaluate(self, df):
            from pyspark.ml.functions import vector_to_array

            seen.append(sorted(r[0] for r in df.select(vector_to_array("features")[0]).collect()))
            return 0.0

    df = spark.range(1000).select(array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"))
    ml.permutation_importance(Model(), df, ["x"], Evaluator())
    assert seen[0] == seen[1]


@pytest.mark.parametrize("bad", [
    "delete from dataset", "select 1; select 2", "/* hi */ insert into t values (1)", "drop table dataset", "select * from hidden_t", "select x from dataset, hidden_t",
    "select count(*) from dataset, parquet.`/root/testdata/sf0.001/region.parquet`", "select * from dataset where x in (select x from hidden_t)",
    "select (select max(x) from hidden_t) from dataset", "with t as (select * from hidden_t) select * from t", "select * from hidden_t, (with hidden_t as (select 1 as x) select * from hidden_t) s",
    "select * from read_csv_auto('C:/secrets.csv')", "select * from 'C:/x.parquet'", "with t as (select * from read_parquet('C:/x.parquet')) select * from t",
    "select reflect('java.lang.System', 'getenv', 'HOME') from dataset", "select * from dataset union all select * from hidden_t", "select * from dataset join lateral (select * from hidden_t)",
])
def test_guarded_sql_refuses(spark, bad):
    from lumenframe.plans import sql as guarded

    spark.createDataFrame([(7,)], "x int").createOrReplaceTempView("hidden_t")
    with pytest.raises(guarded.UnsafeSQL):
        guarded.query_dataset(spark.createDataFrame([(1,)], "x int"), bad).collect()


@pytest.mark.parametrize("good, rows", [
    ("select replace(a, 'x', 'y') as a from dataset", [("ya",)]), ("select load from dataset", [(1,)]), ("select 'set; drop' as s from dataset", [("set; drop",)]),
    ("with t as (select load + 1 as n from dataset) select n from t, (select 1)", [(2,)]), ("select d.a from DATASET d where load in (select load from dataset);", [("xa",)]),
    ("select x from dataset lateral view explode(array(load, 5)) v as x", [(1,), (5,)]), ("-- from hidden_t\nselect count(*) as n from dataset", [(1,)]),
])
def test_guarded_sql_allows(spark, good, rows):
    from lumenframe.plans import sql as guarded

    assert [tuple(r) for r in guarded.query_dataset(spark.createDataFrame([("xa", 1)], "a string, load int"), good).collect()] == rows


def test_sentiment_follows_the_lists(spark):
    from lumenframe.functions import text

    rows = [("I am glad and superb", 1.0, 1.0), ("a waste and a problem", -1.0, -1.0), ("not good but great", 1.0, 0.0), ("isn't very bad", -1.0, 1.0), ("", 0.0, 0.0), ("good very bad", 0.0, -0.2)]
    got = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").select("t", text.lexicon_sentiment(F.col("t")).alias("a"), text.scanned_sentiment(F.col("t")).alias("b")).collect()
    assert [(r["t"], r["a"], round(r["b"], 6)) for r in got] == rows


def test_clusters_cross_the_antimeridian_and_long_chains(spark):
    from lumenframe.functions import geo

    points = [(i, 0.0, 179.99 - 0.02 * (i % 2) * 0 if i < 3 else -179.99) for i in range(6)] + [(100 + i, 40.0, 0.03 * i) for i in range(80)] + [(999, -60.0, 5.0)]
    got = {r["k"]: r["cluster"] for r in geo.dbscan(spark.createDataFrame(points, "k long, la double, lo double"), "k", "la", "lo", km=5, least=2).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[100 + i] for i in range(80)} == {100} and got[999] == -1


def test_delimited_text_is_sniffed_from_its_beginning(spark, tmp_path):
    from lumenframe.sources import files

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "_SUCCESS").write_text("")
    (tmp_path / "t" / "a.csv").write_bytes("k;v\n".encode() + b"1;caf\xe9\n" * 20_000)
    got = files.read_csv(spark, str(tmp_path / "t"))
    assert got.columns == ["k", "v"] and got.count() == 20_000 and got.first()["v"] == "café"
    assert files._head(spark, str(tmp_path / "none*")) == b""
    assert "LIMIT" not in files.jdbc_options("sqlite:x.db", "select 1 as a", limit=None)["query"]


def test_interpolation_over_ranges(spark, capsys):
    n = 2000
    known = {i: float((i * 37) % 101) for i in range(5, n - 5) if i % 7 == 0 and not 300 < i < 1500}
    rows = [(3 * i, known.get(i)) for i in range(n)]
    df = spark.createDataFrame(rows[::-1], "i long, v double")
    got = sampling.interpolate(df, "v", "i")
    at = sorted(known)
    want = {}
    for i in range(n):
        a, b = max((k for k in at if k <= i), default=None), min((k for k in at if k >= i), default=None)
        want[3 * i] = known[i] if i in known else None if a is None else known[a] if b is None else known[a] + (known[b] - known[a]) * (i - a) / (b - a)
    assert {r["i"]: r["v"] for r in got.collect()} == pytest.approx(want)
    few = {r["i"]: r["v"] for r in sampling.interpolate(df, "v", "i", limit=2).collect()}
    assert few == pytest.approx({3 * i: want[3 * i] if any(k in known for k in (i, i - 1, i - 2)) else None for i in range(n)})
    # A frame that ends with the table is read again for every row, and a window without a partition is one task.
    got.explain()
    plan = capsys.readouterr().out
    assert "unboundedfollowing" not in plan and "hashpartitioning(_part" in plan


def test_profile_ranks_values_without_holding_them(spark, capsys):
    import decimal

    rows = [((i * 7919) % 1009, None if i % 5 == 0 else (i * 31 % 997) / 7, None, f"t{i % 13}", decimal.Decimal(i % 17) / 4, (1 << 60) + i % 3) for i in range(1500)] + [(5, float("nan"), None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d string, e decimal(9,2), f long")
    out = quality.profile(df)
    out.explain()
    assert "percentile(" not in capsys.readouterr().out  # it keeps a map of all values of a column in one task
    got = {r["column"]: r for r in out.collect()}
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    for c in "abcef":
        want = df.agg(F.count_distinct(c).alias("unique"), *[F.percentile(F.col(c).cast("double"), q).alias(k) for k, q in shares.items()]).first()
        assert {k: got[c][k] for k in want.asDict()} == want.asDict()
    assert got["f"]["unique"] == 3 and got["d"]["unique"] == 13 and got["d"]["median"] is None and got["c"]["median"] is None
    assert [r["unique"] for r in quality.profile(df.limit(0)).collect()] == [0] * 6
    assert quality.profile(df.select("d")).first()["unique"] == 13


def ranked(values, q):
    """The percentile of present values, interpolated between ranks."""
    v = sorted(x for x in values if x is not None)
    at = (len(v) - 1) * q
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def test_outlier_explain_ranks_values_without_holding_them(spark, capsys):
    import decimal

    rows = [((i * 31 % 997) / 7 - 50 if i % 5 else None, decimal.Decimal(i % 17) / 4, str(i * 7919 % 1009), 1, None) for i in range(1500)]
    df = spark.createDataFrame(rows, "z double, e decimal(9,2), t string, one int, none double")
    got = eda.outlier_explain(df, ["z", "one", "none", "t", "e"])
    got.explain()
    assert "percentile(" not in capsys.readouterr().out  # it keeps a map of all values of a column in one task
    assert got.columns == ["column", "lower", "upper", "p01", "p05", "p50", "p95", "p99"]
    out = got.collect()
    assert [r["column"] for r in out] == ["z", "one", "t", "e"]
    for r in out:
        values = [None if x is None else float(x) for x in (row["zet".index(r["column"])] if r["column"] in "zet" else row[3] for row in rows)]
        a, b = ranked(values, 0.25), ranked(values, 0.75)
        want = {"lower": a - 1.5 * (b - a), "upper": b + 1.5 * (b - a), "p01": ranked(values, 0.01), "p05": ranked(values, 0.05), "p50": ranked(values, 0.5), "p95": ranked(values, 0.95), "p99": ranked(values, 0.99)}
        assert {k: r[k] for k in want} == pytest.approx(want)
    assert eda.outlier_explain(df.limit(0), ["z", "e"]).collect() == []
    with pytest.raises(Exception):
        eda.outlier_explain(df, ["nothing"])


def test_numeric_summary_ranks_values_without_holding_them(spark, capsys):
    import decimal

    rows = [((i * 7919) % 1009 - 500, (i * 31 % 997) / 7 if i % 5 else None, None, "t", decimal.Decimal(i % 17) / 4, (1 << 60) + i % 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "a int, b double, none float, d string, e decimal(9,2), f long")
    got = eda.numeric_summary(df)
    got.explain()
    assert "percentile(" not in capsys.readouterr().out  # it keeps a map of all values of a column in one task
    assert got.columns == ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    out = got.collect()
    assert [r["column"] for r in out] == ["a", "b", "none", "e", "f"]
    for r in out:
        values = [None if x is None else float(x) for x in (row[df.columns.index(r["column"])] for row in rows)]
        known = [x for x in values if x is not None]
        want = {"count": len(known)} | ({"min": min(known), "p25": ranked(values, 0.25), "p50": ranked(values, 0.5), "p75": ranked(values, 0.75), "max": max(known)} if known else dict.fromkeys(["mean", "std", "min", "p25", "p50", "p75", "max"]))
        assert {k: r[k] for k in want} == (pytest.approx(want) if known else want)
    assert [(r["column"], r["count"], r["p50"]) for r in eda.numeric_summary(df.limit(0), 2).collect()] == [("a", 0, None), ("b", 0, None)]
    assert eda.numeric_summary(df.select("d")).collect() == []


def test_clusters_of_many_points_at_one_place(spark, monkeypatch):
    sizes, held = geo._settled, []
    monkeypatch.setattr(geo, "_settled", lambda df: held.append(sizes(df)) or held[-1])
    spots = [(0.0, 180.0, 300), (0.0, -180.0, 200), (0.0, 179.99, 1), (10.0, 10.0, 400), (10.02, 10.0, 1), (10.04, 10.0, 1), (20.0, 20.0, 2), (20.02, 20.0, 1), (30.0, 30.0, 3), (40.0, 40.0, 1), (None, 5.0, 3)]
    points = [(la, lo) for la, lo, n in spots for _ in range(n)]
    rows = [(len(points) - i, *p) for i, p in enumerate(points)]
    got = {r["k"]: r["cluster"] for r in geo.dbscan(spark.createDataFrame(rows, "k long, la double, lo double"), "k", "la", "lo", km=3, least=4).collect()}
    at = {}
    for k, la, lo in rows:
        at.setdefault((la, None if la is None else -180.0 if lo == 180.0 else lo), []).append(k)
    small = {p: min(ks) for p, ks in at.items()}
    first, second = min(small[0.0, -180.0], small[0.0, 179.99]), min(small[10.0, 10.0], small[10.02, 10.0])
    # Core: the places of the first group; 10.0 and 10.02, with 401 and 403 points around; 10.04 has 2 and is reached from 10.02.
    want = {p: first if p[0] == 0.0 else second if p[0] in (10.0, 10.02, 10.04) else -1 for p in at}
    assert got == {k: want[p] for p, ks in at.items() for k in ks}
    assert max(df.count() for df in held) < 30


def test_item_similarity_shuffles_no_pairs(spark, capsys):
    ratings = [(f"u{i % 23}", f"p{(i * i + 7 * i) % 61:02}", None if i % 17 == 0 else float(i % 6)) for i in range(900)]
    ratings += [("all", f"p{i:02}", 1.5) for i in range(61)] + [(None, f"p{i:02}", 3.0) for i in range(0, 61, 2)] + [("u1", None, 2.0), ("x", "lost", None), ("x", "p00", 0.0)]
    df = spark.createDataFrame(ratings, "u string, i string, r double")
    seen = {}
    for u, i, r in ratings:
        seen.setdefault((u, i), []).append(r)
    mean = {k: sum(x) / len(x) if (x := [r for r in v if r is not None]) else None for k, v in seen.items() if k[1] is not None}
    norm = {i: math.sqrt(sum(x)) if (x := [r * r for (_, j), r in mean.items() if j == i and r is not None]) else None for _, i in mean}
    dots = {}
    for (u, a), r in mean.items():
        for (v, b), q in mean.items():
            if u == v and u is not None and a < b:
                dots.setdefault((a, b), []).append(None if r is None or q is None else r * q)
    want = {p: sum(x) / norm[p[0]] / norm[p[1]] if (x := [y for y in v if y is not None]) and norm[p[0]] and norm[p[1]] else None for p, v in dots.items()}
    for sizes in ({}, {"most": 7, "cell_items": 100}):
        out = business.item_similarity(df, "u", "i", "r", **sizes)
        rows = out.collect()
        assert {(r["a"], r["b"]): r["similarity"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert want["lost", "p00"] is None
    out.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(part" in plan and "hashpartitioning(a" not in plan
    hot = business._products(3)
    import pyarrow as pa

    cell = [pa.RecordBatch.from_pydict({"part": [0], "sub": [0], "left_i": [[5]], "left_r": [[2.0]], "left_ss": [[4.0]], "left_at": [[0]], "right_i": [[6, 7]], "right_r": [[1.0, None]], "right_ss": [[4.0, 4.0]], "right_at": [[1, 2]]})] * 2
    assert [r for b in hot(cell) for r in b.to_pylist()] == [{"a": 5, "b": 6, "similarity": 1.0}, {"a": 5, "b": 7, "similarity": None}]
