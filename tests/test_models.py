import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from datascry.operators import evaluate as ev
from datascry.operators import forecast as fc
from datascry.operators import models as m
from datascry.operators import profile as p
from datascry.plans import analysis


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(400):
        n1, n2 = rng.normal(), rng.normal()
        cat = "XYZ"[int(rng.integers(3))]
        y = "A" if n1 + (cat == "X") > 0.3 else "B"
        rows.append((i, None if i == 3 else float(n1), float(n2), None if i == 5 else cat, y, float(2 * n1 + 0.5 * n2)))
    return spark.createDataFrame(rows, "row_id long, num1 double, num2 double, cat1 string, target string, amount double").cache()


def test_classification_analysis_scores_new_rows(spark, table, tmp_path):
    rows = table.drop("amount")
    actions = [{"column": "num1", "actionType": "impute_median"}, {"column": "cat1", "actionType": "target_encode"}]
    out, fitted = analysis.analyze_table(rows, "row_id", "target", actions, trees=10)
    best = out["leaderboard"].filter("rank = 1").first()
    assert best["score"] > out["baseline"].first()["accuracy"] + 0.15
    assert best["model"] == fitted.model_name
    scored = m.score_batch(fitted, rows.drop("target"), str(tmp_path / "out"))
    assert scored.count() == 400 and {r[0] for r in scored.select("target").distinct().collect()} == {"A", "B"}
    fitted.save(spark, str(tmp_path / "p"))
    again = m.FittedPipeline.load(spark, str(tmp_path / "p"))
    same = scored.select("row_id", F.col("target").alias("a")).join(again.transform(rows.drop("target")).select("row_id", F.col("target").alias("b")), "row_id")
    assert same.filter("a <> b").count() == 0
    single = m.score_records(spark, again, {"num1": 3.0, "num2": 0.1, "cat1": "X"}).first()
    assert single["target"] == "A" and sum(single["probabilities"]) == pytest.approx(1.0)
    many = m.score_records(spark, again, {"num1": [3.0, -3.0], "cat1": ["X", "unseen"]}).collect()
    assert [r["target"] for r in many] == ["A", "B"]


def test_regression_analysis(table):
    out, fitted = analysis.analyze_table(table.drop("target"), "row_id", "amount", families=("linear", "ridge"))
    assert out["leaderboard"].filter("rank = 1").first()["score"] > 0.8
    assert fitted.plan.task == "regression"
    top = out["importances"].first()
    assert top["feature"].startswith("num1")


def test_later_model_wins_ties(spark):
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(50).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("label")))
    one = m.train_linear(rows)
    board = m.leaderboard({"first": one, "second": one}, rows, "regression")
    assert m.best_model(board) == "second"


def test_rfe_keeps_planted_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20))
    names = [f"num{i}" for i in range(1, 21)]
    df = spark.createDataFrame([(*map(float, r), float(2 * r[0] + 0.5 * r[1])) for r in x], ", ".join(f"{n} double" for n in names) + ", label double")
    kept = m.rfe_select(VectorAssembler(inputCols=names, outputCol="features").transform(df), "regression", names, trees=20)
    assert len(kept) == 10 and {"num1", "num2"} <= set(kept)


def test_pdp_of_a_line(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 6)], "feat double, label double")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[VectorAssembler(inputCols=["feat"], outputCol="features"), m.regressor("linear", 5)]).fit(df)
    points = m.pdp_ice(model, df, "feat", "feat", ice=2)
    assert {r["series"] for r in points.collect()} == {"PDP", "ICE_0", "ICE_1"}
    for r in points.filter("series = 'PDP'").collect():
        assert r["y"] == pytest.approx(2 * r["x_num"], abs=1e-6)


def test_permutation_importance_finds_the_signal(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a)) for a, b in rng.normal(size=(300, 2))], "a double, b double, label double")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), m.regressor("linear", 300)]).fit(df)
    got = {r["feature"]: r["importance"] for r in m.permutation_importance(model, df, ["a", "b"], "regression", repeats=2).collect()}
    assert got["a"] > 0.5 > abs(got["b"])


def test_permutation_importance_scores_all_shuffles_in_one_job(spark, monkeypatch):
    from pyspark.ml import Pipeline

    from datascry.operators import ordered
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a - b), float(a > 0)) for a, b in rng.normal(size=(400, 2))], "a double, b double, label double, big double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), m.regressor("linear", 400)]).fit(df)
    plans = []

    class Watched:
        def transform(self, rows):
            plans.append(rows)
            return model.transform(rows)

    whole = m.permutation_importance(Watched(), df, ["a", "b"], "regression", repeats=3).collect()
    assert len(plans) == 2  # the rows as they are, and all six shuffled forms at once
    assert plans[1].count() == 6 * 400
    values = {c: sorted(r[c] for r in df.collect()) for c in ("a", "b")}
    for which in range(6):
        rows = plans[1].where(f"__which = {which}").collect()
        assert {c: sorted(r[c] for r in rows) for c in values} == values  # nothing lost, nothing twice
    monkeypatch.setattr(ordered, "HOT_ROWS", 50)  # the same by ranges of the hash
    ranged = m.permutation_importance(model, df, ["a", "b"], "regression", repeats=3).collect()
    assert [(r[0], round(r[1], 9)) for r in ranged] == [(r[0], round(r[1], 9)) for r in whole]
    labels = df.select("a", "b", df.big.alias("label"))
    sorter = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), m.classifier("logistic", 2)]).fit(labels)
    told = {r["feature"]: r["importance"] for r in m.permutation_importance(sorter, labels, ["a", "b"], "classification", repeats=2).collect()}
    assert told["a"] > 0.3 > abs(told["b"])


def test_cross_validation_and_tuning(table):
    plan = m.plan_features(table.drop("amount", "row_id"), p.profile(table.drop("amount", "row_id")), "target")
    ready = m.with_label(m.prepare(table, plan), plan)
    from pyspark.ml import Pipeline

    cv = m.cross_validate(Pipeline(stages=[*m.featurize(plan).getStages(), m.classifier("logistic", 2)]), ready, "row_id", "classification", k=3).first()
    assert cv["folds"] == 3 and cv["mean"] > 0.7
    features = m.featurize(plan).fit(ready).transform(ready)
    model, score, best = m.tune(features, "classification", 2, trials=2)
    assert score > 0.7 and set(best) == {"numTrees", "maxDepth"}


def test_task_rules(spark):
    df = spark.createDataFrame([(i % 3, i % 3 + 5, i * 1.5, float(i % 2)) for i in range(60)], "a int, b int, c double, d double")
    assert [m.task_frame(df, c, False).first()["task"] for c in "abcd"] == ["classification", "regression", "regression", "classification"]


def test_curves_against_direct_computation(spark):
    rng = np.random.default_rng(4)
    score = rng.random(500).round(3)
    label = (rng.random(500) < score).astype(int)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    auc = ev.roc_curve(df, "label", "score").first()["auc"]
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert auc == pytest.approx(want)
    assert ev.roc_curve(df, "label", "score").count() <= 101


def test_forecasters(spark):
    y = [10, 12, 15, 18, 22, 27, 33, 40, 48, 57]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("b", i, 5.0) for i in range(10)], "k string, at int, y double")
    for op in (fc.forecast_ar_per_series, fc.forecast_holt_winters):
        rows = op(df, ["k"], "at", "y").collect()
        assert len(rows) == 6
        assert all(r["forecast"] > 57 for r in rows if r["k"] == "a")
        assert all(abs(r["forecast"] - 5) < 1e-6 for r in rows if r["k"] == "b")


def test_holt_winters_follows_a_season(spark):
    wave = [10 + 0.1 * i + [0, 3, -2, 1, 4, -5, -1][i % 7] for i in range(140)]
    got = fc.holt_winters(np.array(wave[:126]), 14)
    assert np.abs(got - np.array(wave[126:])).max() < 1.0


def test_long_series_are_not_refused(spark, monkeypatch):
    monkeypatch.setattr(fc, "SERIES_POINTS", 5)
    df = spark.range(40).select(F.lit("a").alias("k"), F.col("id").alias("at"), F.lit(1.0).alias("y"))
    assert all(r["forecast"] == pytest.approx(1.0) for r in fc.forecast_holt_winters(df, ["k"], "at", "y").collect())


def test_series_text_and_cluster_analyses(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f"2026-0{1 + d // 28}-{1 + d % 28:02d}", float(10 + d * 0.2 + [0, 3, -2, 1, 4, -5, -1][d % 7] + rng.normal())) for k in "ab" for d in range(112)]
    out = analysis.analyze_series(spark.createDataFrame(rows, "k string, date string, value double"), "value", ["k"])
    board = {r["model"]: r["r2"] for r in out["leaderboard"].collect()}
    assert board["ridge"] > board["mean"] and out["points"].count() > 0 and out["stationarity"].count() == 2
    good, bad = ["great loved wonderful story", "excellent acting and great fun"], ["terrible boring waste", "awful story and bad acting"]
    reviews = [(i, (good if i % 2 else bad)[i // 2 % 2] + f" scene{i % 5}", "positive" if i % 2 else "negative") for i in range(60)]
    out = analysis.analyze_text(spark.createDataFrame(reviews, "id long, review string, sentiment string"), "id", "sentiment")
    assert out["leaderboard"].filter("rank = 1").first()["score"] == 1.0
    tone = {r["sentiment"]: r["polarity"] for r in out["polarity_by_class"].collect()}
    assert tone["positive"] > 0 > tone["negative"]
    points = [(i, float(rng.normal() + 8 * (i % 3)), float(rng.normal() - 8 * (i % 3))) for i in range(150)]
    out = analysis.analyze_clusters(spark.createDataFrame(points, "id long, num1 double, num2 double"), "id")
    assert out["silhouettes"].filter("chosen").first()["k"] == 3 and out["sizes"].count() == 3


def test_quality_analysis_runs(table):
    out = analysis.analyze_quality(table, "target")
    assert all(df.count() >= 0 for df in out.values())
    assert {r["column"]: r["type"] for r in out["profile"].collect()}["row_id"] == "identifier"


def test_cells_on_codes_and_label_codes_over_ranges(spark, monkeypatch):
    from collections import Counter

    from datascry.operators import correlate as co
    from datascry.operators.encode import label_codes
    rng = np.random.default_rng(0)
    rows = [(str(a), None if b == 0 else int(b), "u" + str(i)) for i, (a, b) in enumerate(rng.integers(0, 6, (3000, 2)))]
    df = spark.createDataFrame(rows, "a string, b int, c string").repartition(3)
    for cells in (1_000_000, 500):  # 500: dictionaries start anew many times
        monkeypatch.setattr(co, "TASK_CELLS", cells)
        got = {(r.x, r.y, r.a, r.b): r.o for r in co._cells(df, [("a", "b"), ("b", "c")]).collect()}
        want = Counter(("a", "b", a, str(b)) for a, b, _ in rows if b is not None) + Counter(("b", "c", str(b), c) for _, b, c in rows if b is not None)
        assert got == {k: float(v) for k, v in want.items()}
    names = spark.range(50_000).select(F.concat(F.lit("one long common prefix "), F.lpad("id", 6, "0")).alias("name"))
    coded = label_codes(names, "name")
    assert coded.where("code <> cast(right(label, 6) as int)").isEmpty() and coded.count() == 50_000


def test_orders_are_joined_once_for_a_fitted_pipeline(spark, tmp_path):
    from datascry.catalog import Tables
    from datascry.catalog.learning import fitted_orders

    spark.createDataFrame([(i, i % 6, float(i * 31 % 17), "OFP"[i % 3], f"{1 + i % 2}-X") for i in range(90)],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, float(i), "AB"[i % 2], i) for i in range(6)],
                          "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    fitted, test = fitted_orders(Tables(spark, str(tmp_path)))
    scored = fitted.transform(test)
    assert scored.count() == test.count() > 0
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_boosted_trees_count_equal_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, 6000), rng.integers(0, 5, 6000)
    y = 3.0 * a + b * b + rng.normal(0, 5, 6000)
    df = spark.createDataFrame([(i, float(p), float(q), float(v), float(v > 60)) for i, (p, q, v) in enumerate(zip(a, b, y))], "id long, a double, b double, label double, big double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    seen = []
    plain = m.spread_rows
    monkeypatch.setattr(m, "spread_rows", lambda rows, n: seen.append((n, rows.schema["features"].metadata)) or plain(rows, n))

    def guesses(model):
        return [r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()]

    assert np.allclose(guesses(m.train_boosted(df, "regression", trees=6)), guesses(m.regressor("boosted", 6000, trees=6).fit(df)), rtol=1e-9)
    assert guesses(m.train_boosted(df, "classification", 2, label="big", trees=4)) == guesses(m.classifier("boosted", 2, label="big", trees=4).fit(df))
    assert seen[0][0] <= 200 and seen[1][0] <= 400 and all(meta == df.schema["features"].metadata for _, meta in seen)


def test_training_rows_are_dealt_over_tasks(spark, monkeypatch):
    """One file or row group must not make one task hold every row."""
    monkeypatch.setattr(m, "TASK_ROWS", 50)
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(0, 400, 1, 1).select((F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label")))
    sizes = []
    plain = m.spread_rows
    monkeypatch.setattr(m, "spread_rows", lambda rows, n: (sizes.append([len(p) for p in plain(rows, n).rdd.glom().collect()]), plain(rows, n))[1])
    m.train_random_forest(df, "regression", trees=2)
    m.train_mlp(df, 2, iterations=2)
    assert all(len(s) == 8 and max(s) <= 60 for s in sizes) and len(sizes) == 2, sizes


def test_texts_are_cut_once_for_all_folds(spark):
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} same", float(i % 2), float(i % 5)) for i in range(60)], "id long, text string, label double, x double")
    pipeline = Pipeline(stages=[*m.text_stages("text", "tf", 20), VectorAssembler(inputCols=["tf", "x"], outputCol="features"), m.classifier("logistic", 2)])
    ready, rest = m.apply_unfitted(pipeline, rows)
    assert [type(s).__name__ for s in rest.getStages()] == ["CountVectorizer", "IDF", "VectorAssembler", "LogisticRegression"]
    assert ready.columns == ["id", "label", "x", "tf_k"]
    whole = pipeline.fit(rows).transform(rows).orderBy("id").select("prediction").collect()
    assert rest.fit(ready).transform(ready).orderBy("id").select("prediction").collect() == whole
    assert m.cross_validate(pipeline, rows, "id", "classification", k=3).first()["folds"] == 3


def test_networks_of_many_rows_follow_those_of_the_library(spark, monkeypatch):
    """Whole blocks of 128 rows in one partition: the library's loss is the mean over the rows there."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (1280, 2))
    rows = [(float(a), float(b), float((a * b > 7) + (a + b > 6))) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, label double").coalesce(1)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    plain, points = m.classifier("mlp", 3, 2, iterations=12).fit(df), []
    fit = m.fit_network
    monkeypatch.setattr(m, "fit_network", lambda network, p, total: (points.append((p.count(), total)), fit(network, p, total))[1])
    monkeypatch.setattr(m, "NETWORK_ROWS", 1000)
    for repeated in (3, 10 ** 9):
        monkeypatch.setattr(m, "REPEATED", repeated)
        model = m.train_mlp(df, 3, iterations=12)
        assert np.allclose(model.weights.toArray(), plain.weights.toArray(), rtol=1e-4, atol=1e-4)
        assert model.getMaxIter() == 12 and model.transform(df).select("prediction").collect() == plain.transform(df).select("prediction").collect()
    assert points[0][0] <= 108 and points[1][0] == 1280 and {t for _, t in points} == {1280.0}
    with pytest.raises(ValueError):
        m.train_mlp(df.withColumn("label", F.when(F.col("a") > 0, F.col("label"))), 3, iterations=2)
