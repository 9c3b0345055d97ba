import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datascry.operators import cleaning as cl
from datascry.operators import imputers as im


def plan(*pairs):
    return [{"column": c, "actionType": a} for c, a in pairs]


def test_mean_and_mode(spark):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (None, "A"), (4.0, None), (5.0, "A")], "num_val double, cat_val string")
    out = cl.clean(df, plan(("num_val", "impute_mean"), ("cat_val", "impute_mode")))[1]
    rows = out.collect()
    assert [r["num_val"] for r in rows][2] == 3.0
    assert [r["cat_val"] for r in rows][3] == "A"


def test_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (10.0,), (20.0,)], "num_val double")
    assert cl.clean(df, plan(("num_val", "impute_median")))[1].collect()[2]["num_val"] == 6.0


def test_mode_of_empty_text_is_missing(spark):
    df = spark.createDataFrame([(None,)], "c string")
    assert cl.clean(df, plan(("c", "impute_mode")))[1].first()["c"] == "missing"


@pytest.mark.parametrize("kind", ["impute_knn", "impute_mice"])
def test_model_imputers_leave_no_nulls_and_follow_the_line(spark, kind):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 7)] + [(None, 14.0)], "x double, y double")
    model, out = cl.clean(df, plan(("x", kind)))
    rows = {r["y"]: r["x"] for r in out.collect()}
    assert len(rows) == 7 and None not in rows.values()
    if kind == "impute_mice":
        assert rows[14.0] == pytest.approx(7.0, abs=1e-3)
    again = cl.CleanerModel.from_json(model.to_json()).transform(df)
    assert {r["y"]: r["x"] for r in again.collect()} == pytest.approx(rows)


def test_outliers_in_training_and_scoring(spark):
    df = spark.createDataFrame([(1.0,), (1.1,), (1.2,), (1.3,), (100.0,)], "val double")
    assert cl.clean(df, plan(("val", "clip_outliers")))[1].agg(F.max("val")).first()[0] < 100
    model, trained = cl.clean(df, plan(("val", "drop_outliers")))
    assert trained.count() == 4
    assert model.transform(df).count() == 5


def test_isolation_forest(spark):
    values = np.concatenate([np.random.default_rng(42).normal(10, 1, 50), [1000, -1000]])
    df = spark.createDataFrame(pd.DataFrame({"val": values}))
    model, trained = cl.clean(df, plan(("val", "isolation_forest")))
    assert trained.count() < 52 and trained.filter("val = 1000").count() == 0
    assert model.transform(df).count() == 52
    assert cl.CleanerModel.from_json(model.to_json()).transform(df, training=True).count() == trained.count()


def test_transforms(spark):
    df = spark.createDataFrame([(1.0, 2.0, "2026-06-23 12:00:00"), (-3.0, 4.0, "bad"), (None, 5.0, None)], "num_val double, other_num double, date_val string")
    out = cl.clean(df, plan(("num_val", "transform_log"), ("num_val", "transform_power"), ("num_val", "transform_interaction:other_num"),
                            ("date_val", "transform_date")))[1].collect()
    assert out[0]["num_val_log"] == pytest.approx(np.log1p(1)) and out[1]["num_val_log"] == 0.0 and out[2]["num_val_log"] is None
    assert out[1]["num_val_power"] == 9.0 and out[0]["num_val_x_other_num"] == 2.0
    assert [out[0][f"date_val_{p}"] for p in ("year", "month", "day", "dayofweek", "hour")] == [2026, 6, 23, 1, 12]
    assert [out[1][f"date_val_{p}"] for p in ("year", "month", "day", "dayofweek", "hour")] == [2000, 1, 1, 0, 0]


def test_drop_column_and_rename(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "x int, y double")
    assert cl.clean(df, plan(("x", "drop")))[1].columns == ["y"]
    out = cl.clean(df, plan(("y", "rename:z"), ("y", "impute_mean")))[1]
    assert out.columns == ["x", "z"] and out.filter("z is null").count() == 0


def test_bad_plans_are_refused_early():
    for action in ("nonsense", "remove_less_than:abc", "rename:", "plugin:unknown"):
        with pytest.raises(ValueError):
            cl.parse_actions([{"column": "x", "actionType": action}])


def test_statistics_come_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    other = spark.createDataFrame([(1000.0,), (None,)], "v double")
    model = cl.fit_cleaner(train, plan(("v", "impute_mean")))
    assert model.transform(other).filter("v = 2.0").count() == 1


def brute_knn(q, donors, k=5):
    out = q.copy()
    for i in range(len(q)):
        for j in np.flatnonzero(np.isnan(q[i])):
            both = ~np.isnan(q[i]) & ~np.isnan(donors)
            d = np.where(both, (np.where(np.isnan(q[i]), 0, q[i]) - np.nan_to_num(donors)) ** 2, 0).sum(1) * q.shape[1] / np.maximum(both.sum(1), 1)
            d[both.sum(1) == 0] = np.nan
            ok = np.flatnonzero(~np.isnan(donors[:, j]) & ~np.isnan(d))
            ok = ok[np.lexsort((donors[ok, j], d[ok]))][:k]
            out[i, j] = donors[ok, j].mean()
    return out


def test_knn_against_brute_force_on_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 3)).round(2)
    x[rng.random(x.shape) < 0.15] = np.nan
    x = x[~np.isnan(x).all(1)]
    x = np.vstack([x, np.repeat(x[:1], 40, 0)])  # copies of one row
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    want = brute_knn(x, x)
    cols = ["a", "b", "c"]

    def run(model):
        return np.array([[r[c] for c in cols] for r in model.transform(df).orderBy("id").collect()])

    assert np.allclose(run(im.KnnImputer.fit(df, cols)), want)
    monkeypatch.setattr(im, "DONOR_ROWS", 40)
    monkeypatch.setattr(im, "QUERY_ROWS", 15)
    model = im.KnnImputer.fit(df, cols, limit=40)
    assert model.donors is None
    assert np.allclose(run(model), want)


def test_knn_meets_only_blocks_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(im, "DONOR_ROWS", 1600)  # blocks of 100 and 20 rows
    monkeypatch.setattr(im, "QUERY_ROWS", 320)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.5, (1000, 4)) for c in (0.0, 50.0, 100.0)]).round(3)
    x[:, ::3][rng.random((3000, 2)) < 0.06] = np.nan
    x[:3] = np.nan
    x[:3, 0] = [0.0, 50.0, 100.0]   # many missing
    x[5] = np.nan                   # nothing known: the means
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double").repartition(3)
    cols = ["a", "b", "c", "d"]
    met = []
    plain = im.KnnImputer._pairs

    def watched(self, sides, donors, within):
        pairs = plain(self, sides, donors, within)
        met.append((pairs.count(), sides.count() * len(donors.ids)))
        return pairs

    monkeypatch.setattr(im.KnnImputer, "_pairs", watched)
    model = im.KnnImputer.fit(df, cols, limit=40)
    got = np.array([[r[c] for c in cols] for r in model.transform(df).orderBy("id").collect()])
    want = brute_knn(x, x)
    want[5] = np.nanmean(x, axis=0)
    assert np.allclose(got, want)
    assert sum(n for n, _ in met) < met[0][1] / 2, met  # the clusters lie apart: most pairs of blocks are beyond the bound
    again = im.KnnImputer.load(spark, model.cols, model.k, model.means, model.path)
    assert np.allclose(np.array([[r[c] for c in cols] for r in again.transform(df).orderBy("id").collect()]), want)


def test_knn_donors_near_in_the_known_columns_lie_in_few_blocks(spark, monkeypatch):
    """A wide missing column must not spread the near donors over all blocks."""
    monkeypatch.setattr(im, "DONOR_ROWS", 1600)
    monkeypatch.setattr(im, "QUERY_ROWS", 320)
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.uniform(0, 5e5, 4000).round(2), rng.integers(0, 400, 4000), rng.integers(1, 13, 4000)]).astype(float)
    x[rng.random(4000) < 0.05, 0] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    met = []
    plain = im.KnnImputer._pairs

    def watched(self, sides, donors, within):
        pairs = plain(self, sides, donors, within)
        met.append((pairs.count(), sides.count() * len(donors.ids)))
        return pairs

    monkeypatch.setattr(im.KnnImputer, "_pairs", watched)
    got = np.array([[r[c] for c in "abc"] for r in im.KnnImputer.fit(df, list("abc"), limit=40).transform(df).orderBy("id").collect()])
    assert np.allclose(got, brute_knn(x, x))
    assert sum(n for n, _ in met) < 0.4 * met[0][1], met


def test_knn_sends_a_donor_block_once_for_many_rows_and_bounds_whole_blocks(spark, monkeypatch):
    """Rows of several blocks share a donor block, and rows of a block are held against the boxes near it only."""
    monkeypatch.setattr(im, "DONOR_ROWS", 1600)
    monkeypatch.setattr(im, "QUERY_ROWS", 320)
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 50, 5000), rng.uniform(0, 1e4, 5000).round(), rng.integers(1, 13, 5000)]).astype(float)
    x[rng.random(x.shape) < 0.03] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double")
    stored, pairs = {}, spark.sparkContext.accumulator(0)
    plain, least = im.stored, im.Boxes.least_distances
    monkeypatch.setattr(im, "stored", lambda df, name: stored.setdefault(name, []).append(plain(df, name)) or stored[name][-1])

    def counted(self, q):
        pairs.add(len(q) * len(self.ids))
        return least(self, q)

    monkeypatch.setattr(im.Boxes, "least_distances", counted)
    got = np.array([[r[c] for c in "abc"] for r in im.KnnImputer.fit(df, list("abc"), limit=40).transform(df).orderBy("id").collect()])
    want = np.where(np.isnan(x).all(1)[:, None], np.nanmean(x, axis=0), brute_knn(x, x))
    assert np.allclose(got, want)
    first, rest = stored["pieces"]
    assert rest.select("__d", "__piece").distinct().count() < 0.8 * rest.count()
    asked, boxes = stored["blocks"][1].count(), sum(t.select(im.BLOCK).distinct().count() for t in stored["blocks"][2:])
    assert 0 < pairs.value < 0.7 * 2 * asked * boxes, (pairs.value, asked, boxes)


def test_nearest_values_within_a_radius_keep_ties_by_value():
    donors = np.array([[1.0, 9.0], [1.0, 3.0], [2.0, 5.0], [np.nan, 4.0], [1.0, np.nan], [3.0, 1.0]])
    rows, columns, distances, values = im.nearest_values(np.array([[1.0, np.nan], [3.0, np.nan], [1.0, 2.0]]), donors, 2, np.array([np.inf, 2.0, np.inf]))
    assert rows.tolist() == [0, 0, 1, 1] and columns.tolist() == [1] * 4
    assert distances.tolist() == [0.0, 0.0, 0.0, 2.0] and values.tolist() == [3.0, 9.0, 1.0, 5.0]
