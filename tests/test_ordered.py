import numpy as np
import pytest
from pyspark.sql import functions as F

from datascry.operators import quantiles as qt
from datascry.operators import timeseries as ts
from datascry.operators.ordered import Sequence, numbered_by_hash


@pytest.fixture(scope="module")
def series(spark):
    """900 rows; one key holds most of them, and a third of the rows share one time."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        key = None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 7}"
        at = 500 if i % 3 == 0 else int(rng.integers(0, 1000))
        rows.append((i, key, at, None if rng.random() < 0.3 else float(rng.normal())))
    return spark.createDataFrame(rows, "id long, key string, at long, v double").repartition(5).cache()


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select("id", *cols).collect())


@pytest.mark.parametrize("key", [[], ["key"]])
def test_numbering_of_hot_series_is_exact(series, key):
    cold = Sequence(series, key, ["at", "id"], limit=10**6).numbered("n")
    hot = Sequence(series, key, ["at", "id"], limit=40)
    assert hot.hot
    assert pairs(cold, "n") == pairs(hot.numbered("n"), "n")


def test_numbering_by_text(series):
    texts = series.withColumn("at", F.concat(F.lit("é"), F.md5(F.col("at").cast("string"))))
    assert pairs(Sequence(texts, [], ["at", "id"], 10**6).numbered("n"), "n") == pairs(Sequence(texts, [], ["at", "id"], 30).numbered("n"), "n")


def test_blocked_windows_equal_plain_ones(series):
    fns = dict(key=["key"], ts="at", y="v", tie="id")
    for op, cols in ((ts.lag_features, [f"v_lag_{k}" for k in ts.LAGS]), (lambda df, **k: ts.rolling_mean(df, k=3, **k), ["v_roll_3"]),
                     (ts.rolling_std, ["v_std_7"]), (ts.seasonal_decompose, ["trend", "seasonal", "resid"])):
        cold, hot = pairs(op(series, **fns), *cols), pairs(op(series, limit=30, **fns), *cols)
        for a, b in zip(cold, hot):
            assert a[0] == b[0]
            for x, y in zip(a[1:], b[1:]):
                assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def test_blocked_fills_equal_plain_ones(series):
    for op in (lambda df, **k: ts.fill_directional(df, order="bf", **k), lambda df, **k: ts.fill_directional(df, order="fb", **k), ts.interpolate_linear):
        cold = pairs(op(series, key=["key"], ts="at", c="v", tie="id"), "v")
        hot = pairs(op(series, key=["key"], ts="at", c="v", tie="id", limit=30), "v")
        assert [c[0] for c in cold] == [h[0] for h in hot]
        assert np.allclose([c[1] for c in cold], [h[1] for h in hot])


def test_acf_decimation_and_split_on_both_paths(series):
    known = series.fillna({"v": 0.0})
    a, b = (sorted((str(r["key"]), r["lag"], round(r["acf"], 9)) for r in ts.acf(known, ["key"], "at", "v", 5, "id", limit).collect()) for limit in (None, 30))
    assert a == b
    a, b = (pairs(ts.decimate_even(series, ["key"], ["at", "id"], 50, limit)) for limit in (None, 30))
    assert a == b
    n = series.filter("key = 'hot'").count()
    assert ts.decimate_even(series.filter("key = 'hot'"), [], ["at", "id"], 50).count() == min(50, n)
    a, b = (pairs(ts.chrono_split(series, ["key"], "at", 0.8, "id", limit), "split") for limit in (None, 30))
    assert a == b


def test_even_positions(spark):
    df = spark.range(1000).withColumn("at", F.col("id"))
    kept = [r["id"] for r in ts.decimate_even(df, [], ["at"], 37).orderBy("id").collect()]
    assert kept == [i * 999 // 36 for i in range(37)]


def test_hash_numbering_on_both_paths(series):
    a = numbered_by_hash(series, "id", ["key"], "n")
    b = numbered_by_hash(series, "id", ["key"], "n", limit=20)
    assert pairs(a, "n") == pairs(b, "n")


def linear_quantiles(values, probs):
    return [float(np.percentile(values, 100 * p)) for p in probs]


def test_quantiles_on_every_path(spark, monkeypatch):
    rng = np.random.default_rng(5)
    heavy = np.where(rng.random(4000) < 0.4, 7.0, rng.lognormal(size=4000).round(3))
    df = spark.createDataFrame([(int(i % 3), float(v), None if i % 11 == 0 else float(i), None) for i, v in enumerate(heavy)], "g int, a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    known = np.array([float(i) for i in range(4000) if i % 11])
    monkeypatch.setattr(qt, "BUFFER_ROWS", 25)
    for limit in (10**6, 100):
        got = {r["column"]: r for r in qt.quantiles(df, ["a", "b", "c"], probs, limit=limit).collect()}
        assert np.allclose(got["a"]["q"], linear_quantiles(heavy, probs))
        assert np.allclose(got["b"]["q"], linear_quantiles(known, probs)) and got["b"]["n"] == len(known)
        assert got["c"]["n"] == 0
    for limit in (10**6, 100):
        got = {(r["g"], r["column"]): r["q"] for r in qt.quantiles(df, ["a"], probs, ["g"], limit=limit).collect()}
        for g in range(3):
            assert np.allclose(got[(g, "a")], linear_quantiles(heavy[np.arange(4000) % 3 == g], probs))


def test_adf_against_direct_regression(spark):
    rng = np.random.default_rng(0)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    df = spark.createDataFrame([("walk", i, float(v)) for i, v in enumerate(walk)] + [("noise", i, float(v)) for i, v in enumerate(noise)], "k string, at int, y double")
    got = {r["k"]: r for r in ts.adf_test(df, ["k"], "at", "y").collect()}
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]
    for name, y in (("walk", walk), ("noise", noise)):
        p, d = got[name]["lags"], np.diff(y)
        z = np.column_stack([np.ones(len(d) - p), y[p:-1], *[d[p - i:len(d) - i] for i in range(1, p + 1)]])
        coef, *_ = np.linalg.lstsq(z, d[p:], rcond=None)
        resid = d[p:] - z @ coef
        se = np.sqrt(resid @ resid / (len(resid) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
        assert got[name]["stat"] == pytest.approx(coef[1] / se, rel=1e-6)


def test_pacf_of_autoregression(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for e in rng.normal(size=2000):
        y.append(0.7 * y[-1] + e)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "at int, y double")
    got = {r["lag"]: r["pacf"] for r in ts.pacf(df.withColumn("k", F.lit(1)), ["k"], "at", "y", 5).collect()}
    assert got[1] == pytest.approx(0.7, abs=0.06) and all(abs(got[k]) < 0.08 for k in (2, 3, 4, 5))


def test_window_per_key_is_one_shuffle(series):
    plan = ts.lag_features(series, ["key"], "at", "v", tie="id")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 2


def test_long_series_by_blocks_equal_the_whole(spark, monkeypatch):
    from datascry.operators import forecast as fc
    rng = np.random.default_rng(8)
    walk, pull = [1000.0, 1001.0, 1003.0], [5.0, 5.5, 5.2]
    for e in rng.normal(size=600):
        walk.append(walk[-1] + 0.4 * (walk[-1] - walk[-2]) + e)
        pull.append(2 + 0.5 * pull[-1] + 0.2 * pull[-2] + e)
    wave = 50 + 0.05 * np.arange(500) + 8 * np.sin(np.arange(500) * 2 * np.pi / 7) + rng.normal(size=500)
    series = {"walk": walk, "pull": pull, "wave": list(wave), "flat": [3.0] * 300, "short": [1.0, 2.0, 4.0, 3.0, 5.0, 6.0, 8.0, 7.0, 9.0, 9.5]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, at int, y double").repartition(3)
    for run in (fc.forecast_ar_per_series, lambda *a, **b: fc.forecast_holt_winters(*a, **b), lambda *a, **b: fc.forecast_holt_winters(*a, season=0, **b)):
        monkeypatch.setattr(fc, "SERIES_POINTS", 50_000)
        whole = {(r.k, r.step): r.forecast for r in run(df, ["k"], "at", "y", steps=9).collect()}
        monkeypatch.setattr(fc, "SERIES_POINTS", 64)
        parts = {(r.k, r.step): r.forecast for r in run(df, ["k"], "at", "y", steps=9).collect()}
        assert set(whole) == set(parts) and len(whole) == 45
        for at, value in whole.items():
            assert parts[at] == pytest.approx(value, rel=1e-7, abs=1e-7), at
