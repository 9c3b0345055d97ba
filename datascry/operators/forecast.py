"""Forecasters: a mean baseline, regressions over all series at once, and small models per series, long ones by summaries of blocks."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.operators.keys import attach, spread
from datascry.operators.ordered import Sequence
from datascry.operators.timeseries import adf_fit, chrono_split, series_features

# Points of a series that one task takes as a whole, and points of a block of longer series.
SERIES_POINTS = 50_000
SEASON = 7
# Lags whose products are summed, and first and last values kept beside the sums.
LAGS, ENDS = 4, 16


def forecast_naive(train: DataFrame, test: DataFrame, key: list[str], y: str) -> DataFrame:
    """Test rows with the training mean of their series."""
    means = train.groupBy(*key).agg(F.avg(y).alias("prediction")) if key else None
    if means is None:
        return test.withColumn("prediction", train.agg(F.avg(y)).scalar())
    return attach(test, means, key)


def forecast_regression(df: DataFrame, key: list[str], ts: str, y: str, family: str = "ridge", covariates: list[str] | None = None,
                        frac: float = 0.8, tie: str | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(train, scored test) of one regression over lag features of all series; lags only look back."""
    from datascry.operators.models import regressor

    rows, names = series_features(df, key, ts, y, covariates, tie)
    split = chrono_split(rows, key, ts, frac, tie)
    ready = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(split)
    train, test = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    model = regressor(family, train.count(), label=y, **params).fit(train)
    return train.drop("features"), model.transform(test).drop("features")


def _per_series(df: DataFrame, key: list[str], ts: str, y: str, steps: int, kernel, long_series, bound: int | None = None) -> DataFrame:
    """One forecast per series: `kernel` on those of at most `bound` points (SERIES_POINTS), long_series(rows) on the others."""
    bound = SERIES_POINTS if bound is None else bound
    rows = df.select(*key, ts, F.col(y).cast("double").alias("__y")).filter("__y is not null")
    fields = [df.schema[k] for k in key]
    schema = T.StructType([*fields, T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType())])
    counts = rows.groupBy(*key).agg(F.count("*").alias("__points"))

    def told(frame: pd.DataFrame, values: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"step": np.arange(1, steps + 1, dtype="int32"), "forecast": values})
        for k in key:
            out[k] = frame[k].iloc[0]
        return out[[*key, "step", "forecast"]]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        return told(frame, kernel(frame.sort_values(ts)["__y"].to_numpy(dtype=float), steps))

    longest = counts.agg(F.max("__points")).first()[0] or 0
    if longest <= bound:
        return spread(rows, key).groupBy(*key).applyInPandas(fit, schema)
    sized = attach(rows, counts, key, "inner")
    short = sized.filter(F.col("__points") <= bound).drop("__points")
    summaries, finish = long_series(sized.filter(F.col("__points") > bound))
    merged = spread(summaries, key).groupBy(*key).applyInPandas(lambda frame: told(frame, finish(frame)), schema)
    return spread(short, key).groupBy(*key).applyInPandas(fit, schema).unionByName(merged)


def _ends(sign: int):
    """The ENDS values at one end of a series, as an aggregate over (__at, __y); the position tells their order."""
    near = F.col("__at") <= ENDS if sign > 0 else F.col("__at") > F.col("__points") - ENDS
    return F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("__at", "__y")))), lambda v: v["__y"])


def lag_matrix(x: np.ndarray, p: int) -> np.ndarray:
    return np.column_stack([np.ones(len(x) - p), *[x[p - i:len(x) - i] for i in range(1, p + 1)]])


def needs_difference(x: np.ndarray) -> bool:
    """Unit-root verdict without extra lags."""
    d, back = np.diff(x), x[:-1]
    if len(d) < 6 or np.ptp(x) == 0:
        return False
    z = np.column_stack([np.ones(len(d)), back, d])
    stat, _ = adf_fit(z.T @ z, 0, 0, len(d))
    return not stat < -2.86


def ar_forecast(x: np.ndarray, steps: int, max_order: int = 3) -> np.ndarray:
    """Autoregression by least squares, order by AIC, on first differences when the series has a unit root."""
    if len(x) < 4:
        return np.full(steps, x.mean() if len(x) else np.nan)
    differenced = needs_difference(x)
    z = np.diff(x) if differenced else x
    best = None
    top = min(max_order, max(1, (len(z) - 2) // 2))
    for p in range(1, top + 1):
        target = z[top:]
        a = lag_matrix(z, p)[top - p:]
        coef = np.linalg.lstsq(a, target, rcond=None)[0]
        rss = max(float(((target - a @ coef) ** 2).sum()), 1e-12)
        aic = len(target) * np.log(rss / len(target)) + 2 * (p + 1)
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    coef = np.linalg.lstsq(lag_matrix(z, p), z[p:], rcond=None)[0]
    history = list(z[-p:])
    out = []
    for _ in range(steps):
        nxt = coef[0] + sum(coef[i] * history[-i] for i in range(1, p + 1))
        history.append(nxt)
        out.append(nxt)
    return x[-1] + np.cumsum(out) if differenced else np.array(out)


def ar_summaries(rows: DataFrame, key: list[str], ts: str) -> DataFrame:
    """(key..., centre, points, flat, first, last, s_i_j): one row per series with the sums of products of 1, x and its lags, x centred.

    Products are summed in the tasks; a long series is cut into blocks whose edges carry the lags.
    """
    centred = attach(rows, rows.groupBy(*key).agg(F.avg("__y").alias("__centre")), key, "inner").withColumn("__y", F.col("__y") - F.col("__centre"))
    lags = {f"__l{i}": (lambda w, _, i=i: F.lag("__y", i).over(w)) for i in range(1, LAGS + 1)}
    wide = Sequence(centred, key, [ts, "__y"]).apply({"__at": lambda w, position: position, **lags}, before=LAGS)
    v = [F.lit(1.0), F.col("__y"), *[F.col(f"__l{i}") for i in range(1, LAGS + 1)]]
    whole = F.col(f"__l{LAGS}").isNotNull()
    sums = [F.coalesce(F.sum(F.when(whole, v[i] * v[j])), F.lit(0.0)).alias(f"s_{i}_{j}") for i in range(LAGS + 2) for j in range(i, LAGS + 2)]
    return wide.groupBy(*key).agg(F.first("__centre").alias("centre"), F.first("__points").alias("points"), (F.min("__y") == F.max("__y")).alias("flat"),
                                  _ends(1).alias("first"), _ends(-1).alias("last"), *sums)


def ar_from_summary(row, steps: int, max_order: int = 3) -> np.ndarray:
    """ar_forecast of a series of which only sums and ends are known."""
    n, size = int(row["points"]), LAGS + 2
    gram = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            gram[i, j] = gram[j, i] = row[f"s_{i}_{j}"]
    first, last = np.array(row["first"], dtype=float), np.array(row["last"], dtype=float)

    def products(turn: np.ndarray, start: int) -> np.ndarray:
        """Gram matrix of turn @ (1, x[t], ..., x[t - LAGS]) over t >= start; rows before LAGS come from the first values."""
        total = turn @ gram @ turn.T
        for t in range(start, LAGS):
            v = turn @ np.concatenate([[1.0], first[t::-1], np.zeros(LAGS - t)])
            total += np.outer(v, v)
        return total

    def pick(*rows) -> np.ndarray:
        out = np.zeros((len(rows), size))
        for i, places in enumerate(rows):
            for place, value in places.items():
                out[i, place] = value
        return out

    differenced = False
    if not row["flat"]:
        stat, _ = adf_fit(products(pick({0: 1}, {2: 1}, {1: 1, 2: -1}), 1), 0, 0, n - 1)
        differenced = not stat < -2.86
    value = (lambda i: {1 + i: 1, 2 + i: -1}) if differenced else (lambda i: {1 + i: 1})
    behind = int(differenced)
    best = None
    for p in range(1, max_order + 1):
        g = products(pick({0: 1}, *[value(i) for i in range(1, p + 1)], value(0)), max_order + behind)
        coef = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
        m = n - max_order - behind
        rss = max(float(g[-1, -1] - 2 * coef @ g[:-1, -1] + coef @ g[:-1, :-1] @ coef), 1e-12)
        aic = m * np.log(rss / m) + 2 * (p + 1)
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    g = products(pick({0: 1}, *[value(i) for i in range(1, p + 1)], value(0)), p + behind)
    coef = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    history = list((np.diff(last) if differenced else last)[-p:])
    out = []
    for _ in range(steps):
        history.append(coef[0] + sum(coef[i] * history[-i] for i in range(1, p + 1)))
        out.append(history[-1])
    return row["centre"] + (last[-1] + np.cumsum(out) if differenced else np.array(out))


def smooth(x: np.ndarray, season: int, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray):
    """One pass of additive smoothing for several weights at once: (squared errors, levels, trends, phases x weights)."""
    many = np.ones(len(alpha))
    if season:
        start, cycle = x[:season].mean(), x[season:2 * season]
        level, trend = start * many, ((cycle.mean() - start) / season if len(cycle) == season else 0.0) * many
        phase = (x[:season] - start)[:, None] * many
    else:
        level, trend, phase = x[0] * many, (x[1] - x[0] if len(x) > 1 else 0.0) * many, np.zeros((1, len(many)))
    error = np.zeros(len(many))
    width = len(phase)
    for t in range(season or 1, len(x)):
        s = phase[t % width].copy()
        miss = x[t] - (level + trend + s)
        error += miss * miss
        before = level
        level = alpha * (x[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        if season:
            phase[t % width] = gamma * (x[t] - level) + (1 - gamma) * s
    return error, level, trend, phase


def holt_winters(x: np.ndarray, steps: int, season: int = SEASON) -> np.ndarray:
    """Additive trend and season; short series use a season of 2, very short ones trend only."""
    if len(x) < 2:
        return np.full(steps, x[0] if len(x) else np.nan)
    if len(x) <= 2 * season:
        season = 2
    if len(x) < 2 * season + 1:
        season = 0
    weights = smoothing_weights(season)
    error, level, trend, phase = smooth(x, season, *weights.T)
    best = int(np.argmin(error))
    ahead = [phase[(len(x) + h) % len(phase), best] if season else 0.0 for h in range(steps)]
    return np.array([level[best] + (h + 1) * trend[best] + ahead[h] for h in range(steps)])


def smoothing_weights(season: int) -> np.ndarray:
    return np.array(list(itertools.product((0.1, 0.3, 0.5, 0.8), (0.01, 0.1, 0.3), (0.05, 0.2, 0.5) if season else (0.0,))))


def smooth_block(x: np.ndarray, start: int, season: int) -> tuple[np.ndarray, np.ndarray]:
    """What points start, start + 1, ... do to the state, for each weight: (affine maps, quadratic forms of the squared errors).

    The state (level, trend, phases) after a step is affine in the one before, and so is the error. Running the zero state and every unit
    state side by side gives the map of the block; sums of products of their errors give the squared error of any state it starts from.
    """
    alpha, beta, gamma = (w[:, None] for w in smoothing_weights(season).T)
    width = max(season, 1)
    size = 3 + width
    level, trend, phase = np.zeros((len(alpha), size)), np.zeros((len(alpha), size)), np.zeros((width, len(alpha), size))
    level[:, 1], trend[:, 2] = 1, 1
    for j in range(width):
        phase[j, :, 3 + j] = 1
    form = np.zeros((len(alpha), size, size))
    for t, value in enumerate(x, start):
        s = phase[t % width].copy()
        miss = -(level + trend + s)
        miss[:, 0] += value
        form += miss[:, :, None] * miss[:, None, :]
        before, rest = level, -s
        rest[:, 0] += value
        level = alpha * rest + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        if season:
            left = -level
            left[:, 0] += value
            phase[t % width] = gamma * left + (1 - gamma) * s
    return np.stack([level, trend, *phase], axis=1), form


def smoothing_summaries(rows: DataFrame, key: list[str], ts: str, season: int, size: int) -> DataFrame:
    """(key..., block, points, first, map, form): one row per block of `size` points of each series."""
    numbered = Sequence(rows, key, [ts, "__y"]).numbered("__at")
    blocks = numbered.withColumn("__block", F.floor((F.col("__at") - 1) / size).cast("long"))
    schema = T.StructType([rows.schema[k] for k in key] + [T.StructField("__block", T.LongType()), T.StructField("points", T.LongType())]
                          + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("first", "map", "form")])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__at")
        values, start = frame["__y"].to_numpy(dtype=float), int(frame["__at"].iloc[0]) - 1
        first = values[:2 * max(season, 1)] if start == 0 else values[:0]
        skip = (season or 1) if start == 0 else 0  # these points make the first state
        map_, form = smooth_block(values[skip:], start + skip, season)
        out = pd.DataFrame({"__block": [int(frame["__block"].iloc[0])], "points": [int(frame["__points"].iloc[0])], "first": [first], "map": [map_.ravel()], "form": [form.ravel()]})
        for k in key:
            out[k] = frame[k].iloc[0]
        return out[[*key, "__block", "points", "first", "map", "form"]]

    return spread(blocks, [*key, "__block"]).groupBy(*key, "__block").applyInPandas(run, schema)


def smoothed_from_blocks(frame: pd.DataFrame, steps: int, season: int) -> np.ndarray:
    """holt_winters of a series from its blocks in order: each maps the state on and adds its squared errors."""
    frame = frame.sort_values("__block")
    first, n = np.asarray(frame["first"].iloc[0], dtype=float), int(frame["points"].iloc[0])
    width, many = max(season, 1), len(smoothing_weights(season))
    if season:
        start, cycle = first[:season].mean(), first[season:2 * season]
        begin = np.concatenate([[1.0, start, (cycle.mean() - start) / season], first[:season] - start])
    else:
        begin = np.array([1.0, first[0], first[1] - first[0], 0.0])
    state, error = np.tile(begin, (many, 1)), np.zeros(many)
    for map_, form in zip(frame["map"], frame["form"]):
        error += np.einsum("wi,wij,wj->w", state, np.reshape(form, (many, 3 + width, 3 + width)), state)
        state[:, 1:] = np.einsum("wij,wj->wi", np.reshape(map_, (many, 2 + width, 3 + width)), state)
    best = state[int(np.argmin(error))]
    return np.array([best[1] + (h + 1) * best[2] + (best[3 + (n + h) % width] if season else 0.0) for h in range(steps)])


def forecast_ar_per_series(df: DataFrame, key: list[str], ts: str, y: str, steps: int = 3) -> DataFrame:
    """(key..., step, forecast): one autoregression per series, many series in parallel; long ones from sums of lag products."""
    return _per_series(df, key, ts, y, steps, ar_forecast,
                       lambda rows: (ar_summaries(rows, key, ts), lambda frame: ar_from_summary(frame.iloc[0], steps)))


def forecast_holt_winters(df: DataFrame, key: list[str], ts: str, y: str, steps: int = 3, season: int = SEASON) -> DataFrame:
    """(key..., step, forecast): one smoothed model per series; long ones from blocks whose state maps are composed."""
    size = max(SERIES_POINTS, 2 * season + 1)  # the first block holds two whole seasons
    return _per_series(df, key, ts, y, steps, lambda x, n: holt_winters(x, n, season),
                       lambda rows: (smoothing_summaries(rows, key, ts, season, size), lambda frame: smoothed_from_blocks(frame, steps, season)), size)
