"""Time-series operators per series key. Ordered work goes through Sequence, so a hot series never sits in one task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import TEMPORAL, epoch_seconds, numeric_columns, to_datetime
from datascry.operators.keys import attach
from datascry.operators.ordered import Sequence
from datascry.operators.profile import SERIES_NAMES, long_rows

LAGS = (1, 2, 3, 7)
COVARIATE_LAGS = (1, 3)
RENDER_POINTS = 1500
HISTORY_POINTS = 200


def _order(ts: str, tie: str | None) -> list[str]:
    return [ts] + ([tie] if tie else [])


def time_column(df: DataFrame) -> str | None:
    """A column named like a time, else the first text column of which more than half parses."""
    for c in df.columns:
        if any(k in c.lower() for k in SERIES_NAMES) or isinstance(df.schema[c].dataType, TEMPORAL):
            return c
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    shares = long_rows(df, [], [F.struct(F.lit(c).alias("column"), F.lit(i).alias("at"),
                                         F.avg(F.when(F.col(c).isNotNull(), to_datetime(c).isNotNull().cast("int"))).alias("share"))
                                for i, c in enumerate(texts)])
    best = shares.filter(F.col("share") > 0.5).orderBy("at").first()
    return best["column"] if best else None


def ts_prepare(df: DataFrame, ts: str | None = None) -> DataFrame:
    """Rows whose time parses, with the time column as a timestamp. Order is left to the window operators."""
    ts = ts or time_column(df)
    if ts is None:
        raise ValueError("no time column found")
    if not isinstance(df.schema[ts].dataType, TEMPORAL):
        df = df.withColumn(ts, to_datetime(ts))
    return df.filter(F.col(ts).isNotNull())


def daily_series(df: DataFrame, ts: str, y: str, key: list[str], how: str = "sum") -> DataFrame:
    """One row per key and day, pre-aggregated: (key..., day, y, rows). Bounds a series by the calendar."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return df.groupBy(*key, F.col(ts).cast("date").alias("day")).agg(agg(y).alias(y), F.count("*").alias("rows"))


def lag_features(df: DataFrame, key: list[str], ts: str, y: str, lags=LAGS, tie: str | None = None, limit: int | None = None) -> DataFrame:
    new = {f"{y}_lag_{k}": (lambda w, rn, k=k: F.lag(y, k).over(w)) for k in lags}
    return Sequence(df, key, _order(ts, tie), limit).apply(new, before=max(lags))


def rolling_mean(df: DataFrame, key: list[str], ts: str, y: str, k: int, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """Mean of the k previous values, null until there are k."""
    def mean(w, rn):
        frame = w.rowsBetween(-k, -1)
        return F.when(F.count(y).over(frame) == k, F.avg(y).over(frame))

    return Sequence(df, key, _order(ts, tie), limit).apply({f"{y}_roll_{k}": mean}, before=k)


def covariate_lags(df: DataFrame, key: list[str], ts: str, cols: list[str], lags=COVARIATE_LAGS, tie: str | None = None,
                   limit: int | None = None) -> DataFrame:
    new = {f"{c}_lag_{k}": (lambda w, rn, c=c, k=k: F.lag(c, k).over(w)) for c in cols for k in lags}
    return Sequence(df, key, _order(ts, tie), limit).apply(new, before=max(lags))


def rolling_std(df: DataFrame, key: list[str], ts: str, y: str, k: int = 7, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """Sample deviation of the last k values including the current one; 0 for a single value."""
    def std(w, rn):
        return F.coalesce(F.stddev_samp(y).over(w.rowsBetween(1 - k, 0)), F.lit(0.0))

    return Sequence(df, key, _order(ts, tie), limit).apply({f"{y}_std_{k}": std}, before=k - 1)


def fill_directional(df: DataFrame, key: list[str], ts: str, c: str, order: str = "bf", fallback=0, tie: str | None = None,
                     limit: int | None = None) -> DataFrame:
    """Nearest known value: 'bf' takes the following one first, 'fb' the preceding one; `fallback` where there is none."""
    rows = Sequence(df, key, _order(ts, tie), limit).neighbours(c, "__f")
    first, second = ("__f_next", "__f_prev") if order == "bf" else ("__f_prev", "__f_next")
    dtype = df.schema[c].dataType
    filled = F.coalesce(F.col(first), F.col(second), F.lit(fallback).cast(dtype) if fallback is not None else F.lit(None).cast(dtype))
    return rows.withColumn(c, filled).select(*df.columns)


def interpolate_linear(df: DataFrame, key: list[str], ts: str, c: str, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """Linear by row position between known values, nearest known value at the ends, 0 where all are missing."""
    rows = Sequence(df, key, _order(ts, tie), limit).neighbours(c, "__i")
    step = F.col("__i_next_at") - F.col("__i_prev_at")
    line = F.col("__i_prev") + (F.col("__i_next") - F.col("__i_prev")) * (F.col("__i_at") - F.col("__i_prev_at")) / step
    value = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(step > 0, line).otherwise(
        F.coalesce(F.col("__i_prev"), F.col("__i_next"), F.lit(0.0)))
    return rows.withColumn(c, value).select(*df.columns)


def chrono_split(df: DataFrame, key: list[str], ts: str, frac: float = 0.8, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """`split` = train for the first floor(frac * n) rows of each series, test for the rest."""
    rows = Sequence(df, key, _order(ts, tie), limit).numbered("__at")
    if not key:
        return rows.withColumn("split", F.when(F.col("__at") <= math.floor(frac * df.count()), "train").otherwise("test")).drop("__at")
    sizes = df.groupBy(*key).agg(F.count("*").alias("__n"))
    both = attach(rows, sizes, key)
    return both.withColumn("split", F.when(F.col("__at") <= F.floor(F.lit(frac) * F.col("__n")), "train").otherwise("test")).drop("__at", "__n")


def acf(df: DataFrame, key: list[str], ts: str, y: str, nlags: int = 20, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """Autocorrelation with the biased estimator: (key..., lag, n, acf) for lags 0..nlags."""
    means = df.groupBy(*key).agg(F.avg(y).alias("__mean"))
    rows = df.select(*key, *dict.fromkeys(_order(ts, tie)), F.col(y).cast("double").alias("__y"))
    centred = attach(rows, means, key).withColumn("__d", F.col("__y") - F.col("__mean")).drop("__y", "__mean")
    new = {f"__p{k}": (lambda w, rn, k=k: F.col("__d") * F.lag("__d", k).over(w)) for k in range(1, nlags + 1)}
    lagged = Sequence(centred, key, _order(ts, tie), limit).apply(new, before=nlags)
    sums = lagged.groupBy(*key).agg(F.count("__d").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("p0"),
                                    *[F.sum(f"__p{k}").alias(f"p{k}") for k in range(1, nlags + 1)])
    points = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"p{k}"), F.lit(0.0)).alias("s")) for k in range(nlags + 1)])
    long = sums.select(*key, "n", "p0", F.inline(points))
    return long.select(*key, "lag", "n", F.when(F.col("p0") > 0, F.col("s") / F.col("p0")).alias("acf"))


def pacf(df: DataFrame, key: list[str], ts: str, y: str, nlags: int = 20, tie: str | None = None, limit: int | None = None) -> DataFrame:
    """Partial autocorrelation from the adjusted Yule-Walker equations: (key..., lag, pacf) for lags 1..nlags."""
    table = acf(df, key, ts, y, nlags, tie, limit)
    schema = T.StructType([table.schema[k] for k in key] + [T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lag")
        n = int(frame["n"].iloc[0])
        r = np.array([a * n / (n - k) if n > k and a is not None else np.nan for k, a in zip(frame["lag"], frame["acf"])], dtype=float)
        out = []
        for k in range(1, len(r)):
            toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            ok = np.isfinite(toeplitz).all() and np.isfinite(r[1:k + 1]).all()
            out.append(float(np.linalg.lstsq(toeplitz, r[1:k + 1], rcond=None)[0][-1]) if ok else None)
        res = pd.DataFrame({"lag": np.arange(1, len(r), dtype="int32"), "pacf": out})
        for k in key:
            res[k] = frame[k].iloc[0]
        return res[[*key, "lag", "pacf"]]

    # One group is the nlags + 1 numbers of one series.
    return table.groupBy(*key).applyInPandas(solve, schema)


# Response surface of the critical values (constant, one series) at 1, 5 and 10 percent.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf_fit(gram: np.ndarray, lags: int, width: int, nobs: int) -> tuple[float, float]:
    """(t statistic, AIC) of the regression on [1, y_-1, d_-1..d_-lags] from a matrix of products.

    Columns of `gram`: 1, y_-1, d_-1 .. d_-width, d.
    """
    use, last = list(range(2 + lags)), width + 2
    a, b, yy = gram[np.ix_(use, use)], gram[use, last], gram[last, last]
    inverse = np.linalg.pinv(a)
    coef = inverse @ b
    rss = max(float(yy - coef @ b), 1e-300)
    free = nobs - len(use)
    if free <= 0:
        return float("nan"), float("inf")
    t = coef[1] / math.sqrt(max(rss / free * inverse[1, 1], 1e-300))
    llf = -nobs / 2 * (math.log(2 * math.pi) + math.log(rss / nobs) + 1)
    return float(t), 2 * len(use) - 2 * llf


def adf_test(df: DataFrame, key: list[str], ts: str, y: str, max_lag: int | None = None, tie: str | None = None,
             limit: int | None = None) -> DataFrame:
    """Unit-root test with a constant, lag count by AIC: (key..., n, lags, stat, crit_1, crit_5, crit_10, stationary).

    Only sums of products per series leave the rows; the small regressions run on those.
    """
    rows = df.select(*key, *dict.fromkeys(_order(ts, tie)), F.col(y).cast("double").alias("__y")).filter("__y is not null")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    if max_lag is None:
        longest = sizes.agg(F.max("__n")).first()[0] or 0
        max_lag = max(0, min(math.ceil(12 * (longest / 100) ** 0.25), int(longest) // 2 - 2))
    new = {"__x1": lambda w, rn: F.lag("__y", 1).over(w), "__at": lambda w, rn: rn,
           "__d": lambda w, rn: F.col("__y") - F.lag("__y", 1).over(w)}
    for k in range(1, max_lag + 1):
        new[f"__d{k}"] = lambda w, rn, k=k: F.lag("__y", k).over(w) - F.lag("__y", k + 1).over(w)
    lagged = attach(Sequence(rows, key, _order(ts, tie), limit).apply(new, before=max_lag + 1), sizes, key)
    # A short series tries fewer lags than the longest one.
    own = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("__n") / 100, 0.25)), F.floor(F.col("__n") / 2) - 2, F.lit(max_lag)))
    lagged = lagged.withColumn("__own", own.cast("int"))
    names = ["__one", "__x1", *[f"__d{k}" for k in range(1, max_lag + 1)], "__d"]
    width, size = max_lag, len(names)

    fields = [df.schema[k] for k in key]
    upper = np.triu_indices(size)
    part_schema = T.StructType(fields + [T.StructField("n", T.LongType()), T.StructField("own", T.IntegerType()),
                                         T.StructField("nobs", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def partial(frames):
        """Sums of products per series within a batch, so only matrices are shuffled."""
        for frame in frames:
            frame = frame.assign(__one=1.0)
            groups = frame.groupby(key, dropna=False, sort=False) if key else [((), frame)]
            for values, rows in groups:
                z = np.nan_to_num(rows[names].to_numpy(dtype=float))
                out = pd.DataFrame({"n": int(rows["__n"].max()), "own": np.int32(rows["__own"].max()), "nobs": len(rows),
                                    "cell": np.arange(len(upper[0]), dtype="int32"), "v": (z.T @ z)[upper]})
                for k, value in zip(key, values if isinstance(values, tuple) else (values,)):
                    out[k] = value
                yield out[[*key, "n", "own", "nobs", "cell", "v"]]

    def products(frame: DataFrame) -> DataFrame:
        parts = frame.mapInPandas(partial, part_schema)
        return parts.groupBy(*key, "cell").agg(F.max("n").alias("n"), F.max("own").alias("own"), F.sum("nobs").alias("nobs"), F.sum("v").alias("v"))

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        m = np.zeros((size, size))
        m[upper] = frame.sort_values("cell")["v"].to_numpy()
        return m + np.triu(m, 1).T

    chosen_schema = T.StructType(fields + [T.StructField("__lags", T.IntegerType())])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        gram, nobs, own = matrix(frame), int(frame["nobs"].iloc[0]), int(frame["own"].iloc[0])
        scores = [adf_fit(gram, p, width, nobs)[1] for p in range(own + 1)]
        return frame[key].head(1).assign(__lags=np.int32(int(np.argmin(scores))))

    # All candidate lag counts are compared on the rows that have every lag.
    chosen = products(lagged.filter(F.col("__at") > F.col("__own") + 1)).groupBy(*key).applyInPandas(choose, chosen_schema)
    final = attach(lagged, chosen, key, "inner").filter(F.col("__at") > F.col("__lags") + 1).withColumn("__own", F.col("__lags"))
    schema = T.StructType(fields + [T.StructField("n", T.LongType()), T.StructField("lags", T.IntegerType()), T.StructField("stat", T.DoubleType()),
                                    *[T.StructField(c, T.DoubleType()) for c in CRITICAL], T.StructField("stationary", T.BooleanType())])

    def verdict(frame: pd.DataFrame) -> pd.DataFrame:
        nobs, lags = int(frame["nobs"].iloc[0]), int(frame["own"].iloc[0])
        stat, _ = adf_fit(matrix(frame), lags, width, nobs)
        crit = {c: b[0] + b[1] / nobs + b[2] / nobs**2 + b[3] / nobs**3 for c, b in CRITICAL.items()}
        return frame[key].head(1).assign(n=int(frame["n"].iloc[0]), lags=np.int32(lags), stat=stat, **crit, stationary=bool(stat < crit["crit_5"]))

    return products(final).groupBy(*key).applyInPandas(verdict, schema)


def seasonal_decompose(df: DataFrame, key: list[str], ts: str, y: str, period: int = 7, tie: str | None = None,
                       limit: int | None = None) -> DataFrame:
    """Adds trend (centred mean), seasonal (mean of the detrended values per phase, centred) and resid; edges are null."""
    half = period // 2
    x = F.col(y).cast("double")

    def trend(w, rn):
        frame = w.rowsBetween(-half, half)
        full = F.count(x).over(frame) == 2 * half + 1
        if period % 2:
            return F.when(full, F.avg(x).over(frame))
        ends = (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2
        return F.when(full, (F.sum(x).over(w.rowsBetween(1 - half, half - 1)) + ends) / period)

    rows = Sequence(df, key, _order(ts, tie), limit).apply(
        {"trend": trend, "__phase": lambda w, rn: (rn - 1) % period}, before=half, after=half)
    phases = rows.groupBy(*key, "__phase").agg(F.avg(x - F.col("trend")).alias("__m"))
    if key:
        centred = attach(phases, phases.groupBy(*key).agg(F.avg("__m").alias("__c")), key)
    else:
        centred = phases.withColumn("__c", phases.agg(F.avg("__m")).scalar())
    centred = centred.select(*key, "__phase", (F.col("__m") - F.col("__c")).alias("seasonal"))
    both = attach(rows, centred, key + ["__phase"])
    return both.withColumn("resid", x - F.col("trend") - F.col("seasonal")).drop("__phase")


def residuals_over_time(scored: DataFrame, ts: str, y: str, prediction: str = "prediction", key: list[str] | None = None) -> DataFrame:
    return scored.select(*(key or []), ts, (F.col(y) - F.col(prediction)).alias("residual"))


def forecast_points(train: DataFrame, scored: DataFrame, key: list[str], ts: str, y: str, prediction: str = "prediction",
                    history: int = HISTORY_POINTS, tie: str | None = None) -> DataFrame:
    """Chart rows: the last training points as Historical, then Actual and Forecast per test time."""
    order = [F.desc(c) for c in _order(ts, tie)]
    w = Window.partitionBy(*key).orderBy(*order)
    recent = train.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") <= history)

    def points(df, value, series):
        dtype = df.schema[ts].dataType
        return df.select(*key, F.col(ts).cast("string").alias("x_val"), epoch_seconds(ts, dtype).cast("double").alias("x_num"),
                         F.col(value).cast("double").alias("y"), F.lit(series).alias("series"))

    return points(recent, y, "Historical").unionByName(points(scored, y, "Actual")).unionByName(points(scored, prediction, "Forecast"))


def multi_target(df: DataFrame, ids: list[str], targets: list[str]) -> DataFrame:
    """One row per target and original row: (ids..., target, value); `target` joins the series key."""
    doubles = df.select(*ids, *[F.col(t).cast("double").alias(t) for t in targets])
    return doubles.unpivot(ids, targets, "target", "value")


def decimate_even(points: DataFrame, key: list[str], order: list[str], m: int = RENDER_POINTS, limit: int | None = None) -> DataFrame:
    """At most m evenly spaced rows per series, first and last kept: positions floor(i * (n - 1) / (m - 1))."""
    rows = Sequence(points, key, order, limit).numbered("__at")
    if key:
        rows = attach(rows, points.groupBy(*key).agg(F.count("*").alias("__n")), key)
    else:
        rows = rows.withColumn("__n", F.lit(points.count()))
    at, last = F.col("__at") - 1, F.col("__n") - 1
    # The smallest i whose position is not before this row must land exactly on it.
    i = F.expr(f"((__at - 1) * {m - 1} + __n - 2) div (__n - 1)")
    landed = (i <= m - 1) & (F.floor(i * last / (m - 1)) == at)
    kept = rows.filter(F.when(F.col("__n") <= m, F.lit(True)).otherwise(landed))
    return kept.select(*points.columns)


def run_version(runs: DataFrame, dataset: str = "dataset", ts: str = "ts", run: str = "run", limit: int | None = None) -> DataFrame:
    """Version number of every run inside its dataset, by time."""
    return Sequence(runs, [dataset], [ts, run], limit).numbered("version")


def series_features(df: DataFrame, key: list[str], ts: str, y: str, covariates: list[str] | None = None, tie: str | None = None,
                    limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Lags, rolling means and covariate lags in one pass, nulls at a series' start as 0: (frame, feature names)."""
    covariates = [c for c in (covariates if covariates is not None else numeric_columns(df)) if c not in (y, *key, ts, tie)]
    new = {f"{y}_lag_{k}": (lambda w, rn, k=k: F.lag(y, k).over(w)) for k in LAGS}
    for k in (3, 7):
        new[f"{y}_roll_{k}"] = lambda w, rn, k=k: F.when(F.count(y).over(w.rowsBetween(-k, -1)) == k, F.avg(y).over(w.rowsBetween(-k, -1)))
    for c in covariates:
        for k in COVARIATE_LAGS:
            new[f"{c}_lag_{k}"] = lambda w, rn, c=c, k=k: F.lag(c, k).over(w)
    rows = Sequence(df, key, _order(ts, tie), limit).apply(new, before=max(LAGS))
    return rows.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in new}), list(new)
