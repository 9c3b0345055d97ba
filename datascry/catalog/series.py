"""Time-series queries on events (per event type or user) and daily orders."""

from datascry.catalog import query
from datascry.operators import forecast as fc
from datascry.operators import timeseries as ts

from pyspark.sql import functions as F

KEY, ORDER = ["event_type"], {"ts": "ts", "tie": "event_id"}
W = "(partition by event_type order by ts, event_id"
HOLED = "(select event_id, event_type, ts, case when event_id % 7 in (2, 3) or event_type = 'error' then null else value end as v from events)"
DAILY = "(select o_orderpriority, o_orderdate::date as day, round(sum(o_totalprice), 2) as y, count(*) as rows from orders group by 1, 2)"


def holed(t):
    v = F.when((F.col("event_id") % 7).isin(2, 3) | (F.col("event_type") == "error"), None).otherwise(F.col("value"))
    return t.events.select("event_id", "event_type", "ts", v.alias("v"))


def daily(t, key=("o_orderpriority",)):
    return ts.daily_series(t.orders, "o_orderdate", "o_totalprice", list(key)).withColumn("y", F.round("o_totalprice", 2)).drop("o_totalprice")


@query("ts_prepare", """select o_orderkey, d::timestamp as order_time from (select o_orderkey, case when o_orderstatus = 'P' then 'later' else strftime(o_orderdate, '%Y-%m-%d') end as d from orders)
       where try_cast(d as timestamp) is not null""")
def _(t):
    text = F.when(F.col("o_orderstatus") == "P", "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    out = ts.ts_prepare(t.orders.select("o_orderkey", text.alias("order_time")))
    return out.withColumn("order_time", F.col("order_time").cast("timestamp_ntz"))


@query("daily_series", f"select o_orderpriority, day, y, rows from {DAILY}")
def _(t):
    return daily(t)


@query("lag_features", f"""select event_id, {', '.join(f'lag(value, {k}) over {W}) as value_lag_{k}' for k in ts.LAGS)} from events""")
def _(t):
    out = ts.lag_features(t.events, KEY, "ts", "value", tie="event_id")
    return out.select("event_id", *[f"value_lag_{k}" for k in ts.LAGS])


@query("lag_features_blocked", f"""select event_id, {', '.join(f'lag(value, {k}) over (order by ts, event_id) as value_lag_{k}' for k in ts.LAGS)} from events""")
def _(t):
    out = ts.lag_features(t.events, [], "ts", "value", tie="event_id", limit=2000)
    return out.select("event_id", *[f"value_lag_{k}" for k in ts.LAGS])


@query("rolling_mean", f"""select event_id, case when count(value) over {W} rows between 3 preceding and 1 preceding) = 3 then round(avg(value) over {W} rows between 3 preceding and 1 preceding), 6) end as value_roll_3,
       case when count(value) over {W} rows between 7 preceding and 1 preceding) = 7 then round(avg(value) over {W} rows between 7 preceding and 1 preceding), 6) end as value_roll_7 from events""")
def _(t):
    three = ts.rolling_mean(t.events, KEY, "ts", "value", 3, tie="event_id")
    both = ts.rolling_mean(three, KEY, "ts", "value", 7, tie="event_id")
    return both.select("event_id", F.round("value_roll_3", 6).alias("value_roll_3"), F.round("value_roll_7", 6).alias("value_roll_7"))


@query("covariate_lags", f"""select event_id, lag(value, 1) over {W}) as value_lag_1, lag(value, 3) over {W}) as value_lag_3, lag(user_id, 1) over {W}) as user_id_lag_1,
       lag(user_id, 3) over {W}) as user_id_lag_3 from events""")
def _(t):
    out = ts.covariate_lags(t.events, KEY, "ts", ["value", "user_id"], tie="event_id")
    return out.select("event_id", "value_lag_1", "value_lag_3", "user_id_lag_1", "user_id_lag_3")


NEXT = f"first_value(v ignore nulls) over {W} rows between current row and unbounded following)"
PREV = f"last_value(v ignore nulls) over {W} rows between unbounded preceding and current row)"


@query("fill_directional", f"""select event_id, coalesce({NEXT}, {PREV}, 0) as back_first, coalesce({PREV}, {NEXT}) as forward_first from {HOLED}""")
def _(t):
    rows = holed(t).withColumns({"back_first": F.col("v"), "forward_first": F.col("v")})
    a = ts.fill_directional(rows, KEY, "ts", "back_first", "bf", tie="event_id")
    return ts.fill_directional(a, KEY, "ts", "forward_first", "fb", None, tie="event_id").select("event_id", "back_first", "forward_first")


INTERPOLATED = """with r as (select *, row_number() over {w}) as rn from {rows}),
  n as (select *, {prev} as p, {next} as q, last_value(case when v is not null then rn end ignore nulls) over {w} rows between unbounded preceding and current row) as pr,
    first_value(case when v is not null then rn end ignore nulls) over {w} rows between current row and unbounded following) as qr from r)
  select event_id, round(case when v is not null then v when pr is not null and qr is not null then p + (q - p) * (rn - pr) / (qr - pr) else coalesce(p, q, 0) end, 6) as v from n"""


@query("interpolate_linear", INTERPOLATED.format(w=W, rows=HOLED, prev=PREV, next=NEXT))
def _(t):
    out = ts.interpolate_linear(holed(t), KEY, "ts", "v", tie="event_id")
    return out.select("event_id", F.round("v", 6).alias("v"))


GLOBAL = "(order by ts, event_id"


@query("interpolate_linear_blocked", INTERPOLATED.format(w=GLOBAL, rows=HOLED, prev=PREV.replace(W, GLOBAL), next=NEXT.replace(W, GLOBAL)))
def _(t):
    out = ts.interpolate_linear(holed(t), [], "ts", "v", tie="event_id", limit=2000)
    return out.select("event_id", F.round("v", 6).alias("v"))


@query("rolling_std", f"""select event_id, round(coalesce(stddev_samp(value) over {W} rows between 6 preceding and current row), 0), 5) as value_std_7 from events""")
def _(t):
    out = ts.rolling_std(t.events, KEY, "ts", "value", tie="event_id")
    return out.select("event_id", F.round("value_std_7", 5).alias("value_std_7"))


@query("chrono_split", f"""select event_id, case when row_number() over {W}) <= floor(0.8 * count(*) over (partition by event_type)) then 'train' else 'test' end as split from events""")
def _(t):
    return ts.chrono_split(t.events, KEY, "ts", tie="event_id").select("event_id", "split")


ACF = f"""(with m as (select *, y - avg(y) over (partition by o_orderpriority) as d, row_number() over (partition by o_orderpriority order by day) as rn from {DAILY}),
  k as (select unnest(range(21)) as lag),
  s as (select a.o_orderpriority, k.lag, sum(a.d * b.d) as s from m a join k on true join m b on b.o_orderpriority = a.o_orderpriority and b.rn = a.rn - k.lag group by 1, 2),
  z as (select o_orderpriority, sum(d * d) as s0, count(*) as n from m group by 1)
  select o_orderpriority, lag::int as lag, n, s / s0 as acf from s join z using (o_orderpriority))"""


@query("acf", f"select o_orderpriority, lag, n, round(acf, 6) as acf from {ACF}")
def _(t):
    return ts.acf(daily(t), ["o_orderpriority"], "day", "y").withColumn("acf", F.round("acf", 6))


@query("pacf", f"""with r as (select o_orderpriority, lag, acf * n / (n - lag) as r from {ACF}), p as (select o_orderpriority, max(r) filter (lag = 1) as r1, max(r) filter (lag = 2) as r2 from r group by 1)
       select o_orderpriority, 1 as lag, round(r1, 5) as pacf from p union all select o_orderpriority, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 5) from p""")
def _(t):
    return ts.pacf(daily(t), ["o_orderpriority"], "day", "y", nlags=2).withColumn("pacf", F.round("pacf", 5))


@query("adf_test")
def _(t):
    return ts.adf_test(daily(t), ["o_orderpriority"], "day", "y")


@query("seasonal_decompose", f"""with r as (select *, row_number() over w as rn, count(*) over (partition by o_orderpriority) as n, avg(y) over (w rows between 3 preceding and 3 following) as m from {DAILY} window w as (partition by o_orderpriority order by day)),
       d as (select *, case when rn > 3 and rn <= n - 3 then m end as trend from r), p as (select o_orderpriority, (rn - 1) % 7 as ph, avg(y - trend) as s from d group by 1, 2),
       c as (select o_orderpriority, ph, s - avg(s) over (partition by o_orderpriority) as seasonal from p)
       select d.o_orderpriority, d.day, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(y - trend - seasonal, 4) as resid
       from d join c on c.o_orderpriority = d.o_orderpriority and c.ph = (d.rn - 1) % 7""")
def _(t):
    out = ts.seasonal_decompose(daily(t), ["o_orderpriority"], "day", "y")
    return out.select("o_orderpriority", "day", *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "resid")])


SPLIT = f"(select *, case when row_number() over {W}) <= floor(0.8 * count(*) over (partition by event_type)) then 'train' else 'test' end as split from events)"
NAIVE = f"(select t.*, m.prediction from {SPLIT} t join (select event_type, avg(value) as prediction from {SPLIT} where split = 'train' group by 1) m using (event_type) where split = 'test')"


def naive(t):
    rows = ts.chrono_split(t.events, KEY, "ts", tie="event_id")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return train, fc.forecast_naive(train, test, KEY, "value")


@query("forecast_naive", f"select event_id, round(prediction, 6) as prediction from {NAIVE}")
def _(t):
    return naive(t)[1].select("event_id", F.round("prediction", 6).alias("prediction"))


@query("residuals_over_time", f"select event_type, ts, round(value - prediction, 6) as residual from {NAIVE}")
def _(t):
    return ts.residuals_over_time(naive(t)[1], "ts", "value", key=KEY).withColumn("residual", F.round("residual", 6))


@query("forecast_points", f"""select event_type, floor(epoch(ts))::double as x_num, round(value, 4) as y, 'Historical' as series from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rk from {SPLIT} where split = 'train') where rk <= 200
       union all select event_type, floor(epoch(ts))::double, round(value, 4), 'Actual' from {NAIVE} union all select event_type, floor(epoch(ts))::double, round(prediction, 4), 'Forecast' from {NAIVE}""")
def _(t):
    train, scored = naive(t)
    out = ts.forecast_points(train, scored, KEY, "ts", "value", tie="event_id")
    return out.select("event_type", "x_num", F.round("y", 4).alias("y"), "series")


@query("multi_target", f"""with u as (select event_id, event_type, ts, 'value' as target, value::double as value from events union all select event_id, event_type, ts, 'user_id', user_id::double from events)
       select event_id, target, value, lag(value, 1) over (partition by event_type, target order by ts, event_id) as value_lag_1 from u""")
def _(t):
    rows = ts.multi_target(t.events, ["event_id", "event_type", "ts"], ["value", "user_id"])
    out = ts.lag_features(rows, ["event_type", "target"], "ts", "value", lags=[1], tie="event_id")
    return out.select("event_id", "target", "value", "value_lag_1")


def regression_metrics(scored, y):
    from datascry.operators.evaluate import metrics_regression

    return metrics_regression(scored, y, "prediction")


@query("forecast_regression")
def _(t):
    out = None
    for family in ("linear", "ridge", "lasso", "random_forest", "boosted"):
        scored = fc.forecast_regression(daily(t), ["o_orderpriority"], "day", "y", family)[1]
        one = regression_metrics(scored, "y").select(F.lit(family).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("forecast_ar_per_series")
def _(t):
    users = ts.daily_series(t.events, "ts", "value", ["user_id"])
    return fc.forecast_ar_per_series(users, ["user_id"], "day", "value")


@query("forecast_holt_winters")
def _(t):
    return fc.forecast_holt_winters(daily(t), ["o_orderpriority"], "day", "y", steps=14)


@query("decimate_even", """with r as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as j, count(*) over (partition by event_type) as n from events),
       i as (select event_type, n, unnest(range(100)) as i from (select distinct event_type, n from r)), k as (select distinct event_type, case when n <= 100 then null else (i * (n - 1)) // 99 end as j from i)
       select r.event_id from r where r.n <= 100 or exists (select 1 from k where k.event_type = r.event_type and k.j = r.j)""")
def _(t):
    return ts.decimate_even(t.events, KEY, ["ts", "event_id"], 100).select("event_id")


@query("run_version", """select o_orderkey as run, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as version from orders""")
def _(t):
    runs = t.orders.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("run"))
    return ts.run_version(runs).select("run", "version")
