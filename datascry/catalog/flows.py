"""Streams, plugins, run registry and table states."""

from datascry.catalog import query
from datascry.operators import cleaning as cl
from datascry.operators import plugins as pg
from datascry.session import scratch_path
from datascry.sources import runs as rg
from datascry.streaming import flows as fl

from pyspark.sql import functions as F


def streamed(t, name):
    """A given table as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def drained(t, stream, name):
    """Run a stream over all present files and read back what it wrote."""
    path = scratch_path(t.spark, name)
    fl.write_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


PLAN = [{"column": "value", "actionType": "clip_outliers"}, {"column": "event_type", "actionType": "exclude_categories:error"},
        {"column": "value", "actionType": "transform_log"}, {"column": "ts", "actionType": "transform_date"}]


@query("stream_clean", """with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events), c as (select *, case when value < a - 1.5 * (b - a) then a - 1.5 * (b - a) when value > b + 1.5 * (b - a) then b + 1.5 * (b - a) else value end as v from events, q)
       select event_id, round(v, 6) as value, round(ln(1 + greatest(0, v)), 6) as value_log, hour(ts)::int as ts_hour, (isodow(ts) - 1)::int as ts_dayofweek from c where event_type <> 'error'""")
def _(t):
    model = cl.fit_cleaner(t.events, PLAN)
    out = drained(t, fl.stream_clean(streamed(t, "events"), model, training=True), "clean")
    return out.select("event_id", F.round("value", 6).alias("value"), F.round("value_log", 6).alias("value_log"), "ts_hour", "ts_dayofweek")


@query("stream_clean_distinct", """with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events), d as (select distinct * from events where event_type <> 'error')
       select event_id, round(case when value < a - 1.5 * (b - a) then a - 1.5 * (b - a) when value > b + 1.5 * (b - a) then b + 1.5 * (b - a) else value end, 6) as value from d, q""")
def _(t):
    model = cl.fit_cleaner(t.events, [{"column": "all", "actionType": "remove_duplicates"}, *PLAN[:2]])
    twice = streamed(t, "events").unionByName(streamed(t, "events"))  # every row arrives two times
    return drained(t, fl.stream_clean(twice, model, training=True, ts="ts"), "distinct").select("event_id", F.round("value", 6).alias("value"))


@query("stream_score")
def _(t):
    from pyspark.ml import Pipeline

    from datascry.operators import models as m
    from datascry.operators import profile as p

    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    plan = m.plan_features(rows, p.profile(rows), "o_orderstatus")
    ready = m.with_label(m.prepare(rows, plan), plan)
    stages = Pipeline(stages=[*m.featurize(plan).getStages(), m.classifier("logistic", len(plan.classes))]).fit(ready)
    fitted = m.FittedPipeline(None, stages, plan)
    source = streamed(t, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    live = drained(t, fl.stream_score(source, fitted), "score")
    batch = fitted.transform(rows.drop("o_orderstatus")).select("o_orderkey", F.col("o_orderstatus").alias("batch"))
    return live.join(batch, "o_orderkey").groupBy((F.col("o_orderstatus") == F.col("batch")).alias("same_as_batch")).agg(F.count("*").alias("n"))


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# Rows of one arriving file, about.
ARRIVAL_ROWS = 4_000_000


def arrivals(t):
    """Order lines as files that arrive in four batches: (folder, files a batch). Files and tasks grow in number with the table, not in size."""
    source = scratch_path(t.spark, "arrivals")
    each = -(-t.lineitem.count() // (4 * ARRIVAL_ROWS))
    t.lineitem.repartition(4 * max(each, 1), "l_orderkey").write.parquet(source)
    return source, max(each, 1)


@query("scheduled_profile", "\nunion all ".join([f"""select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, round(min({c})::double, 4) as min, round(max({c})::double, 4) as max,
       round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std from lineitem""" for c in NUMERIC] + [f"""select '{c}', count(*), count(*) - count({c}), null, null, null, null from lineitem"""
                                                                                                            for c in ("l_returnflag", "l_linestatus", "l_shipdate")]))
def _(t):
    source, each = arrivals(t)
    out = scratch_path(t.spark, "profile")
    schema = t.lineitem.schema
    fl.scheduled_profile(t.spark, source, out, schema, max_files=each)
    # A second call finds nothing new and must not count anything twice.
    table = fl.scheduled_profile(t.spark, source, out, schema, max_files=each)
    return table.drop("quartiles", "distinct").withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "std")})


@query("scheduled_sketches")
def _(t):
    """Quartiles and distinct counts of arriving files, from merged sketches."""
    (source, each), out = arrivals(t), scratch_path(t.spark, "profile")
    return fl.scheduled_profile(t.spark, source, out, t.lineitem.schema, max_files=each).select("column", "rows", "quartiles", "distinct")


@query("stream_window_profile", """with w as (select date_trunc('day', ts) as start, event_type, count(*) as n, avg(value) as mean from events group by 1, 2)
       select strftime(start, '%Y-%m-%d') as day, event_type, n, round(mean, 6) as mean from w where start + interval 1 day <= (select max(ts) - interval 1 hour from events)""")
def _(t):
    out = drained(t, fl.stream_window_profile(streamed(t, "events"), "ts", "value", "event_type"), "windows")
    utc = F.to_utc_timestamp("start", F.current_timezone())
    return out.select(F.date_format(utc, "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("window_profile", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2""")
def _(t):
    out = fl.window_profile(t.events, "ts", "value", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


def ratio(df, column, by, out="ratio"):
    return df.withColumn(out, F.col(column) / F.lit(by))


def doubled(pdf, column, factor):
    return pdf.assign(**{column: pdf[column] * factor})


@query("plugin_transform", "select s_suppkey, s_acctbal, s_acctbal / 4 as quarter from supplier")
def _(t):
    pg.register_plugin("ratio", ratio, {"column": None, "by": 1, "out": "ratio"}, "one column over a constant")
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    return cl.clean(rows, [{"column": "s_acctbal", "actionType": "plugin:ratio:column=s_acctbal,by=4,out=quarter"}])[1]


@query("plugin_pandas", "select l_orderkey, l_linenumber, l_quantity * 2.5 as l_quantity from lineitem")
def _(t):
    pg.register_pandas_plugin("scaled", doubled, lambda schema: schema, {"column": "x", "factor": 1.0})
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return pg.apply_plugin(rows, "plugin:scaled:column=l_quantity,factor=2.5")


RUNS = """(select 'r' || o_orderkey as run, o_orderpriority as dataset, 'price' as target, case o_orderstatus when 'O' then 'Classification' when 'F' then 'regression' else 'Forecasting' end as task,
  round(o_totalprice / 1000, 3) as score from orders)"""


def runs(t):
    task = F.when(F.col("o_orderstatus") == "O", "Classification").when(F.col("o_orderstatus") == "F", "regression").otherwise("Forecasting")
    return t.orders.select(F.concat(F.lit("r"), "o_orderkey").alias("run"), F.col("o_orderpriority").alias("dataset"), F.lit("price").alias("target"), task.alias("task"),
                           F.round(F.col("o_totalprice") / 1000, 3).alias("score"))


@query("record_run", f"select run, dataset, target, task, score from {RUNS} union all select 'late', '1-URGENT', 'price', 'regression', 0.5")
def _(t):
    path = scratch_path(t.spark, "runs")
    rg.append_runs(runs(t), path)
    table = rg.record_run(t.spark, path, {"run": "late", "dataset": "1-URGENT", "target": "price", "task": "regression", "score": 0.5})
    return table.select("run", "dataset", "target", "task", "score")


@query("other_runs", f"select run, score from {RUNS} where dataset = '5-LOW' and run <> 'r0'")
def _(t):
    return rg.other_runs(runs(t), "5-LOW", "r0").select("run", "score")


@query("search_runs", f"""select 'urgent' as q, run from {RUNS} where contains(lower(dataset), 'urgent') and contains(lower(task), 'class')
       union all select 'forecast', run from {RUNS} where contains(lower(task), 'time') or contains(lower(task), 'forecast')""")
def _(t):
    a = rg.search_runs(runs(t), "Urgent", "classification").select(F.lit("urgent").alias("q"), "run")
    return a.unionByName(rg.search_runs(runs(t), family="timeseries").select(F.lit("forecast").alias("q"), "run"))


@query("snapshot_rollback", """select state_id, description, n as rows, columns from (select 1 as state_id, 'raw' as description, (select count(*) from customer) as n, 5 as columns
       union all select 2, 'rich', (select count(*) from customer where c_acctbal > 3000), 5 union all select 3, 'slim', (select count(*) from customer where c_acctbal > 3000), 2)""")
def _(t):
    store = rg.StateStore(t.spark, scratch_path(t.spark, "states"))
    first = store.snapshot(t.customer, "raw")
    second = store.snapshot(store.read(first).filter("c_acctbal > 3000"), "rich")
    store.snapshot(store.read(second).limit(0), "mistake")
    back = store.rollback(second)
    store.snapshot(back.select("c_custkey", "c_name"), "slim")
    return store.states().select("state_id", "description", "rows", "columns")
