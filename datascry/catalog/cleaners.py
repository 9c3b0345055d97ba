"""Fitted cleaning: every imputer, outlier rule and encoder, and whole plans."""

from datascry.catalog import query
from datascry.catalog.scalars import tags
from datascry.functions import scalars as s
from datascry.operators import cleaning as cl
from datascry.operators import encode as en

from pyspark.sql import functions as F

HOLED = """(select l_orderkey, l_linenumber, nullif(l_quantity, 7) as qty, case when l_linenumber = 3 then null else l_extendedprice end as price,
  nullif(l_returnflag, 'N') as flag, l_tax, l_linestatus, l_shipdate from lineitem)"""


def holed(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(7.0)).alias("qty"),
                             F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"),
                             F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_tax", "l_linestatus", "l_shipdate")


def plan(*pairs):
    return [{"column": c, "actionType": a} for c, a in pairs]


@query("impute_mean", f"select l_orderkey, l_linenumber, round(coalesce(qty, (select avg(qty) from {HOLED})), 6) as qty from {HOLED}")
def _(t):
    out = cl.clean(holed(t), plan(("qty", "impute_mean")))[1]
    return out.select("l_orderkey", "l_linenumber", F.round("qty", 6).alias("qty"))


@query("impute_median", f"select l_orderkey, l_linenumber, round(coalesce(price, (select quantile_cont(price, 0.5) from {HOLED})), 4) as price from {HOLED}")
def _(t):
    out = cl.clean(holed(t), plan(("price", "impute_median")))[1]
    return out.select("l_orderkey", "l_linenumber", F.round("price", 4).alias("price"))


@query("impute_mode", f"""select l_orderkey, l_linenumber, coalesce(flag, (select flag from {HOLED} where flag is not null group by 1 order by count(*) desc, 1 limit 1)) as flag,
       coalesce(qty, (select qty from {HOLED} where qty is not null group by 1 order by count(*) desc, 1 limit 1)) as qty from {HOLED}""")
def _(t):
    out = cl.clean(holed(t), plan(("flag", "impute_mode"), ("qty", "impute_mode")))[1]
    return out.select("l_orderkey", "l_linenumber", "flag", "qty")


def order_numbers(t):
    hole = F.col("o_orderkey") % 50 == 0
    return t.orders.select(F.when(hole, None).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("double").alias("customer"),
                           F.when(F.col("o_orderkey") % 70 == 0, None).otherwise(F.month("o_orderdate")).cast("double").alias("month"))


@query("impute_knn")
def _(t):
    rows = order_numbers(t)
    return cl.clean(rows, plan(("price", "impute_knn")))[1]


@query("impute_mice")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"),
                             F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice") * 1.1 + F.col("l_quantity")).alias("gross"))
    return cl.clean(rows, plan(("price", "impute_mice")))[1]


QUARTILES = "(select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from {rows})"
SPREAD = "(select l_orderkey, l_linenumber, case when l_linenumber = 3 then null else l_quantity * l_quantity * l_quantity end as x from lineitem)"


def spread(t):
    cube = F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, cube).alias("x"))


@query("clip_outliers", f"""select l_orderkey, l_linenumber, round(case when x < q1 - 1.5 * (q3 - q1) then q1 - 1.5 * (q3 - q1) when x > q3 + 1.5 * (q3 - q1) then q3 + 1.5 * (q3 - q1) else x end, 4) as x
       from {SPREAD}, {QUARTILES.format(rows=SPREAD)}""")
def _(t):
    out = cl.clean(spread(t), plan(("x", "clip_outliers")))[1]
    return out.withColumn("x", F.round("x", 4))


@query("drop_outliers", f"""select l_orderkey, l_linenumber, x from {SPREAD}, {QUARTILES.format(rows=SPREAD)} where x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""")
def _(t):
    return cl.clean(spread(t), plan(("x", "drop_outliers")))[1]


@query("isolation_forest")
def _(t):
    return cl.clean(spread(t), plan(("x", "isolation_forest")))[1]


CLEANED = f"""with src as (select distinct l_orderkey, l_linenumber, qty as quantity, price, flag, l_tax, l_linestatus, l_shipdate from {HOLED}),
  fit as (select avg(quantity) as m, quantile_cont(price, 0.5) as med, quantile_cont(l_tax, 0.25) as a, quantile_cont(l_tax, 0.75) as b from (select l_orderkey, qty as quantity, price, l_tax from {HOLED})),
  kept as (select * from src where coalesce(flag not in ('R'), true) and l_linenumber >= 2),
  filled as (select l_orderkey, l_linenumber, coalesce(quantity, m) as quantity, coalesce(price, med) as price, flag,
    case when l_tax < a - 1.5 * (b - a) then a - 1.5 * (b - a) when l_tax > b + 1.5 * (b - a) then b + 1.5 * (b - a) else l_tax end as l_tax, l_shipdate from kept, fit)
  select l_orderkey, l_linenumber, round(quantity, 6) as quantity, round(price, 4) as price, flag, round(l_tax, 6) as l_tax, round(ln(1 + greatest(0, price)), 6) as price_log,
    round(quantity * price, 4) as quantity_x_price, year(l_shipdate)::int as l_shipdate_year, (isodow(l_shipdate) - 1)::int as l_shipdate_dayofweek from filled"""

PLAN = plan(("qty", "rename:quantity"), ("all", "remove_duplicates"), ("flag", "exclude_categories:R"), ("l_linenumber", "remove_less_than:2"),
            ("l_linestatus", "drop"), ("qty", "impute_mean"), ("price", "impute_median"), ("l_tax", "clip_outliers"), ("price", "transform_log"),
            ("qty", "transform_interaction:price"), ("l_shipdate", "transform_date"))


@query("cleaning_plan", CLEANED)
def _(t):
    out = cl.clean(holed(t), PLAN)[1]
    return out.select("l_orderkey", "l_linenumber", F.round("quantity", 6).alias("quantity"), F.round("price", 4).alias("price"), "flag", F.round("l_tax", 6).alias("l_tax"),
                      F.round("price_log", 6).alias("price_log"), F.round("quantity_x_price", 4).alias("quantity_x_price"), "l_shipdate_year", "l_shipdate_dayofweek")


@query("cleaning_plan_scoring", f"""with fit as (select avg(qty) as m, quantile_cont(price, 0.5) as med from {HOLED} where l_linestatus = 'F')
       select l_orderkey, l_linenumber, round(coalesce(qty, m), 6) as quantity, round(coalesce(price, med), 4) as price, flag from {HOLED}, fit where l_linestatus = 'O'""")
def _(t):
    rows = holed(t)
    model = cl.CleanerModel.from_json(cl.fit_cleaner(rows.filter("l_linestatus = 'F'"), PLAN).to_json())
    out = model.transform(rows.filter("l_linestatus = 'O'"))
    return out.select("l_orderkey", "l_linenumber", F.round("quantity", 6).alias("quantity"), F.round("price", 4).alias("price"), "flag")


@query("target_encode", """with f as (select o_orderkey, o_orderpriority as c, case when o_orderstatus = 'F' then 1.0 else 0.0 end as y, ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 5 as f from orders),
       g as (select c, f, sum(y) as s, count(*) as n from f group by 1, 2), tot as (select c, sum(s) as s, sum(n) as n from g group by 1), ff as (select f, sum(s) as s, sum(n) as n from g group by 1), z as (select sum(s) as s, sum(n) as n from g)
       select f.o_orderkey, round((tot.s - g.s + 10 * (z.s - ff.s) / (z.n - ff.n)) / (tot.n - g.n + 10), 6)::double as priority_target
       from f join g using (c, f) join tot using (c) join ff on ff.f = f.f cross join z""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    out = en.target_encode(rows, "o_orderpriority", "y", "o_orderkey", out="priority_target")
    return out.select("o_orderkey", F.round("priority_target", 6).alias("priority_target"))


@query("one_hot", """select c_custkey, case when s = 'BUILDING' then 1 else 0 end as segment_BUILDING, case when s = 'HOUSEHOLD' then 1 else 0 end as segment_HOUSEHOLD, case when s = 'MACHINERY' then 1 else 0 end as segment_MACHINERY
       from (select c_custkey, coalesce(case when c_custkey % 10 = 0 then null else c_mktsegment end, (select c_mktsegment from customer where c_custkey % 10 <> 0 and c_mktsegment in ('BUILDING', 'HOUSEHOLD', 'MACHINERY')
         group by 1 order by count(*) desc, 1 limit 1)) as s from customer)""")
def _(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"))
    train = rows.filter(F.col("segment").isin("BUILDING", "HOUSEHOLD", "MACHINERY"))
    return en.one_hot(rows, "segment", train).select("c_custkey", "segment_BUILDING", "segment_HOUSEHOLD", "segment_MACHINERY")


@query("label_encode", """select p_partkey, p_brand, k.code, p_brand as back from part join (select p_brand, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part)) k using (p_brand)""")
def _(t):
    codes = en.label_codes(t.part, "p_brand")
    coded = en.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand", codes, "code")
    return en.label_decode(coded, "code", codes, "back")


@query("multilabel_binarize", """select user_id, max(case when event_type = 'click' then 1 else 0 end) as tag_click, max(case when event_type = 'error' then 1 else 0 end) as tag_error,
       max(case when event_type = 'view' then 1 else 0 end) as tag_view from events group by 1""")
def _(t):
    rows = tags(t).select("user_id", s.parse_multilabel("tags").alias("tags"))
    return en.multilabel_binarize(rows, "tags").select("user_id", "tag_click", "tag_error", "tag_view")


@query("standard_scale", f"""with m as (select quantile_cont(qty, 0.5) as mq, quantile_cont(price, 0.5) as mp from {HOLED}), f as (select l_orderkey, l_linenumber, coalesce(qty, mq) as q, coalesce(price, mp) as p from {HOLED}, m),
       z as (select avg(q) as aq, stddev_pop(q) as sq, avg(p) as ap, stddev_pop(p) as sp from f)
       select l_orderkey, l_linenumber, round((q - aq) / sq, 6) as qty, round((p - ap) / sp, 6) as price from f, z""")
def _(t):
    out = en.standard_scale(holed(t), ["qty", "price"])
    return out.select("l_orderkey", "l_linenumber", F.round("qty", 6).alias("qty"), F.round("price", 6).alias("price"))
