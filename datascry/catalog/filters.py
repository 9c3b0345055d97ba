"""Projections and row filters."""

from datascry.catalog import query
from datascry.operators import filters as f
from datascry.operators import profile as p

from pyspark.sql import functions as F

# Nulls for the rules: the tables hold none.
LINES = "(select *, nullif(l_quantity, 7) as qty from lineitem)"


def lines(t):
    return t.lineitem.withColumn("qty", F.nullif("l_quantity", F.lit(7.0)))


@query("drop_column", "select * exclude (l_tax) from lineitem")
def _(t):
    return f.drop_column(t.lineitem, "l_tax")


@query("rename_column", "select c_custkey, c_name, c_nationkey, c_acctbal as balance, c_mktsegment from customer")
def _(t):
    return f.rename_column(t.customer, "c_acctbal", "balance")


@query("exclude_columns", "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders")
def _(t):
    return f.exclude_columns(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("exclude_categories", """select o_orderkey, s from (select o_orderkey, nullif(o_orderstatus, 'P') as s from orders)
       where coalesce(s not in ('F', 'X'), true)""")
def _(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return f.exclude_categories(rows, "s", ["F", "X"])


@query("remove_less_than", f"select l_orderkey, l_linenumber, qty from {LINES} where qty >= 30")
def _(t):
    return f.remove_less_than(lines(t), "qty", 30).select("l_orderkey", "l_linenumber", "qty")


@query("remove_greater_than", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity <= 12")
def _(t):
    return f.remove_greater_than(t.lineitem, "l_quantity", 12).select("l_orderkey", "l_linenumber", "l_quantity")


@query("remove_equals", f"select l_orderkey, l_linenumber, qty from {LINES} where qty is distinct from 10")
def _(t):
    return f.remove_equals(lines(t), "qty", 10).select("l_orderkey", "l_linenumber", "qty")


@query("remove_contains", """select p_partkey, p_name from part where not contains(lower(p_name), 'red')""")
def _(t):
    return f.remove_contains(t.part, "p_name", "RED").select("p_partkey", "p_name")


@query("remove_contains_regex", """select p_partkey, p_name from part where not regexp_matches(p_name, '(?i)^(red|blue) ')""")
def _(t):
    return f.remove_contains(t.part, "p_name", "^(Red|Blue) ", regex=True).select("p_partkey", "p_name")


@query("time_range", """select o_orderkey, o_orderdate from orders
       where o_orderdate between timestamp '1996-03-01' and timestamp '1996-09-30'""")
def _(t):
    return f.time_range(t.orders, "o_orderdate", "1996-03-01", "1996-09-30").select("o_orderkey", "o_orderdate")


@query("year_filter", "select o_orderkey, o_orderdate, o_totalprice from orders where year(o_orderdate) = 1997")
def _(t):
    return f.year_filter(t.orders, "o_orderdate", 1997).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("series_filter", """select event_id, series, y from (select event_id, nullif(event_type, 'error') as series, value as y from events)
       where series in ('click', 'view') or series is null""")
def _(t):
    points = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("series"), F.col("value").alias("y"))
    return f.series_filter(points, ["click", "view"])


@query("search_any_column", """select * from customer where contains(lower(c_name), 'build') or contains(lower(c_mktsegment), 'build')
       or contains(cast(c_custkey as varchar), 'build') or contains(cast(c_nationkey as varchar), 'build')
       or contains(cast(c_acctbal as varchar), 'build')""")
def _(t):
    return f.search_any_column(t.customer, "Build")


@query("drill_through", """with xs as (select distinct x_num from (select l_quantity as x_num from lineitem)),
       gap as (select min(g) / 2 as half from (select lead(x_num) over (order by x_num) - x_num as g from xs))
       select l_orderkey, l_linenumber, l_quantity from lineitem, gap where l_quantity between 44 - half and 44 + half""")
def _(t):
    points = t.lineitem.select(F.col("l_quantity").alias("x_num"))
    hit = f.drill_through(t.lineitem, "l_quantity", x_num=44, points=points)
    return hit.select("l_orderkey", "l_linenumber", "l_quantity")


@query("drill_through_label", """select 'range' as kind, p_partkey from part where p_size between 10 and 20
       union all select 'category', p_partkey from part where lower(trim(p_type)) = 'economy'""")
def _(t):
    a = f.drill_through(t.part, "p_size", x_val="10-20").select(F.lit("range").alias("kind"), "p_partkey")
    b = f.drill_through(t.part, "p_type", x_val=" Economy ").select(F.lit("category").alias("kind"), "p_partkey")
    return a.unionAll(b)


@query("drop_null_target", """select d.doc_id, l.quality from documents d left join labels l using (doc_id) where l.quality is not null""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    return f.drop_null_target(rows, "quality")


@query("drop_unusable_features", "select c_acctbal, c_mktsegment, c_nationkey, c_comment from (select *, c_name || ' of ' || c_mktsegment as c_comment from customer)")
def _(t):
    rows = t.customer.withColumns({"empty": F.lit(None).cast("double"),
                                   "c_comment": F.concat("c_name", F.lit(" of "), "c_mktsegment")})
    kept = f.drop_unusable_features(rows, p.profile(rows), "c_mktsegment")
    return kept.select("c_acctbal", "c_mktsegment", "c_nationkey", "c_comment")


@query("align_features", "select s_acctbal, 0.0::double as credit, s_nationkey from supplier")
def _(t):
    return f.align_features(t.supplier, ["s_acctbal", "credit", "s_nationkey"])


@query("sanitize_names", """select l_orderkey as "order_id_", l_quantity as "qty_lt_5", l_tax as "tax_gt_0" from lineitem""")
def _(t):
    raw = t.lineitem.select(F.col("l_orderkey").alias("order[id]"), F.col("l_quantity").alias("qty_<5"), F.col("l_tax").alias("tax_>0"))
    return f.sanitize_names(raw)


@query("stratify_eligible", """select 'status' as target, count(*) as classes, min(n) as smallest, min(n) >= 2 as eligible
       from (select o_orderstatus, count(*) as n from orders group by 1)
       union all select 'name', count(*), min(n), min(n) >= 2 from (select c_name, count(*) as n from customer group by 1)""")
def _(t):
    a = f.stratify_check(t.orders, "o_orderstatus").select(F.lit("status").alias("target"), "*")
    return a.unionByName(f.stratify_check(t.customer, "c_name").select(F.lit("name").alias("target"), "*"))
