"""Sorts, limits, samples, splits and set operations."""

from datascry.catalog import query
from datascry.operators import sampling as sp

from pyspark.sql import Window
from pyspark.sql import functions as F


def bucket(key, m=1_000_000):
    return f"(('0x' || substr(md5({key}::varchar), 1, 8))::bigint % {m})"


@query("sort_numeric_first", """select o_orderkey, tag from (select o_orderkey, case when o_orderstatus = 'O' then cast(o_custkey as varchar)
       when o_orderstatus = 'P' then null else o_orderpriority end as tag from orders) order by try_cast(tag as double) nulls last, tag nulls last""")
def _(t):
    tag = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string")).when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return sp.sort_numeric_first(t.orders.select("o_orderkey", tag.alias("tag")), "tag")


@query("page", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 100 offset 300")
def _(t):
    return sp.page(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3)


@query("top_k", """select 'all' as scope, o_orderkey, o_totalprice from (select * from orders order by o_totalprice desc, o_orderkey limit 10)
       union all select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderpriority
         order by o_totalprice desc, o_orderkey) as rk from orders) where rk <= 20""")
def _(t):
    one = sp.top_k(t.orders, "o_totalprice", 10, ties=["o_orderkey"]).select(F.lit("all").alias("scope"), "o_orderkey", "o_totalprice")
    each = sp.top_k(t.orders, "o_totalprice", 20, by=["o_orderpriority"], ties=["o_orderkey"])
    return one.unionByName(each.select(F.col("o_orderpriority").alias("scope"), "o_orderkey", "o_totalprice"))


@query("leaderboard_sort", """select row_number() over (order by rmse nulls last, model) as place, model, rmse from
       (select o_orderpriority as model, case when o_orderpriority like '1%' then null else round(stddev_samp(o_totalprice), 4) end as rmse from orders group by 1)""")
def _(t):
    rmse = F.when(F.col("model").startswith("1"), None).otherwise(F.round("sd", 4))
    board = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(F.stddev_samp("o_totalprice").alias("sd")).select("model", rmse.alias("rmse"))
    ranked = sp.leaderboard_sort(board, "rmse")
    # The board has one row per model, so a single window is bounded.
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("rmse").asc_nulls_last(), "model")
    return ranked.select(F.row_number().over(w).cast("long").alias("place"), "model", "rmse")


@query("file_priority", """select name, case when lower(name) like '%train%' then 0 when lower(name) like '%val%' then 2
       when lower(name) like '%test%' then 3 else 1 end::int as priority from
       (select case when p_partkey % 4 = 0 then 'Train' when p_partkey % 4 = 1 then 'val' when p_partkey % 4 = 2 then 'test' else 'x' end || '_' || p_partkey as name from part)""")
def _(t):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "Train").when(k == 1, "val").when(k == 2, "test").otherwise("x")
    return sp.file_priority(t.part.select(F.concat(kind, F.lit("_"), "p_partkey").alias("name")))


@query("sample_n", f"""select o_orderkey from orders where {bucket('o_orderkey')} < round(1000000 * least(1.0, 500.0 / (select count(*) from orders)))""")
def _(t):
    return sp.sample_n(t.orders, "o_orderkey", 500).select("o_orderkey")


@query("sample_stratified", f"""select o_orderstatus, count(*) as n from orders
       where {bucket('o_orderkey')} < round(1000000 * least(1.0, 500.0 / (select count(*) from orders))) group by 1""")
def _(t):
    return sp.sample_stratified(t.orders, "o_orderkey", "o_orderstatus", 500).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("split_train_test", f"""select o_orderkey, case when {bucket('o_orderkey')} < 800000 then 'train' else 'test' end as split from orders""")
def _(t):
    return sp.split_train_test(t.orders.select("o_orderkey"), "o_orderkey")


@query("split_train_test_exact", """select o_orderkey, case when row_number() over (partition by o_orderstatus order by md5(o_orderkey::varchar), o_orderkey)
       <= ceil(0.8 * count(*) over (partition by o_orderstatus)) then 'train' else 'test' end as split from orders""")
def _(t):
    return sp.split_train_test(t.orders, "o_orderkey", "o_orderstatus", exact=True, limit=100).select("o_orderkey", "split")


@query("cap_per_class", """select l_returnflag, l_orderkey, l_linenumber, k from (select *, row_number() over (partition by l_returnflag order by md5(k), k) as rk
       from (select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice as k from lineitem)) where rk <= 200""")
def _(t):
    k = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sp.cap_per_class(t.lineitem.withColumn("k", k), "k", "l_returnflag").select("l_returnflag", "l_orderkey", "l_linenumber", "k")


@query("round_robin_sample", """select p_type, p_partkey, turn from (select *, row_number() over (partition by p_type order by md5(p_partkey::varchar), p_partkey)::int as turn
       from part) order by turn, p_type limit 24""")
def _(t):
    return sp.round_robin_sample(t.part, "p_partkey", "p_type").select("p_type", "p_partkey", "turn")


@query("remove_duplicates", "select distinct l_returnflag, l_linestatus, l_quantity, l_discount from lineitem")
def _(t):
    return sp.remove_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("union_splits", """select doc_id, quality, toxic, 'train' as split from labels where doc_id % 2 = 0
       union all select doc_id, quality, null, 'test' from labels where doc_id % 3 = 0 union all select doc_id, null, toxic, 'val' from labels where doc_id % 5 = 0""")
def _(t):
    test = t.labels.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("Quality"))
    val = t.labels.filter("doc_id % 5 = 0").select("doc_id", "toxic", F.lit(1).alias("extra"))
    return sp.union_splits(t.labels.filter("doc_id % 2 = 0"), test, val, "quality")
