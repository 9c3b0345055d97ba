"""Equi-joins."""

from datascry.catalog import query
from datascry.operators import merge as m

from pyspark.sql import functions as F

# Some orders point to customers that are missing on the right side, and some customers have no order.
LEFT = "(select o_orderkey, nullif(o_custkey, 13) as custkey, o_totalprice, o_orderpriority as note from orders)"
RIGHT = "(select c_custkey + 7 as custkey, c_name, c_mktsegment as note from customer where c_custkey % 3 <> 0)"


def sides(t):
    left = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(13)).alias("custkey"), "o_totalprice",
                           F.col("o_orderpriority").alias("note"))
    right = t.customer.filter("c_custkey % 3 <> 0").select(
        (F.col("c_custkey") + 7).alias("custkey"), "c_name", F.col("c_mktsegment").alias("note"))
    return left, right


@query("merge_inner", f"""select l.o_orderkey, l.custkey, l.o_totalprice, l.note, r.c_name, r.note as note_right
       from {LEFT} l join {RIGHT} r on l.custkey = r.custkey""")
def _(t):
    return m.merge(*sides(t), "custkey", "custkey", "inner")


@query("merge_left", f"""select l.o_orderkey, l.custkey, l.o_totalprice, l.note, r.c_name, r.note as note_right
       from {LEFT} l left join {RIGHT} r on l.custkey = r.custkey""")
def _(t):
    return m.merge(*sides(t), "custkey", "custkey", "left")


@query("merge_right", f"""select l.o_orderkey, l.o_totalprice, l.note, r.custkey, r.c_name, r.note as note_right
       from {LEFT} l right join {RIGHT} r on l.custkey = r.custkey""")
def _(t):
    return m.merge(*sides(t), "custkey", "custkey", "right")


@query("merge_outer", f"""select l.o_orderkey, l.custkey, l.o_totalprice, l.note, r.custkey as custkey_right, r.c_name,
       r.note as note_right from {LEFT} l full join {RIGHT} r on l.custkey = r.custkey""")
def _(t):
    return m.merge(*sides(t), "custkey", "custkey", "outer")


@query("merge_outer_hot", f"""select l.o_orderkey, l.custkey, l.o_totalprice, l.note, r.custkey as custkey_right, r.c_name,
       r.note as note_right from {LEFT} l full join {RIGHT} r on l.custkey = r.custkey""")
def _(t):
    return m.merge(*sides(t), "custkey", "custkey", "outer", hot_limit=0)


@query("label_lookup", """with f as (select doc_id, case when doc_id % 4 = 0 then 'd' || doc_id || '.png'
         else source || '/d' || doc_id || '.png' end as path from documents),
       m as (select case when doc_id % 2 = 0 then 'd' || doc_id || '.png' else 'd' || doc_id end as name, 'q' || quality as label from labels)
       select f.doc_id, f.path, coalesce(a.label, b.label, case when f.path like '%/%' then split_part(f.path, '/', -2) end, 'default') as label
       from f left join m a on a.name = split_part(f.path, '/', -1)
       left join m b on b.name = replace(split_part(f.path, '/', -1), '.png', '')""")
def _(t):
    name = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".png"))
    files = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, name).otherwise(F.concat("source", F.lit("/"), name)).alias("path"))
    meta = t.labels.select(F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.concat(F.lit("d"), "doc_id")).alias("name"),
                           F.concat(F.lit("q"), "quality").alias("label"))
    return m.label_lookup(files, meta)


@query("pair_images_masks", """select 'd' || d.doc_id as stem, 'images/d' || d.doc_id || '.jpg' as image, 'masks/d' || d.doc_id || '.png' as mask
       from documents d join labels l using (doc_id)""")
def _(t):
    images = t.documents.select(F.concat(F.lit("images/d"), "doc_id", F.lit(".jpg")).alias("path"))
    masks = t.labels.select(F.concat(F.lit("masks/d"), "doc_id", F.lit(".png")).alias("path"))
    return m.pair_images_masks(images, masks)


METRICS = """(select o_orderstatus as run, 'importance' as kind, o_orderpriority as name, round(avg(o_totalprice), 4) as value from orders group by all
  union all select o_orderstatus, 'metric', 'mean', round(avg(o_totalprice), 4) from orders group by all
  union all select l_linestatus, 'model', 'm' || l_linenumber, round(avg(l_extendedprice), 4) from lineitem group by all)"""


@query("run_diff", f"""with m as {METRICS},
       k as (select * from m where kind <> 'importance'
         union all select run, kind, name, value from (select *, row_number() over (partition by run, kind order by value desc, name) as rk
           from m where kind = 'importance') where rk <= 3)
       select coalesce(a.kind, b.kind) as kind, coalesce(a.name, b.name) as name, a.value as value_a, b.value as value_b,
         round(b.value - a.value, 4) as delta
       from (select * from k where run = 'O') a full join (select * from k where run = 'F') b on a.kind = b.kind and a.name = b.name""")
def _(t):
    def means(df, run, kind, name, value):
        return df.groupBy(run.alias("run"), F.lit(kind).alias("kind"), name.alias("name")).agg(F.round(F.avg(value), 4).alias("value"))

    metrics = (means(t.orders, F.col("o_orderstatus"), "importance", F.col("o_orderpriority"), "o_totalprice")
               .unionByName(means(t.orders, F.col("o_orderstatus"), "metric", F.lit("mean"), "o_totalprice"))
               .unionByName(means(t.lineitem, F.col("l_linestatus"), "model", F.concat(F.lit("m"), "l_linenumber"), "l_extendedprice")))
    return m.run_diff(metrics, "O", "F", 3).withColumn("delta", F.round("delta", 4))
