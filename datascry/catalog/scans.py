"""Sources and sinks. File formats are exercised by writing a given table to the shared folder and reading it back."""

from datascry.catalog import query
from datascry.operators import profile as p
from datascry.session import scratch_path
from datascry.sources import annotations as an
from datascry.sources import tables as tb

from pyspark.sql import functions as F


# Rows of one written document. A power of two, so that documents end where the row numbers of a task do.
DOCUMENT_ROWS = 1024


def written(t, name):
    return scratch_path(t.spark, name)


@query("scan_parquet", "select * from supplier")
def _(t):
    return tb.read_table(t.spark, f"{t.sf_dir}/supplier.parquet")


@query("scan_csv", """select p_partkey::int as p_partkey, p_name || ', "new"' as p_name, p_brand, p_type, p_size, p_retailprice from part""")
def _(t):
    path = written(t, "part.csv")
    tb.write_csv(t.part.withColumn("p_name", F.concat("p_name", F.lit(', "new"'))), path)
    return tb.read_table(t.spark, path, "csv")


@query("scan_csv_ragged", """select c_custkey::int as a, case when c_custkey % 5 = 1 then null else c_mktsegment end as b,
       case when c_custkey % 5 in (1, 2) then null else c_acctbal end as c from customer where c_custkey % 5 <> 3""")
def _(t):
    k = F.col("c_custkey") % 5
    line = F.when(k == 3, F.concat_ws(",", "c_custkey", "c_mktsegment", "c_acctbal", "c_name")).when(
        k == 2, F.concat_ws(",", "c_custkey", "c_mktsegment")).when(k == 1, F.col("c_custkey").cast("string")).otherwise(
        F.concat_ws(",", "c_custkey", "c_mktsegment", "c_acctbal"))
    path = written(t, "ragged.csv")
    t.customer.select(line.alias("a,b,c")).write.option("header", True).option("sep", "\x01").csv(path)
    return tb.read_table(t.spark, path, "csv", "a int, b string, c double")


@query("scan_tsv", "select o_orderkey::int as o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def _(t):
    path = written(t, "orders.tsv")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return tb.read_table(t.spark, path, "tsv")


@query("scan_jsonl", "select event_id, user_id, event_type, value, props from events")
def _(t):
    path = written(t, "events.jsonl")
    t.events.select("event_id", "user_id", "event_type", "value", "props").write.json(path)
    return tb.read_table(t.spark, path, "jsonl")


@query("scan_json_doc", """select s_suppkey, s_name, s_acctbal, k as part from supplier, (values (0), (1)) v(k)""")
def _(t):
    # Documents of up to DOCUMENT_ROWS suppliers, each an object around its table, one to a file.
    path = written(t, "supplier.json")
    row = lambda k: F.struct("s_suppkey", "s_name", "s_acctbal", F.lit(k).alias("part"))
    at = F.monotonically_increasing_id()
    rows = t.supplier.select(F.floor(at / DOCUMENT_ROWS).alias("file"), F.array(row(0), row(1)).alias("pair"))
    table = F.flatten(F.collect_list("pair")).alias("rows")
    docs = rows.groupBy("file").agg(F.to_json(F.struct(F.lit("v1").alias("about"), table)).alias("value"))
    docs.select("value", "file").write.partitionBy("file").text(path)
    return tb.read_table(t.spark, path, "json").select("s_suppkey", "s_name", "s_acctbal", F.col("part").cast("int").alias("part"))


@query("scan_headerless", "select doc_id::int as col_0, replace(text, chr(10), ' ') as col_1 from documents")
def _(t):
    path = written(t, "headerless.csv")
    rows = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    # Wide fields: the reader's default limit per field is off, blanks inside stay.
    rows.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tb.read_table(t.spark, path, "csv")


@query("normalize_columns", """select o_orderkey as key, case when o_orderstatus = 'O' then null when o_orderstatus = 'P' then null
       else o_totalprice end as price from orders""")
def _(t):
    odd = F.when(F.col("o_orderstatus") == "O", F.lit(float("inf"))).when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(
        F.col("o_totalprice"))
    return tb.normalize_columns(t.orders.select(F.col("o_orderkey").alias(" key "), odd.alias("price ")))


@query("sql_passthrough", """select c_mktsegment, count(*) as n, round(sum(cast(o_totalprice as decimal(18,2)))::double, 2) as total
       from orders join customer on o_custkey = c_custkey group by c_mktsegment""")
def _(t):
    return tb.run_sql(t.spark, """select c_mktsegment, count(*) as n, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 2) as total
        from o join c on o_custkey = c_custkey group by c_mktsegment""", {"o": t.orders, "c": t.customer})


@query("scan_yolo_labels", """select 'r' || l_orderkey as image_stem, l_linenumber::int as class_id, l_quantity / 50 as cx, l_discount as cy, l_tax as w, 0.5::double as h
       from lineitem where l_linenumber <> 4""")
def _(t):
    rows = t.lineitem
    cls = F.when(F.col("l_linenumber") == 4, "cat").otherwise(F.col("l_linenumber").cast("string"))
    line = F.concat_ws(" ", cls, F.col("l_quantity") / 50, "l_discount", "l_tax", F.lit("0.5"))
    path = written(t, "labels")
    # One folder per image group; the stem is stored in the line's file name by partitioning on it.
    rows.select(line.alias("value"), (F.col("l_orderkey") % 20).alias("part")).write.partitionBy("part").text(path)
    boxes = an.read_yolo(t.spark, path)
    keyed = rows.select(F.concat(F.lit("r"), "l_orderkey").alias("stem"), F.col("l_linenumber").alias("k"),
                        (F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("t"))
    counts = boxes.groupBy("class_id", "cx", "cy", "w", "h").agg(F.count("*").alias("n"))
    same = ((keyed.k == counts.class_id) & (keyed.x == counts.cx) & (keyed.y == counts.cy) & (keyed.t == counts.w))
    return keyed.join(counts, same).select(F.col("stem").alias("image_stem"), "class_id", "cx", "cy", "w", "h")


@query("scan_voc_xml", """select 'n' || (s_nationkey % 5) as class_name, count(*)::bigint as boxes, round(avg(0.25 + s_suppkey % 7 * 0.01), 6) as mean_cx,
       round(avg(0.5 - s_suppkey % 7 * 0.02), 6) as mean_w from (select * from supplier union all select s_suppkey, s_name, s_nationkey + 1, s_acctbal from supplier)
       where s_suppkey % 10 <> 3 group by 1""")
def _(t):
    def part(name, c):
        return F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))

    def one(shift):
        corners = F.concat(part("xmin", F.col("s_suppkey") % 7 * 2), F.lit("<ymin>1</ymin><xmax>50</xmax><ymax>9</ymax>"))
        name = F.concat(F.lit("n"), (F.col("s_nationkey") + shift) % 5)
        return F.concat(F.lit("<object>"), part("name", name), F.lit("<bndbox>"), corners, F.lit("</bndbox></object>"))

    width = F.when(F.col("s_suppkey") % 10 == 3, 0).otherwise(100)
    doc = F.concat(F.lit("<annotation><filename>x.jpg</filename><size>"), part("width", width), F.lit("<height>10</height></size>"),
                   one(0), one(1), F.lit("</annotation>"))
    path = written(t, "voc")
    # Files of up to DOCUMENT_ROWS annotations below one root.
    rows = t.supplier.select(F.floor(F.monotonically_increasing_id() / DOCUMENT_ROWS).alias("file"), doc.alias("doc"))
    files = rows.groupBy("file").agg(F.concat(F.lit("<annotations>"), F.array_join(F.collect_list("doc"), ""), F.lit("</annotations>")).alias("value"))
    files.select("value", "file").write.partitionBy("file").text(path)
    boxes = an.read_voc(t.spark, path, pattern="*.txt")
    return boxes.groupBy("class_name").agg(F.count("*").alias("boxes"), F.round(F.avg("cx"), 6).alias("mean_cx"), F.round(F.avg("w"), 6).alias("mean_w"))


@query("detect_layout", """select 'class_hierarchy' as layout, count(distinct l_returnflag) as folders from lineitem""")
def _(t):
    path = written(t, "folders")
    files = t.lineitem.select(F.lit("x").alias("value"), F.col("l_returnflag").alias("class")).distinct()
    files.write.partitionBy("class").text(f"{path}")
    names = an.list_files(t.spark, path)
    layout = an.detect_layout(t.spark, path, image_endings=r"\.txt$")
    return names.agg(F.lit(layout).alias("layout"), F.count_distinct(F.split("path", "/")[0]).alias("folders"))


@query("infer_dataset_type", """select * from (values ('orders', 'timeseries'), ('documents', 'nlp'), ('customer', 'tabular'), ('part', 'tabular'),
       ('conversations', 'nlp'), ('embeddings', 'tabular')) v(name, dataset_type)""")
def _(t):
    out = None
    for name in ("orders", "documents", "customer", "part", "conversations", "embeddings"):
        one = p.dataset_type(getattr(t, name)).select(F.lit(name).alias("name"), "dataset_type")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_csv", "select s_suppkey::int as s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def _(t):
    path = written(t, "supplier.csv")
    tb.write_csv(t.supplier, path)
    return t.spark.read.option("header", True).schema("s_suppkey int, s_name string, s_nationkey int, s_acctbal double").csv(path)


@query("sink_parquet", "select * from customer")
def _(t):
    root = written(t, "landing")
    path = tb.land_parquet(t.customer, root)
    if path != tb.land_parquet(t.customer.orderBy("c_name"), root):
        raise AssertionError("the content id must not depend on row order")
    return t.spark.read.parquet(path)


@query("json_safe", """select o_orderkey, case when o_orderstatus = 'O' then '{"price":null,"status":"O"}'
       else '{"price":1.5,"status":"' || o_orderstatus || '"}' end as json from orders""")
def _(t):
    odd = F.when(F.col("o_orderstatus") == "O", F.lit(float("nan"))).otherwise(F.lit(1.5))
    rows = t.orders.select("o_orderkey", odd.alias("price"), F.col("o_orderstatus").alias("status"))
    return tb.json_safe(rows.select("o_orderkey", "price", "status"), "json", keep=["o_orderkey"])


@query("preview", """select cast(doc_id as varchar) as doc_id, coalesce(cast(quality as varchar), '') as quality, lang
       from documents left join labels using (doc_id) order by documents.doc_id limit 15""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "lang")
    return tb.preview(rows, ["doc_id"])


@query("estimate_rows", """with s as (select * from orders where ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 1000000 < 100000)
       select (select count(*) from orders) as total_rows,
       floor((select count(*) from orders) * (select count(*) from s where o_totalprice >= 100000)::double / (select count(*) from s) + 0.5)::bigint as estimated_rows""")
def _(t):
    return tb.estimate_table(t.orders, "o_orderkey", [{"column": "o_totalprice", "actionType": "remove_less_than:100000"}])
