"""Column profiles, quality rules and associations."""

from datascry.catalog import query
from datascry.operators import correlate as co
from datascry.operators import profile as p
from datascry.operators import quality as q

from pyspark.sql import functions as F

# Documents with their labels; unlabelled documents give nulls.
DOCS = "(select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id))"


def docs(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def union(parts):
    return "\nunion all ".join(parts)


LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
DOC_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def counts_sql(table, cols, by=""):
    pre = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return union([f"select {pre}'{c}' as \"column\", count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as nunique from {table}{group}"
                  for c in cols])


@query("profile_counts", counts_sql("lineitem", LINE_COLS) + "\nunion all " + counts_sql(DOCS, DOC_COLS))
def _(t):
    return p.profile_counts(t.lineitem).unionByName(p.profile_counts(docs(t)))


@query("duplicate_rows", """with c as (select l_returnflag, l_linestatus, l_quantity, l_discount, count(*) as n from lineitem group by all)
       select sum(n)::bigint as rows, count(*) as distinct_rows, sum(n - 1)::bigint as duplicate_rows from c""")
def _(t):
    return p.duplicate_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


def stats_sql(table, cols, by="", expr="{c}"):
    pre = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    one = []
    for c in cols:
        x = f"({expr.format(c=c)})::double"
        one.append(f"""select {pre}'{c}' as "column", count({x}) as n, round(coalesce(min({x}), 0), 4) as min, round(coalesce(max({x}), 0), 4) as max,
        round(coalesce(avg({x}), 0), 4) as mean, round(coalesce(stddev_samp({x}), 0), 4) as std, round(coalesce(quantile_cont({x}, 0.25), 0), 4) as p25,
        round(coalesce(quantile_cont({x}, 0.5), 0), 4) as p50, round(coalesce(quantile_cont({x}, 0.75), 0), 4) as p75 from {table}{group}""")
    return union(one)


STATS = ["min", "max", "mean", "std", "p25", "p50", "p75"]


@query("numeric_stats", stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]) + "\nunion all "
       + stats_sql(DOCS, ["quality", "n_chars"]))
def _(t):
    a = p.numeric_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"])
    return rounded(a.unionByName(p.numeric_stats(docs(t), ["quality", "n_chars"])), 4, *STATS)


@query("numeric_stats_ranked", stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], by="l_returnflag"))
def _(t):
    a = p.numeric_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], by=["l_returnflag"], limit=100)
    return rounded(a, 4, *STATS)


@query("integer_like", """select 'l_quantity' as "column", bool_and(l_quantity = floor(l_quantity)) as integer_like from lineitem
       union all select 'l_discount', bool_and(l_discount = floor(l_discount)) from lineitem
       union all select 'l_linenumber', bool_and(l_linenumber = floor(l_linenumber)) from lineitem""")
def _(t):
    return p.integer_like(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"])


@query("text_length_stats", stats_sql("documents", ["text", "lang", "source"], expr="length({c})"))
def _(t):
    return rounded(p.text_length_stats(t.documents, ["text", "lang", "source"]), 4, *STATS)


@query("top_categories", union([f"""select '{c}' as "column", rank, value, n from (select {c}::varchar as value, count(*) as n,
       row_number() over (order by count(*) desc, {c}::varchar)::int as rank from {tab} where {c} is not null group by 1) where rank <= 5"""
                                for tab, c in (("part", "p_brand"), ("part", "p_type"), ("part", "p_size"), ("part", "p_name"))]))
def _(t):
    return p.top_categories(t.part, ["p_brand", "p_type", "p_size", "p_name"])


def like(name, words):
    return "(" + " or ".join(f"contains('{name.lower()}', '{w}')" for w in words) + ")"


def type_sql(table, kinds):
    """The type rule spelt out per column: kinds maps a column to its family."""
    parts = []
    for c, kind in kinds.items():
        low = c.lower()
        named = low in p.ID_NAMES or low.endswith(("id", "key")) or low.startswith(("id_", "key_"))
        number = kind in ("integer", "number")
        whole = {"integer": "true", "number": f"bool_and({c} = floor({c}))"}.get(kind, "false")
        text = f"{c}::varchar"
        parts.append(f"""select '{c}' as "column",
         case when u >= 0.98 and ({str(named).lower()} or ({str(kind == 'string').lower()} and not blank and len < 40)) then 'identifier'
              when {str(kind == 'time').lower()} or ({str(number).lower()} and {like(c, p.DATE_NAMES)}) then 'datetime'
              when {str(number).lower()} and not (n <= 2 or (n <= 15 and {like(c, p.CATEGORY_NAMES)}) or (n <= 5 and whole and not {like(c, p.CONTINUOUS_NAMES)})) then 'numeric'
              when len > 50 or ({str(kind == 'string').lower()} and n > 100) then 'text' else 'categorical' end as type
         from (select count(distinct {c}) as n, count(distinct {c}) / count({c}) as u, avg(length({text})) as len, coalesce({whole}, false) as whole,
               coalesce(bool_or(regexp_matches({text}, '\\s')), false) as blank from {table})""")
    return union(parts)


LINE_KINDS = dict(zip(LINE_COLS, ["integer"] * 4 + ["number"] * 4 + ["string"] * 2 + ["time"]))
CUSTOMER_KINDS = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number", "c_mktsegment": "string"}
PART_KINDS = {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "number"}
DOCUMENT_KINDS = {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"}
LABEL_KINDS = {"doc_id": "integer", "quality": "integer", "toxic": "integer"}


@query("infer_column_type", union([type_sql("lineitem", LINE_KINDS), type_sql("customer", CUSTOMER_KINDS), type_sql("part", PART_KINDS),
                                   type_sql("documents", DOCUMENT_KINDS), type_sql("labels", LABEL_KINDS)]))
def _(t):
    out = None
    for df in (t.lineitem, t.customer, t.part, t.documents, t.labels):
        one = p.infer_column_type(df).select("column", "type")
        out = one if out is None else out.unionByName(one)
    return out


@query("detect_identifier", f"""select "column", n as non_null, n as nunique from ({type_sql("customer", CUSTOMER_KINDS)}) join (select count(*) as n from customer) on true
       where type = 'identifier'""")
def _(t):
    return p.detect_identifier(t.customer)


@query("detect_datetime", """select 'order_date' as "column", 'string' as family where (select avg(case when try_cast(d as timestamp) is not null then 1 else 0 end)
       from (select case when o_orderkey % 10 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end as d from orders)) >= 0.8
       union all select 'o_orderdate', 'time'""")
def _(t):
    text = F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = t.orders.select("o_orderdate", "o_totalprice", text.alias("order_date"),
                           F.when(F.col("o_orderkey") % 2 == 0, text).alias("note"), F.lit("x").alias("day_name"))
    return p.detect_datetime(rows)


@query("detect_multilabel", """with u as (select user_id % 4 as user_id, string_agg(distinct event_type, ',' order by event_type) as tags from events group by events.user_id)
       select 'tags' as "column", round(avg(contains(tags, ',')::int), 6) as comma_share, round(avg(len(string_split(tags, ','))), 6) as mean_parts,
       avg(contains(tags, ',')::int) >= 0.1 and avg(len(string_split(tags, ','))) > 1.1 as is_multi_label from u""")
def _(t):
    kinds = t.events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))
    return rounded(p.detect_multilabel(kinds.select("tags")), 6, "comma_share", "mean_parts")


@query("datetime_bounds", """select 'l_shipdate' as "column", strftime(min(l_shipdate), '%Y-%m-%d') as min_day, strftime(max(l_shipdate), '%Y-%m-%d') as max_day from lineitem
       union all select 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') from orders""")
def _(t):
    return p.datetime_bounds(t.lineitem).unionByName(p.datetime_bounds(t.orders))


@query("column_categories", union([f"""select 'p_{c}' as "column", value from (select distinct p_{c} as value from part where trim(p_{c}) <> '') qualify row_number() over (order by value) <= 30"""
                                   for c in ("brand", "type", "name")]))
def _(t):
    return p.column_categories(t.part, ["p_brand", "p_type", "p_name"])


@query("profile_splits", counts_sql("(select o_orderkey, o_custkey, o_totalprice, o_orderpriority, case o_orderstatus when 'O' then 'train' when 'F' then 'test' else 'val' end as split from orders)",
                                    ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], by="split"))
def _(t):
    split = F.when(F.col("o_orderstatus") == "O", "train").when(F.col("o_orderstatus") == "F", "test").otherwise("val")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", split.alias("split"))
    return p.profile(rows, by=["split"]).select("split", "column", "rows", "missing", "nunique")


@query("value_counts", "select quality, count(*) as n from labels group by 1")
def _(t):
    return p.value_counts(docs(t), "quality")


@query("majority_share", """with c as (select o_orderpriority as k, count(*) as n from orders group by 1)
       select k as majority_class, round(n / (select sum(n) from c), 6)::double as share, n / (select sum(n) from c) > 0.7 as imbalanced from c order by n desc, k limit 1""")
def _(t):
    return rounded(p.majority_share(t.orders, "o_orderpriority"), 6, "share")


def histogram_sql(table, c, bins):
    return f"""with e as (select min({c})::double as lo, (max({c}) - min({c}))::double / {bins} as w from {table}),
      n as (select least(floor(({c} - lo) / w), {bins - 1})::int as bin, count(*) as n from {table}, e where {c} is not null group by 1)
      select b.bin::int as bin, round(lo + b.bin * w + w / 2, 4) as mid, coalesce(n.n, 0) as n from (select unnest(range({bins}))::int as bin) b cross join e left join n on n.bin = b.bin"""


@query("histogram", histogram_sql("lineitem", "l_extendedprice", 10))
def _(t):
    return rounded(p.histogram(t.lineitem, "l_extendedprice").select("bin", "mid", "n"), 4, "mid")


def box_sql(table, cols, by=""):
    pre = f"{by}, " if by else ""
    parts = []
    for c in cols:
        join = f"using ({by})" if by else "on true"
        group = f" group by {by}" if by else ""
        parts.append(f"""select {pre}'{c}' as "column", count({c}) as n, any_value(q1) as q1, any_value(med) as median, any_value(q3) as q3,
          min(case when q3 <= q1 or {c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then {c} end)::double as whisker_low,
          max(case when q3 <= q1 or {c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then {c} end)::double as whisker_high,
          count(case when q3 > q1 and not ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) then 1 end) as outliers
          from {table} join (select {pre}quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.5) as med, quantile_cont({c}::double, 0.75) as q3
            from {table}{group}) {join}{group}""")
    return union(parts)


BOX_ROWS = "(select *, l_quantity * l_quantity * l_quantity as cube, l_extendedprice / (l_discount + 0.01) as ratio from lineitem)"
BOX_COLS = ["l_quantity", "l_extendedprice", "cube", "ratio", "l_tax", "l_discount"]
BOX_SELECT = """"column", n, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(whisker_low, 4) as whisker_low,
 round(whisker_high, 4) as whisker_high, outliers, round(outliers / n, 6) as outlier_share"""


def box_rows(t):
    return t.lineitem.withColumns({"cube": F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity"),
                                   "ratio": F.col("l_extendedprice") / (F.col("l_discount") + 0.01)})


BOX_OUT = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("boxplot_stats", f"""select {BOX_SELECT} from ({box_sql(BOX_ROWS, BOX_COLS)}) where n >= 5 order by outliers / n desc, "column" limit 5""")
def _(t):
    return rounded(rounded(p.boxplot_stats(box_rows(t), BOX_COLS), 4, *BOX_OUT), 6, "outlier_share")


@query("boxplot_stats_grouped", f"""select l_returnflag, {BOX_SELECT} from ({box_sql(BOX_ROWS, ["cube", "ratio"], "l_returnflag")}) where n >= 5""")
def _(t):
    out = p.boxplot_stats(box_rows(t), ["cube", "ratio"], by=["l_returnflag"], top=None)
    return rounded(rounded(out, 4, *BOX_OUT), 6, "outlier_share")


@query("outlier_share", f"""select "column", outliers, round(outliers / rows, 6) as share, outliers / rows > 0.01 as alert, outliers / rows > 0.05 as recommend
       from ({box_sql(BOX_ROWS, BOX_COLS)}) join (select count(*) as rows from lineitem) on true""")
def _(t):
    return rounded(p.outlier_share(box_rows(t), BOX_COLS), 6, "share")


@query("skew_alert", union([f"""select '{c}' as "column", round(skewness({c}), 5) as skewness, abs(skewness({c})) > 1.5 as alert from {BOX_ROWS}""" for c in BOX_COLS]))
def _(t):
    return rounded(p.skew_alert(box_rows(t), BOX_COLS), 5, "skewness")


@query("missing_alert", f"""select "column", missing, round(missing / rows, 6) as share from ({counts_sql(DOCS, DOC_COLS)}) where missing / rows > 0.3""")
def _(t):
    return rounded(p.missing_alert(p.profile_counts(docs(t))), 6, "share")


@query("missing_top", f"""select "column", missing from ({counts_sql(DOCS, DOC_COLS)}) where missing > 0 order by missing desc, "column" limit 10""")
def _(t):
    return p.missing_top(p.profile_counts(docs(t)))


RAW = """(select l_orderkey, l_linestatus, l_extendedprice, nullif(l_quantity, 7) as qty, case when l_linenumber < 5 then null else l_tax end as tax,
  'fixed' as constant, l_quantity * l_quantity * l_quantity * l_quantity as spread, 'c' || l_partkey || ' of ' || l_suppkey as combo from lineitem)"""


def raw(t):
    price = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linestatus", "l_extendedprice", F.nullif("l_quantity", F.lit(7.0)).alias("qty"),
                             F.when(F.col("l_linenumber") >= 5, F.col("l_tax")).alias("tax"), F.lit("fixed").alias("constant"),
                             (price * price * price * price).alias("spread"),
                             F.concat(F.lit("c"), "l_partkey", F.lit(" of "), "l_suppkey").alias("combo"))


RECOMMENDED = f"""with s as (select count(*) as n, count(qty) as q, count(tax) as x, count(distinct combo) as combos, quantile_cont(spread, 0.25) as q1, quantile_cont(spread, 0.75) as q3 from {RAW}),
  o as (select count(*) as out from {RAW}, s where spread > q3 + 1.5 * (q3 - q1) or spread < q1 - 1.5 * (q3 - q1))
  select 'qty' as "column", printf('%.1f', 100 * (n - q) / n) || '% missing values' as issue, '{q.ADVICE["impute"]}' as recommendation, 'Low' as impact from s
  union all select 'tax', printf('%.1f', 100 * (n - x) / n) || '% missing values', '{q.ADVICE["drop_nulls"]}', 'High' from s
  union all select 'combo', 'High cardinality categorical column (' || combos || ' unique categories)', '{q.ADVICE["many"]}', 'Medium' from s where combos > 100
  union all select 'constant', 'Constant value column (only 1 unique value)', '{q.ADVICE["constant"]}', 'Medium'
  union all select 'spread', 'Outliers detected (' || printf('%.1f', 100.0 * out / n) || '% of values outside whiskers)', '{q.ADVICE["outliers"]}', 'Medium' from s, o where out / n > 0.05"""


@query("cleaning_recommendations", RECOMMENDED)
def _(t):
    return q.cleaning_recommendations(raw(t), "l_extendedprice")


@query("recommendation_actions", f"""select "column", issue, unnest(generate_series(1, len(a)))::int as rank, unnest(a) as action from
       (select "column", issue, case when issue like 'Outliers%' then ['clip_outliers', 'drop_outliers', 'isolation_forest']
         when issue like '%missing%' and impact = 'High' then ['drop', 'impute_median', 'impute_mean', 'impute_knn', 'impute_mice']
         when issue like '%missing%' then ['impute_median', 'impute_mean', 'impute_knn', 'impute_mice', 'drop'] else ['drop'] end as a from ({RECOMMENDED}))""")
def _(t):
    rows = raw(t)
    return q.recommendation_actions(q.cleaning_recommendations(rows, "l_extendedprice"), p.infer_column_type(rows))


@query("leakage_warnings", """with c as (select corr(l_extendedprice, l_extendedprice * (1 + l_tax / 100)) as gross, corr(l_extendedprice, l_quantity) as qty from lineitem)
       select 'price_band' as "column", 'name' as reason, null::double as value union all select 'gross', 'correlation', round(gross, 6) from c where abs(gross) >= 0.98
       union all select 'qty', 'correlation', round(qty, 6) from c where abs(qty) >= 0.98""")
def _(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 + F.col("l_tax") / 100)).alias("gross"),
                             F.col("l_quantity").alias("qty"), F.when(F.col("l_extendedprice") > 1000, "high").alias("price_band"),
                             F.lit(True).alias("is_price"))
    return rounded(q.leakage_warnings(rows, "price"), 6, "value")


PAIRS = [(a, b) for i, a in enumerate(BOX_COLS) for b in BOX_COLS[i + 1:]]


@query("corr_pearson", union([f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as value from {BOX_ROWS}" for a, b in PAIRS]))
def _(t):
    return rounded(co.corr_pearson(box_rows(t), BOX_COLS), 6, "value")


def cramers_sql(table, a, b, name_a=None, name_b=None):
    return f"""select '{name_a or a}' as x, '{name_b or b}' as y, n, round(case when least(r, k) < 2 then 0 else sqrt(chi / n / (least(r, k) - 1)) end, 6) as value from (
      select any_value(n) as n, any_value(r) as r, any_value(k) as k, sum(case when r = 2 and k = 2 then power(abs(o - e) - least(0.5, abs(o - e)), 2) / e else power(o - e, 2) / e end) as chi
      from (select x.n as rn, y.n as cn, t.n as n, rs.c as r, ks.c as k, coalesce(c.n, 0) as o, x.n * y.n / t.n as e
        from (select {a} as v, count(*) as n from {table} where {a} is not null and {b} is not null group by 1) x
        cross join (select {b} as v, count(*) as n from {table} where {a} is not null and {b} is not null group by 1) y
        cross join (select count(*) as n from {table} where {a} is not null and {b} is not null) t
        cross join (select count(distinct {a}) as c from {table} where {b} is not null) rs cross join (select count(distinct {b}) as c from {table} where {a} is not null) ks
        left join (select {a} as a, {b} as b, count(*) as n from {table} group by all) c on c.a = x.v and c.b = y.v))"""


CUST = "(select c_mktsegment, c_nationkey, c_acctbal, case when c_acctbal > 3000 then 'rich' else 'poor' end as band, case when c_nationkey > 12 then 'n' else 's' end as side from customer)"


def cust(t):
    return t.customer.select("c_mktsegment", "c_nationkey", "c_acctbal", F.when(F.col("c_acctbal") > 3000, "rich").otherwise("poor").alias("band"),
                             F.when(F.col("c_nationkey") > 12, "n").otherwise("s").alias("side"))


@query("corr_cramers_v", union([cramers_sql(CUST, "c_mktsegment", "band"), cramers_sql(CUST, "band", "side"), cramers_sql(CUST, "c_mktsegment", "c_nationkey")]))
def _(t):
    rows = cust(t)
    return rounded(co.cramers_v_table(rows, [("c_mktsegment", "band"), ("band", "side"), ("c_mktsegment", "c_nationkey")]), 6, "value")


def eta_sql(table, cat, num):
    return f"""select '{cat}' as x, '{num}' as y, count(*) as levels, sum(n)::bigint as n,
      round(sqrt(sum(n * power(m - mean, 2)) / any_value(sst)), 6) as value from (select {cat} as g, count({num}) as n, avg({num}) as m from {table} where {cat} is not null and {num} is not null group by 1)
      cross join (select avg({num}) as mean, var_pop({num}) * count({num}) as sst from {table} where {cat} is not null and {num} is not null)"""


@query("corr_ratio", eta_sql("lineitem", "l_returnflag", "l_extendedprice"))
def _(t):
    return rounded(co.corr_ratio(t.lineitem, "l_returnflag", "l_extendedprice"), 6, "value")


@query("corr_point_biserial", """select 'l_linestatus' as x, 'l_quantity' as y, 2::bigint as levels, count(*) as n,
       round(corr(case when l_linestatus = 'F' then 1 else 0 end, l_quantity), 6) as value from lineitem""")
def _(t):
    return rounded(co.corr_point_biserial(t.lineitem, "l_linestatus", "l_quantity"), 6, "value")


MIXED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


@query("corr_mixed", f"""select x, y, value from (
       {union([f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as value from lineitem" for a, b in (MIXED[:2], MIXED[1:3], (MIXED[0], MIXED[2]))])}
       union all select x, y, value from ({cramers_sql("lineitem", "l_returnflag", "l_linestatus")})
       union all {union([f"select y, x, value from ({eta_sql('lineitem', 'l_returnflag', c)})" for c in MIXED[:3]])}
       union all {union([f"select '{c}', 'l_linestatus', round(corr(case when l_linestatus = 'F' then 1 else 0 end, {c}), 6) from lineitem" for c in MIXED[:3]])})""")
def _(t):
    return rounded(co.corr_mixed(t.lineitem, MIXED), 6, "value")


@query("calendar_avg", """select 'month' as part, month(o_orderdate)::int as at, round(avg(o_totalprice), 4) as mean from orders group by 2
       union all select 'day', day(o_orderdate)::int, round(avg(o_totalprice), 4) from orders group by 2""")
def _(t):
    out = None
    for part in ("month", "day"):
        one = p.calendar_avg(t.orders, "o_orderdate", "o_totalprice", part).select(F.lit(part).alias("part"), F.col(part).alias("at"), F.round("mean", 4).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_sql(table, kinds):
    parts = []
    for c, kind in kinds.items():
        num = kind in ("integer", "number")
        show = lambda e: f"round({e}, 4)" if num else "null::double"
        day = lambda e: f"strftime({e}, '%Y-%m-%d')" if kind == "time" else "null"
        top = "null" if num or kind == "time" else f"(select substr({c}, 1, 40) from {table} group by {c} order by count(*) desc, {c} limit 1)"
        parts.append(f"""select '{c}' as "column", '{kind}' as family, round(100 * count({c}) / count(*), 1) as non_null_pct, {show(f'min({c})::double')} as min,
          {show(f'max({c})::double')} as max, {show(f'avg({c})')} as mean, {day(f'min({c})')} as first_day, {day(f'max({c})')} as last_day, {top} as top, count(distinct {c}) as nunique from {table}""")
    return union(parts)


ORDER_KINDS = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "string"}


@query("dataset_snapshot", snapshot_sql("orders", ORDER_KINDS))
def _(t):
    return rounded(q.dataset_snapshot(t.orders), 4, "min", "max", "mean")


POINTS = "(select 'sales' as chart, o_orderstatus as series, o_totalprice as y, o_custkey::double as x_num from orders union all select 'events', event_type, value, user_id::double from events)"


def points(t):
    a = t.orders.select(F.lit("sales").alias("chart"), F.col("o_orderstatus").alias("series"), F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x_num"))
    return a.unionByName(t.events.select(F.lit("events").alias("chart"), F.col("event_type").alias("series"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("x_num")))


def point_sql(keys, series):
    return f"""select chart, {series} as series, count(*) as points, round(min(y), 4) as min_y, round(max(y), 4) as max_y, round(avg(y), 4) as mean_y, min(x_num) as min_x, max(x_num) as max_x,
      round(quantile_cont(y, 0.5), 4) as median_y from {POINTS} group by {keys}"""


@query("point_summary", union([point_sql("chart", "null"), point_sql("chart, series", "series")]))
def _(t):
    whole = q.point_summary(points(t)).withColumn("series", F.lit(None).cast("string"))
    return rounded(whole.unionByName(q.point_summary(points(t), by_series=True)), 4, "min_y", "max_y", "mean_y", "median_y")


@query("top_n_others", """with c as (select p_brand as k, count(*) as n from part group by 1), r as (select *, row_number() over (order by n desc, k) as rk from c)
       select case when rk <= 10 then k else 'Others' end as category, sum(n)::bigint as n, round(sum(n) / (select sum(n) from c), 6)::double as share from r group by 1""")
def _(t):
    return rounded(q.top_n_others(t.part, "p_brand"), 6, "share")


@query("share_of_total", """with c as (select c_mktsegment as x_val, round(sum(c_acctbal), 2) as y from customer group by 1)
       select x_val, y, round(y / (select sum(y) from c where y > 0), 6) as share from c where y > 0""")
def _(t):
    totals = t.customer.groupBy(F.col("c_mktsegment").alias("x_val")).agg(F.round(F.sum("c_acctbal"), 2).alias("y"))
    return rounded(q.share_of_total(totals), 6, "share")


@query("quality_checklist", """with d as (select d.doc_id, l.quality, l.toxic, 'x' as fixed, case when doc_id % 3 = 0 then ' ' else lang end as lang, d.n_chars from documents d left join labels l using (doc_id)),
       s as (select count(*) as n, count(*) - count(toxic) as t, count(case when trim(lang) = '' then 1 end) as b from d)
       select 'toxic' as "column", case when floor(100 * t / n) > 40 then 'critical' else 'warning' end as severity, 'Missing values detected' as title, floor(100 * t / n)::int as share, 'impute_mode,exclude' as actions from s
       union all select 'lang', case when floor(100 * b / n) > 40 then 'critical' else 'warning' end, 'Missing values detected', floor(100 * b / n)::int, 'impute_mode,exclude' from s
       union all select 'fixed', 'critical', 'Constant column', null, 'exclude' union all select 'doc_id', 'info', 'Potential identifier column', null, 'exclude'""")
def _(t):
    lang = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))
    return q.quality_checklist(docs(t).select("doc_id", "quality", "toxic", F.lit("x").alias("fixed"), lang.alias("lang"), "n_chars"), "quality")


@query("typical_row", """select 'l_quantity' as "column", round(quantile_cont(l_quantity, 0.5), 0) as number, null as category from lineitem
       union all select 'l_extendedprice', round(quantile_cont(l_extendedprice, 0.5), 4), null from lineitem
       union all select 'l_returnflag', null, (select l_returnflag from lineitem group by 1 order by count(*) desc, 1 limit 1)""")
def _(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(p.typical_row(p.profile(rows), p.top_categories(rows, rows.columns, 1)), 4, "number")


@query("runs_by_dataset", """with r as (select o_orderpriority as dataset, o_orderdate as ts, o_orderkey as run from orders)
       select r.dataset, r.run, r.ts, row_number() over (partition by r.dataset order by r.ts desc, r.run) as place, latest, runs
       from r join (select dataset, max(ts) as latest, count(*) as runs from r group by 1) using (dataset)""")
def _(t):
    runs = t.orders.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("run"))
    return q.runs_by_dataset(runs)


@query("profile", f"""select c."column", c.rows, c.missing, c.nunique, t.type, case when t.type = 'numeric' then s.min end as min, case when t.type = 'numeric' then s.max end as max,
       case when t.type = 'numeric' then s.mean end as mean, case when t.type = 'numeric' then s.std end as std, case when t.type = 'numeric' then s.p25 end as p25,
       case when t.type = 'numeric' then s.p50 end as p50, case when t.type = 'numeric' then s.p75 end as p75
       from ({counts_sql("lineitem", LINE_COLS)}) c join ({type_sql("lineitem", LINE_KINDS)}) t on t."column" = c."column"
       left join ({stats_sql("lineitem", LINE_COLS[:8])}) s on s."column" = c."column" """)
def _(t):
    out = p.profile(t.lineitem).select("column", "rows", "missing", "nunique", "type", *STATS)
    return rounded(out, 4, *STATS)
