"""Scalar functions over whole tables."""

from datascry.catalog import query
from datascry.functions import scalars as s
from datascry.functions import words as w

from pyspark.sql import functions as F


@query("transform_log", """select l_orderkey, l_linenumber, round(ln(1 + greatest(0, x)), 6) as x_log
       from (select *, case when l_linenumber = 3 then null else l_quantity - 5 end as x from lineitem) where x is not null
       union all select l_orderkey, l_linenumber, null from lineitem where l_linenumber = 3""")
def _(t):
    x = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_quantity") - 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(s.transform_log(x), 6).alias("x_log"))


@query("transform_power", "select l_orderkey, l_linenumber, l_quantity * l_quantity as l_quantity_power from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", s.transform_power("l_quantity").alias("l_quantity_power"))


@query("transform_interaction", "select l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) as l_quantity_x_l_discount from lineitem")
def _(t):
    both = s.transform_interaction("l_quantity", "l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(both, 6).alias("l_quantity_x_l_discount"))


@query("transform_date", """select event_id, coalesce(year(d), 2000)::int as year, coalesce(month(d), 1)::int as month, coalesce(day(d), 1)::int as day,
       coalesce(isodow(d) - 1, 0)::int as dayofweek, coalesce(hour(d), 0)::int as hour
       from (select event_id, case when event_type = 'error' then null else ts end as d from events)""")
def _(t):
    rows = t.events.withColumn("d", F.when(F.col("event_type") != "error", F.col("ts")))
    parts = s.transform_date("d", rows.schema["d"].dataType)
    return rows.select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("to_numeric", """select event_id, try_cast(x as double) as number from
       (select event_id, case when event_type = 'view' then 'n/a' else cast(event_id as varchar) || '.5' end as x from events)""")
def _(t):
    x = F.when(F.col("event_type") == "view", "n/a").otherwise(F.concat("event_id", F.lit(".5")))
    return t.events.select("event_id", s.to_numeric(x).alias("number"))


@query("to_datetime", """select o_orderkey, case when o_orderstatus = 'P' then null else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as moment from orders""")
def _(t):
    x = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select("o_orderkey", F.date_format(s.to_datetime(x), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("clip", """select l_orderkey, l_linenumber, case when x < 10 then 10.0 when x > 40 then 40.0 else x end as x
       from (select *, nullif(l_quantity, 25) as x from lineitem)""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", s.clip(F.nullif("l_quantity", F.lit(25.0)), 10.0, 40.0).alias("x"))


@query("text_metrics", r"""select doc_id, length(text)::int as chars, len(regexp_extract_all(text, '\S+'))::int as words,
       greatest(1, length(text) - length(translate(text, '.!?', '')))::int as sentences from documents""")
def _(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in w.text_metrics("text").items()])


# Test words, since the generated prose holds few words of the default lists.
UP, DOWN = ["the", "and", "le", "il"], ["of", "on", "la", "re"]
BARE = r"""list_transform(regexp_extract_all(text, '\S+'), lambda x: trim(lower(x), '.,!?"''()[]{}'))"""


def polarity_sql(up=UP, down=DOWN):
    quote = lambda ws: ", ".join(f"'{x}'" for x in ws)
    pos = f"len(list_filter(b, lambda x: x in ({quote(up)})))"
    neg = f"len(list_filter(b, lambda x: x in ({quote(down)})))"
    return f"case when {pos} + {neg} > 0 then ({pos} - {neg})::double / ({pos} + {neg}) else 0.0 end"


@query("sentiment_polarity", f"""select doc_id, round({polarity_sql()}, 6) as polarity, round({polarity_sql(w.POSITIVE_WORDS, w.NEGATIVE_WORDS)}, 6) as lexicon_polarity
       from (select doc_id, {BARE} as b from documents)""")
def _(t):
    return t.documents.select("doc_id", F.round(w.sentiment_polarity("text", UP, DOWN), 6).alias("polarity"),
                              F.round(w.sentiment_polarity("text"), 6).alias("lexicon_polarity"))


@query("lexical_diversity", f"""select doc_id, round(case when len(b) > 0 then len(list_distinct(b))::double / len(b) else 0.0 end, 6) as diversity
       from (select doc_id, {BARE} as b from documents)""")
def _(t):
    return t.documents.select("doc_id", F.round(w.lexical_diversity("text"), 6).alias("diversity"))


@query("avg_word_length", f"""select doc_id, round(case when len(b) > 0 then list_sum(list_transform(b, lambda x: length(x)))::double / len(b) else 0.0 end, 6) as word_length
       from (select doc_id, {BARE} as b from documents)""")
def _(t):
    return t.documents.select("doc_id", F.round(w.avg_word_length("text"), 6).alias("word_length"))


@query("tokenize", r"""select conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x not in ('the', 'of', 'and')) as tokens
       from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", w.tokenize("text", ["the", "of", "and"]).alias("tokens"))


TAGS = """(select user_id, case when user_id % 2 = 0 then '[' || string_agg(t, ', ' order by t) || ']' else string_agg(t, ',' order by t) end as tags
  from (select distinct user_id, case when user_id % 3 = 0 then '"' || event_type || '"' else event_type end as t from events) group by user_id)"""


def tags(t):
    """Event types per user as one text: at most five distinct values each."""
    kind = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("event_type"))
    per = t.events.select("user_id", kind.alias("t")).distinct().groupBy("user_id").agg(F.array_sort(F.collect_set("t")).alias("s"))
    text = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]"))).otherwise(F.array_join("s", ","))
    return per.select("user_id", text.alias("tags"))


@query("parse_multilabel", "select user_id, list_sort(list(distinct event_type)) as tags from events group by user_id")
def _(t):
    return tags(t).select("user_id", s.parse_multilabel("tags").alias("tags"))


@query("json_props", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(t):
    return t.events.select("event_id", *[c.alias(n) for n, c in s.json_props("props", ["k"]).items()])


@query("robust_scale", """with q as (select quantile_cont(l_quantity, 0.1) as a1, quantile_cont(l_quantity, 0.9) as a9,
       quantile_cont(l_tax, 0.1) as b1, quantile_cont(l_tax, 0.9) as b9 from lineitem)
       select l_orderkey, l_linenumber, round((l_quantity - a1) / (a9 - a1), 6) as l_quantity, round((l_tax - b1) / (b9 - b1), 6) as l_tax from lineitem, q""")
def _(t):
    from datascry.operators.encode import robust_scale

    out = robust_scale(t.lineitem, ["l_quantity", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


@query("minmax_scale", """with q as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where l_linestatus = 'F')
       select l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) as scaled from lineitem, q""")
def _(t):
    from datascry.operators.encode import minmax_scale

    train = t.lineitem.filter("l_linestatus = 'F'")
    out = minmax_scale(t.lineitem, ["l_extendedprice"], train)
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("scaled"))


BOXES = """(select l_orderkey, l_linenumber, 'img' || (l_orderkey // 15) as image_stem, (l_linenumber % 5)::int as class_id,
  l_quantity / 50 as cx, l_discount * 10 as cy, (l_tax + 0.02) * 5 as w, case when l_linenumber = 7 then 0 else l_quantity / 100 end as h from lineitem)"""


def boxes(t):
    """Boxes derived from order lines."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("img"), F.floor(F.col("l_orderkey") / 15)).alias("image_stem"),
        (F.col("l_linenumber") % 5).cast("int").alias("class_id"), (F.col("l_quantity") / 50).alias("cx"),
        (F.col("l_discount") * 10).alias("cy"), ((F.col("l_tax") + 0.02) * 5).alias("w"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") / 100).alias("h"))


@query("box_geometry", f"""select l_orderkey, l_linenumber, round(w * h, 6) as area, round(case when h > 0 then w / h else 0 end, 6) as aspect,
       greatest(0, trunc((cx - w / 2) * 640))::int as x1, greatest(0, trunc((cy - h / 2) * 480))::int as y1,
       least(640, trunc((cx + w / 2) * 640))::int as x2, least(480, trunc((cy + h / 2) * 480))::int as y2 from {BOXES}""")
def _(t):
    b = boxes(t)
    corners = s.box_corners("cx", "cy", "w", "h", 640, 480)
    return b.select("l_orderkey", "l_linenumber", F.round(s.box_area("w", "h"), 6).alias("area"),
                    F.round(s.box_aspect("w", "h"), 6).alias("aspect"), *[c.alias(n) for n, c in corners.items()])


@query("epoch_seconds", "select event_id, floor(epoch(ts))::bigint as x_num from events")
def _(t):
    return t.events.select("event_id", s.epoch_seconds("ts", t.events.schema["ts"].dataType).alias("x_num"))
