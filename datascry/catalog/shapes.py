"""Vectors and box annotations."""

from datascry.catalog import query
from datascry.catalog.scalars import BOXES, boxes
from datascry.operators import boxes as bx
from datascry.operators import vectors as vec

from pyspark.sql import functions as F


@query("intensity_stats", """select vec_id, round(list_avg(e), 6) as mean, round(list_stddev_pop(e), 6) as std from (select vec_id, embedding::double[] as e from embeddings)""")
def _(t):
    out = vec.intensity_stats(t.embeddings, "embedding", ["vec_id"])
    return out.select("vec_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("class_mean_vector", """select label, (pos - 1)::int as pos, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2""")
def _(t):
    return vec.class_mean_vector(t.embeddings, "embedding", "label").withColumn("mean", F.round("mean", 6))


@query("pixel_histogram", """with v as (select least(greatest((x + 1) * 127.5, 0), 255) as p from (select unnest(embedding)::double as x from embeddings)), n as (select least(floor(p * 10 / 255), 9)::int as bin, count(*) as n from v group by 1)
       select b.bin, round(coalesce(n, 0) * 100.0 / (select count(*) from v), 6)::double as pct from (select unnest(range(10))::int as bin) b left join n on n.bin = b.bin""")
def _(t):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.greatest((x + 1) * 127.5, F.lit(0.0)), F.lit(255.0)))
    return vec.pixel_histogram(t.embeddings.select(scaled.alias("p")), "p").withColumn("pct", F.round("pct", 6))


@query("pca_compress")
def _(t):
    out = vec.pca_compress(t.embeddings, "embedding", 10)[1]
    return out.select("vec_id", F.transform("components", lambda x: F.round(F.abs(x), 4)).alias("components"))


@query("reshape_square", """select vec_id, 8 as h, 8 as w, 1 as c, round(list_sum(embedding::double[]), 5) as total from embeddings""")
def _(t):
    out = vec.reshape_square(t.embeddings, "embedding", ["vec_id"])
    return out.select("vec_id", "h", "w", "c", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("classify_vectors")
def _(t):
    return vec.classify_vectors(t.embeddings, "embedding", "label", "vec_id")


@query("segmentation_metrics", """with p as (select label, x > 0 as t, x + sin(vec_id + pos) * 0.1 > 0 as p from (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings)),
       s as (select label, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn from p group by 1)
       select label, round(tp / (tp + fp + fn), 6) as iou, round(2 * tp / (2 * tp + fp + fn), 6) as dice, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((tp + fn) / (tp + fp + fn + tn), 6) as foreground from s""")
def _(t):
    base = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select("vec_id", "label", F.transform(base, lambda x: (x > 0).cast("double")).alias("truth"),
                               F.transform(base, lambda x, i: (x + F.sin(F.col("vec_id") + i + 1) * 0.1 > 0).cast("double")).alias("pred"))
    out = vec.segmentation_metrics(rows, "truth", "pred", by=["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "accuracy", "foreground")])


@query("box_class_counts", f"""select class_id, case class_id when 0 then 'zero' when 1 then 'one' when 2 then 'two' else 'class_' || class_id end as class_name, count(*) as n from {BOXES} group by 1""")
def _(t):
    names = t.spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "class_id int, class_name string")
    return bx.box_class_counts(boxes(t), names)


SPLIT = "case when i % 10 < 7 then 'train' when i % 10 < 9 then 'val' else 'test' end"


@query("box_split_counts", f"""with im as (select 'img' || i as image_stem, {SPLIT} as split from (select distinct o_orderkey // 12 as i from orders)),
       b as (select image_stem, count(*) as n from {BOXES} group by 1) select split, count(*) as images, sum(coalesce(n, 0))::bigint as annotations, round(avg(coalesce(n, 0)), 6) as mean_per_image from im left join b using (image_stem) group by 1""")
def _(t):
    def split(i):
        return F.when(i % 10 < 7, "train").when(i % 10 < 9, "val").otherwise("test")

    i = F.floor(F.col("o_orderkey") / 12)
    images = t.orders.select(F.concat(F.lit("img"), i).alias("image_stem"), split(i).alias("split")).distinct()
    marked = boxes(t).withColumn("split", split(F.floor(F.col("l_orderkey") / 15)))
    return bx.box_split_counts(images, marked).withColumn("mean_per_image", F.round("mean_per_image", 6))


@query("box_area_hist", f"""with a as (select w * h * 100 as a from {BOXES}), s as (select greatest(max(a) / 20, 0.001) as s from a) select round(floor(a / s) * s, 4) as x_num, count(*) as n from a, s group by 1""")
def _(t):
    return bx.box_area_hist(boxes(t))


@query("box_aspect_hist", f"""select round(floor(r / 0.25) * 0.25, 2) as x_num, count(*) as n from (select case when h > 0 then w / h else 0 end as r from {BOXES}) group by 1""")
def _(t):
    return bx.box_aspect_hist(boxes(t))


@query("box_centre_points", f"""select l_orderkey, l_linenumber, cx, cy from {BOXES} where ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::bigint % 1000000 < round(1000000 * least(1.0, 2000.0 / (select count(*) from lineitem)))""")
def _(t):
    return bx.box_centre_points(boxes(t), ["l_orderkey", "l_linenumber"])


FEATURES = ["x_center", "y_center", "width", "height", "area", "aspect_ratio"]


@query("box_correlations", "\nunion all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as value from (select cx as x_center, cy as y_center, w as width, h as height, w * h as area, w / case when h = 0 then 1e-6 else h end as aspect_ratio from {BOXES})"
                                             for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]))
def _(t):
    return bx.box_correlations(boxes(t)).withColumn("value", F.round("value", 6))


@query("classes_present", f"select image_stem, string_agg(c, ', ' order by c) as classes from (select distinct image_stem, 'class_' || class_id as c from {BOXES}) group by 1")
def _(t):
    return bx.classes_present(boxes(t))


PRED = f"(select l_orderkey, l_linenumber, image_stem, class_id, cx + (l_orderkey % 3 - 1) * 0.005 as cx, cy, w * 1.1 as w, h, round(0.3 + (l_orderkey * 7 + l_linenumber * 13) % 70 / 100.0, 2)::double as score from {BOXES})"
IOU = """greatest(0, least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2)) * greatest(0, least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2))"""
PAIRS = f"""select image_stem, class_id, t_n, p_n, round(i / (t_w * t_h + p_w * p_h - i), 6) as iou from (
  select a.image_stem, a.class_id, a.n as t_n, b.n as p_n, a.w as t_w, a.h as t_h, b.w as p_w, b.h as p_h, {IOU} as i
  from (select image_stem, class_id, cx, cy, w, h, count(*) as n from {BOXES} where w > 0 and h > 0 group by all) a
  join (select image_stem, class_id, cx, cy, w, h, count(*) as n from {PRED} where w > 0 and h > 0 group by all) b on a.image_stem = b.image_stem and a.class_id = b.class_id)
  where i / (t_w * t_h + p_w * p_h - i) >= 0.5"""


def predictions(t, b=None):
    b = boxes(t) if b is None else b
    score = F.round(F.lit(0.3) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 70 / 100, 2)
    moved = b.select("l_orderkey", "l_linenumber", "image_stem", "class_id", (F.col("cx") + (F.col("l_orderkey") % 3 - 1) * 0.005).alias("cx"), "cy",
                     (F.col("w") * 1.1).alias("w"), "h", score.alias("score"))
    # Some order lines share both numbers; their place in the table's own values tells them apart.
    return moved.withColumn("p_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "cx", "cy", "w", "h"))


@query("box_iou_pairs", PAIRS)
def _(t):
    out = bx.box_iou_pairs(boxes(t), predictions(t))
    return out.select("image_stem", "class_id", "t_n", "p_n", F.round("iou", 6).alias("iou"))


@query("box_iou_pairs_grid", PAIRS)
def _(t):
    out = bx.box_iou_pairs(boxes(t), predictions(t), limit=1)
    return out.select("image_stem", "class_id", "t_n", "p_n", F.round("iou", 6).alias("iou"))


@query("detection_map")
def _(t):
    # Numbers of a known order line name its image and class, so its copies meet where the image's boxes do, and only numbers travel; the others meet by p_id.
    b, known = boxes(t), F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    pred = predictions(t, b.filter(known).repartition("image_stem", "class_id")).dropDuplicates(["image_stem", "class_id", "p_id"])
    rest = b.filter(~known)
    if not rest.isEmpty():
        pred = pred.unionByName(predictions(t, rest).dropDuplicates(["p_id"]))
    out = bx.detection_map(b, pred)
    return out.select("class_id", "truths", F.round("map50", 6).alias("map50"), F.round("map50_95", 6).alias("map50_95"))
