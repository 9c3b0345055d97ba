"""Box annotations: charts, overlap and detection quality. Boxes are (image_stem, class_id, cx, cy, w, h), normalised."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import box_area, box_aspect
from datascry.operators.correlate import corr_pearson
from datascry.operators.keys import attach, spread
from datascry.operators.sampling import sample_n
from datascry.session import cut_lineage, stored

KEYS = ["image_stem", "class_id"]
SHAPE = ["cx", "cy", "w", "h"]
# Distinct boxes of one image and class up to which overlap is tested group by group.
GROUP_BOXES = 1000
# Candidate pairs of one image and class that may be matched in one task.
GROUP_PAIRS = 500_000
# Candidate pairs that one call of the matching gets, on average.
BUCKET_PAIRS = 100_000
SCORE_BINS = 1000
IOU_STEPS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def box_class_counts(boxes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Boxes per class: (class_id, class_name, n); ids without a name become class_<id>."""
    counts = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    if names is None:
        return counts.select("class_id", F.concat(F.lit("class_"), "class_id").alias("class_name"), "n")
    both = attach(counts, names.select("class_id", "class_name"), ["class_id"])
    return both.select("class_id", F.coalesce("class_name", F.concat(F.lit("class_"), "class_id")).alias("class_name"), "n")


def box_split_counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images (also empty ones), boxes and mean boxes per image of every split. `images` holds (image_stem, split)."""
    per_image = boxes.groupBy("image_stem", "split").agg(F.count("*").alias("n"))
    both = attach(images, per_image, ["image_stem", "split"])
    n = F.coalesce("n", F.lit(0))
    return both.groupBy("split").agg(F.count("*").alias("images"), F.sum(n).alias("annotations"), F.avg(n).alias("mean_per_image"))


def box_area_hist(boxes: DataFrame, bins: int = 20) -> DataFrame:
    """Boxes per area bin in percent of the image; bins start at multiples of max / 20, at least 0.001."""
    area = box_area("w", "h") * 100
    top = boxes.agg(F.max(area)).first()[0] or 0.0
    size = max(top / bins, 0.001)
    at = F.round(F.floor(area / F.lit(size)) * F.lit(size), 4)
    return boxes.groupBy(at.alias("x_num")).agg(F.count("*").alias("n"))


def box_aspect_hist(boxes: DataFrame, size: float = 0.25, shown: int | None = None) -> DataFrame:
    """Boxes per bin of width / height, all bins unless the first `shown` are asked for."""
    at = F.round(F.floor(box_aspect("w", "h") / size) * size, 2)
    bins = boxes.groupBy(at.alias("x_num")).agg(F.count("*").alias("n")).orderBy("x_num")
    return bins if shown is None else bins.limit(shown)


def box_centre_points(boxes: DataFrame, key, n: int = 2000) -> DataFrame:
    """About n box centres, chosen by key hash."""
    rows = sample_n(boxes, key, n)
    keys = [key] if isinstance(key, str) else list(key)
    return rows.select(*keys, "cx", "cy")


def box_correlations(boxes: DataFrame) -> DataFrame:
    rows = boxes.select(F.col("cx").alias("x_center"), F.col("cy").alias("y_center"), F.col("w").alias("width"), F.col("h").alias("height"),
                        box_area("w", "h").alias("area"), box_aspect("w", "h", 1e-6).alias("aspect_ratio"))
    return corr_pearson(rows, ["x_center", "y_center", "width", "height", "area", "aspect_ratio"])


def classes_present(boxes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct class names per image, sorted and joined. Duplicates go before the grouping, so a list holds classes only."""
    kinds = boxes.select(*KEYS).distinct()
    if names is not None:
        kinds = attach(kinds, names.select("class_id", "class_name"), ["class_id"])
        label = F.coalesce("class_name", F.concat(F.lit("class_"), "class_id"))
    else:
        label = F.concat(F.lit("class_"), "class_id")
    return kinds.groupBy("image_stem").agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("classes"))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes given by column prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    side = lambda n, s: F.least(c(a, n) + c(a, s) / 2, c(b, n) + c(b, s) / 2) - F.greatest(c(a, n) - c(a, s) / 2, c(b, n) - c(b, s) / 2)
    inter = F.greatest(F.lit(0.0), side("cx", "w")) * F.greatest(F.lit(0.0), side("cy", "h"))
    union = c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _distinct_boxes(boxes: DataFrame, prefix: str) -> DataFrame:
    """Equal boxes once with their number; boxes without area or centre overlap nothing."""
    counted = boxes.filter("w > 0 and h > 0 and cx is not null and cy is not null").groupBy(*KEYS, *SHAPE).agg(F.count("*").alias(f"{prefix}n"))
    return counted.withColumnsRenamed({c: f"{prefix}{c}" for c in SHAPE})


# Powers of two of width or height that share one level of the grid.
OCTAVES = 2


def _bounds(low: Column, high: Column) -> Column:
    """The whole numbers from floor(low) to floor(high)."""
    return F.sequence(F.floor(low), F.floor(high))


def _placed(boxes: DataFrame, prefix: str, min_iou: float, truth: bool) -> DataFrame:
    """Boxes with their cells (CELL): mostly 2 for a truth box and 4 for a predicted one at an overlap of a half.

    Each axis has levels of OCTAVES powers of two, with cells wider than the boxes of the level. Two boxes meet at the level of the
    wider one. An overlap of t bounds the ratio of widths by t, so a box stands at its own level and at the few that a partner can have
    (`up`), and the distance of centres by (1 - t) / (1 + t) of the mean width: a truth box takes the cell of its centre, a predicted one
    the cells within that reach, three at most.
    """
    wide, far = -float(np.log2(min_iou)) / OCTAVES, (1 - min_iou) / (1 + min_iou) / 2
    margin = 0.0 if truth and min_iou == 1 else 1e-9
    out = boxes
    for a, n in (("x", "w"), ("y", "h")):
        length, centre, level, at = F.col(f"{prefix}{n}"), F.col(f"{prefix}c{a}"), f"__l{a}", f"__i{a}"
        power = F.log2(length) / OCTAVES
        size = F.pow(F.lit(2.0), (F.col(level) + 1) * OCTAVES)
        out = out.withColumn(level, F.explode(_bounds(power, power + wide + margin))).withColumn(f"{prefix}up{a}", F.col(level) > F.floor(power))
        if truth:
            out = out.withColumn(at, F.floor(centre / size))
        else:
            reach = (F.least(length / min_iou, size) + length) * far + size * 1e-9
            out = out.withColumn(at, F.explode(_bounds((centre - reach) / size, (centre + reach) / size)))
    return out


#: Columns that two boxes share where they meet.
CELL = ["__lx", "__ix", "__ly", "__iy"]


def _met(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Placed boxes that share a cell at the level of the wider one, so every pair once."""
    both = truth.join(pred, KEYS + CELL).filter("not (t_upx and p_upx) and not (t_upy and p_upy)")
    return both.drop(*CELL, *[f"{p}_up{a}" for p in "tp" for a in "xy"])


def box_iou_pairs(truth: DataFrame, pred: DataFrame, min_iou: float = 0.5, limit: int = GROUP_BOXES) -> DataFrame:
    """Distinct boxes of the same image and class with at least `min_iou` overlap.

    (image_stem, class_id, t_cx.., t_n, p_cx.., p_n, iou), where t_n and p_n count equal boxes. Where an image has
    more boxes of a class than `limit` (checked), boxes only meet within cells of a hierarchical grid, one level per size.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must lie in (0, 1]")
    t, p = _distinct_boxes(truth, "t_"), _distinct_boxes(pred, "p_")
    most = [df.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 for df in (t, p)]
    if max(most) <= limit:
        both = t.join(p, KEYS)
    else:
        both = _met(_placed(t, "t_", min_iou, True), _placed(p, "p_", min_iou, False))
    return both.withColumn("iou", overlap("t_", "p_")).filter(F.col("iou") >= min_iou)


# ---- detection quality -----------------------------------------------------------------------------------------


def _greedy(frame: pd.DataFrame, limits: list[float]) -> pd.DataFrame:
    """The rows of (keys..., p_id, score, t_id, t_n, iou) that stand for predictions with hits, with the limits: predictions by score, each takes its best truth that is still free."""
    ordered = frame.sort_values(["score", "p_id", "iou", "t_id"], ascending=[False, True, False, True])
    preds = ordered.groupby([*KEYS, "p_id"], sort=False, dropna=False).ngroup().to_numpy()
    truths = ordered.groupby([*KEYS, "t_id"], sort=False, dropna=False).ngroup().to_numpy()
    iou, room = ordered["iou"].to_numpy(), dict(zip(truths.tolist(), ordered["t_n"].tolist()))
    won: dict = {}
    for limit in limits:
        free, done = dict(room), set()
        near = np.flatnonzero(iou >= limit)
        for p, t in zip(preds[near].tolist(), truths[near].tolist()):
            if p not in done and free[t]:
                free[t] -= 1
                done.add(p)
                won.setdefault(p, []).append(limit)
    first = ordered.iloc[np.unique(preds, return_index=True)[1]]
    return first.iloc[list(won)].assign(limits=list(won.values()))


def _match_groups(pairs: DataFrame, limits: list[float], total: int) -> DataFrame:
    """Greedy matching of whole groups, many a task."""
    schema = T.StructType([*[pairs.schema[c] for c in (*KEYS, "p_id")], T.StructField("limits", T.ArrayType(T.DoubleType()))])
    match = lambda frame: _greedy(frame, limits)[[*KEYS, "p_id", "limits"]]
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(total // BUCKET_PAIRS + 1))
    bucketed = spread(pairs.withColumn("__bucket", bucket), ["__bucket"])
    return bucketed.groupBy("__bucket").applyInPandas(match, schema)


def _group_hits(truth: DataFrame, pred: DataFrame, limits: list[float]) -> DataFrame:
    """(class_id, bin, limits): predictions that hit a truth box, in groups that fit a task.

    Both sides are dealt by image and class once; overlap and matching happen where they lie, and nothing is written between.
    """
    t = _distinct_boxes(truth.select(*KEYS, *SHAPE).repartition(*KEYS), "t_").withColumn("t_id", F.concat_ws(",", *[f"t_{c}" for c in SHAPE]))
    # Rows of one image and class with the same p_id are one prediction; each counts in its own bin.
    bins = F.collect_list(F.struct("bin")).over(Window.partitionBy(*KEYS, "p_id"))
    p = pred.withColumn("bins", bins).filter("w > 0 and h > 0 and cx is not null and cy is not null").withColumnsRenamed({c: f"p_{c}" for c in SHAPE})
    near = t.join(p, KEYS).withColumn("iou", overlap("t_", "p_")).filter(F.col("iou") >= min(limits))
    groups = near.groupBy(*KEYS).agg(F.collect_list(F.struct("p_id", "score", "bins", "t_id", "t_n", "iou")).alias("pairs"))

    def match(batches):
        for batch in batches:
            lists = batch.column("pairs")
            pairs = lists.flatten()
            group = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            frame = pd.DataFrame({c: pairs.field(c).to_pandas() for c in ("p_id", "score", "t_id", "t_n", "iou")}).assign(image_stem=group, class_id=0, row=np.arange(len(group)))
            hits = _greedy(frame, limits)
            taken = pairs.take(pa.array(hits["row"].to_numpy()))
            classes = batch.column("class_id").take(pa.array(hits["image_stem"].to_numpy()))
            yield pa.RecordBatch.from_arrays([classes, taken.field("bins"), pa.array(hits["limits"].tolist(), pa.list_(pa.float64()))], names=["class_id", "bins", "limits"])

    schema = T.StructType([pred.schema["class_id"], T.StructField("bins", p.schema["bins"].dataType), T.StructField("limits", T.ArrayType(T.DoubleType()))])
    hits = groups.select("class_id", "pairs").mapInArrow(match, schema)
    return hits.select("class_id", "limits", F.inline("bins"))


def _match_rounds(pairs: DataFrame) -> DataFrame:
    """The same matching as rounds of joins: a prediction asks for its best truth that has not refused it, a truth of
    n equal boxes keeps its n best-scored suitors. All truths rank suitors by score, so this ends in the greedy result.
    """
    group = ["limit", *KEYS]
    asks = pairs
    while True:
        best = Window.partitionBy(*group, "p_id").orderBy(F.desc("iou"), "t_id")
        top = asks.withColumn("rk", F.row_number().over(best)).filter("rk = 1").drop("rk")
        suitor = Window.partitionBy(*group, "t_id").orderBy(F.desc("score"), "p_id")
        judged = top.withColumn("rk", F.row_number().over(suitor))
        refused = cut_lineage(judged.filter("rk > t_n").select(*group, "p_id", "t_id"))
        if refused.isEmpty():
            return judged.filter("rk <= t_n").groupBy(*KEYS, "p_id").agg(F.collect_list("limit").alias("limits"))
        asks = cut_lineage(asks.join(refused, [*group, "p_id", "t_id"], "left_anti"))


def _hits(truth: DataFrame, pred: DataFrame, limits: list[float], pair_limit: int) -> DataFrame:
    """(image_stem, class_id, p_id, limits): predictions that hit a truth box, with the limits at which they do."""
    near = box_iou_pairs(truth, pred, min(limits))
    shapes = near.select(*KEYS, F.concat_ws(",", *[f"t_{c}" for c in SHAPE]).alias("t_id"), "t_n", *[F.col(f"p_{c}").alias(c) for c in SHAPE], "iou")
    pairs = stored(shapes.join(pred.select(*KEYS, *SHAPE, "p_id", "score"), [*KEYS, *SHAPE]).drop(*SHAPE), "pairs")
    most, total = pairs.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= pair_limit:
        return _match_groups(pairs, limits, total or 0)
    return _match_rounds(pairs.withColumn("limit", F.explode(F.lit(limits))).filter("iou >= limit"))


def match_detections(truth: DataFrame, pred: DataFrame, limits: list[float] | None = None, pair_limit: int = GROUP_PAIRS) -> DataFrame:
    """Predictions that hit a truth box: (limit, image_stem, class_id, p_id). `pred` also has p_id and score.

    Equal truth boxes count as one with room for several predictions, so copies never multiply.
    """
    hits = _hits(truth, pred, [float(x) for x in limits or IOU_STEPS], pair_limit)
    return hits.select(F.explode("limits").alias("limit"), *KEYS, "p_id")


def detection_map(truth: DataFrame, pred: DataFrame, pair_limit: int = GROUP_PAIRS) -> DataFrame:
    """Average precision per class and overall (class_id null): (class_id, truths, map50, map50_95).

    Scores are cut into at most SCORE_BINS + 1 bins per class, so the curves are bounded; the area is taken under
    the falling envelope of precision.
    """
    steps = [float(x) for x in IOU_STEPS]
    every = pred.select(*KEYS, *SHAPE, "p_id", "score", F.round(F.col("score") * SCORE_BINS, 0).cast("int").alias("bin"))
    kinds = every.groupBy(*KEYS, "bin").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.sum("n").alias("rows"), F.collect_list(F.struct("bin", "n")).alias("kinds"))
    counts = stored(kinds.select("class_id", "rows", F.inline("kinds")).groupBy("class_id", "bin").agg(F.sum("n").alias("n"), F.max("rows").alias("rows")), "bins")
    most = (counts.agg(F.max("rows")).first()[0] or 0) * (truth.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0)
    if most <= pair_limit:
        marked = _group_hits(truth, every, steps)
    else:
        marked = attach(every, _hits(truth, pred, steps, pair_limit), [*KEYS, "p_id"])
    # A prediction is one row with its limits; rows per limit begin with the bounded bins.
    hits = marked.groupBy("class_id", "bin").agg(*[F.count_if(F.array_contains("limits", x)).alias(f"tp{i}") for i, x in enumerate(steps)])
    counted = attach(counts, hits, ["class_id", "bin"]).fillna(0, [f"tp{i}" for i in range(len(steps))])
    tried = F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.col(f"tp{i}").alias("tp")) for i, x in enumerate(steps)]))
    bins = counted.select("class_id", "bin", "n", tried.alias("__at")).select("__at.limit", "class_id", "bin", "__at.tp", "n")
    truths = truth.groupBy("class_id").agg(F.count("*").alias("truths"))
    group = Window.partitionBy("limit", "class_id")
    down = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    curve = attach(bins, truths, ["class_id"], "inner").select(
        "limit", "class_id", "bin", "truths", (F.sum("tp").over(down) / F.sum("n").over(down)).alias("precision"),
        (F.col("tp") / F.col("truths")).alias("step"))
    # Precision at a recall is the best precision from there on, that is at this or a lower score.
    lower = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    area = curve.withColumn("envelope", F.max("precision").over(lower)).groupBy("limit", "class_id").agg(F.sum(F.col("step") * F.col("envelope")).alias("ap"))
    per_class = area.groupBy("class_id").agg(F.max(F.when(F.col("limit") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    table = attach(truths, per_class, ["class_id"]).fillna({"map50": 0.0, "map50_95": 0.0})
    # One pass gives the classes and, in the row without a class, their mean.
    return table.rollup("class_id").agg(F.sum("truths").alias("truths"), F.avg("map50").alias("map50"), F.avg("map50_95").alias("map50_95"))
