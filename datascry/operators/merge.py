"""Equi-joins: dataset merge, sidecar labels, image/mask pairs and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One key with more rows than this on a side that an outer join cannot split is joined another way.
HOT_KEY_ROWS = 5_000_000


def has_hot_key(df: DataFrame, key: str, limit: int = HOT_KEY_ROWS) -> bool:
    """Pre-aggregated check: does one non-null key hold more than `limit` rows?"""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return not counts.filter(F.col("n") > limit).isEmpty()


def merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner",
          hot_limit: int = HOT_KEY_ROWS) -> DataFrame:
    """Join two datasets on one key each.

    inner / left keep the left key, right keeps the right key, outer keeps both. Clashing right names get
    '_right'. Null keys never match. Catalyst and AQE choose the physical join; AQE splits hot keys of inner,
    semi and anti joins on both sides, but of an outer join only on the preserved side. So where a hot key
    sits on the other side, the outer join is written as an inner join plus the unmatched rows.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join type {how}")
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and not (how != "outer" and c == right_key)}
    hidden = "__right_key"
    r = right.withColumnsRenamed(clash)
    key = clash.get(right_key, right_key)
    if how in ("inner", "left"):
        r = r.withColumnRenamed(key, hidden)
        keep = left.columns + [c for c in r.columns if c != hidden]
        key = hidden
    elif how == "right":
        r = r.withColumnRenamed(key, hidden)
        keep = [c for c in left.columns if c != left_key] + r.columns
        key = hidden
    else:
        keep = left.columns + r.columns
    on = left[left_key] == r[key]
    split = (how in ("left", "outer") and has_hot_key(r, key, hot_limit)) or (
        how in ("right", "outer") and has_hot_key(left, left_key, hot_limit))
    if not split:
        out = left.join(r, on, {"outer": "full"}.get(how, how)).select(keep)
    else:
        out = left.join(r, on, "inner").select(keep)
        if how in ("left", "outer"):
            lonely = left.join(r.select(key).distinct(), on, "left_anti")
            out = out.unionByName(lonely, allowMissingColumns=True)
        if how in ("right", "outer"):
            lonely = r.join(left.select(left_key).distinct(), on, "left_anti")
            out = out.unionByName(lonely, allowMissingColumns=True)
    if how == "right":
        return out.withColumnRenamed(hidden, right_key)
    return out


def file_name(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path) -> F.Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def label_lookup(files: DataFrame, meta: DataFrame, path: str = "path") -> DataFrame:
    """Label per file: metadata by full file name, else by stem, else the parent folder, else 'default'.

    `files` holds paths relative to the dataset root, `meta` holds (name, label) with unique names.
    """
    p = F.col(path)
    parts = F.split(p, "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    base = files.withColumns({"__name": file_name(p), "__stem": file_stem(p), "__parent": parent})
    by_name = meta.select(F.col("name").alias("__name"), F.col("label").alias("__by_name"))
    by_stem = meta.select(F.col("name").alias("__stem"), F.col("label").alias("__by_stem"))
    joined = base.join(by_name, "__name", "left").join(by_stem, "__stem", "left")
    label = F.coalesce("__by_name", "__by_stem", "__parent", F.lit("default"))
    return joined.select(*files.columns, label.alias("label"))


def pair_images_masks(images: DataFrame, masks: DataFrame, path: str = "path") -> DataFrame:
    """Image and mask paths with the same file stem."""
    i = images.select(file_stem(F.col(path)).alias("stem"), F.col(path).alias("image"))
    m = masks.select(file_stem(F.col(path)).alias("stem"), F.col(path).alias("mask"))
    return i.join(m, "stem")


def run_diff(metrics: DataFrame, run_a: str, run_b: str, top_features: int = 8) -> DataFrame:
    """Two runs side by side.

    `metrics` holds (run, kind, name, value) with kind 'metric', 'model' or 'importance'. Of the importances
    only the strongest of each run are compared.
    """
    from pyspark.sql import Window

    def side(run, out):
        mine = metrics.filter(F.col("run") == run)
        w = Window.partitionBy("kind").orderBy(F.desc("value"), "name")
        ranked = mine.filter("kind = 'importance'").withColumn("rk", F.row_number().over(w))
        top = ranked.filter(F.col("rk") <= top_features).drop("rk")
        return mine.filter("kind <> 'importance'").unionByName(top).select("kind", "name", F.col("value").alias(out))

    both = side(run_a, "value_a").join(side(run_b, "value_b"), ["kind", "name"], "full")
    return both.withColumn("delta", F.col("value_b") - F.col("value_a"))
