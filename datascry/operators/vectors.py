"""Vector and image operators over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.functions.scalars import column, square_shape


def _doubles(v) -> Column:
    return column(v).cast("array<double>")


def intensity_stats(df: DataFrame, v: str, keep: list[str]) -> DataFrame:
    """Mean and population deviation of each row's values: (keep..., mean, std)."""
    arr, n = _doubles(v), F.size(column(v))
    mean = F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / n
    rows = df.select(*keep, arr.alias("__a"), mean.alias("mean"))
    spread = F.aggregate(F.transform("__a", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*keep, "mean", F.sqrt(spread / F.size("__a")).alias("std"))


def image_intensity(images: DataFrame, keep: list[str], data: str = "data") -> DataFrame:
    """Mean and population deviation of decoded image bytes, scaled to 0..1."""
    @F.pandas_udf("mean double, std double")
    def stats(raw: pd.Series) -> pd.DataFrame:
        pixels = [np.frombuffer(b, dtype=np.uint8) / 255.0 for b in raw]
        return pd.DataFrame({"mean": [p.mean() for p in pixels], "std": [p.std() for p in pixels]})

    return images.select(*keep, stats(data).alias("s")).select(*keep, "s.mean", "s.std")


def class_mean_vector(df: DataFrame, v: str, label: str) -> DataFrame:
    """Element-wise mean per class: (label, pos, mean). One vector per class leaves each task."""
    rows = df.filter(F.col(label).isNotNull()).select(label, array_to_vector(_doubles(v)).alias("__v"))
    means = rows.groupBy(label).agg(Summarizer.mean(F.col("__v")).alias("__m"))
    return means.select(label, F.posexplode(vector_to_array("__m")).alias("pos", "mean"))


def pixel_histogram(df: DataFrame, v: str, bins: int = 10, top: float = 255.0) -> DataFrame:
    """Share of all values per equal bin of [0, top], in percent: (bin, pct). Values up to 1.01 are scaled up first."""
    facts = df.agg(F.max(F.array_max(v)).alias("hi"), F.sum(F.size(v)).alias("n"))
    small = facts.select(F.col("hi") <= 1.01).scalar()
    values = df.select(F.explode(_doubles(v)).alias("x"), small.alias("small"))
    values = values.select(F.when(F.col("small"), F.col("x") * top).otherwise(F.col("x")).alias("x"))
    at = F.least(F.floor(F.col("x") * bins / top), F.lit(bins - 1)).cast("int")
    counts = values.filter(F.col("x").between(0, top)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return slots.join(counts, "bin", "left").select("bin", (F.coalesce("n", F.lit(0)) * 100.0 / facts.select("n").scalar()).alias("pct"))


def pca_compress(df: DataFrame, v: str, k: int = 50, out: str = "components"):
    """(model, df with the first k principal components as an array)."""
    rows = df.withColumn("__v", array_to_vector(_doubles(v)))
    width = rows.first()["__v"].size
    model = PCA(k=min(k, width), inputCol="__v", outputCol="__pc").fit(rows)
    return model, model.transform(rows).withColumn(out, vector_to_array("__pc")).drop("__v", "__pc")


def reshape_square(df: DataFrame, v: str, keep: list[str]) -> DataFrame:
    """Height, width and channels of a square image, values scaled to 0..1 when any exceeds 1.01."""
    big = df.agg(F.max(F.array_max(v))).scalar() > 1.01
    pixels = F.transform(_doubles(v), lambda x: F.when(F.col("__big"), x / 255.0).otherwise(x))
    rows = df.select(*keep, v, square_shape(v).alias("__s"), big.alias("__big"))
    return rows.select(*keep, F.col("__s.h").alias("h"), F.col("__s.w").alias("w"), F.col("__s.c").alias("c"), pixels.alias("pixels"))


def segmentation_metrics(pairs: DataFrame, truth: str, pred: str, limit: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """IoU, Dice, pixel accuracy and foreground share from mask pairs, counted inside each row before any shuffle."""
    rows = pairs.select(*(by or []), F.zip_with(_doubles(truth), _doubles(pred), lambda a, b: F.struct((a > limit).alias("t"), (b > limit).alias("p"))).alias("z"))
    count = lambda rule: F.size(F.filter("z", rule)).cast("long")
    cells = rows.select(*(by or []), count(lambda x: x["t"] & x["p"]).alias("tp"), count(lambda x: ~x["t"] & x["p"]).alias("fp"),
                        count(lambda x: x["t"] & ~x["p"]).alias("fn"), count(lambda x: ~x["t"] & ~x["p"]).alias("tn"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    s = cells.groupBy(*by).agg(*sums) if by else cells.agg(*sums)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return s.select(*(by or []), ratio(tp, tp + fp + fn).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"),
                    ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((tp + fn) / (tp + fp + fn + tn)).alias("foreground"))


def classify_vectors(df: DataFrame, v: str, label: str, key: str, families=("logistic", "random_forest"), **params) -> DataFrame:
    """Leaderboard of classifiers on a vector column, with the majority class as baseline."""
    from datascry.operators.evaluate import dummy_baseline, metrics_classification
    from datascry.operators.models import leaderboard, train
    from datascry.operators.sampling import split_train_test

    classes = [r[0] for r in df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().limit(10_001).collect()]
    if len(classes) > 10_000:
        raise ValueError(f"{label} does not hold classes")
    classes.sort()
    code = (F.array_position(F.lit(classes), F.col(label).cast("string")) - 1).cast("double")
    rows = split_train_test(df, key).select("split", array_to_vector(_doubles(v)).alias("features"), code.alias("label")).filter("label is not null").persist()
    try:
        fit, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        models = {f: train(f, fit, "classification", len(classes), **(params if f in ("random_forest", "boosted") else {})) for f in families}
        base = metrics_classification(dummy_baseline(fit, test, "label"), "label")
        first = base.select(F.lit("majority").alias("model"), "rows", F.col("accuracy").alias("score"), "precision", "recall", "f1", F.lit(None).cast("int").alias("rank"))
        board = leaderboard(models, test, "classification").select(first.columns).unionByName(first)
        return df.sparkSession.createDataFrame(board.collect(), board.schema)
    finally:
        rows.unpersist()
