"""Metrics and curves over scored frames. Everything is computed from grouped counts; no prediction is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.operators.ordered import running_totals
from datascry.operators.sampling import sample_n

CURVE_POINTS = 100


def metrics_regression(scored: DataFrame, y: str, p: str = "prediction", by=()) -> DataFrame:
    """One row, or one per group: (by...), rows, r2, mse, rmse, mae."""
    actual, guess = F.col(y).cast("double"), F.col(p).cast("double")
    miss = actual - guess
    both = scored.filter(actual.isNotNull() & guess.isNotNull())
    total = F.var_pop(actual) * F.count(actual)
    sse = F.sum(miss * miss)
    return both.groupBy(*by).agg(F.count("*").alias("rows"), F.when(total > 0, 1 - sse / total).alias("r2"), (sse / F.count("*")).alias("mse"),
                    F.sqrt(sse / F.count("*")).alias("rmse"), F.avg(F.abs(miss)).alias("mae"))


def confusion_matrix(scored: DataFrame, y: str, p: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted)."""
    return scored.groupBy(F.col(y).cast("string").alias("actual"), F.col(p).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(scored: DataFrame, y: str, p: str = "prediction") -> DataFrame:
    """Per class: support, predicted, hits, precision, recall, f1; a division by zero gives 0."""
    cells = confusion_matrix(scored, y, p)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    seen = cells.select(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_n"), hit.alias("hits"))
    told = cells.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted_n"),
                        F.lit(0).cast("long").alias("hits"))
    table = seen.unionByName(told).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted"), F.sum("hits").alias("hits"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("predicted") + F.col("support"))).otherwise(F.lit(0.0))
    return table.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def metrics_classification(scored: DataFrame, y: str, p: str = "prediction") -> DataFrame:
    """One row: rows, accuracy and support-weighted precision, recall and f1."""
    table = class_metrics(scored, y, p)
    weighted = lambda c: (F.sum(F.col("support") * F.col(c)) / F.sum("support")).alias(c)
    return table.agg(F.sum("support").alias("rows"), (F.sum("hits") / F.sum("support")).alias("accuracy"),
                     weighted("precision"), weighted("recall"), weighted("f1"))


def evaluate_split(scored: DataFrame, y: str, p: str = "prediction", split: str = "val", classification: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Metrics (and confusion counts of a classifier) on one split."""
    rows = scored.filter(F.col("split") == split)
    if classification:
        return metrics_classification(rows, y, p), confusion_matrix(rows, y, p)
    return metrics_regression(rows, y, p), None


def _cumulative(scored: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positives from the highest score down, per different score; NaN and null scores are left out.

    Scores are counted first and lie in ranges; ranges are added up once, running sums stay inside a range.
    """
    value, positive = F.col(score).cast("double"), F.col(label) == 1
    counts = scored.filter(value.isNotNull() & ~F.isnan(value)).groupBy((-value).alias("down")).agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg"))
    told = running_totals(counts, [], ["down"], {"tp": "pos", "fp": "neg", "at": F.lit(1)})
    return told.select((-F.col("down")).alias("threshold"), "pos", "neg", "at", F.col("at_all").alias("points"), "tp", "fp",
                       F.col("tp_all").alias("all_pos"), F.col("fp_all").alias("all_neg"))


def _thin(points: DataFrame) -> DataFrame:
    """At most CURVE_POINTS evenly spaced points of the curve, first and last kept."""
    keep = (F.col("points") <= CURVE_POINTS) | (
        F.floor((F.col("at") - 1) * (CURVE_POINTS - 1) / (F.col("points") - 1)) != F.floor((F.col("at") - 2) * (CURVE_POINTS - 1) / (F.col("points") - 1)))
    return points.filter((F.col("at") == 1) | keep).drop("at", "points")


def _share(part, whole) -> Column:
    """part / whole, null where there is none."""
    return F.try_divide(part, whole)


def roc_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr, auc) per different score, thinned after the area by trapezoids over all scores is taken."""
    c = _cumulative(scored, label, score).withColumns({
        "tpr": _share(F.col("tp"), F.col("all_pos")), "fpr": _share(F.col("fp"), F.col("all_neg")),
        "before": _share(F.col("tp") - F.col("pos"), F.col("all_pos")), "step": _share(F.col("neg"), F.col("all_neg"))})
    area = c.agg(F.sum(F.col("step") * (F.col("tpr") + F.col("before")) / 2)).first()[0]
    return _thin(c.select("at", "points", "threshold", "fpr", "tpr", F.lit(area).cast("double").alias("auc")))


def pr_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall, average_precision, baseline) per different score, thinned last."""
    c = _cumulative(scored, label, score).withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": _share(F.col("tp"), F.col("all_pos")),
        "baseline": F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))})
    area = c.agg(F.sum(_share(F.col("pos"), F.col("all_pos")) * F.col("precision"))).first()[0]
    return _thin(c.select("at", "points", "threshold", "precision", "recall", F.lit(area).cast("double").alias("average_precision"), "baseline"))


def calibration_curve(scored: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score against positive rate per uniform bin, empty bins left out."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"),
                                               F.count("*").alias("n"))


def pred_vs_actual_classes(scored: DataFrame, y: str, p: str = "prediction") -> DataFrame:
    """Rows per class among the actual and the predicted labels."""
    table = class_metrics(scored, y, p)
    return table.select("class", F.col("support").alias("actual"), "predicted")


def scatter_sample(scored: DataFrame, key, y: str, p: str = "prediction", n: int = 200) -> DataFrame:
    """About n (actual, predicted) points, chosen by key hash."""
    rows = sample_n(scored, key, n)
    keys = [key] if isinstance(key, str) else list(key)
    return rows.select(*keys, F.col(y).alias("actual"), F.col(p).alias("predicted"))


def residuals(scored: DataFrame, key, y: str, p: str = "prediction", n: int = 300) -> DataFrame:
    """About n (predicted, residual) points, chosen by key hash."""
    points = scatter_sample(scored, key, y, p, n)
    return points.withColumn("residual", F.col("actual") - F.col("predicted")).drop("actual")


def dummy_baseline(train: DataFrame, test: DataFrame, t: str, classification: bool = True) -> DataFrame:
    """Test rows with the most frequent training class, or the training mean, as prediction."""
    known = train.filter(F.col(t).isNotNull())
    if classification:
        counts = known.groupBy(t).agg(F.count("*").alias("n"))
        best = counts.orderBy(F.desc("n"), t).limit(1).select(t).scalar()
    else:
        best = known.agg(F.avg(t)).scalar()
    return test.withColumn("prediction", best)


def linear_attribution(df: DataFrame, features: list[str], coefficients: list[float], means: dict[str, float] | None = None) -> DataFrame:
    """Mean |coefficient * (x - mean)| per feature, strongest first: (feature, coefficient, importance)."""
    from datascry.operators.profile import long_rows

    if means is None:
        row = df.agg(*[F.avg(c).alias(c) for c in features]).first()
        means = {c: row[c] for c in features}
    facts = [F.struct(F.lit(c).alias("feature"), F.lit(float(b)).alias("coefficient"),
                      F.avg(F.abs(F.lit(float(b)) * (F.col(c) - F.lit(means[c])))).alias("importance")) for c, b in zip(features, coefficients)]
    return long_rows(df, [], facts).orderBy(F.desc("importance"), "feature")


