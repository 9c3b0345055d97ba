"""Whole analyses composed from the operators. Each returns a dict of small DataFrames (and the fitted pipeline)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.functions.scalars import numeric_columns
from datascry.operators import cluster, correlate, evaluate, forecast, models, quality, sampling, text, timeseries
from datascry.operators.cleaning import fit_cleaner
from datascry.operators.filters import drop_null_target
from datascry.operators.profile import boxplot_stats, dataset_type, infer_column_type, profile, skew_alert, value_counts
from datascry.session import cut_lineage

CLASSIFIERS = ("logistic", "random_forest")
REGRESSORS = ("linear", "ridge", "random_forest")


def analyze_quality(df: DataFrame, target: str | None = None, exact: bool = True) -> dict[str, DataFrame]:
    """Types, statistics, quality findings and associations of a table, without any model."""
    numeric = numeric_columns(df)
    out = {
        "dataset_type": dataset_type(df),
        "profile": profile(df, exact=exact),
        "recommendations": quality.cleaning_recommendations(df, target, exact=exact),
        "checklist": quality.quality_checklist(df, target, exact=exact),
        "snapshot": quality.dataset_snapshot(df, exact=exact),
        "correlations": correlate.corr_mixed(df, df.columns, target, exact=exact),
    }
    out["actions"] = quality.recommendation_actions(out["recommendations"], infer_column_type(df, exact=exact))
    if numeric:
        out["boxplots"] = boxplot_stats(df, numeric, exact=exact)
        out["skew"] = skew_alert(df, numeric)
    if target:
        out["leakage"] = quality.leakage_warnings(df, target)
    return out


def analyze_table(df: DataFrame, key, target: str | None = None, actions: list[dict] | None = None, families: tuple | None = None,
                  exact: bool = True, folds: int = 0, **params) -> tuple[dict[str, DataFrame], models.FittedPipeline]:
    """Clean, split, featurise, train several models, and evaluate the best: (results, fitted pipeline).

    `key` names rows, so that the split is the same on every run. Cleaning is fitted on the training rows.
    """
    target = target or models.resolve_target(df)
    rows = sampling.split_train_test(drop_null_target(df, target), key)
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    encodings = [a for a in actions or [] if a["actionType"] == "target_encode"]
    cleaner = fit_cleaner(train, [a for a in actions or [] if a not in encodings], exact) if actions else None
    if cleaner:
        train, test = cleaner.transform(train, training=True), cleaner.transform(test)
    facts = profile(train, exact=exact)
    keys = [key] if isinstance(key, str) else list(key)
    plan = models.plan_features(train.drop(*keys), facts.filter(~F.col("column").isin(keys)), target, encodings)
    ready = models.with_label(models.prepare(train, plan), plan)
    features = models.featurize(plan).fit(ready)
    # All families train on the same vectors: written once to the shared folder, not rebuilt per fit.
    fit = cut_lineage(features.transform(ready).select("features", "label"))
    held = cut_lineage(features.transform(models.with_label(models.prepare(test, plan), plan)).select("features", "label"))
    families = families or (CLASSIFIERS if plan.task == "classification" else REGRESSORS)
    fitted = {f: models.train(f, fit, plan.task, len(plan.classes), **(params if f in ("random_forest", "boosted") else {})) for f in families}
    board = models.leaderboard(fitted, held, plan.task)
    best = models.best_model(board)
    scored = fitted[best].transform(held)
    out = {"profile": facts, "leaderboard": board}
    baseline = evaluate.dummy_baseline(fit, held, "label", plan.task == "classification")
    if plan.task == "classification":
        out["baseline"] = evaluate.metrics_classification(baseline, "label")
        out["confusion"] = evaluate.confusion_matrix(scored, "label")
        out["classes"] = value_counts(train, target)
    else:
        out["baseline"] = evaluate.metrics_regression(baseline, "label")
    if hasattr(fitted[best], "featureImportances") or hasattr(fitted[best], "coefficients") or hasattr(fitted[best], "coefficientMatrix"):
        out["importances"] = models.feature_importance(fitted[best], models.feature_names(features.transform(ready.limit(1))), df.sparkSession)
    if folds:
        maker = models.classifier(best, len(plan.classes)) if plan.task == "classification" else models.regressor(best, fit.count())
        out["cross_validation"] = models.cross_validate(Pipeline(stages=[*models.featurize(plan).getStages(), maker]), ready, key, plan.task, k=folds)
    from pyspark.ml import PipelineModel

    return out, models.FittedPipeline(cleaner, PipelineModel(stages=[*features.stages, fitted[best]]), plan, best)


def analyze_series(df: DataFrame, y: str, key: list[str], ts: str | None = None, steps: int = 14) -> dict[str, DataFrame]:
    """Daily series per key: structure, stationarity, a baseline and regressions on lags, and per-series forecasts."""
    rows = timeseries.ts_prepare(df, ts)
    ts = ts or timeseries.time_column(rows)
    daily = cut_lineage(timeseries.daily_series(rows, ts, y, key))
    split = timeseries.chrono_split(daily, key, "day")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    naive = forecast.forecast_naive(train, test, key, y)
    seen, scored = forecast.forecast_regression(daily, key, "day", y, "ridge")
    board = evaluate.metrics_regression(naive, y).select(F.lit("mean").alias("model"), "*").unionByName(
        evaluate.metrics_regression(scored, y).select(F.lit("ridge").alias("model"), "*"))
    return {
        "daily": daily,
        "acf": timeseries.acf(daily, key, "day", y),
        "pacf": timeseries.pacf(daily, key, "day", y),
        "stationarity": timeseries.adf_test(daily, key, "day", y),
        "components": timeseries.seasonal_decompose(daily, key, "day", y),
        "rolling_std": timeseries.rolling_std(daily, key, "day", y),
        "leaderboard": board,
        "points": timeseries.forecast_points(seen, scored, key, "day", y),
        "residuals": timeseries.residuals_over_time(scored, "day", y, key=key),
        "autoregression": forecast.forecast_ar_per_series(train, key, "day", y, steps),
        "holt_winters": forecast.forecast_holt_winters(train, key, "day", y, steps),
    }


def analyze_text(df: DataFrame, key: str, target: str, text_column: str | None = None, stop: list[str] | None = None, max_features: int = 200,
                 families: tuple = ("multinomial_nb", "complement_nb", "logistic", "linear_svm")) -> dict[str, DataFrame]:
    """Words, tones and classes of a corpus, and a comparison of text classifiers."""
    text_column = text_column or text.pick_text_column(df, target)
    rows = df.filter(F.col(target).isNotNull())
    out = {
        "top_words": text.top_words(rows, text_column, 20, max_features, stop),
        "class_words": text.class_top_words(rows, text_column, target, 5, max_features, stop),
        "bigrams": text.ngrams(rows, text_column, 2, 10, stop),
        "trigrams": text.ngrams(rows, text_column, 3, 10, stop),
        "word_counts": text.word_count_hist(rows, text_column),
        "tones": text.sentiment_bands(rows, text_column),
        "polarity_by_class": text.polarity_by_class(rows, text_column, target),
        "words_by_class": text.words_by_class(rows, text_column, target),
        "word_boxes": text.word_box_by_class(rows, text_column, target),
        "projection": text.svd_projection(rows, [key, target], text_column, 2, max_features, stop),
    }
    split = sampling.split_train_test(rows, key)
    plan = models.Features(target, "classification", classes=[r[0] for r in rows.select(F.col(target).cast("string")).distinct().collect()])
    plan.classes.sort()
    coded = models.with_label(split, plan)
    model = text.Tfidf.fit(coded.filter("split = 'train'"), text_column, max_features, stop)
    vectors = cut_lineage(model.vectors(coded, text_column).select("split", "features", "label"))
    fitted = models.train_text_models(vectors.filter("split = 'train'"), len(plan.classes), families)
    out["leaderboard"] = models.leaderboard(fitted, vectors.filter("split = 'test'"), "classification")
    if "logistic" in fitted:
        out["informative"] = text.informative_terms(fitted["logistic"], model.vocabulary, df.sparkSession)
    return out


def analyze_clusters(df: DataFrame, key: str, cols: list[str] | None = None) -> dict[str, DataFrame]:
    """Clusters of the numeric columns with sizes, densities and a 2-D projection."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    labelled, tried = cluster.kmeans_auto_k(df, cols)
    return {
        "silhouettes": tried,
        "sizes": cluster.cluster_sizes(labelled),
        "density": cluster.cluster_density(labelled, cols[0]),
        "projection": cluster.pca_2d(labelled, [key, "cluster"]),
    }
