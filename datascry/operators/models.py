"""Feature pipelines, model families, comparison and scoring on pyspark.ml. Training rows are never capped."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (IDF, CountVectorizer, Imputer, OneHotEncoder, RegexTokenizer, StopWordsRemover, StringIndexer, TargetEncoder,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import INTEGRAL, hash_bucket
from datascry.operators.cleaning import CleanerModel
from datascry.operators.evaluate import metrics_classification, metrics_regression
from datascry.operators.filters import feature_roles
from datascry.operators.networks import fit_network
from datascry.operators.ordered import numbered_by_hash
from datascry.operators.profile import TARGET_NAMES
from datascry.session import stored

SEED = 42
TEXT_TERMS = 15
MAX_CLASSES = 1000
# Training rows a task may hold in memory at most, and rows below which another task does not pay.
TASK_ROWS = 500_000
LEAST_ROWS = 20_000
# Rows from which networks are trained by numpy in the tasks, and how often rows must repeat on average for equal ones to be counted once there.
NETWORK_ROWS = 100_000
REPEATED = 3
# Families that pass over their rows again and again.
ITERATIVE = ("logistic", "linear_svm", "random_forest", "boosted", "mlp")


# ---- task and target -------------------------------------------------------------------------------------------


def task_frame(df: DataFrame, t: str, categorical: bool) -> DataFrame:
    """One row: (task, classes). Integers count as classes when at most 10 of them run without gaps from 0 or 1."""
    whole = isinstance(df.schema[t].dataType, INTEGRAL)
    values = df.filter(F.col(t).isNotNull()).select(t).distinct()
    facts = values.agg(F.count("*").alias("classes"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    if categorical:
        rule = F.lit(True)
    elif whole:
        rule = (F.col("classes") <= 10) & (F.col("hi") - F.col("lo") + 1 == F.col("classes")) & F.col("lo").isin(0, 1)
    else:
        rule = F.col("classes") <= 10
    return facts.select(F.when(F.coalesce(rule, F.lit(False)), "classification").otherwise("regression").alias("task"), "classes")


def resolve_task(df: DataFrame, t: str, categorical: bool | None = None) -> str:
    if categorical is None:
        from datascry.operators.profile import infer_column_type

        categorical = infer_column_type(df.select(t)).first()["type"] in ("categorical", "text")
    return task_frame(df, t, categorical).first()["task"]


def target_frame(df: DataFrame) -> DataFrame:
    """One row with the target: the first column named like one, else the last that is not free text."""
    for c in df.columns:
        if any(k in c.lower() for k in TARGET_NAMES):
            return df.select(F.lit(c).alias("target")).limit(1)
    choice = F.lit(df.columns[-1])
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            blanks = F.size(F.regexp_extract_all(F.col(f.name), F.lit(r"(\s+)"), F.lit(1)))
            prose = F.coalesce((F.avg(F.length(f.name)) > 60) & (F.avg(F.when(F.col(f.name).isNotNull(), blanks)) + 1 > 4), F.lit(False))
            choice = F.when(prose, choice).otherwise(F.lit(f.name))
        else:
            choice = F.lit(f.name)
    # A free-text column keeps the choice made before it; a leading one keeps the last column as fallback.
    return df.agg(choice.alias("target"))


def resolve_target(df: DataFrame) -> str:
    return target_frame(df).first()["target"]


# ---- features --------------------------------------------------------------------------------------------------


@dataclass
class Features:
    """Column roles of a feature pipeline and what the label is."""

    target: str
    task: str
    numeric: list[str] = field(default_factory=list)
    one_hot: list[str] = field(default_factory=list)
    target_encoded: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)

    @property
    def label(self) -> str:
        return "label"

    def indicator(self, i: int) -> str:
        return f"__is_{i}"


def plan_features(df: DataFrame, profile_table: DataFrame, t: str, actions: list[dict] | None = None, task: str | None = None) -> Features:
    roles = feature_roles(df, profile_table, t)
    encoded = {a["column"] for a in actions or [] if a["actionType"] == "target_encode"}
    kinds = {r["column"]: r["type"] for r in profile_table.select("column", "type").collect()}
    task = task or resolve_task(df, t, kinds.get(t) in ("categorical", "text"))
    plan = Features(t, task)
    for c, role in roles.items():
        if role == "numeric":
            plan.numeric.append(c)
        elif role == "categorical":
            (plan.target_encoded if c in encoded else plan.one_hot).append(c)
        elif role == "text":
            plan.text.append(c)
    if task == "classification":
        values = df.filter(F.col(t).isNotNull()).select(F.col(t).cast("string").alias("v")).distinct().orderBy("v").limit(MAX_CLASSES + 1).collect()
        if len(values) > MAX_CLASSES:
            raise ValueError(f"target {t} has more than {MAX_CLASSES} classes")
        plan.classes = [r["v"] for r in values]
    return plan


def with_label(df: DataFrame, plan: Features) -> DataFrame:
    """Rows with a known target, with the numeric label (class code or value) and what target encoding needs."""
    rows = df.filter(F.col(plan.target).isNotNull())
    if plan.task == "regression":
        return rows.withColumn(plan.label, F.col(plan.target).cast("double"))
    code = (F.array_position(F.lit(plan.classes), F.col(plan.target).cast("string")) - 1).cast("double")
    rows = rows.withColumn(plan.label, code).filter(F.col(plan.label) >= 0)
    if plan.target_encoded and len(plan.classes) > 2:
        rows = rows.withColumns({plan.indicator(i): (F.col(plan.label) == i).cast("double") for i in range(len(plan.classes))})
    return rows


def prepare(df: DataFrame, plan: Features) -> DataFrame:
    """Numbers as double, categories and texts as string; missing columns appear as null, so scoring never breaks."""
    have = set(df.columns)
    cols = {}
    for c in plan.numeric:
        cols[c] = F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    for c in plan.one_hot + plan.target_encoded:
        cols[c] = F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    for c in plan.text:
        cols[c] = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    return df.withColumns(cols) if cols else df


def featurize(plan: Features, stop: list[str] | None = None, terms: int = TEXT_TERMS) -> Pipeline:
    """Median numbers, one-hot and target-mean categories and weighted terms, assembled into `features`."""
    stages: list = []
    parts: list[str] = []
    if plan.numeric:
        filled = [f"{c}__num" for c in plan.numeric]
        stages.append(Imputer(inputCols=plan.numeric, outputCols=filled, strategy="median", relativeError=0.001))
        parts += filled
    if plan.one_hot:
        index, hot = [f"{c}__idx" for c in plan.one_hot], [f"{c}__hot" for c in plan.one_hot]
        stages.append(StringIndexer(inputCols=plan.one_hot, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep", dropLast=True))
        parts += hot
    if plan.target_encoded:
        index = [f"{c}__cat" for c in plan.target_encoded]
        stages.append(StringIndexer(inputCols=plan.target_encoded, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"))
        kind = "continuous" if plan.task == "regression" else "binary"
        labels = [plan.indicator(i) for i in range(len(plan.classes))] if len(plan.classes) > 2 else [plan.label]
        for n, label in enumerate(labels):
            out = [f"{c}__mean{n}" for c in plan.target_encoded]
            stages.append(TargetEncoder(inputCols=index, outputCols=out, labelCol=label, targetType=kind, smoothing=10.0, handleInvalid="keep"))
            parts += out
    for c in plan.text:
        stages += text_stages(c, f"{c}__tfidf", terms, stop)
        parts.append(f"{c}__tfidf")
    if not parts:
        raise ValueError("no usable feature column")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def text_stages(c: str, out: str, terms: int, stop: list[str] | None = None) -> list:
    """Tokens without stop words, the most frequent terms, weighted by rarity."""
    words = StopWordsRemover.loadDefaultStopWords("english") if stop is None else list(stop)
    return [
        RegexTokenizer(inputCol=c, outputCol=f"{out}_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        StopWordsRemover(inputCol=f"{out}_w", outputCol=f"{out}_k", stopWords=words),
        CountVectorizer(inputCol=f"{out}_k", outputCol=f"{out}_c", vocabSize=terms),
        IDF(inputCol=f"{out}_c", outputCol=out),
    ]


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Slot names of an assembled vector, from its metadata."""
    attrs = df.schema[column].metadata.get("ml_attr", {})
    slots = sorted((a["idx"], a.get("name", str(a["idx"]))) for group in attrs.get("attrs", {}).values() for a in group)
    return [n for _, n in slots] or [str(i) for i in range(attrs.get("num_attrs", 0))]


# ---- families --------------------------------------------------------------------------------------------------


def regressor(family: str, rows: int, label: str = "label", features: str = "features", trees: int = 50, depth: int = 5, alpha: float | None = None,
              prediction: str = "prediction") -> Estimator:
    cols = {"labelCol": label, "featuresCol": features, "predictionCol": prediction}
    if family == "linear":
        return LinearRegression(regParam=0.0, **cols)
    if family == "ridge":
        return LinearRegression(regParam=(1.0 if alpha is None else alpha) / max(rows, 1), elasticNetParam=0.0, standardization=False, **cols)
    if family == "lasso":
        return LinearRegression(regParam=0.1 if alpha is None else alpha, elasticNetParam=1.0, standardization=False, **cols)
    if family == "random_forest":
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=SEED, **cols)
    if family == "boosted":
        return GBTRegressor(maxIter=trees, maxDepth=depth, seed=SEED, **cols)
    raise ValueError(f"unknown regressor {family}")


def classifier(family: str, classes: int, width: int | None = None, label: str = "label", features: str = "features", trees: int = 50, depth: int = 5,
               iterations: int = 100, prediction: str = "prediction") -> Estimator:
    cols = {"labelCol": label, "featuresCol": features, "predictionCol": prediction}
    if family == "logistic":
        return LogisticRegression(maxIter=iterations, **cols)
    if family == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, **cols)
    if family == "boosted":
        one = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED, **cols)
        return one if classes <= 2 else OneVsRest(classifier=one, **cols)
    if family == "mlp":
        if width is None:
            raise ValueError("a network needs the number of features")
        return MultilayerPerceptronClassifier(layers=[width, 64, 32, max(classes, 2)], maxIter=iterations, seed=SEED, **cols)
    if family == "multinomial_nb":
        return NaiveBayes(modelType="multinomial", **cols)
    if family == "complement_nb":
        return NaiveBayes(modelType="complement", **cols)
    if family == "linear_svm":
        one = LinearSVC(maxIter=iterations, regParam=0.01, **cols)
        return one if classes <= 2 else OneVsRest(classifier=one, **cols)
    raise ValueError(f"unknown classifier {family}")


def spread_rows(rows: DataFrame, n: int) -> DataFrame:
    """The n rows dealt evenly over every core, at most TASK_ROWS to a task: a scan gives a task whole row groups or files, however few there are."""
    parts = max(-(-n // TASK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    return rows.repartition(parts) if parts > 1 else rows


def counted_rows(rows: DataFrame, task: str, label: str, features: str) -> DataFrame:
    """Equal rows once, with how often they occur in __weight; for regression rows of equal features, with their mean label.

    Boosted trees fitted on these are those of the single rows: a sum over rows of equal features is the weight times the mean, and the
    spread inside them falls out of every gain.
    """
    if task == "regression":
        return rows.groupBy(features).agg(F.avg(label).alias(label), F.count(label).cast("double").alias("__weight"))
    return rows.groupBy(features, label).agg(F.count("*").cast("double").alias("__weight"))


def train(family: str, rows: DataFrame, task: str, classes: int = 0, **params):
    """Fit one family on rows that hold `features` and the label."""
    label, features = params.get("label", "label"), params.get("features", "features")
    n = rows.count()
    if family == "boosted":
        rows = stored(counted_rows(rows.select(label, features), task, label, features), "counted")
        spread = spread_rows(rows, rows.count())
        if task == "regression":
            return regressor(family, n, **params).setWeightCol("__weight").fit(spread)
        model = classifier(family, classes, **params)
        return model.setWeightCol("__weight").fit(spread)
    if family == "mlp" and task == "classification" and n > NETWORK_ROWS:
        return train_network(rows.select(label, features), n, classifier(family, classes, rows.first()[features].size, **params))
    if family in ITERATIVE:
        rows = spread_rows(rows.select(label, features), n)
    if task == "regression":
        return regressor(family, n, **params).fit(rows)
    width = rows.first()[features].size if family == "mlp" else None
    return classifier(family, classes, width, **params).fit(rows)


def train_network(rows: DataFrame, n: int, network: MultilayerPerceptronClassifier):
    """`network` fitted on all n rows. Where rows are equal REPEATED times over on average, each kind is one point that counts as often as its rows."""
    x, label, classes = F.col("x"), F.col("label"), network.getLayers()[-1]
    points = rows.select(F.col(network.getLabelCol()).alias("label"), vector_to_array(network.getFeaturesCol()).alias("x"))
    points = stored(spread_rows(points, n), "points")
    right = label.between(0, classes - 1) & (F.floor(label) == label)
    known = (F.size(x) == network.getLayers()[0]) & F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    facts = points.agg(F.approx_count_distinct(F.xxhash64("label", "x")).alias("kinds"), F.count_if(F.coalesce(right & known, F.lit(False))).alias("good"), F.count("*").alias("rows")).first()
    if facts["good"] < facts["rows"]:
        raise ValueError(f"labels must be whole numbers below {classes}, and features finite numbers, {network.getLayers()[0]} a row")
    points = points.withColumn("label", label.cast("int"))
    if facts["kinds"] * REPEATED > facts["rows"]:
        return fit_network(network, points.withColumn("times", F.lit(1.0)), float(facts["rows"]))
    points = stored(points.groupBy("label", "x").agg(F.count("*").cast("double").alias("times")), "counted")
    return fit_network(network, stored(spread_rows(points, points.count()), "points"), float(facts["rows"]))


def train_logistic(rows, classes, **params):
    return train("logistic", rows, "classification", classes, **params)


def train_linear(rows, **params):
    return train("linear", rows, "regression", **params)


def train_ridge_lasso(rows, **params):
    return {f: train(f, rows, "regression", **params) for f in ("ridge", "lasso")}


def train_random_forest(rows, task, classes=0, **params):
    return train("random_forest", rows, task, classes, **params)


def train_boosted(rows, task, classes=0, **params):
    return train("boosted", rows, task, classes, **params)


def train_mlp(rows, classes, **params):
    return train("mlp", rows, "classification", classes, **params)


TEXT_FAMILIES = ("multinomial_nb", "complement_nb", "logistic", "linear_svm", "boosted", "random_forest")


def train_text_models(rows: DataFrame, classes: int, families=TEXT_FAMILIES, **params) -> dict:
    return {f: train(f, rows, "classification", classes, **(params if f in ("boosted", "random_forest") else {})) for f in families}


def train_multilabel(rows: DataFrame, tags: str, known: list[str], features: str = "features", family: str = "logistic") -> dict:
    """One binary model per tag. The rows are kept in memory over the fits."""
    kept = rows.persist()
    try:
        return {tag: classifier(family, 2, label="__tag", features=features, prediction=f"pred_{tag}")
                .setParams(rawPredictionCol=f"raw_{tag}", probabilityCol=f"prob_{tag}")
                .fit(kept.withColumn("__tag", F.array_contains(tags, tag).cast("double"))) for tag in known}
    finally:
        kept.unpersist()


def predict_multilabel(models: dict, rows: DataFrame) -> DataFrame:
    for model in models.values():
        rows = model.transform(rows)
    hits = F.array(*[F.when(F.col(f"pred_{tag}") == 1, F.lit(tag)) for tag in models])
    out = rows.withColumn("predicted_tags", F.filter(hits, lambda x: x.isNotNull()))
    return out.drop(*[f"{p}_{tag}" for tag in models for p in ("pred", "raw", "prob")])


def subset_accuracy(scored: DataFrame, tags: str, known: list[str], predicted: str = "predicted_tags") -> DataFrame:
    """Share of rows whose whole tag set is right."""
    actual = F.filter(F.lit(list(known)), lambda k: F.array_contains(F.col(tags), k))
    same = (F.array_sort(F.array_distinct(actual)) == F.array_sort(F.array_distinct(predicted))).cast("double")
    return scored.agg(F.count("*").alias("rows"), F.avg(same).alias("accuracy"))


# ---- comparison ------------------------------------------------------------------------------------------------


def leaderboard(models: dict, test: DataFrame, task: str, label: str = "label") -> DataFrame:
    """One row per model with its test metrics; rank 1 is best, and of equal scores the later model."""
    board = None
    for order, (name, model) in enumerate(models.items()):
        scored = model.transform(test)
        if task == "classification":
            m = metrics_classification(scored, label).select("rows", F.col("accuracy").alias("score"), "precision", "recall", "f1")
        else:
            m = metrics_regression(scored, label).select("rows", F.col("r2").alias("score"), "mse", "rmse", "mae")
        row = m.select(F.lit(name).alias("model"), F.lit(order).alias("order"), "*")
        board = row if board is None else board.unionByName(row)
    # One row per model: a single window is bounded.
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("score"), F.desc("order"))
    return board.withColumn("rank", F.row_number().over(w)).drop("order")


def best_model(board: DataFrame) -> str:
    return board.filter("rank = 1").first()["model"]


def _evaluator(task: str, label: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return RegressionEvaluator(labelCol=label, metricName="r2")


def apply_unfitted(pipeline: Pipeline, rows: DataFrame) -> tuple[DataFrame, Pipeline]:
    """Rows with the stages that learn nothing and need only columns at hand applied, without the inputs that no later stage reads, and the other stages."""
    rest, used = [], set()
    for stage in pipeline.getStages():
        needs = _columns(stage, "inputCol", "inputCols")
        if isinstance(stage, Transformer) and needs and set(needs) <= set(rows.columns):
            rows = stage.transform(rows)
            used |= set(needs)
        else:
            rest.append(stage)
    read = {c for stage in rest for c in _columns(stage, *[p.name for p in stage.params if p.name.endswith(("Col", "Cols"))])}
    return rows.drop(*[c for c in used if c not in read]), Pipeline(stages=rest)


def _columns(stage, *names: str) -> list[str]:
    """The columns that the named parameters of a stage hold."""
    held = [stage.getOrDefault(n) for n in names if stage.hasParam(n) and stage.isDefined(n)]
    return [c for v in held for c in ([v] if isinstance(v, str) else v)]


def cross_validate(pipeline: Pipeline, rows: DataFrame, key, task: str, label: str = "label", k: int = 5, parallelism: int = 4) -> DataFrame:
    """Mean score and spread over k hash folds; the whole pipeline is refitted per fold, so no fold leaks.

    k falls to the size of the smallest class. Leading stages that learn nothing (tokens of texts) run once for all folds.
    """
    if task == "classification":
        smallest = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
        k = max(2, min(k, smallest))
    folded = rows.withColumn("__fold", hash_bucket(key, k, "fold").cast("int"))
    ready, rest = apply_unfitted(pipeline, folded)
    folded = stored(spread_rows(ready, rows.count()), "folded")
    cv = CrossValidator(estimator=rest, estimatorParamMaps=[{}], evaluator=_evaluator(task, label), numFolds=k, foldCol="__fold",
                        parallelism=parallelism)
    fitted = cv.fit(folded)
    return rows.sparkSession.createDataFrame([(k, float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0]))], "folds int, mean double, std double")


def tune(rows: DataFrame, task: str, classes: int = 0, family: str = "random_forest", trials: int = 50, label: str = "label", parallelism: int = 4):
    """Best of `trials` seeded random settings on an 80/20 split inside the training rows: (model, score, settings)."""
    rng = random.Random(SEED)
    base = regressor(family, 0, label) if task == "regression" else classifier(family, classes, label=label)
    inner = base.getClassifier() if isinstance(base, OneVsRest) else base
    count = inner.numTrees if family == "random_forest" else inner.maxIter
    settings = [{count: rng.randint(10, 100), inner.maxDepth: rng.randint(3, 10)} for _ in range(trials)]
    search = TrainValidationSplit(estimator=base, estimatorParamMaps=settings or ParamGridBuilder().build(), evaluator=_evaluator(task, label),
                                  trainRatio=0.8, parallelism=parallelism, seed=SEED)
    kept = spread_rows(rows, rows.count()).persist()
    try:
        fitted = search.fit(kept)
    finally:
        kept.unpersist()
    best = max(range(len(settings)), key=lambda i: fitted.validationMetrics[i])
    return fitted.bestModel, fitted.validationMetrics[best], {p.name: v for p, v in settings[best].items()}


def rfe_select(rows: DataFrame, task: str, names: list[str], label: str = "label", features: str = "features", trees: int = 50, depth: int = 5,
               keep: int | None = None) -> list[str]:
    """Drop a fifth of the features a round by forest importance until max(10, half) are left."""
    want = max(10, len(names) // 2) if keep is None else keep
    step = max(1, int(0.2 * len(names)))
    left = list(range(len(names)))
    kept = rows.select(label, features).persist()
    try:
        while len(left) > want:
            sliced = VectorSlicer(inputCol=features, outputCol="__rfe", indices=left).transform(kept)
            model = train("random_forest", sliced, task, 2, label=label, features="__rfe", trees=trees, depth=depth)
            weight = model.featureImportances.toArray()
            drop = min(step, len(left) - want)
            worst = sorted(range(len(left)), key=lambda i: (weight[i], i))[:drop]
            left = [f for i, f in enumerate(left) if i not in set(worst)]
    finally:
        kept.unpersist()
    return [names[i] for i in left]


# ---- explanation -----------------------------------------------------------------------------------------------


def feature_importance(model, names: list[str], spark: SparkSession, k: int = 10) -> DataFrame:
    """Strongest features of a tree or linear model: (feature, importance)."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        weights = abs(model.coefficients.toArray())
    rows = sorted(((n, float(w)) for n, w in zip(names, weights)), key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(model, test: DataFrame, features: list[str], task: str, label: str = "label", repeats: int = 5, k: int = 10) -> DataFrame:
    """Drop of the score when one input column is shuffled over all rows: (feature, importance), the mean of `repeats` shuffles.

    `model` starts from the raw columns (a pipeline). Rows are numbered once by one hash and once per repeat by another; a row
    takes the feature of the row with its number, so every value can come from any row. All repeats meet the rows in one job:
    the rows are shuffled once, only values and numbers travel besides, and each row is scored once per feature and repeat.
    """
    rows = stored(test.withColumn("__row", F.monotonically_increasing_id()), "permuted")
    rows = stored(numbered_by_hash(rows.withColumn("__seed", F.lit(0)), ["__row", "__seed"], [], "__n").drop("__seed"), "permuted")

    if task == "classification":
        hit = F.coalesce(F.col(label).cast("string") == F.col("prediction").cast("string"), F.lit(False))
        scores = lambda df, *by: df.groupBy(*by).agg(F.avg(hit.cast("int")).alias("score"))
    else:
        scores = lambda df, *by: metrics_regression(df, label, by=by).withColumnRenamed("r2", "score")
    base = scores(model.transform(rows)).first()["score"]
    tried = []
    for r in range(repeats):
        for place, c in enumerate(features):
            values = [F.col(f"__other_{r}.{x}" if x == c else f"`{x}`").alias(x) for x in features]
            tried.append(F.struct(F.lit(r * len(features) + place).alias("__which"), *values))
    varied = shuffle_columns(rows, features, [SEED + r for r in range(repeats)]).withColumn("__tried", F.explode(F.array(*tried)))
    varied = varied.withColumns({c: F.col(f"__tried.{c}") for c in features}).withColumn("__which", F.col("__tried.__which"))
    drops = {c: 0.0 for c in features}
    for row in scores(model.transform(varied), "__which").orderBy("__which").collect():
        drops[features[row["__which"] % len(features)]] += base - row["score"]
    table = sorted(((c, float(d / repeats)) for c, d in drops.items()), key=lambda r: (-r[1], r[0]))[:k]
    return test.sparkSession.createDataFrame(table, "feature string, importance double")


def shuffle_columns(numbered: DataFrame, columns: list[str], seeds: list[int]) -> DataFrame:
    """Rows numbered in __n from 1, with __other_0, __other_1 ...: the struct of `columns` of the row that has their number in the order of one more hash per seed."""
    out = numbered
    for r, seed in enumerate(seeds):
        other = numbered.select("__row", F.struct(*[F.col(c).alias(c) for c in columns]).alias(f"__other_{r}"), F.lit(seed).alias("__seed"))
        out = out.join(numbered_by_hash(other, ["__row", "__seed"], [], "__n").select("__n", f"__other_{r}"), "__n")
    return out


def pdp_ice(model, df: DataFrame, feature: str, key, grid: int = 20, ice: int = 10, output: str = "prediction") -> DataFrame:
    """Chart points (x_val, x_num, y, series): the mean prediction over all rows per grid value, and `ice` single rows."""
    edges = df.agg(F.min(feature).cast("double").alias("lo"), F.max(feature).cast("double").alias("hi")).first()
    lo, hi = edges["lo"], edges["hi"]
    if lo is None or lo == hi:
        return df.sparkSession.createDataFrame([], "x_val string, x_num double, y double, series string")
    values = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]

    def predict(rows):
        spread = rows.withColumn("__x", F.explode(F.lit(values))).withColumn(feature, F.col("__x"))
        out = model.transform(spread)
        if output == "probability":
            return out.withColumn("__y", vector_to_array("probability")[1])
        return out.withColumn("__y", F.col(output).cast("double"))

    chart = lambda df, series: df.select(F.lit(feature).alias("x_val"), F.col("__x").alias("x_num"), "y", series.alias("series"))
    mean = predict(df).groupBy("__x").agg(F.avg("__y").alias("y"))
    keys = [key] if isinstance(key, str) else list(key)
    chosen = df.withColumn("__h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))).orderBy("__h", *keys).limit(ice)
    numbered = chosen.withColumn("__ice", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__h", *keys)) - 1)
    single = predict(numbered).withColumn("y", F.col("__y"))
    return chart(mean, F.lit("PDP")).unionByName(chart(single, F.concat(F.lit("ICE_"), F.col("__ice"))))


# ---- persistence and scoring -----------------------------------------------------------------------------------


@dataclass
class FittedPipeline:
    """Cleaner, feature and model stages of one target, as fitted on training rows."""

    cleaner: CleanerModel | None
    stages: PipelineModel
    plan: Features
    model_name: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        """All input columns plus the prediction, named after the target; class labels are the original ones."""
        cleaned = self.cleaner.transform(df, training=False) if self.cleaner else df
        scored = self.stages.transform(prepare(cleaned, self.plan))
        out = self.plan.target or "predicted_target"
        if self.plan.task == "classification":
            value = F.element_at(F.lit(self.plan.classes), F.col("prediction").cast("int") + 1)
        else:
            value = F.col("prediction")
        keep = [c for c in cleaned.columns if c != out]
        extra = [vector_to_array("probability").alias("probabilities")] if "probability" in scored.columns else []
        return scored.select(*keep, value.alias(out), *extra)

    def save(self, spark: SparkSession, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        side = {"cleaner": self.cleaner.to_json() if self.cleaner else None, "plan": self.plan.__dict__, "model_name": self.model_name}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedPipeline:
        side = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/plan").collect()))
        cleaner = CleanerModel.from_json(side["cleaner"]) if side["cleaner"] else None
        return FittedPipeline(cleaner, PipelineModel.load(f"{path}/stages"), Features(**side["plan"]), side["model_name"])


def score_batch(fitted: FittedPipeline, df: DataFrame, out: str | None = None, fmt: str = "csv") -> DataFrame:
    """Every input row with its prediction, written to `out` when given."""
    scored = fitted.transform(df)
    if out is not None:
        flat = scored.drop("probabilities")
        writer = flat.write.mode("errorifexists")
        writer.option("header", True).csv(out) if fmt == "csv" else writer.parquet(out)
    return scored


def score_records(spark: SparkSession, fitted: FittedPipeline, records) -> DataFrame:
    """Predictions for one record, a list of records, or a dict of equally long lists."""
    if isinstance(records, dict):
        lists = [v for v in records.values() if isinstance(v, list)]
        records = [dict(zip(records, row)) for row in zip(*records.values())] if lists else [records]
    plan = fitted.plan
    wanted = plan.numeric + plan.one_hot + plan.target_encoded + plan.text
    columns = list(dict.fromkeys([c for r in records for c in r] + wanted))
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in plan.numeric else T.StringType()) for c in columns])

    def cell(c, v):
        if v is None or v == "":
            return None
        return float(v) if c in plan.numeric else str(v)

    rows = [tuple(cell(c, r.get(c)) for c in columns) for r in records]
    return fitted.transform(spark.createDataFrame(rows, schema))


