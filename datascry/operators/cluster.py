"""Clustering with the number of clusters chosen by silhouette, and charts over cluster labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.operators.encode import standard_scores
from datascry.operators.profile import histogram
from datascry.session import stored

SEED = 42
# How often rows must repeat on average for equal ones to be counted once.
REPEATED = 3
# Points from which all numbers of clusters are fitted in the same passes, by numpy in the tasks.
MANY_POINTS = 250_000
# Passes of k-means at most, least move of a centre that counts, and rounds of picking first centres; all as pyspark.ml has them.
ROUNDS, MOVED, PICKS = 20, 1e-4, 2


def scaled_vectors(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """df with median-imputed, standardised columns assembled into `features`; the columns themselves stay."""
    return assembled(df, standard_scores(df, cols, exact))


def assembled(df: DataFrame, scores: dict) -> DataFrame:
    named = {f"__z_{c}": score for c, score in scores.items()}
    return VectorAssembler(inputCols=list(named), outputCol="features").transform(df.withColumns(named)).drop(*named)


def kmeans_auto_k(df: DataFrame, cols: list[str], ks=(2, 3, 4, 5), default: int = 3, exact: bool = True):
    """(labelled df with `cluster`, table of (k, silhouette, chosen)). The silhouette uses all rows.

    Where rows are equal in `cols` REPEATED times over on average, each kind is one point that weighs as much as its rows: the same sums, fewer points.
    """
    scores = standard_scores(df, cols, exact)
    ready = assembled(df, scores)
    total, kinds = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*cols))).first()
    if kinds * REPEATED <= total:
        points = assembled(df.groupBy(*cols).agg(F.count("*").cast("double").alias("__weight")), scores)
        vectors, weighed = points.select("features", "__weight").persist(), {"weightCol": "__weight"}
    else:
        vectors, weighed = ready.select("features").persist(), {}
    if (kinds if weighed else total) > MANY_POINTS:
        vectors.unpersist()
        weight = F.col("__weight") if weighed else F.lit(1.0)
        x = vector_to_array("features")
        tried = fitted_together(stored(vectors.select(x.alias("x"), weight.alias("weight")).select(*[F.col("x")[i].alias(f"x{i}") for i in range(len(cols))], "weight"), "points"), ks)
        return _chosen(ready, tried, default)
    try:
        judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
        silhouette = (lambda scored: weighed_silhouette(scored, len(cols))) if weighed else judge.evaluate
        tried = []
        for k in ks:
            model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster", **weighed).fit(vectors)
            found = sum(1 for size in model.summary.clusterSizes if size)
            tried.append((k, float(silhouette(model.transform(vectors))) if found > 1 else None, model))
    finally:
        vectors.unpersist()
    return _chosen(ready, tried, default)


def _chosen(ready: DataFrame, tried: list, default: int):
    known = [t for t in tried if t[1] is not None]
    best = max(known, key=lambda t: t[1]) if known else next((t for t in tried if t[0] == default), tried[0])
    table = ready.sparkSession.createDataFrame([(k, s, k == best[0]) for k, s, _ in tried], "k int, silhouette double, chosen boolean")
    return best[2].transform(ready), table


def _in_tasks(points: DataFrame, run, turn: int = 0) -> list[np.ndarray]:
    """What run(x, weight, random) gives for batches of points, an array of one shape or, where `run.rows`, rows; per task added up or put together."""

    def work(batches):
        task, out = TaskContext.get(), None
        rng = np.random.default_rng([SEED, turn, task.partitionId() if task else 0])
        for batch in batches:
            if batch.num_rows:
                *x, weight = (c.to_numpy() for c in batch.columns)
                got = run(np.column_stack(x), weight, rng)
                out = got if out is None else {k: np.vstack([out[k], v]) for k, v in got.items()} if isinstance(got, dict) else out + got
        for k, v in (out.items() if isinstance(out, dict) else [(0, out)] if out is not None else []):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], names=["k", "found"])

    return [(r["k"], np.frombuffer(r["found"])) for r in points.mapInArrow(work, "k int, found binary").collect()]


def _sums(points: DataFrame, run) -> np.ndarray:
    return np.sum([found for _, found in _in_tasks(points, run)], axis=0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (x @ centres.T), 0.0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, the first of equally near ones."""
    away = (centres * centres).sum(1)[:, None] - 2 * (centres @ x.T)
    label, least = np.zeros(len(x), np.int64), away[0].copy()
    for i in range(1, len(centres)):
        label[away[i] < least] = i
        np.minimum(least, away[i], out=least)
    return label


def _group_sums(x: np.ndarray, weight: np.ndarray, label: np.ndarray, k: int, *more: np.ndarray) -> np.ndarray:
    """(k, 1 + width + more): weight and weighed sums of the columns per label."""
    return np.stack([np.bincount(label, weight * v, k) for v in (np.ones(len(x)), *x.T, *more)], axis=1)


def _moved(centres: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]:
    """Centres after one round, and whether none moved; a centre without points stays."""
    new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1e-300), centres)
    return new, bool((((new - centres) ** 2).sum(1) <= MOVED ** 2).all())


def _picked(candidates: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the weighed candidates by k-means++, moved by k-means among them."""
    rng, chosen = np.random.default_rng(SEED), []
    share = weight / weight.sum()
    while len(chosen) < k:
        chosen.append(rng.choice(len(candidates), p=share))
        cost = weight * _distances(candidates, candidates[chosen]).min(1)
        cost[chosen] = 0.0
        share = cost / cost.sum() if cost.sum() > 0 else np.full(len(cost), 1 / len(cost))
    centres = candidates[chosen]
    for _ in range(30):
        centres, still = _moved(centres, _group_sums(candidates, weight, _nearest(candidates, centres), k))
        if still:
            break
    return centres


def first_centres(points: DataFrame, ks) -> dict[int, np.ndarray]:
    """Starting centres for every k as k-means|| finds them: rows picked by their share of the cost, weighed by the rows near them."""
    x = points.columns[:-1]
    seed = list(points.select(*x).orderBy(F.xxhash64(*x, F.lit(SEED)), *x).first())
    found = {k: np.array([seed], dtype=float) for k in ks}
    turn, lacking = 0, True
    while turn < PICKS or lacking:
        costs = dict(zip(ks, _sums(points, lambda x, w, rng, found=found: np.array([(w * _distances(x, found[k]).min(1)).sum() for k in ks]))))

        def pick(x, w, rng, found=found, costs=costs):
            out = {}
            for k in ks:
                share = w * _distances(x, found[k]).min(1) * (2 * k / costs[k]) if costs[k] > 0 else np.zeros(len(x))
                out[k] = x[rng.random(len(x)) < share]
            return out

        turn += 1
        new = _in_tasks(points, pick, turn)
        found = {k: np.unique(np.vstack([found[k], *[v.reshape(-1, len(seed)) for at, v in new if at == k]]), axis=0) for k in ks}
        # Too few by chance: another round, unless every row is a centre already.
        lacking = turn < 10 * PICKS and any(len(found[k]) < k and costs[k] > 1e-9 for k in ks)
    near = _sums(points, lambda x, w, rng: np.concatenate([np.bincount(_nearest(x, c), w, len(c)) for c in found.values()]))
    weights = np.split(near, np.cumsum([len(c) for c in found.values()])[:-1])
    return {k: c if len(c) <= k else _picked(c, np.maximum(n, 1e-300), k) for (k, c), n in zip(found.items(), weights)}


def fitted_together(points: DataFrame, ks) -> list:
    """(k, silhouette, model) for every k, fitted on all points (x0, x1 ..., weight) in the same passes."""
    centres, open_ = first_centres(points, ks), list(ks)
    for _ in range(ROUNDS):
        held = {k: centres[k] for k in open_}
        sums = _sums(points, lambda x, w, rng: np.concatenate([_group_sums(x, w, _nearest(x, c), len(c)).ravel() for c in held.values()]))
        for (k, c), part in zip(held.items(), np.split(sums, np.cumsum([c.size + len(c) for c in held.values()])[:-1])):
            centres[k], still = _moved(c, part.reshape(len(c), -1))
            if still:
                open_.remove(k)
        if not open_:
            break
    silhouettes, spark = together_silhouettes(points, centres), points.sparkSession
    out = []
    for k, c in centres.items():
        # Of as many points as clusters, all are taken.
        one = spark.createDataFrame([(Vectors.dense(v),) for v in c], ["features"])
        out.append((k, silhouettes[k], KMeans(k=max(len(c), 2), seed=SEED, initMode="random", maxIter=0, featuresCol="features", predictionCol="cluster").fit(one)))
    return out


def together_silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float | None]:
    """weighed_silhouette for every k."""
    sums = _sums(points, lambda x, w, rng: np.concatenate([_group_sums(x, w, _nearest(x, c), len(c), (x * x).sum(1)).ravel() for c in centres.values()]))
    held = {k: part.reshape(len(c), -1) for (k, c), part in zip(centres.items(), np.split(sums, np.cumsum([c.size + 2 * len(c) for c in centres.values()])[:-1]))}

    def values(x, w, rng):
        total = []
        for k, c in centres.items():
            label, n = _nearest(x, c), np.maximum(held[k][:, 0], 1e-300)
            away = (x * x).sum(1)[:, None] + held[k][:, -1] / n - 2 * (x @ (held[k][:, 1:-1] / n[:, None]).T)
            at = (np.arange(len(x)), label)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = away[at] * np.where(n > 1, n / (n - 1), np.nan)[label]
                away[at] = np.inf
                away[:, held[k][:, 0] <= 0] = np.inf
                other = away.min(1)
                total.append((w * np.where(own < other, 1 - own / other, np.where(own > other, other / own - 1, 0.0))).sum())
        return np.array(total)

    found = _sums(points, values)
    return {k: float(v / held[k][:, 0].sum()) if (held[k][:, 0] > 0).sum() > 1 else None for k, v in zip(centres, found)}


def weighed_silhouette(scored: DataFrame, size: int) -> float:
    """The mean silhouette of the rows that scored(features, cluster, __weight) stands for, by squared distances as in ClusteringEvaluator.

    A row is left out of its own cluster's mean, its equals are not; the evaluator's own weights leave out all of them.
    """
    weight, x = F.col("__weight"), F.col("__x")
    rows = scored.select("cluster", "__weight", vector_to_array("features").alias("__x"))
    rows = rows.withColumn("__q", F.aggregate("__x", F.lit(0.0), lambda total, v: total + v * v))
    sums = rows.groupBy("cluster").agg(F.sum("__weight").alias("w"), F.sum(weight * F.col("__q")).alias("q"), F.array(*[F.sum(weight * x[i]) for i in range(size)]).alias("s")).collect()
    mine = lambda r: F.col("cluster") == r["cluster"]
    away = lambda r: F.col("__q") + r["q"] / r["w"] - 2 * sum(x[i] * (r["s"][i] / r["w"]) for i in range(size))
    own = F.coalesce(*[F.when(mine(r), away(r) * (r["w"] / (r["w"] - 1))) for r in sums if r["w"] > 1])
    other = F.least(*[F.when(~mine(r), away(r)) for r in sums])
    value = F.when(own < other, 1 - own / other).when(own > other, other / own - 1).otherwise(0.0)
    return rows.agg(F.sum(value * weight) / F.sum("__weight")).first()[0]


def pca_2d(labelled: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """(keep..., pc1, pc2); each direction's largest entry is made positive."""
    model = PCA(k=2, inputCol=features, outputCol="__pc").fit(labelled)
    directions = model.pc.toArray()
    signs = [1.0 if directions[abs(directions[:, i]).argmax(), i] > 0 else -1.0 for i in range(directions.shape[1])]
    pc = vector_to_array("__pc")
    return model.transform(labelled).select(*keep, (pc[0] * signs[0]).alias("pc1"), (pc[1] * signs[1]).alias("pc2"))


def pca_variance(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Cumulative explained variance of standardised numbers: (component, share, cumulative); at least three columns."""
    if len(cols) < 3:
        raise ValueError("needs at least three numeric columns")
    shares = PCA(k=len(cols), inputCol="features", outputCol="__pc").fit(scaled_vectors(df, cols, exact)).explainedVariance.toArray()
    rows = [(i + 1, float(s), float(shares[:i + 1].sum())) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def cluster_sizes(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(cluster).agg(F.count("*").alias("n"))


def cluster_density(labelled: DataFrame, c: str, cluster: str = "cluster", bins: int = 30) -> DataFrame:
    """Share of a cluster's values per bin, bins common to all clusters: (cluster, x_num, y)."""
    counts = histogram(labelled, c, bins, by=[cluster])
    totals = labelled.filter(F.col(c).isNotNull()).groupBy(F.col(cluster).alias("__c")).agg(F.count("*").alias("__n"))
    both = counts.join(totals, counts[cluster].eqNullSafe(totals["__c"]))
    return both.select(cluster, F.col("mid").alias("x_num"), (F.col("n") / F.col("__n")).alias("y"))
