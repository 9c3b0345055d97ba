"""Isolation forest over one numeric column.

With one column a tree is a row of cuts, so a forest of any number of trees is one step function. Growing it needs
only the small samples the method prescribes; scoring is a binary search per value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.operators.quantiles import quantiles

# Fixed values of the method: trees, rows per tree, share of outliers.
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.05
EULER = 0.5772156649015329


def expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow(values: np.ndarray, rng: np.random.Generator, depth: int, max_depth: int, cuts: list, depths: list) -> None:
    """Random cuts of sorted values, appended from left to right; depths holds one entry per leaf."""
    if depth >= max_depth or len(values) < 2 or values[0] == values[-1]:
        depths.append(depth + expected_depth(len(values)))
        return
    cut = rng.uniform(values[0], values[-1])
    at = np.searchsorted(values, cut, side="right")
    if at == len(values):
        cut, at = values[0], np.searchsorted(values, values[0], side="right")
    grow(values[:at], rng, depth + 1, max_depth, cuts, depths)
    cuts.append(float(cut))
    grow(values[at:], rng, depth + 1, max_depth, cuts, depths)


class IsolationForest:
    """`cuts` and `scores` of the step function (one score more than cuts), and the score limit."""

    def __init__(self, cuts: list[float], scores: list[float], limit: float, median: float):
        self.cuts, self.scores, self.limit, self.median = cuts, scores, limit, median

    @staticmethod
    def fit(df: DataFrame, c: str, median: float, seed: int = 42) -> IsolationForest:
        values = df.select(F.coalesce(F.col(c).cast("double"), F.lit(median)).alias("x"))
        rows = values.count()
        wanted = TREES * TREE_ROWS
        drawn = values if rows <= wanted else values.sample(fraction=min(1.0, 1.2 * wanted / rows), seed=seed).limit(2 * wanted)
        pool = np.sort(drawn.toPandas()["x"].to_numpy(dtype=float))
        rng = np.random.default_rng(seed)
        size = min(TREE_ROWS, len(pool))
        max_depth = math.ceil(math.log2(max(size, 2)))
        trees = []
        for _ in range(TREES):
            cuts, depths = [], []
            grow(np.sort(rng.choice(pool, size, replace=False)), rng, 0, max_depth, cuts, depths)
            trees.append((np.array(cuts), np.array(depths)))
        edges = np.unique(np.concatenate([t for t, _ in trees])) if trees else np.array([])
        # A value x lies right of every cut below it; the mean depth is constant between neighbouring cuts.
        inside = np.concatenate([edges, [np.inf]])
        total = sum(d[np.searchsorted(t, inside, side="left")] for t, d in trees)
        scores = 2.0 ** (-(total / TREES) / max(expected_depth(size), 1e-12))
        forest = IsolationForest(edges.tolist(), scores.tolist(), 1.0, median)
        scored = values.select(forest.score(F.col("x")).alias("s"))
        forest.limit = quantiles(scored, ["s"], [1 - CONTAMINATION]).first()["q"][0]
        return forest

    def score(self, c: Column) -> Column:
        cuts, scores, median = np.array(self.cuts), np.array(self.scores), self.median

        @F.pandas_udf("double")
        def anomaly(x: pd.Series) -> pd.Series:
            return pd.Series(scores[np.searchsorted(cuts, x.fillna(median).to_numpy(dtype=float), side="left")])

        return anomaly(c.cast("double"))

    def keep(self, df: DataFrame, c: str) -> DataFrame:
        return df.filter(self.score(F.col(c)) <= self.limit)
