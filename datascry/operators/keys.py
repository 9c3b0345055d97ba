"""Joins of a frame with a table derived from it, on grouping keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Left's columns and right's other columns, joined on `keys`; null keys match each other."""
    hidden = {k: f"__on_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(k).alias(h) for k, h in hidden.items()], *[F.col(c).alias(c) for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[h]) for k, h in hidden.items()])
    return left.join(renamed, on, how).drop(*hidden.values())


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash partitioning by `keys` in a fixed number of partitions.

    Groups that are costly in Python are small in bytes; left to itself, adaptive execution packs them into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
