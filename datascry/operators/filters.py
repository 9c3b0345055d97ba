"""Projections, row filters and small predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.scalars import TEMPORAL, to_numeric


def drop_column(df: DataFrame, c: str) -> DataFrame:
    return df.drop(c)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def exclude_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def exclude_categories(df: DataFrame, c: str, values: list[str]) -> DataFrame:
    """Drop rows whose value, as text, is listed; nulls stay."""
    return df.filter(~F.coalesce(F.col(c).cast("string").isin(list(values)), F.lit(False)))


def _as_number(df: DataFrame, c: str) -> Column:
    """Bare column where it is numeric already, so the comparison reaches the scan."""
    return to_numeric(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)


def remove_less_than(df: DataFrame, c: str, v: float) -> DataFrame:
    return df.filter(_as_number(df, c) >= v)


def remove_greater_than(df: DataFrame, c: str, v: float) -> DataFrame:
    return df.filter(_as_number(df, c) <= v)


def remove_equals(df: DataFrame, c: str, v: float) -> DataFrame:
    """Drop rows equal to v; nulls stay."""
    return df.filter(~_as_number(df, c).eqNullSafe(F.lit(v)))


def remove_contains(df: DataFrame, c: str, text: str, regex: bool = False) -> DataFrame:
    """Drop rows whose text contains the pattern, ignoring case; nulls stay."""
    value = F.col(c).cast("string")
    hit = value.rlike(f"(?i){text}") if regex else F.lower(value).contains(text.lower())
    return df.filter(~F.coalesce(hit, F.lit(False)))


def time_range(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= ts <= end; both bounds optional, unparsable times dropped."""
    dtype = df.schema[ts].dataType
    stamp = F.col(ts) if isinstance(dtype, TEMPORAL) else F.try_to_timestamp(F.col(ts))
    kind = dtype.simpleString() if isinstance(dtype, TEMPORAL) else "timestamp"
    out = df.filter(stamp.isNotNull())
    if start is not None:
        out = out.filter(stamp >= F.lit(start).cast(kind))
    if end is not None:
        out = out.filter(stamp <= F.lit(end).cast(kind))
    return out


def year_filter(df: DataFrame, ts: str, y: int) -> DataFrame:
    """One calendar year, as a half-open range on the bare column."""
    kind = df.schema[ts].dataType.simpleString()
    return df.filter((F.col(ts) >= F.lit(f"{y}-01-01").cast(kind)) & (F.col(ts) < F.lit(f"{y + 1}-01-01").cast(kind)))


def series_filter(points: DataFrame, names: list[str], c: str = "series") -> DataFrame:
    return points.filter(F.col(c).isin(list(names)) | F.col(c).isNull())


def search_any_column(df: DataFrame, q: str) -> DataFrame:
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(q.lower()), F.lit(False)) for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def drill_through(df: DataFrame, c: str, x_val: str | None = None, x_num: float | None = None,
                  points: DataFrame | None = None) -> DataFrame:
    """Rows behind one chart point.

    A label 'low-high' selects the closed range, another label the equal category (trimmed, any case).
    A number selects values within half of the smallest gap between the chart's distinct x positions.
    """
    if x_val is not None:
        parts = x_val.split("-")
        try:
            low, high = (float(p) for p in parts)
        except ValueError:
            return df.filter(F.lower(F.trim(F.col(c).cast("string"))) == x_val.strip().lower())
        return df.filter(_as_number(df, c).between(low, high))
    if x_num is None:
        return df
    from datascry.operators.ordered import Sequence

    xs = points.select(F.col("x_num").cast("double").alias("x_num")).filter("x_num is not null").distinct()
    gaps = Sequence(xs, [], ["x_num"]).apply({"gap": lambda w, rn: F.lead("x_num").over(w) - F.col("x_num")}, after=1)
    half = gaps.agg((F.min("gap") / 2).alias("half")).first()["half"] or 1e-5
    return df.filter(_as_number(df, c).between(x_num - half, x_num + half))


def drop_null_target(df: DataFrame, t: str) -> DataFrame:
    return df.na.drop(subset=[t])


# Name parts that mark a column of many distinct strings as a key instead of text.
KEY_LIKE = ("id", "uuid", "key", "index", "code", "url", "link")


def feature_roles(df: DataFrame, profile: DataFrame, t: str | None) -> dict[str, str]:
    """Role of each feature column: numeric, categorical, text or drop. The profile has one row per column."""
    rows = {r["column"]: r for r in profile.collect()}
    roles = {}
    for c in df.columns:
        if c == t or c not in rows:
            continue
        r = rows[c]
        if r["nunique"] == 0 or r["type"] == "identifier":
            roles[c] = "drop"
        elif r["type"] == "numeric":
            roles[c] = "numeric"
        elif r["type"] == "datetime":
            roles[c] = "datetime"
        elif r["nunique"] > 100:
            roles[c] = "drop" if any(k in c.lower() for k in KEY_LIKE) else "text"
        else:
            roles[c] = "categorical"
    return roles


def drop_unusable_features(df: DataFrame, profile: DataFrame, t: str | None = None) -> DataFrame:
    """Without all-null columns, identifiers and key-like columns of more than 100 distinct strings."""
    roles = feature_roles(df, profile, t)
    return df.select([c for c in df.columns if roles.get(c) != "drop"])


def align_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named columns in that order; missing ones are 0.0."""
    return df.select([F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in names])


# Replacements in feature names.
NAME_REPLACEMENTS = {"[": "_", "]": "_", "<": "lt_", ">": "gt_"}


def sanitize_names(df: DataFrame) -> DataFrame:
    def clean(name):
        for old, new in NAME_REPLACEMENTS.items():
            name = name.replace(old, new)
        return name

    return df.toDF(*[clean(c) for c in df.columns])


def stratify_check(df: DataFrame, t: str) -> DataFrame:
    """One row: number of classes, smallest class, and whether every class has at least two rows."""
    counts = df.filter(F.col(t).isNotNull()).groupBy(t).count()
    return counts.agg(
        F.count("*").alias("classes"),
        F.min("count").alias("smallest"),
        F.coalesce((F.min("count") >= 2) & (F.count("*") > 1), F.lit(False)).alias("eligible"),
    )


def stratify_eligible(df: DataFrame, t: str) -> bool:
    return bool(stratify_check(df, t).first()["eligible"])
