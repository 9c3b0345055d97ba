"""Fitted scalings and encodings: statistics become literals or small tables, application stays narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.functions.scalars import hash_bucket
from datascry.operators.keys import attach
from datascry.operators.ordered import Sequence
from datascry.operators.quantiles import quantiles

# Categories one-hot encoding may turn into columns.
MAX_LEVELS = 1000


def _quantile_map(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> dict[str, list[float]]:
    return {r["column"]: r["q"] for r in quantiles(df, cols, probs, exact=exact).collect()}


def robust_scale(df: DataFrame, cols: list[str], train: DataFrame | None = None, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(x - q_low) / (q_high - q_low) for columns whose quantiles differ."""
    q = _quantile_map(train or df, cols, [low, high])
    scaled = {}
    for c in cols:
        lo, hi = q[c] if q[c] and q[c][0] is not None else (0.0, 0.0)
        if hi > lo:
            scaled[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumns(scaled) if scaled else df


def minmax_scale(df: DataFrame, cols: list[str], train: DataFrame | None = None) -> DataFrame:
    """To [0, 1] by the training rows' extremes; a constant column becomes 0."""
    fit = (train or df).agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    scaled = {}
    for c in cols:
        lo, hi = float(fit[f"lo_{c}"]), float(fit[f"hi_{c}"])
        scaled[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0)
    return df.withColumns(scaled)


def standard_scale(df: DataFrame, cols: list[str], train: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Median imputation, then z-scores with the population deviation of the imputed training rows."""
    return df.withColumns(standard_scores(train or df, cols, exact))


def standard_scores(base: DataFrame, cols: list[str], exact: bool = True) -> dict[str, Column]:
    """{column: its imputed z-score} as learnt from `base`."""
    medians = {c: q[0] for c, q in _quantile_map(base, cols, [0.5], exact).items()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in cols}
    fit = base.agg(*[F.avg(filled[c]).alias(f"m_{c}") for c in cols], *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in cols]).first()
    return {c: (filled[c] - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0) for c in cols}


def label_codes(df: DataFrame, c: str) -> DataFrame:
    """Code per class, classes in text order: (label, code). Classes are numbered through ranges of the whole text, however many there are."""
    labels = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("label")).distinct()
    coded = Sequence(labels, [], ["label"], limit=0).numbered("code")
    return coded.withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, c: str, codes: DataFrame | None = None, out: str | None = None) -> DataFrame:
    codes = codes if codes is not None else label_codes(df, c)
    named = codes.select(F.col("label").alias("__label"), F.col("code").alias(out or f"{c}_code"))
    return df.join(named, F.col(c).cast("string") == F.col("__label"), "left").drop("__label")


def label_decode(df: DataFrame, code: str, codes: DataFrame, out: str) -> DataFrame:
    named = codes.select(F.col("code").alias("__code"), F.col("label").alias(out))
    return df.join(named, F.col(code) == F.col("__code"), "left").drop("__code")


def one_hot(df: DataFrame, c: str, train: DataFrame | None = None) -> DataFrame:
    """0/1 column per training category; null counts as the most frequent one, an unknown value sets none."""
    base = train or df
    counts = base.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    rows = counts.orderBy(F.desc("n"), c).limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{c} has more than {MAX_LEVELS} categories; encode it by target means instead")
    filled = F.coalesce(F.col(c), F.lit(rows[0][0])) if rows else F.col(c)
    hits = {f"{c}_{r[0]}": F.coalesce((filled == F.lit(r[0])).cast("int"), F.lit(0)) for r in sorted(rows, key=lambda r: str(r[0]))}
    return df.withColumns(hits)


def multilabel_binarize(df: DataFrame, tags: str, known: list[str] | None = None, prefix: str = "tag_") -> DataFrame:
    """0/1 column per tag, in tag order."""
    if known is None:
        found = df.select(F.explode(tags).alias("t")).distinct().orderBy("t").limit(MAX_LEVELS + 1).collect()
        if len(found) > MAX_LEVELS:
            raise ValueError(f"{tags} holds more than {MAX_LEVELS} tags")
        known = [r["t"] for r in found]
    return df.withColumns({f"{prefix}{k}": F.array_contains(tags, k).cast("int") for k in sorted(known)})


def target_table(df: DataFrame, c: str, t: str | Column, smooth: float) -> tuple[DataFrame, float]:
    """Smoothed target mean per category over all given rows, and the overall mean for unseen categories."""
    y = (F.col(t) if isinstance(t, str) else t).cast("double")
    rows = df.select(F.col(c).alias("category"), y.alias("y")).filter("y is not null")
    mean = rows.agg(F.avg("y")).first()[0]
    sums = rows.groupBy("category").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    return sums.select("category", ((F.col("s") + smooth * F.lit(mean)) / (F.col("n") + smooth)).alias("encoded")), mean


def target_encode(df: DataFrame, c: str, t: str, key, folds: int = 5, smooth: float = 10.0, out: str | None = None) -> DataFrame:
    """Out-of-fold target mean: a row's own fold never enters its code.

    Sums per (category, fold) are formed before any shuffle of rows; a fold's code is total minus fold.
    """
    fold = (hash_bucket(key, folds)).cast("int")
    rows = df.withColumn("__fold", fold)
    y = F.col(t).cast("double")
    sums = rows.filter(F.col(t).isNotNull()).groupBy(F.col(c).alias("__cat"), F.col("__fold").alias("__f")).agg(
        F.sum(y).alias("s"), F.count("*").alias("n"))
    per_fold = {r["f"]: (r["s"], r["n"]) for r in sums.groupBy(F.col("__f").alias("f")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    all_s, all_n = sum(s for s, _ in per_fold.values()), sum(n for _, n in per_fold.values())
    mean_of = F.lit(all_s / all_n if all_n else 0.0)
    for f, (s, n) in per_fold.items():
        rest = (all_s - s) / (all_n - n) if all_n > n else all_s / all_n
        mean_of = F.when(F.col("__fold") == f, F.lit(rest)).otherwise(mean_of)
    # Every category meets every fold, so a fold without rows of a category still gets the other folds' sum.
    totals = sums.groupBy("__cat").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"),
                                       F.map_from_entries(F.collect_list(F.struct("__f", F.struct("s", "n")))).alias("own"))
    joined = attach(rows, totals.withColumnRenamed("__cat", c), [c])
    own = F.try_element_at(F.col("own"), F.col("__fold"))
    s = F.coalesce(F.col("ts"), F.lit(0.0)) - F.coalesce(own["s"], F.lit(0.0))
    n = F.coalesce(F.col("tn"), F.lit(0)) - F.coalesce(own["n"], F.lit(0))
    code = (s + smooth * mean_of) / (n + smooth)
    return joined.select(*df.columns, code.alias(out or f"{c}_target"))
